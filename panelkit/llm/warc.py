"""WARC archives compressed with a Zstandard dictionary, after the public ``.warc.zst`` layout.

An archive starts with a skippable frame that holds the dictionary; every record follows as a frame of
its own, compressed with it. So an archive needs nothing but itself to be read.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelkit.session import keep, new_path, remove_at_end

# The magic number of the dictionary's skippable frame, and the profile of revisits.
DICTIONARY_MAGIC = 0x184D2A5D
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

# Payloads below this many bytes are always stored.
MIN_REVISIT_BYTES = 100
# An archive is closed when its records reach this size, so a reader can hold one whole.
ARCHIVE_BYTES = 16 << 20
# The dictionary and the records it is trained on: the first ones of its archive, up to these bytes.
DICTIONARY_BYTES, SAMPLE_BYTES = 64 << 10, 4 << 20
# Bytes given to the decompressor at a time, as it copies what lies behind a record's end.
STEP_BYTES = 16 << 10

_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def mark_revisits(pages: DataFrame, key: str, html: str, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Add ``_digest`` and ``_first``: the smallest key with an equal payload, for payloads worth a revisit.

    Digests are counted with map-side combining, and only digests that occur more than once are joined
    back, so a payload that a third of the pages share costs one row per task.
    """
    body = F.coalesce(F.col(html), F.lit(""))
    rows = pages.withColumn("_digest", F.sha2(body, 256))
    large = F.octet_length(body) >= min_bytes
    seen = rows.where(large).groupBy("_digest").agg(F.min(key).alias("_first"), F.count(F.lit(1)).alias("_n"))
    return rows.join(seen.where("_n > 1").drop("_n"), "_digest", "left")


def _record(key, url: str | None, html: str | None, digest: str, first) -> bytes:
    payload = (html or "").encode()
    revisit = first is not None and key != first
    body = _HTTP if revisit else _HTTP + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if key is None else key}>",
        f"WARC-Target-URI: {(url or '').translate({13: '%0D', 10: '%0A'})}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Payload-Length: {len(payload)}",
    ]
    if revisit:
        head += [f"WARC-Refers-To: <urn:page:{first}>", f"WARC-Profile: {REVISIT_PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join([*head, "", ""]).encode() + body + b"\r\n\r\n"


def train_dictionary(records: list[bytes]) -> bytes:
    """A dictionary from records; too few to train on serve as the dictionary themselves."""
    sample, size = [], 0
    for r in records:
        if size >= SAMPLE_BYTES:
            break
        sample.append(r[: 128 << 10])
        size += len(sample[-1])
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, max(1024, size // 8)), sample).as_bytes()
    except zstandard.ZstdError:
        return b"".join(sample)[:DICTIONARY_BYTES]


def archive_bytes(records: list[bytes]) -> bytes:
    """An archive of the records."""
    dictionary = train_dictionary(records)
    packer = zstandard.ZstdCompressor(
        level=3, dict_data=zstandard.ZstdCompressionDict(dictionary), write_content_size=True, write_checksum=True
    )
    frames = [packer.compress(r) for r in records]
    return struct.pack("<II", DICTIONARY_MAGIC, len(dictionary)) + dictionary + b"".join(frames)


def read_archive(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and payload of each record of an archive."""
    magic, size = struct.unpack_from("<II", data)
    if magic != DICTIONARY_MAGIC:
        raise ValueError("no dictionary frame")
    unpacker = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[8 : 8 + size]))
    at = 8 + size
    while at < len(data):
        frame, parts = unpacker.decompressobj(), []
        while not frame.eof:
            piece = data[at : at + STEP_BYTES]
            if not piece:
                raise ValueError("archive ends inside a record")
            parts.append(frame.decompress(piece))
            at += len(piece) - len(frame.unused_data)
        record = b"".join(parts)
        head, _, body = record.partition(b"\r\n\r\n")
        headers = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
        content = body[: int(headers["Content-Length"])]
        yield headers, content.partition(b"\r\n\r\n")[2]


def write_archives(
    pages: DataFrame, path: str, key: str = "page_id", url: str = "url", html: str = "html"
) -> DataFrame:
    """Write a WARC record per page below ``path``; returns ``file, records, bytes`` of each archive.

    Of the records with equal payloads (HTML in UTF-8, NULL counts as empty) of at least 100 bytes, the
    one with the smallest key is a response with the payload and the others are revisits that refer to
    it. Smaller payloads are all responses. Rows that tie for the smallest key are all responses; a
    group whose keys are all NULL too. Every task trains a dictionary per archive on the archive's own
    first records (at most 4 MB of them). A file is written under a name of its task and attempt, so a
    task that runs again does no harm; only archives in the returned list belong to the result.
    """
    marked = mark_revisits(pages.select(F.col(key).alias("_k"), F.col(url).alias("_u"), F.col(html).alias("_h")), "_k", "_h")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = fs.FileSystem.from_uri(path)
        store.create_dir(folder, recursive=True)
        task = TaskContext.get()
        name = f"part-{task.partitionId():05d}-{task.taskAttemptId()}"
        records: list[bytes] = []
        done: dict[str, list] = {"file": [], "records": [], "bytes": []}

        def close() -> None:
            data = archive_bytes(records)
            file = f"{name}-{len(done['file']):04d}.warc.zst"
            with store.open_output_stream(f"{folder}/{file}", compression=None) as out:
                out.write(data)
            for column, v in zip(done.values(), (file, len(records), len(data)), strict=True):
                column.append(v)
            records.clear()

        size = 0
        for batch in batches:
            for row in zip(*(batch.column(c) for c in ("_k", "_u", "_h", "_digest", "_first")), strict=True):
                records.append(_record(*(v.as_py() for v in row)))
                size += len(records[-1])
                if size >= ARCHIVE_BYTES:
                    close()
                    size = 0
        if records:
            close()
        kinds = pa.schema([("file", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())])
        yield pa.RecordBatch.from_pydict(done, kinds)

    rows = marked.select("_k", "_u", "_h", "_digest", "_first")
    return keep(rows.mapInArrow(write, "file string, records bigint, bytes bigint"))


def read_archives(path: str, archives: DataFrame) -> DataFrame:
    """Records of the listed archives below ``path``, read and checked frame by frame.

    ``record_id, url, record_type, refers_to, payload_bytes, payload_digest, payload``; a revisit has no
    payload of its own, its length and digest are those of the payload it refers to. A response whose
    payload does not have the stated digest raises an error. Each archive is opened in the folder's own
    file system by the task that gets its row.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(
            [
                ("record_id", pa.string()),
                ("url", pa.string()),
                ("record_type", pa.string()),
                ("refers_to", pa.string()),
                ("payload_bytes", pa.int64()),
                ("payload_digest", pa.string()),
                ("payload", pa.binary()),
            ]
        )

        def row(headers: dict[str, str], payload: bytes) -> dict:
            digest = headers["WARC-Payload-Digest"].removeprefix("sha256:")
            response = headers["WARC-Type"] == "response"
            if response and hashlib.sha256(payload).hexdigest() != digest:
                raise ValueError(f"damaged record {headers['WARC-Record-ID']}")
            refers = headers.get("WARC-Refers-To")
            return {
                "record_id": headers["WARC-Record-ID"][1:-1].removeprefix("urn:page:"),
                "url": headers["WARC-Target-URI"],
                "record_type": headers["WARC-Type"],
                "refers_to": refers and refers[1:-1].removeprefix("urn:page:"),
                "payload_bytes": len(payload) if response else int(headers["WARC-Payload-Length"]),
                "payload_digest": digest,
                "payload": payload if response else None,
            }

        store, folder = fs.FileSystem.from_uri(path)
        for batch in batches:
            for file in batch.column(0).to_pylist():
                with store.open_input_file(f"{folder}/{file}") as f:
                    data = f.read()
                rows = []
                for record in read_archive(data):
                    rows.append(row(*record))
                    if len(rows) == 256:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows = []
                yield pa.RecordBatch.from_pylist(rows, schema)

    # adaptive execution would merge so small a table into one task; a stated number stays
    return archives.select("file").repartition(max(archives.count(), 1), "file").mapInArrow(
        read,
        "record_id string, url string, record_type string, refers_to string, payload_bytes bigint, "
        "payload_digest string, payload binary",
    )


def archive_pages(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", path: str | None = None) -> DataFrame:
    """Write the pages' archives to ``path``, by default in the work folder, and read them back."""
    spark = pages.sparkSession
    own = path is None
    path = path or new_path(spark, "warc")
    archives = write_archives(pages, path, key, url, html)
    if own:
        remove_at_end(spark, path)
    return read_archives(path, archives)
