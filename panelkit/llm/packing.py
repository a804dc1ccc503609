"""Best-fit packing of documents into sequences, in bulk-synchronous sweeps."""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelkit.llm.prefix import running_totals
from panelkit.llm.tokens import word_tokenizer
from panelkit.session import discard, keep

CAPACITY = 4096
# Text given to the tokenizer at a time.
BATCH_BYTES = 1 << 20


def token_pieces(
    docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = 1,
    key: str = "doc_id", text: str = "text", with_ids: bool = False,
) -> DataFrame:
    """Pieces of the documents' token ids: ``key, piece, start, length, ids_crc32, _pid`` (and ``ids``).

    A document's ids are those of its text followed by ``end``; a NULL text counts as empty. Documents
    of more than ``capacity`` ids are cut into pieces of that many, the last may be shorter. ``_pid``
    numbers the pieces; it holds for a stored table only.
    """
    kind = docs.select(key).schema[0].dataType.simpleString()
    stop = end.to_bytes(4, "little")
    fields = [("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("_pid", pa.int64())]
    names = ["_id", *[n for n, _ in fields], *["ids"] * with_ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_tokenizer(tokenizer)
        pid = TaskContext.get().partitionId() << 33

        def cut(keys: pa.Array, texts: list[bytes]) -> pa.RecordBatch:
            nonlocal pid
            rows: list[tuple] = []
            at: list[int] = []
            for d, ids in enumerate(words.encode(texts)):
                ids += stop
                for p, a in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[a : a + 4 * capacity]
                    rows.append((p, a // 4, len(part) // 4, zlib.crc32(part), pid, part))
                    at.append(d)
                    pid += 1
            values = list(zip(*rows, strict=True))
            columns = [keys.take(pa.array(at)), *[pa.array(v, t) for v, (_, t) in zip(values, fields, strict=False)]]
            if with_ids:
                columns.append(pa.array([memoryview(v).cast("I").tolist() for v in values[-1]], pa.list_(pa.int64())))
            return pa.RecordBatch.from_arrays(columns, names=names)

        for batch in batches:
            first, size, texts = 0, 0, []
            for i, value in enumerate(batch.column(1)):
                texts.append((value.as_py() or "").encode())
                size += len(texts[-1])
                if size >= BATCH_BYTES or i + 1 == batch.num_rows:
                    yield cut(batch.column(0).slice(first, len(texts)), texts)
                    first, size, texts = i + 1, 0, []

    schema = f"_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, _pid bigint"
    schema += ", ids array<bigint>" * with_ids
    pieces = docs.select(F.col(key).alias("_id"), F.col(text).alias("_text")).mapInArrow(run, schema)
    return pieces.withColumnRenamed("_id", key)


def _bands(capacity: int) -> list[tuple[int, int]]:
    """Ranges of lengths ``(above, up to]``, each half of the one before; the last goes down to 0."""
    out, hi = [], capacity - 1
    while hi > 0:
        lo = hi // 2 if hi > 64 else 0
        out.append((lo, hi))
        hi = lo
    return out


def _sweep(docs: DataFrame, bins: DataFrame, top: int, slots: int) -> DataFrame:
    """Match documents with gaps: ``_pid, length, bin``, where ``bin`` is NULL if there was none.

    Gaps and documents are sorted by size, larger ones first, and each document takes the last gap that
    came before it and is still free: its successor in size. Where several documents want the same gap,
    their rank decides: counting gaps as +1 and documents as -1, the running total gives each a level,
    and inside a level gaps and documents take turns, so the partner is the row before. A level holds
    two rows for each size at most. A gap that holds several documents of this range whatever their
    length offers several places, which only documents without a tighter gap take.
    """
    places = F.greatest(F.lit(1), F.least(F.floor(F.col("gap") / top).cast("int"), F.lit(slots)))
    gaps = bins.select(
        (-F.least(F.col("gap"), F.lit(top))).alias("_size"),
        F.lit(0).alias("_kind"),
        (-F.col("gap")).alias("_tight"),
        F.col("bin").alias("_own"),
        F.explode(F.sequence(F.lit(1), places)).alias("_place"),
        F.lit(1).alias("_step"),
    )
    wants = docs.select(
        (-F.col("length")).alias("_size"),
        F.lit(1).alias("_kind"),
        F.lit(0).cast("bigint").alias("_tight"),
        F.col("_pid").alias("_own"),
        F.lit(1).alias("_place"),
        F.lit(-1).alias("_step"),
    )
    order = ["_size", "_kind", "_tight", "_own", "_place"]
    line = running_totals(gaps.unionByName(wants), [], order, "_step", "_before")
    level = F.col("_before") + F.when(F.col("_kind") == 0, 1).otherwise(0)
    turn = Window.partitionBy("_level").orderBy(*order)
    seen = line.withColumn("_level", level).select(
        "*", F.lag("_kind").over(turn).alias("_last"), F.lag("_own").over(turn).alias("_gap")
    )
    partner = F.when(F.col("_last") == 0, F.col("_gap"))
    return seen.where("_kind = 1").select(
        F.col("_own").alias("_pid"), (-F.col("_size")).alias("length"), partner.alias("bin")
    )


def best_fit(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Place pieces (``_pid, length``) in bins of ``capacity``: ``_pid, length, bin``.

    Lengths are worked off in ranges from long to short. In a range, sweeps match documents with the
    gaps of open bins and gaps shrink, until no document fits any. The others open new bins: those of
    which a bin holds exactly ``k`` are put in order of length and every ``k`` neighbours share one
    (:func:`_open`).
    Every step sorts, counts or joins tables of piece numbers, so a length that a third of the pieces
    have spreads over many tasks.
    """
    placed = [pieces.where(F.col("length") >= capacity).select("_pid", "length", (-1 - F.col("_pid")).alias("bin"))]
    bins: DataFrame | None = None
    for number, (lo, hi) in enumerate(_bands(capacity), 1):
        docs = pieces.where((F.col("length") > lo) & (F.col("length") <= hi)).select("_pid", "length")
        first = True
        while True:
            waiting = docs.agg(F.count(F.lit(1)).alias("n"), F.min("length").alias("least")).first()
            if not waiting["n"] or bins is None:
                break
            # a document without a partner found all larger gaps taken, so only those can hold it now
            room = bins.where((F.col("gap") >= waiting["least"]) & (F.lit(first) | F.col("taken")))
            first = False
            n = room.count()
            if not n:
                break
            matched = keep(_sweep(docs, room, hi, 2 * -(-waiting["n"] // n)))
            hits = matched.where("bin IS NOT NULL")
            placed.append(hits)
            taken = hits.groupBy("bin").agg(F.sum("length").alias("_sum"))
            bins, old = keep(_shrink(bins, taken)), bins
            discard(old)
            docs = matched.where("bin IS NULL").select("_pid", "length")
        if waiting["n"]:
            each = docs.withColumn("_k", F.floor(F.lit(capacity) / F.col("length"))).withColumn("_one", F.lit(1))
            opened = keep(_open(each, number, capacity))
            placed.append(opened)
            new = opened.groupBy("bin").agg((F.lit(capacity) - F.sum("length")).cast("bigint").alias("gap"))
            new = new.where("gap > 0").withColumn("taken", F.lit(False))
            bins = keep(new if bins is None else bins.unionByName(new))
    out = placed[0]
    for more in placed[1:]:
        out = out.unionByName(more)
    return out


def _open(each: DataFrame, number: int, capacity: int) -> DataFrame:
    """New bins: ``k`` neighbours share one; what is left over in all classes is packed in one task.

    Less than a bin's content is left over in each class, so that task's input is bounded by the number
    of classes, however many documents there are.
    """
    ranked = running_totals(each, ["_k"], [F.desc("length"), "_pid"], "_one", "_rank")
    counts = each.groupBy("_k").agg(F.count(F.lit(1)).alias("_n"))
    ranked = ranked.join(F.broadcast(counts), "_k")
    bin_id = (F.lit(number) * 8192 + F.col("_k")) * F.lit(1 << 42) + F.floor(F.col("_rank") / F.col("_k"))
    full = F.col("_rank") < F.col("_n") - F.col("_n") % F.col("_k")
    first = (number * 8192 + 8191) << 42

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "_pid"], ascending=[False, True])
        gaps: list[tuple[int, int]] = []
        chosen = []
        for length in rows["length"].tolist():
            at = bisect_left(gaps, (length, 0))
            gap, own = gaps.pop(at) if at < len(gaps) else (capacity, first + len(chosen))
            insort(gaps, (gap - length, own))
            chosen.append(own)
        return rows.assign(bin=chosen)[["_pid", "length", "bin"]]

    rest = ranked.where(~full).select("_pid", "length", F.lit(0).alias("_all"))
    rest = rest.groupBy("_all").applyInPandas(pack, "_pid bigint, length bigint, bin bigint")
    return ranked.where(full).select("_pid", "length", bin_id.cast("bigint").alias("bin")).unionByName(rest)


def _shrink(bins: DataFrame, taken: DataFrame) -> DataFrame:
    left = F.col("gap") - F.coalesce(F.col("_sum"), F.lit(0))
    joined = bins.join(taken, "bin", "left")
    return joined.select("bin", left.alias("gap"), F.col("_sum").isNotNull().alias("taken")).where("gap > 0")


def pack_documents(
    docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = 1,
    key: str = "doc_id", text: str = "text", with_ids: bool = False,
) -> DataFrame:
    """Pack whole documents into few sequences of at most ``capacity`` tokens, one row per piece.

    ``key, piece, start, length, ids_crc32, sequence_id, offset`` (and ``ids``): the pieces of
    :func:`token_pieces` with their sequence and place in it, gapless from 0. A NULL or empty text is a
    document of one token, rows that repeat a key are documents of their own, NULL keys are kept, other
    columns are ignored, and an empty table gives an empty result.
    """
    pieces = keep(token_pieces(docs, tokenizer, capacity, end, key, text, with_ids))
    placed = best_fit(pieces, capacity).select(F.col("_pid").alias("_p"), F.col("bin").alias("sequence_id"))
    joined = pieces.join(placed, F.col("_pid") == F.col("_p"))
    before = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "_pid").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("length").over(before), F.lit(0)).cast("bigint")
    return joined.withColumn("offset", offset).drop("_pid", "_p")
