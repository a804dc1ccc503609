"""Whole numbers packed into bytes, and how often hashes occur over all blocks of a table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

# Parts that hashes are dealt to, at least; with more blocks there are more.
PARTS = 256


def pack(values: np.ndarray) -> bytes:
    """Little-endian unsigned numbers, bytes of equal place together, compressed."""
    width = values.dtype.itemsize
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(-1, width).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(data: bytes, kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(width, -1)
    return np.ascontiguousarray(planes.T).view(kind).reshape(-1)


def occurrences(blocks: DataFrame, n_blocks: int) -> DataFrame:
    """``_block, _part, _counts`` for rows ``_block, _hashes``: how often each hash stands in all blocks.

    ``_hashes`` are packed, sorted 64-bit hashes. A block's hashes are cut into parts of their range, the
    same part of all blocks meets in one group, and the block gets back one number for each of its own, in
    order. Hashes are spread evenly, so parts are; their number follows that of the blocks.
    """
    parts = max(PARTS, n_blocks // 2)
    edges = np.array([-(-(p << 64) // parts) for p in range(1, parts)], np.uint64)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, hashes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                hashes = unpack(hashes, "<u8")
                found = np.split(hashes, np.searchsorted(hashes, edges))
                part = [p for p, some in enumerate(found) if len(some)]
                columns = [pa.array(np.full(len(part), number)), pa.array(part, pa.int64()), pa.array([pack(found[p]) for p in part], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["_block", "_part", "_hashes"])

    def count(table: pa.Table) -> pa.Table:
        hashes = [unpack(h, "<u8") for h in table.column("_hashes").to_pylist()]
        _, at, n = np.unique(np.concatenate(hashes), return_inverse=True, return_counts=True)
        counts = np.split(np.minimum(n, (1 << 32) - 1).astype("<u4")[at], np.cumsum([len(h) for h in hashes])[:-1])
        return pa.table([table.column("_block"), table.column("_part"), pa.array([pack(c) for c in counts], pa.binary())], names=["_block", "_part", "_counts"])

    sent = blocks.select("_block", "_hashes").mapInArrow(cut, "_block bigint, _part bigint, _hashes binary")
    sent = sent.repartition(max(parts // 8, 1), "_part")
    return sent.groupBy("_part").applyInArrow(count, "_block bigint, _part bigint, _counts binary")


def in_order(answers: pa.Table) -> np.ndarray:
    """A block's counts in the order of its hashes."""
    parts = answers.sort_by("_part").column("_counts").to_pylist()
    return np.concatenate([np.zeros(0, np.uint32), *[unpack(c, "<u4") for c in parts]])
