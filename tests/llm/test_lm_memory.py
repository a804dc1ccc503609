"""What scoring a block of tokens takes of a worker's memory."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pyarrow as pa

from panelkit.llm import lm
from panelkit.llm.packed import pack


class Grouped:
    """Stands for both tables and hands out the function that scores a block."""

    def groupBy(self, *_):
        return self

    def cogroup(self, _):
        return self

    def applyInArrow(self, run, _):
        return run


def test_scoring_a_block_takes_less_than_105_bytes_a_token():
    rng = np.random.default_rng(1)
    sizes = rng.integers(0, 800, 1000).astype("<i8")
    tokens = (rng.zipf(1.3, int(sizes.sum())) % 30_000 + 1).astype("<u2")
    pairs, triples, part = lm._Grams(sizes, tokens, 3).dealt(1)
    one = [pa.array([pack(np.full(len(a), 2, "<i8"))], pa.binary()) for a in (pairs, triples)]
    known = pa.table([pa.array([0]), *one], names=["_part", "_pair_counts", "_triple_counts"])
    ids = pa.array([list(range(len(sizes)))], pa.list_(pa.int64()))
    block = pa.table(
        [pa.array([0]), ids, pa.array([sizes.tobytes()]), pa.array([pack(tokens)])],
        names=["_block", "_ids", "_sizes", "_tokens"],
    )
    single = np.bincount(tokens, minlength=1 << 16)
    run = lm._scored(Grouped(), Grouped(), single, "bigint", 1, 3, 0.4, 2)
    tracemalloc.start()
    scored = run(block, known)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert scored.num_rows == 1000
    assert peak < 105 * len(tokens)
