"""The suffix array of line numbers and its common prefixes, against a sorted list of suffixes."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from panelkit.llm import line_dedup


def sequences():
    rng = random.Random(5)
    free = [[rng.choice("abc") for _ in range(rng.randrange(1, 12))] for _ in range(12)]
    # equal sequences, one inside another, one symbol again and again, places with a gap between sequences
    return [*free, free[0], free[3], list("aaaaaaaaa"), list("aaaaa"), list("abcabcabcabc"), list("z")]


@pytest.mark.parametrize("bits", [1, 12])
def test_ranks_and_common_prefixes(spark, monkeypatch, bits):
    monkeypatch.setattr(line_dedup, "BLOCK_BITS", bits)
    symbols, suffixes, place = [], {}, 0
    counts = Counter(c for s in sequences() for c in s)
    for number, s in enumerate(sequences()):
        end = place + len(s) - 1
        for i, c in enumerate(s):
            smaller = sum(n for d, n in counts.items() if d < c)
            symbols.append((place + i, end, smaller, counts[c]))
            suffixes[place + i] = "".join(s[i:])
        place = end + 1 + (number % 3)
    table = spark.createDataFrame(symbols, "_p bigint, _end bigint, _rank bigint, _n bigint")
    ranks, levels = line_dedup.suffix_ranks(table)
    ordered = sorted(suffixes.values())
    assert {r["_p"]: r["_rank"] for r in ranks.collect()} == {p: ordered.index(s) for p, s in suffixes.items()}

    found = line_dedup.common_prefixes(ranks, levels).orderBy("_rank").collect()
    distinct = sorted(set(ordered))
    assert [suffixes[r["_first"]] for r in found] == distinct
    assert [r["_n"] for r in found] == [ordered.count(s) for s in distinct]
    before = [""] + distinct[:-1]
    shared = [next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b))) for a, b in zip(before, distinct)]
    assert [r["_lcp"] for r in found] == shared


@pytest.mark.parametrize("bits", [1, 12])
def test_intervals_reach_over_blocks(spark, monkeypatch, bits):
    monkeypatch.setattr(line_dedup, "BLOCK_BITS", bits)
    rows = [(r, 0 if r in (0, 9) else 5, 3) for r in range(30)] + [(r, 4 if r % 2 else 7, 6) for r in range(8, 20)]
    table = spark.createDataFrame(rows, "_rank bigint, _lcp bigint, _len bigint")
    got = {(r["_len"], r["_rank"]): r["_from"] for r in line_dedup._intervals(table.where(F.lit(True))).collect()}
    expected, last = {}, {}
    for rank, lcp, length in rows:
        if lcp < length:
            last[length] = rank
        expected[(length, rank)] = last.get(length)
    assert got == expected
