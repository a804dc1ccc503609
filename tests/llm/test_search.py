"""The ranked search against a plain version."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from panelkit.llm import search
from tests.llm.conftest import WORDS, prose

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def ranked(docs, items, top):
    """``(item, rank, key, score)`` of documents and items given as ``(key, text)``."""
    counted = [(k, Counter(terms(t))) for k, t in docs]
    n_docs = sum(1 for _, c in counted if c)
    total = sum(sum(c.values()) for _, c in counted)
    held = Counter(t for _, c in counted for t in c)
    weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for t, d in held.items()}
    out = []
    for item, text in items:
        scores = []
        for k, c in counted:
            if c:
                m = 50 + 50 * sum(c.values()) * n_docs // total
                s = sum(weight[t] * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in set(terms(text)) if c[t])
                if s > 0:
                    scores.append((-s, k is None, k))
        scores.sort(key=lambda x: (x[0], x[1], x[2] or 0))
        out += [(item, r + 1, k, -s) for r, (s, _, k) in enumerate(scores[:top])]
    return out


def seen(rows):
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in rows), key=str)


@pytest.fixture(scope="module")
def items(spark):
    rows = [(1, "Kaka lon  KARe-nust"), (2, None), (3, " "), (4, prose(2, 20)), (5, "Ünï cödé 漢字"), (6, "nothing-of-this"), (7, prose(1, 200)), (8, "one ONE three word")]
    return spark.createDataFrame([(*r, 5, 6) for r in rows], "item_id long, text string, _item int, rank int"), rows


@pytest.mark.parametrize("top", [1, 3, 50])
def test_search_of_tricky_rows(documents, tricky, items, top):
    docs, rows = documents(tricky).repartition(4), [(k, t) for k, t, _ in tricky]
    got = search.ranked_search(docs, items[0], top=top)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert seen(got.collect()) == sorted(ranked(rows, items[1], top), key=str)


@pytest.mark.parametrize("pairs", [7, 100_000])
def test_many_documents_in_several_shards_and_turns(documents, items, pairs):
    r = random.Random(8)
    rows = [(i, " ".join(r.choice(WORDS) + r.choice(WORDS)[: r.randint(0, 2)] for _ in range(r.randint(1, 60)))) for i in range(700)]
    # copies tie, also over shards
    rows += [(1000 + i, rows[i % 7][1]) for i in range(300)]
    wanted = [(i, " ".join(r.sample(WORDS, 6))) for i in range(20)]
    asked = items[0].sparkSession.createDataFrame(wanted, "item_id long, text string")
    got = search.ranked_search(documents(rows).repartition(5), asked, top=5, pairs=pairs).collect()
    assert seen(got) == sorted(ranked(rows, wanted, 5), key=str)


def test_no_documents_and_no_items(documents, items):
    assert search.ranked_search(documents([]), items[0]).collect() == []
    assert search.ranked_search(documents([(1, None), (2, "-")]), items[0]).collect() == []
    assert search.ranked_search(documents([(1, "one")]), items[0].limit(0)).collect() == []


def test_documents_leave_only_when_out_of_reach():
    scores = np.array([0, 5, 9, 7, 7, 1])
    assert search._within_reach(scores, 0, 2).tolist() == [2, 3, 4]
    assert search._within_reach(scores, 2, 2).tolist() == [1, 2, 3, 4]
    assert search._within_reach(scores, 6, 2).tolist() == [1, 2, 3, 4, 5]
    assert search._within_reach(scores, 0, 9).tolist() == [1, 2, 3, 4, 5]


def test_owners_take_rare_terms_first():
    held = np.array([100, 1, 1, 40, 3, 2, 60, 0])
    owner = search._owners(held)
    assert owner.min() >= 0 and owner.max() == search.OWNERS - 1
    assert all(owner[i] <= owner[j] for i in range(8) for j in range(8) if held[i] < held[j])
