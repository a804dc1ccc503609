"""The factorization machine: its formula, what pairs add, held-out labels, and rows that are out of the ordinary."""

from __future__ import annotations

import itertools
import math
import random
import zlib

import numpy as np
import pytest

from panelkit.llm import queries, toxicity
from panelkit.llm.terms import term_chunks
from tests.compare import connect
from tests.llm.conftest import prose


def random_machine(seed: int, terms: np.ndarray) -> toxicity.Machine:
    r = np.random.default_rng(seed)
    return toxicity.Machine(terms, 0.3, r.normal(size=len(terms)), r.normal(size=(len(terms), 3)).astype(np.float32))


def test_margins_are_weights_and_pairs():
    machine = random_machine(1, np.arange(6, dtype=np.uint64))
    texts = [[0, 2, 5], [], [3], [1, 2, 3, 4]]
    doc = np.repeat(np.arange(4), [len(t) for t in texts])
    got = machine.margins(doc, np.array(list(itertools.chain(*texts))), 4)
    for t, margin in zip(texts, got, strict=True):
        pairs = sum(float(machine.vectors[i] @ machine.vectors[j]) for i, j in itertools.combinations(t, 2))
        assert math.isclose(margin, machine.bias + sum(machine.weights[i] for i in t) + pairs, rel_tol=1e-5)


def test_pairs_are_learnt_that_weights_miss():
    # an insult is toxic only beside a mention of a group; both alone are as frequent among clean texts
    r = random.Random(4)
    rows, labels = [], []
    for _ in range(2000):
        insult, group = r.random() < 0.5, r.random() < 0.5
        rows.append(np.array(sorted({*([0] if insult else []), *([1] if group else []), *r.sample(range(2, 30), 5)})))
        labels.append(float(insult == group))
    machine = toxicity.fit_machine(np.arange(30, dtype=np.uint64), rows[:1500], np.array(labels[:1500]))
    held = rows[1500:]
    doc = np.repeat(np.arange(len(held)), [len(t) for t in held])
    right = (machine.margins(doc, np.concatenate(held), len(held)) > 0) == np.array(labels[1500:])
    assert right.mean() > 0.95
    # the best additive rule on the two terms is right in three of four cases at most
    flat = toxicity.fit_machine(np.arange(30, dtype=np.uint64), rows[:1500], np.array(labels[:1500]), factors=0)
    assert ((flat.margins(doc, np.concatenate(held), len(held)) > 0) == np.array(labels[1500:])).mean() < 0.8


def test_terms_of_texts():
    import pyarrow as pa

    ((_, _, texts),) = term_chunks(pa.array(["Moron! morons, a-b", None, "a\x00b"]))
    doc, hashes = toxicity.text_terms(texts)
    by_doc = {d: set(hashes[doc == d].tolist()) for d in range(3)}
    # five words, and the beginnings of the two longer ones, of four and of five bytes
    assert len(by_doc[0]) == 4 + 1 + 1 and by_doc[1] == set() and by_doc[2] < by_doc[0]


def test_held_out_accuracy(spark, medium):
    got = queries.op12_toxicity(spark, medium).toPandas()
    assert list(got.columns) == ["doc_id", "held_out", "score", "predicted"] and len(got) == 1000
    assert all(h == (zlib.crc32(str(i).encode()) % 5 == 0) for i, h in zip(got.doc_id, got.held_out, strict=True))
    both = got.merge(connect(medium).sql("SELECT doc_id, toxic FROM labels").df(), on="doc_id")
    held = both[both.held_out]
    assert (held[held.toxic == 0].predicted == 0).mean() > 0.97
    assert held[held.toxic == 1].score.mean() > 10 * held[held.toxic == 0].score.mean()
    assert ((got.score >= 0.5).astype(int) == got.predicted).all() and got.score.between(0, 1).all()


@pytest.fixture(scope="module")
def insulted(documents):
    rows = [(i, prose(i, 40) + (" you utter blockhead" if i % 3 == 0 else "")) for i in range(200)]
    rows += [(200, prose(5, 20_000) + "\nblockhead"), (201, None), (202, ""), (None, "blockhead"), (6, "blockhead"), (6, "blockhead")]
    return documents(rows), rows


def test_every_row_is_scored_by_its_whole_text(spark, insulted):
    docs, rows = insulted
    labels = spark.createDataFrame([(i, int(i % 3 == 0), 5) for i in range(150)] + [(3, None, 1), (999, 1, 1), (None, 1, 1)], "doc_id long, toxic int, score int")
    got = toxicity.toxicity_scores(docs.repartition(5), labels)
    assert got.columns == ["doc_id", "score", "predicted"]
    found = got.collect()
    assert len(found) == len(rows)
    by_key = {r["doc_id"]: r for r in found}
    wrong = [i for i in range(200) if by_key[i]["predicted"] != int(i % 3 == 0)]
    assert len(wrong) <= 2 and all(i >= 150 and i % 3 == 0 for i in wrong)
    assert by_key[200]["predicted"] == 1 and by_key[None]["predicted"] == 1
    assert by_key[201]["score"] == by_key[202]["score"] and by_key[201]["predicted"] == 0
    # the order of rows and their spread over tasks change nothing
    again = toxicity.toxicity_scores(docs.orderBy("text").coalesce(1), labels).collect()
    assert sorted((str(r["doc_id"]), r["score"]) for r in found) == sorted((str(r["doc_id"]), r["score"]) for r in again)


def test_no_labels_and_no_documents(spark, documents, insulted):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {round(r["score"], 9) for r in toxicity.toxicity_scores(insulted[0], none).collect()} == {0.25}
    some = spark.createDataFrame([(1, 1)], "doc_id long, toxic int")
    assert toxicity.toxicity_scores(documents([]), some).collect() == []


def test_sample_is_bounded(spark, insulted):
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, toxic int")
    few = toxicity._labelled(insulted[0], labels, "doc_id", "text", "toxic", 40).count()
    assert 20 <= few <= 65
    assert toxicity._labelled(insulted[0], labels, "doc_id", "text", "toxic", 400).count() == 201
