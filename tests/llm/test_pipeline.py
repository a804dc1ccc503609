"""The pipeline stage by stage: each against a plain version of it, on what its predecessor kept."""

from __future__ import annotations

from collections import Counter

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from panelkit.llm import cotraining
from panelkit.session import keep
from tests.llm import brute

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def steps(spark, medium):
    docs = spark.read.parquet(f"{medium}/documents.parquet")
    # groups that a hot source and repeated rows bring along
    docs = docs.union(docs.where("doc_id % 10 = 0").withColumn("doc_id", F.col("doc_id") + 10_000)).union(docs.limit(5))
    tables = [keep(docs)]
    for _, stage in corpus_pipeline.STAGES:
        tables.append(keep(stage(spark, tables[-1], medium)))
    return [t.toPandas() for t in tables]


def test_stages_return_document_columns(steps):
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality classifier", "exact dedup", "n-gram Jaccard join", "source mixing", "best-fit packing",
    ]
    assert all(list(t.columns) == COLUMNS for t in steps[:-1])


def test_classifier_keeps_what_the_operator_keeps(spark, medium, steps):
    docs = spark.createDataFrame(steps[0])
    scores = cotraining.quality_scores(docs, spark.read.parquet(f"{medium}/labels.parquet"))
    kept = Counter(r["doc_id"] for r in scores.where("kept").collect())
    assert Counter(steps[1].doc_id) == kept
    labels = spark.read.parquet(f"{medium}/labels.parquet").toPandas()
    good = set(labels[labels.quality == 1].doc_id)
    assert len(good & set(steps[1].doc_id)) >= 0.98 * len(good)


def test_exact_dedup(steps):
    last = {}
    for i, t in zip(steps[1].doc_id, steps[1].text, strict=True):
        last[t] = max(i, last.get(t, i))
    assert sorted(zip(steps[2].doc_id, steps[2].text, strict=True)) == sorted((i, t) for t, i in last.items())


def test_near_dedup(steps):
    found = brute.components(dict(zip(steps[2].doc_id, steps[2].text, strict=True)), 5, 80, 100)
    assert sorted(steps[3].doc_id) == sorted(i for i, (n, c) in found.items() if n == 0 or c == i)


def test_mixing(steps):
    before, after = steps[3], Counter(steps[4].doc_id)
    size = {i: len(brute.words(t)) for i, t in zip(before.doc_id, before.text, strict=True)}
    per_source = Counter()
    for i, s in zip(before.doc_id, before.source, strict=True):
        per_source[s] += size[i]
    targets = brute.targets(per_source, 1.5 * sum(per_source.values()))
    for s, rows in before.groupby("source"):
        taken = sum(after[i] * size[i] for i in rows.doc_id)
        assert abs(taken - targets[s]) <= max(size[i] for i in rows.doc_id)
        assert max(after[i] for i in rows.doc_id) <= 2
    texts = dict(zip(before.doc_id, before.text, strict=True))
    assert all(texts[i] == t for i, t in zip(steps[4].doc_id, steps[4].text, strict=True))


def test_packing(steps):
    brute.check_places(steps[5], 4096)
    pieces = Counter(steps[5][steps[5].piece == 0].doc_id)
    assert pieces == Counter(steps[4].doc_id)


def test_run_writes_every_stage(spark, small):
    assert corpus_pipeline.ORACLE_SQL is None
    out = corpus_pipeline.run(spark, small)
    assert {"doc_id", "piece", "sequence_id", "offset"} <= set(out.columns) and out.count() > 100
