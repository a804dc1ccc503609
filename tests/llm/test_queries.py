"""The registered queries: against SQL where there is some, against brute force elsewhere."""

from __future__ import annotations

import math
import zlib
from collections import Counter

import __spark_entry__ as contract
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from panelkit.llm import queries
from tests.compare import connect, difference
from tests.llm import brute

SQL = sorted(set(queries.QUERIES) & set(contract.LLM_ORACLES))


@pytest.fixture(scope="module")
def sql_engine(medium):
    return connect(medium)


@pytest.fixture(scope="module")
def texts(small):
    return connect(small).sql("SELECT doc_id, text, source FROM documents").fetchall()


@pytest.mark.parametrize("name", SQL)
def test_query_matches_sql(spark, medium, sql_engine, name):
    expected = sql_engine.sql(contract.oracle_sql()[name]).to_arrow_table()
    assert difference(queries.QUERIES[name](spark, medium).toArrow(), expected) is None


def test_all_are_registered():
    assert {f"op{n}" for n in range(1, 14)} == {n.split("_")[0] for n in queries.QUERIES}
    assert {*queries.QUERIES, "pipeline"} <= set(contract.queries())


def test_mixing(spark, small, texts):
    got = queries.op3_source_mixing(spark, small).toPandas()
    sizes = {i: len(brute.words(t)) for i, t, _ in texts}
    assert dict(zip(got.doc_id, got["size"], strict=True)) == sizes
    per_source = Counter()
    for i, _, s in texts:
        per_source[s] += sizes[i]
    targets = brute.targets(per_source, 1.5 * sum(per_source.values()))
    source = {i: s for i, _, s in texts}
    got["source"] = got.doc_id.map(source)
    for s, rows in got.groupby("source"):
        assert (rows.source_size == per_source[s]).all()
        assert np.allclose(rows.target, targets[s])
        assert rows.taken.sum() == int(rows.target.iloc[0] + 1e-6)
    assert (got.taken <= 2 * got["size"]).all()
    again = queries.op3_source_mixing(spark, small).toPandas()
    assert dict(zip(got.doc_id, got.taken, strict=True)) == dict(zip(again.doc_id, again.taken, strict=True))


def test_quality_rules(spark, small, texts):
    got = {r["doc_id"]: r for r in queries.op4_quality_rules(spark, small).collect()}
    for i, t, _ in texts:
        expected = brute.quality(t)
        assert {k: got[i][k] for k in expected} == expected
        assert not (got[i]["kept"] and got[i]["base_failed"])


def test_packing(spark, small, texts):
    got = queries.op5_best_fit_packing(spark, small).toPandas()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    expected = {}
    for i, t, _ in texts:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        for p in range(0, len(ids), 4096):
            part = np.array(ids[p : p + 4096], "<u4").tobytes()
            expected[i, p // 4096] = (p, len(part) // 4, zlib.crc32(part))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got.itertuples()} == expected
    brute.check_places(got, 4096)
    assert got.sequence_id.nunique() <= math.ceil(got.length.sum() / 4096) * 1.03 + 1


def test_quality_classifier(spark, medium, sql_engine):
    got = queries.op6_quality_classifier(spark, medium).toPandas()
    labels = sql_engine.sql("SELECT doc_id, quality FROM labels").df()
    assert len(got) == 1000 and got.doc_id.is_unique
    both = got.merge(labels, on="doc_id")
    assert both[both.quality == 1].kept.mean() > 0.98
    assert (~both[both.quality == 0].kept).mean() > 0.85


def test_lm_scores(spark, small, texts):
    got = {r["doc_id"]: r for r in queries.op9_lm_scores(spark, small).collect()}
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {i: tokenizer.encode(t or "", add_special_tokens=False).ids for i, t, _ in texts}
    for i, (n, back, score) in brute.backoff(ids, 3, 0.4, 2).items():
        assert (got[i]["n_tokens"], got[i]["n_backoff"]) == (n, back)
        assert math.isclose(got[i]["log_score"], score, rel_tol=1e-9, abs_tol=1e-9)


def test_jaccard_join(spark, medium, sql_engine):
    rows = sql_engine.sql("SELECT doc_id, text FROM documents").fetchall()
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in queries.op10_jaccard_join(spark, medium).collect()}
    assert got == brute.components(dict(rows), 4, 85, 100)
