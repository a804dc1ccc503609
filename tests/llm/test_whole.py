"""The registered queries do the whole job: what the reviews found cut, against brute force."""

from __future__ import annotations

import math
import random

import public_tokenizers
from tokenizers import Tokenizer

from panelkit.llm import cotraining, queries
from tests.llm import brute
from tests.llm.conftest import prose


def test_lm_scores_count_three_tokens(spark, documents, tmp_path):
    words = "the cat sat on a mat and saw two dogs run far".split()
    r = random.Random(3)
    prose = [" ".join(words)] * 4
    # every pair below stands in the corpus more than once, the order of the pairs makes no sense
    pairs = [f"{a} {b}" for a in words for b in words]
    shuffled = [" ".join(r.sample(pairs, len(pairs))) for _ in range(3)]
    texts = dict(enumerate([*prose, *shuffled, "", None]))
    documents(list(texts.items())).write.parquet(f"{tmp_path}/documents.parquet")
    got = {row["doc_id"]: row for row in queries.op9_lm_scores(spark, str(tmp_path)).collect()}
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {i: tokenizer.encode(t or "", add_special_tokens=False).ids for i, t in texts.items()}
    expected = brute.backoff(ids, 3, 0.4, 2)
    assert len(got) == len(expected)
    for i, (n, back, score) in expected.items():
        assert (got[i]["n_tokens"], got[i]["n_backoff"]) == (n, back)
        assert math.isclose(got[i]["log_score"], score, rel_tol=1e-9, abs_tol=1e-9)
    assert got[0]["n_backoff"] == 0 and got[4]["n_backoff"] > 0


def test_metadata_slots_tell_long_names_apart():
    old = {v: int.from_bytes(v.encode().rjust(8, b"\0"), "big") * 0x9E3779B97F4A7C15 % (1 << 64) * 32 >> 64 for v in ("", "src19")}
    assert {v: cotraining._slot(v, 32) for v in old} == old and cotraining._slot(None, 32) == old[""]
    for start in ("https://", "commoncrawl-", "a name of more than sixteen bytes "):
        slots = {cotraining._slot(f"{start}{i}", 32) for i in range(200)}
        assert len(slots) > 24


def test_labels_that_calibration_leaves_are_trained_on(documents, spark, monkeypatch):
    docs = documents([(i, prose(i, 30)) for i in range(60)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    fitted, held = [], []
    fit, calibrated = cotraining._fit, cotraining._calibrated

    def counted_fit(rows, *args):
        fitted.append({r["_id"] for r in rows.where("_label IS NOT NULL").collect()})
        return fit(rows, *args)

    def counted_calibrated(models, frame):
        held.append(set(frame["_id"]))
        return calibrated(models, frame)

    monkeypatch.setattr(cotraining, "_fit", counted_fit)
    monkeypatch.setattr(cotraining, "_calibrated", counted_calibrated)
    monkeypatch.setattr(cotraining, "CALIBRATION_ROWS", 3)
    cotraining.train_on(docs, labels, rounds=0)
    assert len(held[0]) == 3 and not fitted[0] & held[0] and fitted[0] | held[0] == set(range(60))
