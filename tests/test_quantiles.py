from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelkit import session
from panelkit.operators.profile import hexbin, histogram
from panelkit.operators import quantiles
from panelkit.operators.numbering import number_rows
from panelkit.operators.quantiles import cumulative_share, exact_quantiles, pooled_quantiles
from panelkit.operators.resample import sample_per_group

PROBS = [0.0, 0.05, 0.25, 0.4, 0.5, 0.95, 1.0]


def frame(spark, groups):
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs]
    return spark.createDataFrame(rows, "g string, v double")


def groups():
    rng = np.random.default_rng(7)
    return {
        "normal": rng.normal(size=701),
        "heavy": rng.standard_cauchy(size=500) * 1e5,
        "ties": rng.integers(-3, 3, size=400),
        "close": 1000 + rng.integers(0, 900, size=300) * 1e-9,
        "one": [4.5],
        "two": [-1.0, 2.0],
        "constant": [3.25] * 50,
        "zeros": [0.0, -0.0, 0.0, 1e-310, -1e-310],
    }


def check(spark, data):
    got = {r["g"]: r for r in exact_quantiles(frame(spark, data), "v", PROBS, ["g"]).collect()}
    assert set(got) == set(data)
    for g, vs in data.items():
        assert got[g]["n"] == len(vs)
        assert got[g]["quantiles"] == pytest.approx(list(np.quantile(vs, PROBS)), rel=1e-12, abs=1e-12)


def test_equals_linear_interpolation(spark):
    check(spark, groups())


def test_all_levels_of_splitting(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "ORDER_ROWS", 3)
    check(spark, groups())


def test_many_groups_take_the_checkpoint_path(spark, monkeypatch):
    settled = []

    def tiny(df, max_rows=0):
        out = session.settle(df, 0)
        settled.append(out[1])
        return out

    monkeypatch.setattr(quantiles, "settle", tiny)
    monkeypatch.setattr(quantiles, "ORDER_ROWS", 20)
    check(spark, groups())
    assert settled and all(rows > 0 for rows in settled)


def test_missing_values_and_null_groups(spark):
    rows = [("a", 1.0), ("a", None), ("a", float("nan")), ("a", 3.0), (None, 7.0), (None, 9.0), ("b", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r["g"]: (r["n"], r["quantiles"]) for r in exact_quantiles(df, "v", [0.5], ["g"]).collect()}
    assert got == {"a": (2, [2.0]), None: (2, [8.0])}


def test_infinite_values(spark):
    df = frame(spark, {"a": [float("-inf"), 1.0, 2.0, float("inf")]})
    row = exact_quantiles(df, "v", [0.0, 1 / 3, 1.0]).first()
    assert row["quantiles"] == [float("-inf"), 1.0, float("inf")]


def test_skewed_group_of_one_value(spark):
    df = spark.range(300_000).select(F.when(F.col("id") % 3 == 0, 5.0).otherwise(F.col("id") * 0.5).alias("v"))
    got = exact_quantiles(df, "v", [0.1, 0.5, 0.9]).first()["quantiles"]
    values = np.where(np.arange(300_000) % 3 == 0, 5.0, np.arange(300_000) * 0.5)
    assert got == pytest.approx(list(np.quantile(values, [0.1, 0.5, 0.9])))


def test_empty_input(spark):
    df = frame(spark, {"a": [1.0]}).where("v > 2")
    assert exact_quantiles(df, "v", [0.5], ["g"]).count() == 0
    assert quantiles.quantile_values(df, "v", [0.5, 0.9]) == [None, None]


def test_pooled_names(spark):
    rows = pooled_quantiles(frame(spark, {"a": range(101)}), "v", [0.05, 0.4]).collect()
    assert [(r["quantile"], r["value"]) for r in rows] == [("5%", 5.0), ("40%", 40.0)]


@pytest.mark.parametrize("shift", [20, 51])
def test_cumulative_share(spark, monkeypatch, shift):
    monkeypatch.setattr(quantiles, "SHARE_SHIFT", shift)
    sample = frame(spark, {"s": [1.0, 2.0, 2.0, 3.0, 10.0]})
    asked = [0.5, 1.0, 2.0, 2.5, 10.0, 11.0, 2.0, None]
    queries = spark.createDataFrame([(i, q) for i, q in enumerate(asked)], "i int, q double")
    got = {r["i"]: r["p"] for r in cumulative_share(queries, "q", sample, "v", "p").collect()}
    assert got == {0: 0.0, 1: 0.2, 2: 0.6, 3: 0.6, 4: 1.0, 5: 1.0, 6: 0.6, 7: None}


def test_cumulative_share_of_missing_values_and_an_empty_sample(spark):
    nan = float("nan")
    queries = spark.createDataFrame([(0, 5.0), (1, nan), (2, None), (3, -0.0)], "i int, q double")
    sample = frame(spark, {"s": [*range(1, 11), 0.0, nan]})
    got = {r["i"]: r["p"] for r in cumulative_share(queries, "q", sample, "v", "p").collect()}
    assert got == {0: pytest.approx(6 / 11), 1: None, 2: None, 3: pytest.approx(1 / 11)}
    empty = cumulative_share(queries, "q", sample.where("v > 100 and v < 200"), "v", "p").collect()
    assert all(r["p"] is None for r in empty) and len(empty) == 4


def test_groups_by_timestamps_of_a_zone_with_summer_time(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        rows = [(1636263000, float(i)) for i in range(5)] + [(1636266600, float(i)) for i in range(10, 15)]
        df = spark.createDataFrame(rows, "s long, v double").select(F.timestamp_seconds("s").alias("t"), "v")
        found = exact_quantiles(df, "v", [0.5], ["t"]).select(F.unix_seconds("t").alias("s"), "quantiles").collect()
        assert {r["s"]: r["quantiles"][0] for r in found} == {1636263000: 2.0, 1636266600: 12.0}
        assert sample_per_group(df, ["t"], 2, ["v"]).count() == 4
        assert histogram(df, "v", bins=3, by=["t"]).select("t").distinct().count() == 2
        assert hexbin(df.withColumn("w", F.col("v")), "v", "w", by=["t"]).select("t").distinct().count() == 2
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_numbering_keeps_null_groups_and_blocks(spark):
    df = spark.createDataFrame([("a", 3), ("a", None), (None, 5), (None, 1), ("a", 40)], "g string, k int")
    got = number_rows(df, F.floor(F.col("k") / 16), ["k"], "pos", ["g"]).collect()
    assert {(r["g"], r["k"]): r["pos"] for r in got} == {
        ("a", None): 0, ("a", 3): 1, ("a", 40): 2, (None, 1): 0, (None, 5): 1,
    }


def test_numbering_in_blocks_equals_the_global_order(spark):
    df = spark.range(500).select(
        (F.col("id") % 3).alias("g"), ((F.col("id") * 37) % 500).alias("k")
    ).repartition(7)
    got = number_rows(df, F.floor(F.col("k") / 16), ["k"], "pos", ["g"]).collect()
    expected = {}
    for g in range(3):
        keys = sorted(i * 37 % 500 for i in range(500) if i % 3 == g)
        expected |= {(g, k): i for i, k in enumerate(keys)}
    assert {(r["g"], r["k"]): r["pos"] for r in got} == expected
