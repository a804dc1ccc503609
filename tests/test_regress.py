from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelkit.operators import regress

PAIRS = "formula string, sample_id int, veg_type string, y double, x double"
LAST = regress.formula(*regress.PAIRS[5])


def pairs(spark, rows, name=LAST):
    return spark.createDataFrame([(name, s, v, y, x) for s, v, y, x in rows], PAIRS)


def noisy(spark, reps=3, n=20):
    rng = np.random.default_rng(11)
    rows = []
    for s in range(1, reps + 1):
        for v in ("Savannas", "Grasslands"):
            x = rng.uniform(0.2, 1, n)
            rows += [(s, v, float(b), float(a)) for a, b in zip(x, 0.3 + 0.5 * x + rng.normal(0, 0.05, n))]
    return pairs(spark, rows), rows


def test_all_pairs_come_from_one_pass(spark):
    wide = spark.createDataFrame(
        [(1, "s", 1, "Savannas", 0.1, 0.2, 0.3, 0.4, None, 0.6, float("nan"), 0.8)],
        "id int, scenario string, sample_id int, veg_type string, gpp_impact double, gpp_recovery_base double,"
        "gpp_recovery_impact double, gpp_stability double, precip_impact double, precip_recovery_base double,"
        "precip_recovery_impact double, precip_stability double",
    )
    rows = {r["formula"]: (r["y"], r["x"]) for r in regress.pair_long(wide).collect()}
    assert rows == {
        "gpp_recovery_base ~ gpp_impact": (0.2, 0.1),
        "gpp_recovery_impact ~ gpp_impact": (0.3, 0.1),
        "gpp_impact ~ precip_impact": (0.1, None),
        "gpp_recovery_base ~ precip_recovery_base": (0.2, 0.6),
        "gpp_recovery_impact ~ precip_recovery_impact": (0.3, None),
        "gpp_stability ~ precip_stability": (0.4, 0.8),
    }
    assert regress.pair_long(wide, complete=True).count() == 4


def test_ols_and_residuals(spark):
    df, rows = noisy(spark)
    df = df.union(pairs(spark, [(1, "Savannas", None, 0.5), (1, "Savannas", 0.5, None)]))
    coefs = {(r["sample_id"], r["veg_type"]): r for r in regress.grouped_ols(df).collect()}
    for (s, v), r in coefs.items():
        x = np.array([q[3] for q in rows if q[:2] == (s, v)])
        y = np.array([q[2] for q in rows if q[:2] == (s, v)])
        assert (r["slope"], r["intercept"]) == pytest.approx(tuple(np.polyfit(x, y, 1)))
        assert r["n"] == 20 and r["r2"] == pytest.approx(np.corrcoef(x, y)[0, 1] ** 2)
    res = regress.augment(df, regress.grouped_ols(df))
    assert res.count() == len(rows)
    checks = res.agg(F.max(F.abs(F.col("fitted") + F.col("resid") - F.col("y")))).first()[0]
    assert checks < 1e-12
    means = res.groupBy(*regress.MODEL_KEYS).agg(F.avg("resid").alias("m")).collect()
    assert all(abs(r["m"]) < 1e-12 for r in means)
    got = {r["veg_type"]: r["mae"] for r in regress.mae(res).collect()}
    expected = res.where("veg_type = 'Savannas'").agg(F.avg(F.abs("resid"))).first()[0]
    assert got["Savannas"] == pytest.approx(expected)


def test_constant_x_has_no_line(spark):
    df = pairs(spark, [(1, "a", 1.0, 2.0), (1, "a", 3.0, 2.0), (2, "a", 1.0, 1.0)])
    for r in regress.grouped_ols(df).collect():
        assert r["slope"] is None and r["intercept"] is None
    assert regress.grouped_ols(pairs(spark, [(1, "a", None, 2.0)])).count() == 0


def test_band(spark):
    coefs = spark.createDataFrame(
        [(LAST, s, "a", float(s), 1.0) for s in range(41)] + [(LAST, 1, "b", -5.0, 1.0)],
        "formula string, sample_id int, veg_type string, intercept double, slope double",
    )
    ranges = spark.createDataFrame([(LAST, "a", 0.0, 9.9), (LAST, "b", 0.0, 1.0)], "formula string, veg_type string, min double, max double")
    rows = regress.confidence_band(coefs, ranges).orderBy("veg_type", "point").collect()
    assert len(rows) == 200
    assert (rows[1]["x"], rows[1]["low"], rows[1]["high"]) == pytest.approx((0.1, 1.1, 39.1))
    assert all(r["low"] <= r["high"] for r in rows)
    assert {(r["low"], r["high"]) for r in rows if r["veg_type"] == "b"} == {(0.0, 0.0)}


def test_range_uses_complete_pairs(spark):
    df = pairs(spark, [(1, "a", 1.0, 2.0), (2, "a", 1.0, 3.0), (2, "a", None, 9.0)])
    row = regress.x_ranges(df).first()
    assert (row["min"], row["max"]) == (2.0, 3.0)


def sampled(spark, rows):
    """Sampled rows with the last pair of variables filled and the others missing."""
    names = sorted({c for p in regress.PAIRS for c in p})
    df = spark.createDataFrame(rows, "sample_id int, veg_type string, gpp_stability double, precip_stability double")
    missing = {c: F.lit(None).cast("double") for c in names if c not in df.columns}
    return df.withColumns(missing).withColumns({"id": F.lit(1), "scenario": F.lit("s")})


def test_fit_sample_equals_regressions_over_pairs(spark):
    _, rows = noisy(spark)
    df = sampled(spark, rows + [(1, "Savannas", 0.4, float("nan")), (9, "Savannas", None, 0.3)])
    fitted = regress.fit_sample(df)
    assert fitted.count() == 6
    expected = regress.grouped_ols(regress.pair_long(df))
    for got, want in zip(
        fitted.orderBy("sample_id", "veg_type").collect(),
        expected.orderBy("sample_id", "veg_type").collect(),
        strict=True,
    ):
        assert got["formula"] == want["formula"] and got["n"] == want["n"]
        assert (got["slope"], got["intercept"]) == pytest.approx((want["slope"], want["intercept"]))
    constant = regress.fit_sample(sampled(spark, [(1, "a", 1.0, 0.1), (1, "a", 2.0, 0.1)])).first()
    assert constant["slope"] is None and constant["intercept"] is None and constant["n"] == 2
    plan = fitted._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and "SortAggregate" not in plan


def test_coefficient_rows_and_ratios(spark):
    df, rows = noisy(spark)
    other = df.withColumn("formula", F.lit(regress.formula(*regress.PAIRS[0])))
    both = df.union(other)
    long = regress.coef_long(regress.grouped_ols(both)).collect()
    assert len(long) == 12 and {r["metric"] for r in long} == {"Stability"}
    assert {r["term"] for r in long} == {"Intercept", "Slope"}
    found = regress.ratio_median(sampled(spark, rows + [(1, "Savannas", None, 0.5)])).collect()
    assert {r["metric"] for r in found} == {"Stability"}
    med = {(r["sample_id"], r["veg_type"]): r["median"] for r in found}
    assert len(med) == 6
    for (s, v), m in med.items():
        assert m == pytest.approx(np.median([q[2] / q[3] for q in rows if q[:2] == (s, v)]))
    zero = sampled(spark, [(1, "a", 1.0, 0.0), (1, "a", 1.0, 2.0)])
    assert regress.ratio_median(zero).first()["median"] == 0.5
    assert regress.ratio_median(zero, on_zero="ieee").first()["median"] == float("inf")


def test_residuals_of_rows_equal_those_of_pairs(spark):
    columns = sorted({c for p in regress.PAIRS for c in p})
    rows = [
        [i, "s", i % 2, "g", *[None if (i + j) % 7 == 0 else float((i * (j + 3)) % 11) for j in range(len(columns))]]
        for i in range(40)
    ]
    df = spark.createDataFrame(rows, "id long, scenario string, sample_id int, veg_type string, " + ", ".join(f"{c} double" for c in columns))
    fits = regress.fit_sample(df)
    direct, long = regress.sample_residuals(df, fits), regress.augment(regress.pair_long(df, complete=True), fits)
    names = ["id", "scenario", "sample_id", "veg_type", "formula", "y", "x", "fitted", "resid"]
    key = lambda d: sorted(tuple(r[n] for n in names) for r in d.collect())
    assert key(direct) == key(long)
