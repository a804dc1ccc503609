from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelkit.operators import profile


def values(spark, vs, g="a"):
    return spark.createDataFrame([(g, float(v)) for v in vs], "g string, v double")


def test_summary_leaves_missing_values_out(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, 5.0), (4.0, float("nan"))], "p double, q double")
    rows = {r["variable"]: r for r in profile.summary_stats(df, ["p", "q"]).collect()}
    assert (rows["p"]["n"], rows["p"]["median"], rows["p"]["mean"]) == (3, 2.0, pytest.approx(7 / 3))
    assert rows["p"]["sd"] == pytest.approx(np.std([1, 2, 4], ddof=1))
    assert (rows["q"]["n"], rows["q"]["min"], rows["q"]["max"], rows["q"]["sd"]) == (1, 5.0, 5.0, None)
    assert {r["variable"]: r["mean"] for r in profile.summary_stats(df, ["p"], digits=2).collect()} == {"p": 2.33}
    flat = {r["metric"]: r["p"] for r in profile.summary_transposed(df, ["p", "q"]).collect()}
    assert flat["n"] == 3.0 and flat["max"] == 4.0 and set(flat) == set(profile.STATISTICS)


def test_boxplot(spark):
    vs = [1, 2, 3, 4, 5, 6, 7, 8, 9, 30]
    row = profile.boxplot_stats(values(spark, vs), ["g"], "v").first()
    assert (row["q1"], row["median"], row["q3"]) == (3.25, 5.5, 7.75)
    assert (row["whisker_low"], row["whisker_high"], row["outliers"], row["mean"]) == (1, 9, 1, 7.5)
    assert [r["v"] for r in profile.boxplot_outliers(values(spark, vs), ["g"], "v").collect()] == [30.0]


def test_boxplot_rows_need_all_metrics(spark):
    full = [1, "s", "Savannas"] + [float(i) for i in range(10)]
    part = [2, "s", "Savannas"] + [float(i) for i in range(9)] + [None]
    schema = "id long, scenario string, veg_type string, " + ", ".join(f"{c} double" for c in profile.WIDE_METRICS)
    rows = profile.metric_boxplot_rows(spark.createDataFrame([tuple(full), tuple(part)], schema)).collect()
    assert {r["id"] for r in rows} == {1}
    assert {r["variable"] for r in rows} == set(profile.WIDE_METRICS) - {"gpp_recovery", "precip_recovery"}


def test_histogram_centres_bins_on_multiples_of_the_width(spark):
    rows = profile.histogram(values(spark, [0, 1, 2, 3, 4, 4, 1.5]), "v", bins=5).orderBy("xmin").collect()
    assert [(r["xmin"], r["xmax"], r["count"]) for r in rows] == [
        (-0.5, 0.5, 1), (0.5, 1.5, 2), (1.5, 2.5, 1), (2.5, 3.5, 1), (3.5, 4.5, 2),
    ]
    constant = profile.histogram(values(spark, [3, 3, 3]), "v").collect()
    assert [r["count"] for r in constant] == [3]


def test_histogram_and_hexagons_count_every_row(spark):
    rng = np.random.default_rng(3)
    data = [("ab"[i % 2], float(x), float(y)) for i, (x, y) in enumerate(rng.normal(size=(500, 2)))]
    df = spark.createDataFrame(data + [("a", None, 1.0)], "g string, x double, y double")
    for by in ([], ["g"]):
        assert profile.histogram(df, "x", by=by).agg(F.sum("count")).first()[0] == 500
        assert profile.hexbin(df, "x", "y", by=by).agg(F.sum("count")).first()[0] == 500
    inside = sum(-1 <= x <= 1 and 0 <= y <= 1 for _, x, y in data)
    limited = profile.hexbin(df, "x", "y", limits=((-1, 1), (0, 1)))
    assert limited.agg(F.sum("count")).first()[0] == inside


def test_hexagon_is_the_nearest_centre(spark):
    rng = np.random.default_rng(4)
    points = rng.uniform(0, 1, size=(300, 2))
    df = spark.createDataFrame([(float(x), float(y)) for x, y in points], "x double, y double")
    got = {(round(r["x"], 9), round(r["y"], 9)): r["count"] for r in profile.hexbin(df, "x", "y", bins=6).collect()}
    (x0, y0), (x1, y1) = points.min(0), points.max(0)
    wx, wy = (x1 - x0) / 6, (y1 - y0) / 6
    bx, by = math.floor(x0 / wx) * wx - 1e-6, math.floor(y0 / wy) * wy - 1e-6
    centres = [
        (bx + (i + h) * wx, by + (j + h) * wy * math.sqrt(3)) for h in (0, 0.5) for i in range(-1, 9) for j in range(-1, 9)
    ]
    expected: dict = {}
    for x, y in points:
        near = min(centres, key=lambda c: ((x - c[0]) / wx) ** 2 + ((y - c[1]) / wy) ** 2)
        key = (round(near[0], 9), round(near[1], 9))
        expected[key] = expected.get(key, 0) + 1
    assert got == expected


def test_density_integrates_to_one_and_matches_the_kernel_sum(spark):
    rng = np.random.default_rng(5)
    vs = rng.normal(size=400)
    rows = profile.density_profile(values(spark, vs), ["g"], "v", points=512).orderBy("point").collect()
    x, d = np.array([r["x"] for r in rows]), np.array([r["density"] for r in rows])
    assert np.trapezoid(d, x) == pytest.approx(1, abs=0.01)
    iqr = np.subtract(*np.quantile(vs, [0.75, 0.25]))
    bw = 0.9 * min(vs.std(ddof=1), iqr / 1.34) * 400**-0.2
    exact = np.exp(-0.5 * ((x[:, None] - vs) / bw) ** 2).sum(1) / (400 * bw * math.sqrt(2 * math.pi))
    assert d == pytest.approx(exact, abs=2e-4)
    assert rows[0]["low"] == pytest.approx(np.quantile(vs, 0.025))
    assert rows[0]["x"] == pytest.approx(vs.min() - 3 * bw)


def test_panel_shares_bandwidth_and_grid(spark):
    df = values(spark, [0, 1, 2, 3], "a").union(values(spark, [10, 20, 30, 40, 50], "b")).withColumn("p", F.lit(1))
    rows = profile.density_profile(df, ["p", "g"], "v", points=16, panel=["p"]).collect()
    assert len({(r["point"], round(r["x"], 9)) for r in rows}) == 16
    one_value = profile.density_profile(values(spark, [2, 2]), ["g"], "v", points=16)
    assert one_value.where("density > 0").count() > 0


def test_line_and_band(spark):
    rng = np.random.default_rng(6)
    x = rng.uniform(size=60)
    y = 1 + 2 * x + rng.normal(size=60) * 0.1
    df = spark.createDataFrame([("a", float(p), float(q)) for p, q in zip(x, y)] + [("c", 1.0, 1.0)], "g string, x double, y double")
    rows = profile.smooth_line(df, "x", "y", ["g"], points=5, band=True).orderBy("point").collect()
    slope, intercept = np.polyfit(x, y, 1)
    assert [r["fit"] for r in rows] == pytest.approx([intercept + slope * r["x"] for r in rows])
    s = math.sqrt(((y - intercept - slope * x) ** 2).sum() / 58)
    t = 2.0017174830120923  # 97.5 % quantile of Student's t with 58 degrees of freedom
    half = [t * s * math.sqrt(1 / 60 + (r["x"] - x.mean()) ** 2 / ((x - x.mean()) ** 2).sum()) for r in rows]
    assert [r["high"] - r["fit"] for r in rows] == pytest.approx(half, rel=1e-6)
    clipped = profile.smooth_line(df, "x", "y", ["g"], {"x": (0.2, 0.8)}, points=2).collect()
    kept = x[(x >= 0.2) & (x <= 0.8)]
    assert sorted(r["x"] for r in clipped) == pytest.approx([kept.min(), kept.max()])


def test_student_quantiles(spark):
    # tabled values; fixed
    tabled = {1: 12.7062, 2: 4.30265, 3: 3.18245, 5: 2.57058, 9: 2.26216, 10: 2.22814, 30: 2.04227, 120: 1.97993}
    df = spark.createDataFrame([(float(k),) for k in tabled], "df double")
    got = {r["df"]: r["t"] for r in df.select("df", profile._t_quantile(profile.Z_95, F.col("df")).alias("t")).collect()}
    assert all(abs(got[k] - t) < 3e-5 for k, t in tabled.items())
