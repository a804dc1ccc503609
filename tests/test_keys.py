"""NULL and repeated keys in joins and groups, and packed minima."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from panelkit.functions.semantics import packed_at, packed_pair
from panelkit.operators import design, keys, metrics, reshape, rollup

PANEL = "scenario string, x int, y int, gpp double"
LABELLED = "scenario string, x int, y int, period string, year int, phase_year int, gpp double, precip double"


def plan(df):
    return df.select("*")._jdf.queryExecution().executedPlan().toString()


def rows(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=str)


def test_null_keys_meet(spark):
    left = spark.createDataFrame([(1, "a"), (None, "b"), (2, "c")], "k int, l string")
    right = spark.createDataFrame([(1, 10), (None, 20)], "k int, r int")
    assert rows(keys.match_keys(left, right, ["k"])) == [(1, "a", 10), (None, "b", 20)]
    assert rows(keys.join_unique(left, right, ["k"], "rows")) == [(1, "a", 10), (2, "c", None), (None, "b", 20)]
    assert rows(keys.match_keys(left, right, ["k"], "left_semi")) == [(1, "a"), (None, "b")]
    with pytest.raises(ValueError, match="both tables"):
        keys.match_keys(left, right.withColumn("l", F.lit(1)), ["k"])


@pytest.mark.parametrize("key", [1, None])
def test_repeated_keys_are_refused(spark, key):
    left = spark.createDataFrame([(1, "a")], "k int, l string")
    right = spark.createDataFrame([(key, 10), (key, 10)], "k int, r int")
    with pytest.raises(Exception, match="rows repeat a key.*k"):
        keys.unique_rows(right, ["k"], "rows").collect()
    # also where no row of the other side has the key, and where its columns are not read
    with pytest.raises(Exception, match="rows repeat a key"):
        keys.join_unique(left, right, ["k"], "rows").select("l").collect()


def test_full_join_in_one_exchange(spark):
    a = spark.createDataFrame([(1, 1, 0.5), (None, 2, 0.7)], "x int, y int, lat double")
    b = spark.createDataFrame([(2, 1, 7), (None, 2, 6)], "x int, y int, soil int")
    c = spark.createDataFrame([(2, 1, "v"), (1, 1, None)], "x bigint, y int, veg string")
    found = keys.full_by_key([a, b, c], ["x", "y"])
    assert rows(found) == [(1, 1, 0.5, None, None), (2, 1, None, 7, "v"), (None, 2, 0.7, 6, None)]
    assert plan(found).count("Exchange") == 1
    with pytest.raises(Exception, match="a table repeats a key"):
        keys.full_by_key([a, b.union(b), c], ["x", "y"]).collect()
    with pytest.raises(ValueError, match="column of two tables: lat"):
        keys.full_by_key([a, a], ["x", "y"])
    assert keys.full_by_key([a.limit(0), b.limit(0)], ["x", "y"]).count() == 0


def test_attribute_joins_keep_their_contract(spark):
    panel = spark.createDataFrame([("s", 1, 1, 5.0), (None, None, 1, 6.0)], PANEL)
    scenarios = spark.createDataFrame([("s", 1), (None, 2)], "scenario string, drought_duration int")
    cells = spark.createDataFrame([(1, 1, 7), (None, 1, 8)], "x int, y int, id int")
    found = rollup.enrich_panel(panel, scenarios, cells)
    assert rows(found, "gpp", "drought_duration", "id") == [(5.0, 1, 7), (6.0, 2, 8)]
    with pytest.raises(Exception, match="cells repeat a key"):
        rollup.enrich_panel(panel, scenarios, cells.union(cells)).collect()
    with pytest.raises(Exception, match="scenarios repeat a key"):
        rollup.enrich_panel(panel, scenarios.union(scenarios), cells).collect()
    a = cells.select("id", "x", "y", F.lit(1.0).alias("lat"))
    with pytest.raises(Exception, match="a table repeats a key"):
        rollup.cell_attributes(a, a.union(a).withColumnRenamed("lat", "lon")).collect()


def test_metrics_keep_null_keys_and_refuse_changing_attributes(spark):
    found = spark.createDataFrame([("s", 1, 1, 0.5), ("s", None, 1, 0.6)], "scenario string, x int, y int, impact double")
    panel = spark.createDataFrame(
        [("s", 1, 1, 7), ("s", 1, 1, 7), ("s", None, 1, 8)], "scenario string, x int, y int, veg_type int"
    )
    joined = metrics.enrich_metrics(found, panel, dimensions=["veg_type"])
    assert rows(joined, "x", "impact", "veg_type") == [(1, 0.5, 7), (None, 0.6, 8)]
    changing = panel.union(spark.createDataFrame([("s", 1, 1, 9)], panel.schema))
    with pytest.raises(Exception, match="attributes repeat a key"):
        metrics.enrich_metrics(found, changing, dimensions=["veg_type"]).collect()


def labelled(spark, values, first=2003):
    panel = spark.createDataFrame(
        [("s", None, 1, first + i, v, v) for i, v in enumerate(values)],
        "scenario string, x int, y int, year int, gpp double, precip double",
    )
    return design.label_periods(
        panel.withColumn("drought_duration", F.lit(4)), recovery_len=4, control=None, year=F.col("year")
    )


VALUES = [90.0, 100.0, 60.0, -50.0, -50.0, 70.0, 80.0, 97.0, 98.0, 99.0]


def test_repeated_years_are_refused(spark):
    df = labelled(spark, VALUES)
    assert metrics.resilience_metrics(df).count() == 2
    again = df.where("year = 2006")
    with pytest.raises(Exception, match="repeats a year"):
        metrics.resilience_metrics(df.union(again)).collect()
    lacking = again.withColumn("year", F.lit(None).cast("int")).select(*df.columns)
    with pytest.raises(Exception, match="repeats a year"):
        metrics.resilience_metrics(df.where("year <> 2006").union(lacking)).collect()


def test_any_length_equals_the_form_for_known_lengths(spark):
    for values in (VALUES, [None if i in (3, 7) else v for i, v in enumerate(VALUES)], [float("nan")] * 10):
        df = labelled(spark, values)
        known = metrics.resilience_metrics(df, mode="threshold")
        free = metrics.resilience_metrics(df, mode="threshold", recovery_len=None, max_duration=None)
        assert rows(free) == rows(known)
    text = plan(free)
    assert "SortAggregate" not in text and "ObjectHashAggregate" not in text
    assert text.count("Exchange hashpartitioning") == 1
    assert "SortAggregate" not in plan(metrics.impact_min(df))


def test_packed_pairs_order_as_pairs(spark):
    values = [-1e308, -2.5, -1e-300, 0.0, 5e-324, 1.0, 1.0000000000000002, 3e307, float("inf"), float("-inf")]
    years = [-2147483648, -1, 0, 1995, 2147483647]
    pairs = [(v, y) for v in values for y in years]
    df = spark.createDataFrame(pairs, "v double, y int").withColumn("p", packed_pair(F.col("v"), F.col("y")))
    found = df.select("v", "y", "p", packed_at(F.col("p")).alias("back")).collect()
    assert [(r["v"], r["y"]) for r in sorted(found, key=lambda r: r["p"])] == sorted(pairs)
    assert len({r["p"] for r in found}) == len(pairs) and all(r["back"] == r["y"] for r in found)


def test_wide_form_refuses_repeated_levels(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (1, "b", 2.0), (None, "a", 3.0)], "id int, n string, v double")
    assert rows(reshape.to_wide(df, ["id"], "n", ["v"], ["a", "b"])) == [(1, 1.0, 2.0), (None, 3.0, None)]
    with pytest.raises(Exception, match="repeat a level of n"):
        reshape.to_wide(df.union(df.where("n = 'b'")), ["id"], "n", ["v"], ["a", "b"]).collect()
