from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from panelkit.operators import design, rollup

KEYS = ["scenario", "x", "y"]


def test_grid_rows_run_along_x(spark):
    df = spark.createDataFrame([("t", [1.0, 2.0, 3.0, 4.0, 5.0, 6.0], [10.0] * 6)], "t string, a array<double>, b array<double>")
    rows = rollup.grid_explode(df, ["a", "b"], nx=3).collect()
    assert [(r["x"], r["y"], r["a"], r["b"]) for r in rows] == [
        (0, 0, 1, 10), (1, 0, 2, 10), (2, 0, 3, 10), (0, 1, 4, 10), (1, 1, 5, 10), (2, 1, 6, 10),
    ]


def daily(spark, values):
    rows = [("s", 1, 1, day, v, 1.0) for day, v in values]
    df = spark.createDataFrame(rows, "scenario string, x int, y int, day string, gpp double, precip double")
    return df.withColumn("ts", F.to_timestamp_ntz("day"))


def test_monthly_sum_outlier_and_yearly_sum(spark):
    df = daily(spark, [("2003-01-01", 1000.0), ("2003-01-31", 1001.0), ("2003-02-01", 2000.0), ("2003-03-01", 7.0)])
    monthly = rollup.monthly_rollup(df, KEYS, ["gpp", "precip"])
    assert {r["time"].month: r["gpp"] for r in monthly.collect()} == {1: 2001.0, 2: 2000.0, 3: 7.0}
    cleaned = rollup.null_outliers(monthly, {"gpp": 2000.0})
    # only the month above the limit is removed, and only in this variable
    assert {r["time"].month: r["gpp"] for r in cleaned.collect()} == {1: None, 2: 2000.0, 3: 7.0}
    row = rollup.yearly_panel(df, KEYS, ["gpp", "precip"], {"gpp": 2000.0}).first()
    assert (row["time"], row["gpp"], row["precip"]) == (dt.date(2003, 1, 1), 2007.0, 4.0)


def test_negative_outlier_and_year_without_values(spark):
    df = daily(spark, [("2003-01-01", -2001.0), ("2004-01-01", None)])
    rows = rollup.yearly_panel(df, KEYS, ["gpp", "precip"], {"gpp": 2000.0}).collect()
    assert {r["time"].year: r["gpp"] for r in rows} == {2003: 0.0, 2004: 0.0}
    assert rollup.monthly_rollup(df, KEYS, ["gpp"]).where("time = '2004-01-01'").first()["gpp"] is None


def test_cell_ids_follow_x_then_y(spark):
    cells = [(x, y) for x in range(7) for y in range(5) if (x * y) % 4 != 1]
    df = spark.createDataFrame(cells[::-1], "x int, y int")
    got = {(r["x"], r["y"]): r["id"] for r in rollup.cell_id(df).collect()}
    assert got == {c: i + 1 for i, c in enumerate(sorted(cells))}


def test_attributes_keep_cells_of_every_table(spark):
    a = spark.createDataFrame([(1, 1, 1, 0.5)], "id long, x int, y int, lat double")
    b = spark.createDataFrame([(2, 1, 2, 7)], "id long, x int, y int, soil_type int")
    rows = {r["id"]: (r["lat"], r["soil_type"]) for r in rollup.cell_attributes(a, b).collect()}
    assert rows == {1: (0.5, None), 2: (None, 7)}


def test_enriched_panel_keeps_unmatched_rows(spark):
    panel = spark.createDataFrame([("scen_02", 1, 1, 5.0), ("other", 9, 9, 6.0)], "scenario string, x int, y int, gpp double")
    cells = spark.createDataFrame([(1, 1, 3)], "x int, y int, id int")
    rows = {r["scenario"]: r for r in rollup.enrich_panel(panel, design.scenario_design(spark), cells).collect()}
    assert rows["scen_02"]["scen_code"] == "D1-N-4" and rows["scen_02"]["id"] == 3
    assert rows["other"]["scen_code"] is None and rows["other"]["id"] is None


def test_scenario_design_matches_the_repeated_factors(spark):
    rows = design.scenario_design(spark).orderBy("scenario").collect()
    droughts = ["N"] + [d for d in ("D1", "D2", "D3") for _ in range(16)]
    recoveries = ["N"] + [r for _ in range(3) for r in ("N", "W3", "W2", "W1") for _ in range(4)]
    durations = [0] + [4, 3, 2, 1] * 12
    assert [r["drought_intensity"] for r in rows] == droughts
    assert [r["recovery_intensity"] for r in rows] == recoveries
    assert [r["drought_duration"] for r in rows] == durations
    assert rows[0]["scen_code"] == "N-N-0" and rows[48]["scen_code"] == "D3-W1-1"
    assert len({r["scen_code"] for r in rows}) == 49 and rows[48]["scenario"] == "scen_49"


def test_schedule(spark):
    schedule = spark.createDataFrame([("scen_01", 2017, 2012), ("scen_02", 2012, 1999)], "scen string, X1 int, X2 int")
    classes = spark.createDataFrame([("N", 2017), ("D1", 2012)], "Class string, Year int")
    rows = design.schedule_long(schedule, classes, ["X1", "X2"]).collect()
    assert {(r["Scen"], r["Time"], r["Year"], r["Class"]) for r in rows} == {
        ("Scen[01]", 1, 2017, "N"), ("Scen[01]", 2, 2012, "D1"), ("Scen[02]", 1, 2012, "D1"), ("Scen[02]", 2, 1999, None),
    }


def test_only_map_side_reduced_rows_are_shuffled(spark):
    df = daily(spark, [("2003-01-01", 1.0)])
    plan = rollup.monthly_rollup(df, KEYS, ["gpp"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and "partial_sum" in plan
