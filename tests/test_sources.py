from __future__ import annotations

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from panelkit.operators import regress
from panelkit.operators.reshape import nest, to_long, to_wide, unnest
from panelkit.sources import tables


def test_wide_series(spark, tmp_path):
    f = tmp_path / "annual.csv"
    f.write_text("Year,GLDAS2_1,Petrolina,Juazeiro,GLDAS2_0\n2001,4.5,NA,1,2\n2002,,3,,NA\n")
    rows = tables.read_wide_series(spark, str(f)).orderBy("Year").collect()
    assert rows[0].asDict() == {"Year": 2001, "Petrolina": None, "Juazeiro": 1.0, "GLDAS2_0": 2.0, "GLDAS2_1": 4.5}
    assert rows[1]["Juazeiro"] is None and rows[1]["Petrolina"] == 3.0


def test_schedule(spark, tmp_path):
    f = tmp_path / "scenarios_years.txt"
    f.write_text("2017,2012,2001\n2012,2000,2006\n")
    rows = tables.read_schedule(spark, str(f), slots=3).orderBy("scen").collect()
    assert [tuple(r) for r in rows] == [("scen_01", 2017, 2012, 2001), ("scen_02", 2012, 2000, 2006)]
    f.write_text("b,1,2\na,3,4\n")
    rows = tables.read_schedule(spark, str(f), slots=2, scenario_column=True).orderBy("scen").collect()
    assert [tuple(r) for r in rows] == [("a", 3, 4), ("b", 1, 2)]


def test_schedule_takes_every_year_and_counts_filled_lines(spark, tmp_path):
    f = tmp_path / "long.csv"
    f.write_text("\n\n" + ",".join(str(2000 + i) for i in range(15)) + "\n\n1,2,NA\n")
    rows = tables.read_schedule(spark, str(f)).orderBy("scen").collect()
    assert [r["scen"] for r in rows] == ["scen_01", "scen_02"]
    assert rows[0]["X15"] == 2014 and rows[1]["X2"] == 2 and rows[1]["X3"] is None and rows[1]["X15"] is None
    with pytest.raises(ValueError):
        tables.read_schedule(spark, str(f), slots=13)


def test_wide_series_with_differing_headers_is_refused(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Year,Petrolina,Juazeiro,GLDAS2_0,GLDAS2_1\n1980,1,2,3,4\n" * 1)
    (tmp_path / "b.csv").write_text("Year,Juazeiro,Petrolina,GLDAS2_0,GLDAS2_1\n1981,2,1,3,4\n")
    with pytest.raises(Exception, match="(?i)header"):
        tables.read_wide_series(spark, str(tmp_path)).collect()


def test_scenario_folders_of_numbers_are_text(spark, tmp_path):
    df = spark.createDataFrame([("01", 1.0), ("02", 2.0)], "scenario string, gpp double")
    path = str(tmp_path / "numbers")
    tables.write_by_scenario(df, path)
    assert {r["scenario"] for r in tables.read_panel(spark, path).collect()} == {"01", "02"}
    full = tables.read_panel(spark, path, tables.PANEL_SCHEMA)
    assert {r["scenario"] for r in full.collect()} == {"01", "02"} and "veg_type" in full.columns


def test_grid_files(spark, tmp_path):
    for scen, stamp in (("scen_01", "2003010100"), ("scen_01", "2004013112"), ("scen_02", "2003010106")):
        df = spark.createDataFrame([([1.0, 2.0], [3.0, 4.0], 5)], "GPP array<double>, RAINRATE array<double>, other int")
        (tmp_path / scen).mkdir(exist_ok=True)
        df.coalesce(1).write.parquet(str(tmp_path / scen / f"{stamp}.parquet"))
    # one file per stamp, as a model writes them
    for folder in tmp_path.glob("*/*.parquet"):
        part = next(folder.glob("part-*"))
        part.rename(folder.parent / f"{folder.name.split('.')[0]}.grid_sub")
    got = tables.read_grids(spark, str(tmp_path / "*" / "*.grid_sub"), ["GPP", "RAINRATE"])
    rows = {(r["scenario"], r["ts"]) for r in got.collect()}
    assert rows == {
        ("scen_01", dt.datetime(2003, 1, 1, 0)), ("scen_01", dt.datetime(2004, 1, 31, 12)), ("scen_02", dt.datetime(2003, 1, 1, 6)),
    }
    assert {tuple(r) for r in tables.grid_years(got).collect()} == {("scen_01", 2003), ("scen_01", 2004), ("scen_02", 2003)}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "other" not in plan.split("ReadSchema")[1]


def test_scenario_from_file_name(spark, tmp_path):
    spark.range(1).coalesce(1).write.parquet(str(tmp_path / "in"))
    next((tmp_path / "in").glob("part-*")).rename(tmp_path / "scen_07.nc")
    df = tables.scenario_from_path(spark.read.parquet(str(tmp_path / "scen_07.nc")))
    assert df.first()["scenario"] == "scen_07"


def test_write_and_read_by_scenario(spark, tmp_path):
    df = spark.createDataFrame([("s1", 1, 1.0), ("s1", 2, float("nan")), ("s2", 1, None)], "scenario string, x int, gpp double")
    path = str(tmp_path / "panel")
    tables.write_by_scenario(df, path)
    assert sorted(p.name for p in (tmp_path / "panel").glob("scenario=*")) == ["scenario=s1", "scenario=s2"]
    back = tables.read_panel(spark, path)
    assert {(r["scenario"], r["x"], r["gpp"]) for r in back.collect()} == {("s1", 1, 1.0), ("s1", 2, None), ("s2", 1, None)}
    plan = back.where("scenario = 's1'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(scenario" in plan
    with pytest.raises(Exception, match="already exists"):
        tables.write_by_scenario(df, path)


def test_literal_tables(spark):
    assert {r["Class"]: r["Year"] for r in tables.class_table(spark).collect()}["D1"] == 2012
    rows = tables.variable_pairs(spark, regress.PAIRS).collect()
    assert [r["formula"] for r in rows] == [regress.formula(*p) for p in regress.PAIRS]


def test_reshape_round_trip(spark):
    df = spark.createDataFrame([(1, 1.0, None), (2, None, math.pi)], "id int, a double, b double")
    long = to_long(df, ["id"], ["a", "b"])
    assert long.count() == 4 and long.where("value is null").count() == 2
    back = to_wide(long, ["id"], "variable", ["value"], ["a", "b"])
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    nested = nest(long.where("value is not null"), ["id"], "data", ["variable", "value"])
    assert {(r["id"], r["variable"], r["value"]) for r in unnest(nested, "data").collect()} == {(1, "a", 1.0), (2, "b", math.pi)}
    empty = nested.withColumn("data", F.filter("data", lambda d: d["value"] > 3))
    assert unnest(empty, "data").count() == 1


def test_union_by_name_fills_missing_columns(spark):
    a = spark.createDataFrame([(1, 2.0)], "id int, p double")
    b = spark.createDataFrame([(3,)], "id int")
    rows = {tuple(r) for r in a.unionByName(b, allowMissingColumns=True).collect()}
    assert rows == {(1, 2.0), (3, None)}
