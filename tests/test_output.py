"""Tables of which single scenarios are replaced, and files packed to a size."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from panelkit.sources import tables


def written(spark, path, files=1):
    rows = [(s, i, float(i)) for s in ("s1", "s2", "10", None) for i in range(40 if s == "s1" else 5)]
    df = spark.createDataFrame(rows, "scenario string, x int, gpp double")
    # round-robin pieces, so that every scenario has many small files
    df.repartition(files).write.partitionBy("scenario").parquet(path)
    return df


def rows(df):
    return sorted((tuple(r) for r in df.select("scenario", "x", "gpp").collect()), key=str)


def test_one_scenario_is_replaced(spark, tmp_path):
    path = str(tmp_path / "panel")
    df = written(spark, path)
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "panel").glob("scenario=s1/*.parquet")}
    tables.replace_scenarios(df.where("scenario = 's2' and x < 2").withColumn("gpp", F.lit(-1.0)), path)
    expected = df.where("coalesce(scenario, '') <> 's2'").union(
        spark.createDataFrame([("s2", 0, -1.0), ("s2", 1, -1.0)], df.schema)
    )
    assert rows(tables.read_panel(spark, path)) == rows(expected)
    assert before == {p: p.stat().st_mtime_ns for p in (tmp_path / "panel").glob("scenario=s1/*.parquet")}
    # without rows nothing is replaced, a new scenario is added, and the NULL one is a scenario too
    tables.replace_scenarios(df.limit(0), path)
    assert rows(tables.read_panel(spark, path)) == rows(expected)
    more = spark.createDataFrame([("s3", 1, 3.0), (None, 7, 7.0)], df.schema)
    tables.replace_scenarios(more, path)
    assert rows(tables.read_panel(spark, path)) == rows(expected.where("scenario is not null").union(more))


@pytest.mark.parametrize("file_bytes", [900, 3000, 1 << 30])
def test_files_are_packed(spark, tmp_path, file_bytes):
    source, path = str(tmp_path / "panel"), str(tmp_path / "packed")
    df = written(spark, source, files=8)
    sizes = {r["scenario"]: r for r in tables.scenario_files(spark, source).collect()}
    assert sum(r["files"] for r in sizes.values()) > len(sizes)
    tables.pack_by_scenario(spark, source, path, file_bytes)
    assert rows(tables.read_panel(spark, path)) == rows(df)
    for scenario, r in sizes.items():
        name = "__HIVE_DEFAULT_PARTITION__" if scenario is None else scenario
        found = list((tmp_path / "packed" / f"scenario={name}").glob("*.parquet"))
        # a file that no row is dealt to is not written
        assert 1 <= len(found) <= max(1, -(-r["bytes"] // file_bytes))
    with pytest.raises(Exception, match="already exists"):
        tables.pack_by_scenario(spark, source, path)


def test_repeated_rows_are_packed(spark, tmp_path):
    df = spark.createDataFrame([("s", 1, None)] * 20, "scenario string, x int, gpp double")
    source, path = str(tmp_path / "panel"), str(tmp_path / "packed")
    tables.write_by_scenario(df, source)
    tables.pack_by_scenario(spark, source, path)
    assert rows(tables.read_panel(spark, path)) == rows(df)
