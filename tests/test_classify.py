from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from panelkit.functions.labels import CLASS_METRICS
from panelkit.operators import classify

# two stations with values 0..100 in 101 years, and a gridded product
SOURCES = ("A", "B", "GLDAS2_1")


def annual(spark):
    rows = [(1900 + i, float(i), None, 0.5 + i if i % 10 == 0 else None) for i in range(101)]
    return spark.createDataFrame(rows, "Year int, A double, B double, GLDAS2_1 double")


def stations():
    return classify.is_station("Source")


@pytest.fixture(scope="module")
def classified(spark):
    long = classify.series_long(annual(spark), ["Year"], SOURCES)
    return classify.classify_by_quantiles(long, stations()).cache()


def test_long_form_keeps_missing_values(spark):
    assert classify.series_long(annual(spark), ["Year"], SOURCES).count() == 303


def test_class_limits(classified):
    got = {r["Precip"]: r["Condition"] for r in classified.where("Source = 'A'").collect()}
    # cut points 5, 40, 60 and 95
    assert (got[4.0], got[5.0], got[39.0]) == (None, "Dry", "Dry")
    assert (got[40.0], got[60.0]) == ("Normal", "Normal")
    assert (got[61.0], got[95.0], got[96.0]) == ("Wet", "Wet", None)
    assert classified.where("Source = 'B' and Condition is not null").count() == 0


def test_summary_targets_and_distances(classified):
    summary = classify.class_summary(classified, stations())
    values = {r["Condition"]: (r["min"], r["mean"], r["max"]) for r in summary.collect()}
    assert values == {"Dry": (5, 22, 39), "Normal": (40, 50, 60), "Wet": (61, 78, 95)}
    targets = classify.class_targets(summary).collect()
    assert [r["Class"] for r in targets] == ["D1", "D2", "D3", "N", "W1", "W2", "W3"]
    assert [r["Precip"] for r in targets] == [5, 22, 39, 50, 61, 78, 95]
    assert {(r["Condition"], r["Metric"]): r["Class"] for r in targets} == CLASS_METRICS
    rows = {r["Year"]: r for r in classify.class_distance(classified, summary, "GLDAS2_1").collect()}
    assert (rows[1910]["Min_Dif"], rows[1910]["Mean_Dif"], rows[1910]["Max_Dif"]) == (5.5, 11.5, 28.5)
    assert (rows[1940]["Min_Dif"], rows[1940]["Mean_Dif"], rows[1940]["Max_Dif"]) == (None, 9.5, None)
    # 0.5 and 100.5 lie outside the cuts
    assert set(rows) == {1910, 1920, 1930, 1940, 1950, 1960, 1970, 1980, 1990}


def test_sample_is_trimmed_to_classified_years(classified):
    assert classify.station_sample(classified, stations()).count() == 91
    assert classify.station_sample(classified, stations(), trim=False).count() == 101


def test_report(spark, classified):
    summary = classify.class_summary(classified, stations())
    years = spark.createDataFrame([("D1", 1910), ("N", 1950), ("W3", 1990)], "Class string, Year int")
    rows = classify.year_report(
        years,
        classify.class_distance(classified, summary, "GLDAS2_1"),
        classify.class_targets(summary),
        classify.station_sample(classified, stations()),
    ).collect()
    assert [(r["Class"], r["Year"], r["GLDAS"], r["Stations"], r["Metric"]) for r in rows] == [
        ("D1", 1910, 10.5, 5.0, "Min"), ("N", 1950, 50.5, 50.0, "Mean"), ("W3", 1990, 90.5, 95.0, "Max"),
    ]
    # values 5..10, 5..50 and 5..90 of the 91 sample values
    assert [r["Quantile"] for r in rows] == pytest.approx([6 / 91, 46 / 91, 86 / 91])


def test_parts_and_highlight(spark, classified):
    sub = spark.createDataFrame(
        [(1950, "Jan", "GLDAS2_1", 1.0), (1950, "Feb", "GLDAS2_1", None), (1960, "Jan", "GLDAS2_1", 2.0), (1800, "Jan", "A", 3.0)],
        "Year int, Month string, Source string, Precip double",
    )
    parts = classify.enrich_subperiods(sub, classified)
    assert parts.count() == 3  # the year 1800 is unknown, and years without months drop out
    chosen = spark.createDataFrame([("N", 1950)], "Class string, Year int")
    rows = classify.highlight_series(parts, chosen, "GLDAS2_1").collect()
    assert [(r["Year"], r["Month"], r["Class"], r["Condition"]) for r in rows] == [(1950, "Jan", "N", "Normal")]


def test_station_years_have_both_values(spark, classified):
    chosen = spark.createDataFrame([("N", 1950)], "Class string, Year int")
    years = classify.year_classes(chosen, classified, "GLDAS2_1")
    rows = classify.station_year_classes(classified, years, stations()).collect()
    assert len(rows) == 91
    assert {(r["Precip_01"], r["Precip_02"]) for r in rows if r["Class"]} == {(50.0, 50.5)}


def test_plot_series_starts_in_1976_by_default(spark):
    rows = [(y, "A", 1.0) for y in (1974, 1975, 1976)] + [(1980, "A", None), (1980, "G", 1.0)]
    long = spark.createDataFrame(rows, "Year int, Source string, Precip double")
    got = classify.plot_series(long, exclude=["G"]).collect()
    assert [r["Year"] for r in got] == [dt.date(1976, 1, 1)]
    assert classify.plot_series(long, exclude=["G"], min_year=1975).count() == 2


def test_cut_points_enter_the_plan_as_literals(spark):
    long = classify.series_long(annual(spark), ["Year"], SOURCES)
    plan = classify.classify_by_quantiles(long, F.col("Source") == "A")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan
