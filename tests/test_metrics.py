"""Hand-computed cases of period labels, states, components and the cohort."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from panelkit.operators import design, metrics, reshape

PANEL = "scenario string, x int, y int, time date, drought_duration int, gpp double, precip double"


def panel(spark, gpp, duration=2, scenario="scen_02", precip=None, x=1):
    """Years 2003-2012 with the given values."""
    precip = precip or [100.0] * 10
    rows = [
        (scenario, x, 1, f"{2003 + i}-01-01", duration, g, p)
        for i, (g, p) in enumerate(zip(gpp, precip, strict=True))
    ]
    df = spark.createDataFrame(rows, PANEL.replace("time date", "time string"))
    return df.withColumn("time", F.to_date("time"))


def gpp_row(spark, gpp, duration=2, **options):
    labelled = design.label_periods(panel(spark, gpp, duration))
    rows = metrics.resilience_metrics(labelled, **options).where("variable = 'gpp'").collect()
    assert len(rows) == 1
    return rows[0]


BASE = [90.0, 100.0, 60.0, 50.0, 80.0, 99.0, 100.0, 100.0, 100.0, 100.0]


def test_labels_equal_the_sequences_of_the_study(spark):
    # fixed values: labels of 2003-2012 for droughts of 4, 3, 2 and 1 years
    b, i, r, n = "baseline", "impact", "recovery", "normal"
    expected = {
        4: [b] * 2 + [i] * 4 + [r] * 4,
        3: [b] * 2 + [i] * 3 + [r] * 4 + [n],
        2: [b] * 2 + [i] * 2 + [r] * 4 + [n] * 2,
        1: [b] * 2 + [i] + [r] * 4 + [n] * 3,
    }
    for duration, labels in expected.items():
        rows = design.label_periods(panel(spark, BASE, duration)).orderBy("time").collect()
        assert [row["period"] for row in rows] == labels
        assert [row["year"] for row in rows] == list(range(2003, 2013))


def test_years_before_start_have_no_period_and_control_is_dropped(spark):
    df = panel(spark, BASE).withColumn("time", F.add_months("time", -24))
    rows = design.label_periods(df).orderBy("time").collect()
    assert [(r["period"], r["year"]) for r in rows[:2]] == [(None, None)] * 2
    assert rows[2]["period"] == "baseline"
    assert design.label_periods(panel(spark, BASE, scenario="scen_01")).count() == 0


def test_components(spark):
    row = gpp_row(spark, BASE)
    assert (row["s_to"], row["s_ti1"], row["ti1"], row["s_ti2"], row["ti2"]) == (100, 50, 2006, 50, 2006)
    assert (row["s_tr"], row["tr"]) == (80, 2007)
    assert row["impact"] == pytest.approx(0.5)
    assert row["recovery"] == pytest.approx(1.6)
    assert row["recovery_base"] == pytest.approx(0.3)
    assert row["recovery_impact"] == pytest.approx(0.6)
    values = BASE[:8]
    mean = sum(values) / 8
    sd = math.sqrt(sum((v - mean) ** 2 for v in values) / 7)
    assert row["stability"] == pytest.approx(sd / mean)


def test_threshold_mode_waits_for_95_percent(spark):
    row = gpp_row(spark, BASE, mode="threshold")
    assert (row["s_tr"], row["tr"]) == (99, 2008)
    never = gpp_row(spark, BASE[:4] + [80.0] * 6, mode="threshold")
    assert never["s_tr"] is None and never["tr"] is None and never["recovery"] is None
    # a missing recovery state triggers no validity rule
    assert never["impact"] == pytest.approx(0.5)
    with pytest.raises(ValueError):
        gpp_row(spark, BASE, mode="other")


@pytest.mark.parametrize("max_duration", [4, None])
def test_tie_takes_the_earliest_year(spark, max_duration):
    row = gpp_row(spark, [90.0, 100.0, 50.0, 50.0] + BASE[4:], max_duration=max_duration)
    assert (row["s_ti1"], row["ti1"]) == (50, 2005)


@pytest.mark.parametrize("max_duration", [4, None])
def test_missing_impact_values_are_skipped_but_not_at_its_end(spark, max_duration):
    row = gpp_row(spark, [90.0, 100.0, 60.0, None] + BASE[4:], max_duration=max_duration)
    assert (row["s_ti1"], row["ti1"]) == (60, 2005)
    assert (row["s_ti2"], row["ti2"]) == (None, 2006)
    assert row["stability"] is None
    empty = gpp_row(spark, [90.0, 100.0, None, None] + BASE[4:], max_duration=max_duration)
    assert (empty["s_ti1"], empty["ti1"]) == (None, None)


def test_validity_rules_clear_all_five_metrics(spark):
    cases = (
        BASE[:4] + [40.0] + BASE[5:],  # recovery below the end of the impact
        [90.0, 100.0, 120.0, 110.0, 130.0] + BASE[5:],  # impact minimum above the baseline
        [90.0, 100.0, 60.0, 110.0, 130.0] + BASE[5:],  # end of impact above the baseline
    )
    for gpp in cases:
        row = gpp_row(spark, gpp)
        assert [row[m] for m in metrics.METRICS] == [None] * 5
        assert row["s_to"] == 100


def test_zero_baseline_and_nan(spark):
    zero = gpp_row(spark, [0.0, 0.0, 0.0, 0.0, 5.0] + BASE[5:])
    assert zero["impact"] is None and zero["recovery"] is None
    ieee = gpp_row(spark, [0.0, 0.0, 0.0, 0.0, 5.0] + BASE[5:], on_zero="ieee")
    assert ieee["recovery"] == math.inf and math.isnan(ieee["impact"])
    row = gpp_row(spark, [90.0, 100.0, float("nan"), 50.0] + BASE[4:])
    assert (row["s_ti1"], row["ti1"], row["stability"]) == (50, 2006, None)


def test_long_impact_raises_unless_any_length_is_allowed(spark):
    labelled = design.label_periods(panel(spark, BASE, duration=5))
    with pytest.raises(Exception, match="max_duration"):
        metrics.resilience_metrics(labelled).collect()
    row = metrics.resilience_metrics(labelled, max_duration=None).where("variable = 'gpp'").first()
    assert (row["s_ti1"], row["ti1"], row["ti2"]) == (50, 2006, 2009)


def test_key_without_labelled_years_has_no_row(spark):
    labelled = design.label_periods(panel(spark, BASE).withColumn("time", F.add_months("time", 120)))
    assert metrics.resilience_metrics(labelled).count() == 0


def test_one_pass_equals_the_separate_operators(spark, small):
    from testbed import views as v

    rows = v.labelled(spark, small)
    base = metrics.baseline_value(rows, v.BASE_YEAR)
    for mode in ("first", "threshold"):
        joined = base
        for part in (
            metrics.impact_min(rows),
            metrics.impact_last(rows),
            metrics.recovery_point(rows, base, mode),
            metrics.stability(rows),
        ):
            joined = joined.join(part, [*metrics.KEYS, "variable"], "full")
        names = [*metrics.KEYS, "variable", *metrics.STATES[:-1]]
        left = joined.select(names)
        right = v.resilience(spark, small, mode).select(names)
        rounded = [F.round(c, 9).alias(c) if c.startswith("s_") else F.col(c) for c in names]
        assert left.select(rounded).exceptAll(right.select(rounded)).count() == 0
        assert right.select(rounded).exceptAll(left.select(rounded)).count() == 0


def test_carried_attributes_equal_the_join(spark, small):
    from testbed import views as v

    joined = metrics.enrich_metrics(v.resilience(spark, small), v.enriched(spark, small))
    carried = v.resilience_carried(spark, small).select(joined.columns)
    names = [F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in joined.dtypes]
    assert joined.select(names).exceptAll(carried.select(names)).count() == 0
    assert joined.count() == carried.count()


def test_plan_has_one_shuffle_and_hash_aggregation(spark, tmp_path):
    path = str(tmp_path / "panel")
    panel(spark, BASE).write.parquet(path)
    labelled = design.label_periods(spark.read.parquet(path))
    plan = metrics.resilience_metrics(labelled)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1
    assert "SortAggregate" not in plan and "Python" not in plan and "Arrow" not in plan
    assert "IsNotNull(scenario)" in plan  # the control filter reaches the scan


COHORT = (
    "id long, scenario string, x int, y int, variable string, stability double, impact double, "
    "recovery double, recovery_base double, recovery_impact double, veg_type int, soil_type int, "
    "drought_duration int, recovery_intensity string"
)


def metric_row(id, variable, impact, veg=7, soil=7, duration=2):
    return (id, "s", id, 1, variable, 0.1, impact, 1.0, 0.2, 0.3, veg, soil, duration, "W1")


def test_cohort_filters_long_rows_and_wide_keeps_the_other_side_null(spark):
    rows = [
        metric_row(1, "gpp", 0.5),
        metric_row(1, "precip", 0.05),
        metric_row(2, "gpp", float("nan")),
        metric_row(2, "precip", 0.2),
        metric_row(3, "gpp", None),
        metric_row(4, "gpp", 0.10),
        metric_row(5, "gpp", 0.5, veg=11),
        metric_row(6, "gpp", 0.5, soil=6),
        metric_row(7, "gpp", 0.5, duration=3),
    ]
    kept = metrics.cohort(spark.createDataFrame(rows, COHORT))
    assert {(r["id"], r["variable"]) for r in kept.collect()} == {(1, "gpp"), (2, "precip")}
    assert {r["veg_type"] for r in kept.collect()} == {"Open Shrublands"}
    assert {r["recovery_order"] for r in kept.collect()} == {1}
    wide = {r["id"]: r for r in reshape.metrics_wide(kept).collect()}
    assert wide[1]["gpp_impact"] == 0.5 and wide[1]["precip_impact"] is None
    assert wide[2]["gpp_impact"] is None and wide[2]["precip_impact"] == 0.2


def test_cohort_conditions_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "metrics")
    spark.createDataFrame([metric_row(1, "gpp", 0.5)], COHORT).write.parquet(path)
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    plan = metrics.cohort(spark.read.parquet(path))._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    for pushed in ("GreaterThan(impact,0.1)", "EqualTo(soil_type,7)", "LessThanOrEqual(drought_duration,2)"):
        assert pushed in plan


def test_long_recoveries_are_refused_or_searched_whole(spark):
    # recovery of six years reaches 95 % of the baseline in the fifth
    gpp = [90.0, 100.0, 60.0, 50.0, 60.0, 70.0, 80.0, 97.0, 98.0, 99.0]
    labelled = design.label_periods(panel(spark, gpp, 1), recovery_len=6)
    base = metrics.baseline_value(labelled)
    point = metrics.recovery_point(labelled, base, "threshold").where("variable = 'gpp'").first()
    assert (point["s_tr"], point["tr"]) == (97.0, 2010)
    found = metrics.resilience_metrics(labelled, mode="threshold", recovery_len=None)
    row = found.where("variable = 'gpp'").first()
    assert (row["s_tr"], row["tr"]) == (97.0, 2010)
    with pytest.raises(Exception, match="recovery_len"):
        metrics.resilience_metrics(labelled, mode="threshold").collect()


def test_nan_is_missing_in_the_single_operators(spark):
    nan = float("nan")
    gpp = [90.0, 100.0, 60.0, 50.0, nan, 96.0, 100.0, 100.0, 100.0, 100.0]
    labelled = design.label_periods(panel(spark, gpp))
    base = metrics.baseline_value(labelled)
    point = metrics.recovery_point(labelled, base, "threshold").where("variable = 'gpp'").first()
    row = gpp_row(spark, gpp, mode="threshold")
    assert (point["s_tr"], point["tr"]) == (row["s_tr"], row["tr"]) == (96.0, 2008)
    assert metrics.stability(labelled).where("variable = 'gpp'").first()["stability"] is None
