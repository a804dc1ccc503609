"""The composed steps on a small model run with known structure."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelkit.operators import classify, design
from panelkit.plans import study

NX, NY = 8, 6


@pytest.fixture(scope="module")
def panel(spark):
    """Two grids per month for 2003-2012; droughts lower both variables during the impact years."""
    rng = np.random.default_rng(1)
    duration = {r["scenario"]: r["drought_duration"] for r in design.scenario_design(spark).collect()}
    rows = []
    for scenario in ("scen_01", "scen_04", "scen_05", "scen_08", "scen_09"):
        for year in range(2003, 2013):
            hit = 2005 <= year < 2005 + duration[scenario]
            for stamp in (f"{year}-03-01 00:00:00", f"{year}-03-15 12:00:00", f"{year}-10-01 00:00:00"):
                rain = rng.uniform(90, 110, NX * NY) * (0.5 if hit else 1.0)
                gpp = rain * rng.uniform(0.9, 1.1, NX * NY)
                gpp[0] = 5000.0 if year == 2003 else gpp[0]
                rows.append((scenario, stamp, rain.tolist(), gpp.tolist()))
    df = spark.createDataFrame(rows, "scenario string, ts string, RAINRATE array<double>, GPP array<double>")
    setup = spark.range(NX * NY).select(
        (F.col("id") % NX).cast("int").alias("x"),
        F.floor(F.col("id") / NX).cast("int").alias("y"),
        (F.col("id") * 0.1).alias("lat"),
        (F.col("id") * -0.1).alias("lon"),
        F.lit(7).alias("soil_type"),
        (7 + F.col("id") % 4).cast("int").alias("veg_type"),
    )
    monthly = study.monthly_grids(df.withColumn("ts", F.to_timestamp_ntz("ts")), NX)
    return study.yearly_table(monthly, study.cell_table(setup)).cache()


def test_panel(panel):
    assert panel.count() == 5 * 10 * NX * NY
    first = panel.where("x = 0 and y = 0 and time = '2003-01-01' and scenario = 'scen_04'").first()
    # all months of the outlier cell are above the limit
    assert first["gpp"] == 0.0 and 200 < first["precip"] < 400
    assert first["id"] == 1 and first["scen_code"] == "D1-N-2"
    row = panel.where("x = 1 and y = 0").first()
    assert row["id"] == NY + 1


@pytest.fixture(scope="module")
def table(panel):
    return study.metrics_table(panel).cache()


def test_metrics(table):
    assert table.count() == 4 * NX * NY * 2
    assert table.where("scenario = 'scen_01'").count() == 0
    near = table.where("impact is not null").agg(F.avg("impact")).first()[0]
    assert 0.4 < near < 0.6


def test_exploration(table, tmp_path):
    out = study.exploration(table, str(tmp_path))
    assert out["summary"].count() == 6
    assert out["boxes"].count() == 8 * 4
    for (x, y) in study.SCATTERS:
        assert out[f"{y} ~ {x}"].agg(F.sum("count")).first()[0] > 0


def test_regressions(table, tmp_path):
    out = study.regressions(table, n=15, reps=12, workdir=str(tmp_path))
    assert out["coefs"].count() == 6 * 12 * 4
    assert out["band"].count() == 6 * 4 * 100
    assert out["mae"].count() == 24
    assert out["coef_rows"].count() == 4 * 12 * 4 * 2
    assert out["ratios"].count() == 4 * 12 * 4
    assert out["residual_histogram"].select("formula").distinct().count() == 6
    assert out["residual_hexbin"].agg(F.sum("count")).first()[0] == out["residuals"].count()
    assert out["impact_lines"].select("formula").distinct().count() == 2
    assert set(out["impact_lines"].columns) >= {"low", "high"}
    assert "low" not in out["precip_lines"].columns
    for name in ("coef_density", "ratio_density"):
        assert out[name].where("density < 0 or density is null").count() == 0


def test_classes(spark, small):
    from testbed import views as v

    out = study.precipitation_classes(
        v.annual_wide(spark, small),
        v.monthly_wide(spark, small),
        v.chosen_years(v.classified(spark, small)),
        v.SOURCES,
        v.stations(),
        v.REFERENCE,
    )
    assert out["report"].count() >= 7
    assert out["histogram"].agg(F.sum("count")).first()[0] == classify.station_sample(
        out["classified"], v.stations()
    ).count()
    for name in ("series", "months", "month_boxes", "reference_months", "chosen_months", "station_years", "years"):
        assert out[name].columns
