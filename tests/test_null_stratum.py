"""Rows of a NULL stratum keep their residuals, errors and bands."""

from __future__ import annotations

from panelkit.operators import regress

WIDE = "id int, scenario string, sample_id int, veg_type string, gpp_stability double, precip_stability double"


def test_null_stratum_keeps_residuals_and_bands(spark):
    rows = [(i, "s", 1, v, 0.5 * i + 0.1 * (i % 2), 0.1 * i) for v in ("Savannas", None) for i in range(1, 7)]
    sample = spark.createDataFrame(rows, WIDE)
    last = [regress.PAIRS[5]]
    coefs = regress.fit_sample(sample, last)
    long = regress.pair_long(sample, last)
    for found in (regress.sample_residuals(sample, coefs, last), regress.augment(long, coefs)):
        resid = {v: sorted(round(r["resid"], 9) for r in found.collect() if r["veg_type"] == v) for v in ("Savannas", None)}
        assert len(resid[None]) == 6 and resid[None] == resid["Savannas"]
        errors = {r["veg_type"]: round(r["mae"], 9) for r in regress.mae(found).collect()}
        assert set(errors) == {"Savannas", None} and errors[None] == errors["Savannas"]
    band = regress.confidence_band(coefs, regress.x_ranges(long), points=5).collect()
    points = {v: sorted((r["point"], round(r["low"], 9)) for r in band if r["veg_type"] == v) for v in ("Savannas", None)}
    assert len(points[None]) == 5 and points[None] == points["Savannas"]
