"""The queries at the study's own size, at a small one against plain versions, and their plans."""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np
import pytest

from panelkit.operators import regress
from testbed import catalog, views


@pytest.fixture
def few(monkeypatch):
    monkeypatch.setattr(views, "STUDY_REPS", 5)
    monkeypatch.setattr(views, "STUDY_SAMPLE", 40)
    monkeypatch.setattr(views, "STUDY_SHOWN", 30)
    monkeypatch.setattr(views, "STUDY_POINTS", 16)


@pytest.fixture
def drawn(spark, small, few):
    return views.study_sample(spark, small)


def samples(drawn):
    found = defaultdict(list)
    for r in drawn.collect():
        found[r["sample_id"], r["veg_type"]].append(r.asDict())
    return found


def pairs():
    return {regress.formula(d, i): (d, i) for d, i in regress.PAIRS}


def test_draws(spark, small, drawn):
    rows = samples(drawn)
    assert set(rows) == {(s, v) for s in range(1, 6) for v in ("7", "8", "9", "10")}
    counts = defaultdict(int)
    for (_, veg), part in rows.items():
        # line items may share an id, but no row is drawn twice
        assert len({tuple(r.values()) for r in part}) == len(part) == 40
        for r in part:
            counts[veg, r["id"]] += 1
    got = {(r["veg_type"], r["id"]): r["draws"] for r in catalog.study_draws(spark, small).collect()}
    assert got == counts


def test_fits_errors_and_bands(spark, small, drawn):
    rows = samples(drawn)
    fits, errors = {}, defaultdict(list)
    for (s, veg), part in rows.items():
        for name, (dep, ind) in pairs().items():
            x, y = np.array([r[ind] for r in part]), np.array([r[dep] for r in part])
            slope, intercept = np.polyfit(x, y, 1)
            fits[name, s, veg] = intercept, slope
            errors[name, veg] += np.abs(y - intercept - slope * x).tolist()
    got = {(r["formula"], r["sample_id"], r["veg_type"]): r for r in catalog.study_coefs(spark, small).collect()}
    assert set(got) == set(fits)
    for k, (intercept, slope) in fits.items():
        assert math.isclose(got[k]["slope"], slope, abs_tol=1e-4) and math.isclose(got[k]["intercept"], intercept, abs_tol=1e-3)
    for r in catalog.study_mae(spark, small).collect():
        assert math.isclose(r["mae"], np.mean(errors[r["formula"], r["veg_type"]]), rel_tol=1e-4)
    band = catalog.study_band(spark, small).collect()
    assert len(band) == 100 * len(errors)
    for r in band[::37]:
        lines = [fits[r["formula"], s, r["veg_type"]] for s in range(1, 6)]
        low, high = np.quantile([a + b * r["x"] for a, b in lines], [0.025, 0.975])
        assert math.isclose(r["low"], max(low, 0), abs_tol=2e-2) and math.isclose(r["high"], max(high, 0), abs_tol=2e-2)


def test_shown_residuals_and_ratios(spark, small, drawn):
    shown = catalog.study_shown(spark, small).collect()
    counts = defaultdict(int)
    for r in shown:
        counts[r["formula"], r["veg_type"]] += 1
    assert set(counts.values()) == {30} and len(counts) == 4 * len(pairs())
    rows = samples(drawn)
    names = {v: pairs()[k] for k, v in regress.FORMULA_METRICS.items()}
    ratios = catalog.study_ratios(spark, small).collect()
    assert len(ratios) == 20 * len(names)
    for r in ratios:
        dep, ind = names[r["metric"]]
        part = rows[r["sample_id"], r["veg_type"]]
        assert math.isclose(r["median"], np.median([p[dep] / p[ind] for p in part if p[ind]]), rel_tol=1e-6)


def test_densities(spark, small, few):
    for found, by in ((catalog.study_density(spark, small), ("metric", "veg_type")), (catalog.study_coef_density(spark, small), ("metric", "term", "veg_type"))):
        curves = defaultdict(list)
        for r in found.collect():
            curves[tuple(r[c] for c in by)].append((r["x"], r["density"]))
        for curve in curves.values():
            x, y = np.array(sorted(curve)).T
            assert len(x) == 16
            # rounded values; a narrow group of a wide panel may lie between two grid points
            assert (y >= 0).all() and 0.5 < np.trapezoid(y, x) < 1.5


def test_stored_samples_are_not_exchanged(drawn):
    fits = regress.fit_sample(drawn)
    for df in (fits, regress.ratio_median(drawn), regress.sample_residuals(drawn, fits)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Exchange hashpartitioning" not in plan and "SortMergeJoin" not in plan


def test_order_of_study_rows_leaves_no_ties_open(spark, medium):
    rows = views.study_rows(spark, medium)
    repeated = rows.distinct().groupBy("veg_type", *views.STUDY_ORDER).count().where("count > 1")
    assert repeated.count() == 0
