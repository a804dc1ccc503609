"""The six steps of the study. Each one takes and returns DataFrames and can be run on its own.

Steps hand over tables. Pass ``workdir`` (a folder all executors reach) to write the tables that several
results read, so that they are computed once; without it they are recomputed per result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelkit.functions.labels import METRIC_ORDER, VARIABLES, ordinal
from panelkit.operators import classify, design, metrics, profile, regress, resample, reshape, rollup
from panelkit.sources.tables import store

# axis limits of the study's plots; fixed values
SCATTERS = {
    ("gpp_impact", "gpp_recovery_base"): None,
    ("gpp_impact", "gpp_recovery_impact"): None,
    ("precip_recovery_base", "gpp_recovery_base"): ((-0.01, 3.5), (-0.01, 3.5)),
    ("precip_recovery_impact", "gpp_recovery_impact"): ((-0.1, 13.0), (-0.1, 13.0)),
    ("precip_impact", "gpp_impact"): ((0.0, 1.0), (0.0, 1.0)),
    ("precip_stability", "gpp_stability"): ((0.0, 1.0), (0.0, 1.0)),
}
LINE_LIMITS = dict(zip([regress.formula(*p) for p in regress.PAIRS[2:]], (1.0, 2.5, 12.5, 1.0), strict=True))
UNPLOTTED = ("GLDAS2_0",)
GPP_OUTLIER = 2000.0
REPLICATES, SAMPLE_SIZE, SEED, RESIDUALS_SHOWN = 5000, 500, 2021, 3000


def _kept(df: DataFrame, workdir: str | None, name: str) -> DataFrame:
    return df if workdir is None else store(df, f"{workdir}/{name}")


def precipitation_classes(
    annual: DataFrame,
    monthly: DataFrame,
    class_years: DataFrame,
    sources: Sequence[str],
    stations: Column,
    reference: str,
    workdir: str | None = None,
) -> dict[str, DataFrame]:
    """Classify the years of all sources by the station quantiles and describe the chosen years."""
    long = classify.series_long(annual, ["Year"], sources)
    classified = _kept(classify.classify_by_quantiles(long, stations), workdir, "classified")
    summary = classify.class_summary(classified, stations)
    distances = classify.class_distance(classified, summary, reference)
    targets = classify.class_targets(summary)
    years = classify.year_classes(class_years, classified, reference)
    parts = classify.enrich_subperiods(
        classify.series_long(monthly, ["Year", "Month"], sources), classified
    )
    return {
        "series": classify.plot_series(long, exclude=UNPLOTTED),
        "classified": classified,
        "summary": summary,
        "distances": distances,
        "targets": targets,
        "years": years,
        "report": classify.year_report(
            class_years, distances, targets, classify.station_sample(classified, stations)
        ),
        "months": parts,
        "month_boxes": profile.boxplot_stats(
            parts.where(stations).dropna("any"), ["Month", "Condition"], "Precip"
        ),
        "reference_months": parts.where(F.col("Source") == reference).dropna("any"),
        "chosen_months": classify.highlight_series(parts, class_years, reference),
        "histogram": profile.histogram(classified.where(stations).dropna("any"), "Precip", bins=7),
        "station_years": classify.station_year_classes(classified, years, stations),
    }


def monthly_grids(grids: DataFrame, nx: int, values: Sequence[str] = ("RAINRATE", "GPP")) -> DataFrame:
    """Gridded model output (one array per variable and time) to monthly sums per scenario and cell."""
    cells = rollup.grid_explode(grids.select("scenario", "ts", *values), values, nx)
    return rollup.monthly_rollup(cells, ["scenario", "x", "y"], values)


def cell_table(setup: DataFrame) -> DataFrame:
    """Cell attributes with ids from the setup grid (``x, y, lat, lon, soil_type, veg_type``)."""
    numbered = rollup.cell_id(setup.select("x", "y", "lat", "lon", "soil_type", "veg_type"))
    return numbered.select(*rollup.CELL_KEYS, "lat", "lon", "soil_type", "veg_type")


def yearly_table(monthly: DataFrame, cells: DataFrame, limit: float = GPP_OUTLIER) -> DataFrame:
    """Monthly sums to the yearly panel with scenario factors and cell attributes."""
    named = monthly.withColumnsRenamed({"RAINRATE": "precip", "GPP": "gpp"})
    cleaned = rollup.null_outliers(named, {"gpp": limit})
    yearly = rollup.yearly_rollup(cleaned, ["scenario", "x", "y"], ["precip", "gpp"])
    # 49 scenarios by construction
    scenarios = F.broadcast(design.scenario_design(monthly.sparkSession))
    return rollup.enrich_panel(yearly, scenarios, cells)


def metrics_table(panel: DataFrame, mode: str = "first") -> DataFrame:
    """Yearly panel to resilience metrics with all attributes, in one shuffle."""
    return metrics.resilience_metrics(
        design.label_periods(panel), mode=mode, carry=metrics.DIMENSIONS, variables=VARIABLES
    )


def exploration(table: DataFrame, workdir: str | None = None) -> dict[str, DataFrame]:
    """Summary table, scatter densities and boxplots of the cohort."""
    wide = _kept(reshape.metrics_wide(metrics.cohort(table)), workdir, "metrics_wide")
    out = {
        "wide": wide,
        "summary": profile.summary_transposed(wide),
        "boxes": profile.boxplot_stats(
            profile.metric_boxplot_rows(wide), ["variable", "veg_type"], "value"
        ),
    }
    for (x, y), limits in SCATTERS.items():
        out[f"{y} ~ {x}"] = profile.hexbin(wide, x, y, limits=limits)
    return out


def regressions(
    table: DataFrame,
    n: int = SAMPLE_SIZE,
    reps: int = REPLICATES,
    seed: int = SEED,
    workdir: str | None = None,
) -> dict[str, DataFrame]:
    """Replicated regressions of the cohort: bands, errors, coefficients, ratios and fitted lines."""
    wide = _kept(reshape.metrics_wide(metrics.cohort(table)), workdir, "cohort_wide")
    drawn = resample.resample(
        wide, "veg_type", n, reps, F.floor(F.col("id") / 64), ["id", "scenario"], seed
    )
    drawn = _kept(drawn, workdir, "sample")
    coefs = _kept(regress.fit_sample(drawn), workdir, "coefs")
    pairs = regress.pair_long(drawn, complete=True)
    residuals = _kept(regress.sample_residuals(drawn, coefs), workdir, "residuals")
    shown = resample.sample_per_group(
        residuals,
        ["formula", "veg_type"],
        RESIDUALS_SHOWN,
        ["formula", "sample_id", "id", "scenario"],
        seed,
    )
    shown = _kept(shown, workdir, "residuals_shown")
    coef_rows, ratios = regress.coef_long(coefs), regress.ratio_median(drawn)
    first = [regress.formula(*p) for p in regress.PAIRS[:2]]
    limit = F.lit(None).cast("double")
    for text, top in LINE_LIMITS.items():
        limit = F.when(F.col("formula") == text, F.lit(top)).otherwise(limit)
    clipped = residuals.where(
        F.col("formula").isin(*LINE_LIMITS) & F.col("x").between(0, limit) & F.col("fitted").between(0, limit)
    )
    band = regress.confidence_band(coefs, regress.x_ranges(pairs))
    # the axis limits cut the bands drawn with the lines; formulas without limits keep theirs
    shown_band = limit.isNull() | (
        F.col("x").between(0, limit) & F.col("low").between(0, limit) & F.col("high").between(0, limit)
    )
    by = ["formula", "veg_type"]
    return {
        "coefs": coefs,
        "residuals": residuals,
        "band": band,
        "band_shown": band.where(shown_band),
        "mae": regress.mae(residuals),
        "coef_rows": coef_rows.withColumn("metric_order", ordinal(F.col("metric"), METRIC_ORDER)),
        "ratios": ratios,
        "residual_histogram": profile.histogram(shown, "resid", by=["formula"]),
        "residual_hexbin": profile.hexbin(shown, "fitted", "resid", by=["formula"]),
        "impact_lines": profile.smooth_line(
            residuals.where(F.col("formula").isin(*first)), "x", "fitted", by, {"x": (0.0, 1.0)}, band=True
        ),
        "precip_lines": profile.smooth_line(clipped, "x", "fitted", by),
        "coef_density": profile.density_profile(
            coef_rows, ["metric", "term", "veg_type"], "estimate", panel=["metric", "term"]
        ),
        "ratio_density": profile.density_profile(
            ratios, ["metric", "veg_type"], "median", panel=["metric"]
        ),
    }
