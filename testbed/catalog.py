"""Registered queries: one entry per operator of the survey, each over whole driver tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelkit.functions.labels import WIDE_METRICS
from panelkit.operators import classify, design, metrics, profile, quantiles, regress, resample
from panelkit.operators import reshape, rollup
from panelkit.session import keep, new_path, remove_at_end
from panelkit.sources.tables import grid_file_keys, grid_years, pack_by_scenario, read_panel, read_schedule
from panelkit.sources.tables import read_wide_series, replace_scenarios, write_by_scenario
from testbed import views as v

Query = Callable[[SparkSession, str], DataFrame]

DIGITS = 8


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Doubles rounded, so that summation order does not show."""
    doubles = [n for n, t in df.dtypes if t == "double"]
    return df.withColumns({c: F.round(c, digits) for c in doubles}) if doubles else df


def period_labels(spark, sf):
    return v.labelled(spark, sf).select("scenario", "x", "y", "year", "period", "phase_year")


def baseline(spark, sf):
    return rounded(metrics.baseline_value(v.labelled(spark, sf), v.BASE_YEAR))


def impact_min(spark, sf):
    return rounded(metrics.impact_min(v.labelled(spark, sf)))


def impact_last(spark, sf):
    return rounded(metrics.impact_last(v.labelled(spark, sf)))


def recovery_first(spark, sf):
    return rounded(metrics.recovery_point(v.labelled(spark, sf)))


def recovery_threshold(spark, sf):
    rows = v.labelled(spark, sf)
    base = metrics.baseline_value(rows, v.BASE_YEAR)
    return rounded(metrics.recovery_point(rows, base, mode="threshold"))


def stability(spark, sf):
    return rounded(metrics.stability(v.labelled(spark, sf)))


def resilience(spark, sf):
    return rounded(v.resilience(spark, sf))


def resilience_any_length(spark, sf):
    found = metrics.resilience_metrics(
        v.labelled(spark, sf), base_year=v.BASE_YEAR, mode="threshold", recovery_len=None, max_duration=None
    )
    return rounded(found)


def annual_file(spark, sf):
    """The annual series written as a CSV with a header and read back."""
    path = new_path(spark, "csv")
    v.annual_wide(spark, sf).write.csv(path, header=True, nullValue="NA")
    remove_at_end(spark, path)
    schema = "Year INT, " + ", ".join(f"{s} DOUBLE" for s in v.SOURCES)
    return rounded(classify.series_long(read_wide_series(spark, path, schema), ["Year"], v.SOURCES))


def schedule_file(spark, sf):
    """The schedule written without a header, its first field the scenario, and read back."""
    path = new_path(spark, "csv")
    v.schedule(spark, sf).write.csv(path, header=False, nullValue="NA")
    remove_at_end(spark, path)
    return read_schedule(spark, path, slots=7, scenario_column=True)


def panel_written(spark, sf):
    """The panel written by scenario, those with droughts of two years run again, then packed and read back."""
    first, packed = new_path(spark, "panel"), new_path(spark, "panel")
    rows = keep(v.panel(spark, sf))
    write_by_scenario(rows, first)
    remove_at_end(spark, first)
    chosen = v.scenarios(spark, sf).where("drought_duration = 2").select("scenario")
    again = rows.join(chosen, "scenario", "left_semi").withColumn("gpp", F.col("gpp") * 2)
    replace_scenarios(again.select(*rows.columns), first)
    pack_by_scenario(spark, first, packed)
    remove_at_end(spark, packed)
    return rounded(read_panel(spark, packed))


def resilience_threshold(spark, sf):
    return rounded(v.resilience(spark, sf, "threshold"))


def grid_explode(spark, sf):
    grids = v.table(spark, sf, "embeddings").select("vec_id", "label", F.col("embedding").alias("v"))
    cells = rollup.grid_explode(grids, ["v"], nx=8)
    return rounded(cells.withColumn("v", F.col("v").cast("double")))


def grid_monthly(spark, sf):
    daily = v.observations(spark, sf)
    return rounded(rollup.monthly_rollup(daily, ["scenario", "x", "y"], ["precip", "gpp"]))


GPP_LIMIT = 200.0


def outlier_null(spark, sf):
    monthly = rollup.monthly_rollup(v.observations(spark, sf), ["scenario", "x", "y"], ["precip", "gpp"])
    return rounded(rollup.null_outliers(monthly, {"gpp": GPP_LIMIT}))


def yearly_panel(spark, sf):
    daily = v.observations(spark, sf)
    keys = ["scenario", "x", "y"]
    return rounded(rollup.yearly_panel(daily, keys, ["precip", "gpp"], {"gpp": GPP_LIMIT}))


def cell_ids(spark, sf):
    return rollup.cell_id(v.cells(spark, sf).select("x", "y"))


def cell_attributes(spark, sf):
    c = rollup.cell_id(v.cells(spark, sf).drop("id"))
    keys = list(rollup.CELL_KEYS)
    # each table lacks other cells, so none of them has all
    coordinates = c.where("x <> 5").select(*keys, "lat", "lon")
    soil = c.where("x <> 3").select(*keys, "soil_type")
    vegetation = c.where("y % 2 = 0 or x = 3").select(*keys, "veg_type")
    return rounded(rollup.cell_attributes(coordinates, soil, vegetation))


def panel_enriched(spark, sf):
    return rounded(v.enriched(spark, sf))


def design_panel(spark, sf):
    lines = v.table(spark, sf, "lineitem").select(
        F.concat(F.lit("scen_"), F.lpad((F.col("l_suppkey") % 49 + 1).cast("string"), 2, "0")).alias(
            "scenario"
        ),
        "l_quantity",
    )
    sums = lines.groupBy("scenario").agg(F.sum("l_quantity").alias("precip"))
    # 49 rows by construction
    return rounded(sums.join(F.broadcast(design.scenario_design(spark)), "scenario", "left"))


def schedule_long(spark, sf):
    # a year chosen for two classes keeps the first of them
    years = v.chosen_years(v.classified(spark, sf)).groupBy("Year").agg(F.min("Class").alias("Class"))
    return design.schedule_long(v.schedule(spark, sf), years, [f"X{i}" for i in range(1, 8)])


def series_long(spark, sf):
    return rounded(v.series(spark, sf))


def plot_series(spark, sf):
    return rounded(classify.plot_series(v.series(spark, sf), exclude=["error"], min_year=3))


def pooled_quantiles(spark, sf):
    return rounded(quantiles.pooled_quantiles(v.series(spark, sf).where(v.stations()), "Precip", classify.PROBS))


def grouped_quantiles(spark, sf):
    found = quantiles.exact_quantiles(v.observations(spark, sf), "gpp", [0.25, 0.5, 0.9], ["scenario"])
    return rounded(
        found.select(
            "scenario", "n", *[F.col("quantiles")[i].alias(f"q{i}") for i in range(3)]
        )
    )


def classified(spark, sf):
    return rounded(v.classified(spark, sf))


def class_summary(spark, sf):
    return rounded(classify.class_summary(v.classified(spark, sf), v.stations()))


def class_distance(spark, sf):
    return rounded(v.distances(v.classified(spark, sf)))


def class_targets(spark, sf):
    return rounded(classify.class_targets(classify.class_summary(v.classified(spark, sf), v.stations())))


def ecdf_rank(spark, sf):
    rows = v.classified(spark, sf)
    queries = rows.where(F.col("Source") == v.REFERENCE).drop("Condition")
    return rounded(classify.ecdf_rank(queries, "Precip", classify.station_sample(rows, v.stations())))


def year_report(spark, sf):
    rows = v.classified(spark, sf)
    summary = classify.class_summary(rows, v.stations())
    return rounded(
        classify.year_report(
            v.chosen_years(rows),
            classify.class_distance(rows, summary, v.REFERENCE),
            classify.class_targets(summary),
            classify.station_sample(rows, v.stations()),
        )
    )


def year_classes(spark, sf):
    rows = v.classified(spark, sf)
    return rounded(classify.year_classes(v.chosen_years(rows), rows, v.REFERENCE))


def subperiods(spark, sf):
    return rounded(classify.enrich_subperiods(v.subseries(spark, sf), v.classified(spark, sf)))


def highlight(spark, sf):
    rows = v.classified(spark, sf)
    parts = classify.enrich_subperiods(v.subseries(spark, sf), rows)
    return rounded(classify.highlight_series(parts, v.chosen_years(rows), v.REFERENCE))


def station_years(spark, sf):
    rows = v.classified(spark, sf)
    years = classify.year_classes(v.chosen_years(rows), rows, v.REFERENCE)
    return rounded(classify.station_year_classes(rows, years, v.stations()))


def metrics_enriched(spark, sf):
    found = v.resilience(spark, sf)
    return rounded(metrics.enrich_metrics(found, v.enriched(spark, sf)))


def metrics_carried(spark, sf):
    return rounded(v.resilience_carried(spark, sf))


def cohort(spark, sf):
    return rounded(v.cohort(spark, sf))


def metrics_wide(spark, sf):
    return rounded(v.wide(spark, sf))


def summary_stats(spark, sf):
    return rounded(profile.summary_stats(keep(v.wide(spark, sf))))


def summary_transposed(spark, sf):
    return rounded(profile.summary_transposed(keep(v.wide(spark, sf))))


def boxplot_metric(spark, sf):
    rows = profile.metric_boxplot_rows(keep(v.wide(spark, sf)))
    return rounded(profile.boxplot_stats(rows, ["variable", "veg_type"], "value"))


def boxplot_subperiod(spark, sf):
    parts = classify.enrich_subperiods(v.subseries(spark, sf), v.classified(spark, sf))
    rows = keep(parts.where(v.stations()).dropna("any"))
    return rounded(profile.boxplot_stats(rows, ["Month", "Condition"], "Precip"))


def boxplot_outliers(spark, sf):
    return rounded(profile.boxplot_outliers(v.table(spark, sf, "events"), ["event_type"], "value"))


def hexbin(spark, sf):
    return rounded(profile.hexbin(keep(v.wide(spark, sf)), "gpp_impact", "gpp_recovery_base"), 6)


def hexbin_limits(spark, sf):
    found = profile.hexbin(
        v.observations(spark, sf), "precip", "gpp", limits=((5.0, 45.0), (0.0, 80.0)), by=["scenario"]
    )
    return rounded(found, 6)


def histogram(spark, sf):
    rows = v.classified(spark, sf).where(v.stations()).dropna("any")
    return rounded(profile.histogram(rows, "Precip", bins=7))


def histogram_residuals(spark, sf):
    return rounded(profile.histogram(keep(v.residuals(spark, sf)), "resid", by=["formula"]), 6)


def coef_density(spark, sf):
    rows = regress.coef_long(v.coefs(spark, sf))
    found = profile.density_profile(
        rows, ["metric", "term", "veg_type"], "estimate", points=64, panel=["metric", "term"]
    )
    return rounded(found, 6)


def ratio_density(spark, sf):
    rows = regress.ratio_median(v.sample(spark, sf))
    found = profile.density_profile(rows, ["metric", "veg_type"], "median", points=64, panel=["metric"])
    return rounded(found, 6)


def smooth_line(spark, sf):
    found = profile.smooth_line(
        v.residuals(spark, sf), "x", "fitted", ["formula", "veg_type"], {"x": (0.0, 1.0)}, band=True
    )
    return rounded(found, 6)


def smooth_line_raw(spark, sf):
    found = profile.smooth_line(
        v.observations(spark, sf), "precip", "gpp", ["scenario"], {"gpp": (0.0, 80.0)}, band=True
    )
    return rounded(found, 6)


def resample_rows(spark, sf):
    return v.sample(spark, sf).select("sample_id", "veg_type", "id", "scenario")


def resample_panel(spark, sf):
    rows = v.panel(spark, sf)
    drawn = resample.resample(
        rows, "scenario", 25, 8, block=F.col("y"), order=["y", "x", "year"], seed=v.SEED, method="md5"
    )
    return rounded(drawn)


def sample_rows(spark, sf):
    key = ["scenario", "x", "y", "year"]
    return rounded(resample.sample_per_group(v.panel(spark, sf), ["scenario"], 30, key, v.SEED, "md5"))


def residual_sample(spark, sf):
    key = ["formula", "sample_id", "id", "scenario"]
    drawn = resample.sample_per_group(
        keep(v.residuals(spark, sf)), ["formula", "veg_type"], 30, key, v.SEED, "md5"
    )
    return rounded(drawn, 6)


def pair_rows(spark, sf):
    return rounded(regress.pair_long(v.sample(spark, sf)))


def ols_coefs(spark, sf):
    return rounded(v.coefs(spark, sf), 6)


def ols_pairs(spark, sf):
    return rounded(regress.grouped_ols(v.pairs(spark, sf)).drop("r2"), 6)


def ols_scenarios(spark, sf):
    rows = v.observations(spark, sf).select(
        "scenario", "x", "y", F.col("gpp").alias("y_"), F.col("precip").alias("x_")
    )
    pairs = rows.select("scenario", F.col("y_").alias("y"), F.col("x_").alias("x"))
    return rounded(regress.grouped_ols(pairs, ["scenario"]), 6)


def residuals(spark, sf):
    return rounded(v.residuals(spark, sf), 6)


def mae(spark, sf):
    return rounded(regress.mae(v.residuals(spark, sf)), 6)


def coef_long(spark, sf):
    return rounded(regress.coef_long(v.coefs(spark, sf)), 6)


def confidence_band(spark, sf):
    drawn = keep(v.sample(spark, sf))
    ranges = regress.x_ranges(regress.pair_long(drawn))
    return rounded(regress.confidence_band(regress.fit_sample(drawn), ranges), 6)


def ratio_median(spark, sf):
    return rounded(regress.ratio_median(v.sample(spark, sf)))


def study_draws(spark, sf):
    """How often each row is in one of 5,000 replicates of 500 rows of its stratum."""
    return v.study_sample(spark, sf).groupBy("veg_type", "id").agg(F.count("sample_id").alias("draws"))


def study_coefs(spark, sf):
    return rounded(regress.fit_sample(v.study_sample(spark, sf)), 6)


def _study_residuals(spark, sf):
    drawn = v.study_sample(spark, sf)
    return regress.sample_residuals(drawn, regress.fit_sample(drawn))


def study_mae(spark, sf):
    return rounded(regress.mae(_study_residuals(spark, sf)), 6)


def study_shown(spark, sf):
    """The 3,000 residuals of each formula and stratum that the study displays."""
    key = ["formula", "sample_id", "id"]
    drawn = resample.sample_per_group(keep(_study_residuals(spark, sf)), ["formula", "veg_type"], v.STUDY_SHOWN, key, v.SEED)
    return rounded(drawn, 6)


def study_band(spark, sf):
    drawn = v.study_sample(spark, sf)
    ranges = keep(regress.sample_ranges(drawn))
    return rounded(regress.confidence_band(regress.fit_sample(drawn), ranges), 6)


def study_ratios(spark, sf):
    return rounded(regress.ratio_median(v.study_sample(spark, sf)))


def study_density(spark, sf):
    rows = keep(regress.ratio_median(v.study_sample(spark, sf)))
    found = profile.density_profile(rows, ["metric", "veg_type"], "median", points=v.STUDY_POINTS, panel=["metric"])
    return rounded(found, 6)


def study_coef_density(spark, sf):
    rows = keep(regress.coef_long(regress.fit_sample(v.study_sample(spark, sf))))
    found = profile.density_profile(rows, ["metric", "term", "veg_type"], "estimate", points=v.STUDY_POINTS, panel=["metric", "term"])
    return rounded(found, 6)


def yearly_missing(spark, sf):
    """A limit below most monthly sums, so that many years have no value left and become 0."""
    daily = v.observations(spark, sf)
    return rounded(rollup.yearly_panel(daily, ["scenario", "x", "y"], ["precip", "gpp"], {"gpp": 20.0}))


def nested_panel(spark, sf):
    """Yearly values of each cell packed into one row and unpacked again."""
    packed = reshape.nest(v.panel(spark, sf), ["scenario", "x", "y"], "years", ["year", "precip", "gpp"])
    return rounded(reshape.unnest(packed, "years"))


def station_sources(spark, sf):
    """Sums of the sources whose name does not contain the mark of gridded products."""
    rows = v.table(spark, sf, "events").where(classify.is_station("event_type", "c"))
    return rounded(rows.groupBy("event_type").agg(F.sum("value").alias("value")))


def grid_file_years(spark, sf):
    """Scenario and years of the grid files that events would have been written to."""
    name = F.date_format("ts", "yyyyMMddHH")
    path = F.concat(F.lit("file:/grids/scen_"), (F.col("user_id") % 49).cast("string"), F.lit("/"), name, F.lit(".grid"))
    files = v.table(spark, sf, "events").select(path.alias("path"))
    return grid_years(grid_file_keys(files, F.col("path")))


def ecdf_prices(spark, sf):
    """Share of line items that are not dearer, for every distinct price."""
    lines = v.table(spark, sf, "lineitem").select(F.col("l_extendedprice").alias("price"))
    return rounded(quantiles.cumulative_share(lines.distinct(), "price", lines, "price", "share"))


# At the study's own size SQL is too slow; tests/test_study_size.py holds these against plain versions.
STUDY_SIZE: dict[str, Query] = {
    f.__name__: f
    for f in (study_draws, study_coefs, study_mae, study_shown, study_band, study_ratios, study_density, study_coef_density)
}

QUERIES: dict[str, Query] = {
    **STUDY_SIZE,
    "yearly_missing": yearly_missing,
    "nested_panel": nested_panel,
    "station_sources": station_sources,
    "grid_file_years": grid_file_years,
    "ecdf_prices": ecdf_prices,
    "period_labels": period_labels,
    "baseline": baseline,
    "impact_min": impact_min,
    "impact_last": impact_last,
    "recovery_first": recovery_first,
    "recovery_threshold": recovery_threshold,
    "stability": stability,
    "metrics": resilience,
    "metrics_threshold": resilience_threshold,
    "metrics_any_length": resilience_any_length,
    "annual_file": annual_file,
    "schedule_file": schedule_file,
    "panel_written": panel_written,
    "grid_explode": grid_explode,
    "grid_monthly": grid_monthly,
    "outlier_null": outlier_null,
    "yearly_panel": yearly_panel,
    "cell_ids": cell_ids,
    "cell_attributes": cell_attributes,
    "panel_enriched": panel_enriched,
    "design_panel": design_panel,
    "schedule_long": schedule_long,
    "series_long": series_long,
    "plot_series": plot_series,
    "quantiles": pooled_quantiles,
    "grouped_quantiles": grouped_quantiles,
    "classified": classified,
    "class_summary": class_summary,
    "class_distance": class_distance,
    "class_targets": class_targets,
    "ecdf_rank": ecdf_rank,
    "year_report": year_report,
    "year_classes": year_classes,
    "subperiods": subperiods,
    "highlight": highlight,
    "station_years": station_years,
    "metrics_enriched": metrics_enriched,
    "metrics_carried": metrics_carried,
    "cohort": cohort,
    "metrics_wide": metrics_wide,
    "summary_stats": summary_stats,
    "summary_transposed": summary_transposed,
    "boxplot_metric": boxplot_metric,
    "boxplot_subperiod": boxplot_subperiod,
    "boxplot_outliers": boxplot_outliers,
    "hexbin": hexbin,
    "hexbin_limits": hexbin_limits,
    "histogram": histogram,
    "histogram_residuals": histogram_residuals,
    "coef_density": coef_density,
    "ratio_density": ratio_density,
    "smooth_line": smooth_line,
    "smooth_line_raw": smooth_line_raw,
    "resample": resample_rows,
    "resample_panel": resample_panel,
    "sample_rows": sample_rows,
    "residual_sample": residual_sample,
    "pair_rows": pair_rows,
    "ols_coefs": ols_coefs,
    "ols_pairs": ols_pairs,
    "ols_scenarios": ols_scenarios,
    "residuals": residuals,
    "mae": mae,
    "coef_long": coef_long,
    "confidence_band": confidence_band,
    "ratio_median": ratio_median,
}
