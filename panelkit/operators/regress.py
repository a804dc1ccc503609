"""Grouped single-predictor regressions over replicates and the products made from them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelkit.functions.semantics import clamp_negative, nan_to_null, ratio
from panelkit.operators.numbering import null_safe_join
from panelkit.operators.quantiles import quantile_of
from panelkit.session import settle

# (dependent, independent); fixed values of the study
PAIRS = (
    ("gpp_recovery_base", "gpp_impact"),
    ("gpp_recovery_impact", "gpp_impact"),
    ("gpp_impact", "precip_impact"),
    ("gpp_recovery_base", "precip_recovery_base"),
    ("gpp_recovery_impact", "precip_recovery_impact"),
    ("gpp_stability", "precip_stability"),
)

STRATUM = "veg_type"
MODEL_KEYS = ("formula", "sample_id", STRATUM)


def formula(dependent: str, independent: str) -> str:
    return f"{dependent} ~ {independent}"


# metric shown for each vegetation-against-precipitation formula; fixed values of the study
FORMULA_METRICS = dict(
    zip(
        [formula(*p) for p in PAIRS[2:]],
        ("Impact", "Recovery[b]", "Recovery[i]", "Stability"),
        strict=True,
    )
)


def pair_long(
    sample: DataFrame,
    pairs: Sequence[tuple[str, str]] = PAIRS,
    ids: Sequence[str] = ("id", "scenario", "sample_id", STRATUM),
    complete: bool = False,
) -> DataFrame:
    """One row per sampled row and formula with ``y`` and ``x``; one pass serves all formulas.

    ``complete=True`` drops rows without both values, which no model uses.
    """
    items = [
        F.struct(
            F.lit(formula(dep, ind)).alias("formula"),
            nan_to_null(F.col(dep)).alias("y"),
            nan_to_null(F.col(ind)).alias("x"),
        )
        for dep, ind in pairs
    ]
    rows = sample.select(*ids, F.inline(F.array(*items)))
    return rows.dropna("any", subset=["y", "x"]) if complete else rows


def grouped_ols(pairs: DataFrame, by: Sequence[str] = MODEL_KEYS) -> DataFrame:
    """Coefficients of ``y ~ x`` per group; incomplete pairs are left out.

    Without spread in ``x`` slope and intercept are NULL.
    """
    rows = pairs.dropna("any", subset=["y", "x"])
    return rows.groupBy(*by).agg(
        F.regr_intercept("y", "x").alias("intercept"),
        F.regr_slope("y", "x").alias("slope"),
        F.regr_count("y", "x").alias("n"),
        F.regr_r2("y", "x").alias("r2"),
    )


def fit_sample(
    sample: DataFrame,
    pairs: Sequence[tuple[str, str]] = PAIRS,
    by: Sequence[str] = ("sample_id", STRATUM),
) -> DataFrame:
    """Coefficients of all formulas straight from the sampled rows.

    Equals :func:`grouped_ols` over :func:`pair_long`, but aggregates each sampled row once for all
    formulas instead of shuffling one row per formula. The line is put together from a covariance, a
    variance and two means, which need half the buffers of slope and intercept. Groups without a
    complete pair have no row.
    """
    aggs, models = [], []
    for i, (dep, ind) in enumerate(pairs):
        y, x = nan_to_null(F.col(dep)), nan_to_null(F.col(ind))
        both = y.isNotNull() & x.isNotNull()
        aggs += [
            F.covar_pop(y, x).alias(f"_c{i}"),
            F.var_pop(F.when(both, x)).alias(f"_v{i}"),
            F.avg(F.when(both, y)).alias(f"_my{i}"),
            F.avg(F.when(both, x)).alias(f"_mx{i}"),
            F.count(F.when(both, 1)).alias(f"_n{i}"),
        ]
        slope = ratio(F.col(f"_c{i}"), F.col(f"_v{i}"))
        models.append(
            F.struct(
                F.lit(formula(dep, ind)).alias("formula"),
                (F.col(f"_my{i}") - slope * F.col(f"_mx{i}")).alias("intercept"),
                slope.alias("slope"),
                F.col(f"_n{i}").alias("n"),
            )
        )
    fits = sample.groupBy(*by).agg(*aggs).select(*by, F.inline(F.array(*models)))
    return fits.where(F.col("n") > 0).select("formula", *by, "intercept", "slope", "n")


def augment(pairs: DataFrame, coefs: DataFrame, by: Sequence[str] = MODEL_KEYS) -> DataFrame:
    """Complete pairs with the fitted value and residual of their model."""
    rows = pairs.dropna("any", subset=["y", "x"])
    joined = null_safe_join(rows, coefs.select(*by, "intercept", "slope"), list(by))
    fitted = F.col("intercept") + F.col("slope") * F.col("x")
    return joined.withColumn("fitted", fitted).withColumn("resid", F.col("y") - F.col("fitted")).drop(
        "intercept", "slope"
    )


def sample_residuals(
    sample: DataFrame,
    coefs: DataFrame,
    pairs: Sequence[tuple[str, str]] = PAIRS,
    ids: Sequence[str] = ("id", "scenario"),
    by: Sequence[str] = ("sample_id", STRATUM),
) -> DataFrame:
    """Complete pairs with fitted value and residual straight from the sampled rows.

    Equals :func:`augment` over :func:`pair_long`, but the models of a sample travel as one row, so each
    sampled row is joined once for all formulas and turned long afterwards. Models are one row for many
    sampled ones: they are counted, and if few are sent to where the sample lies. Each formula has a column
    of its own there, so no name is looked up for a sampled row.
    """
    model = F.struct("intercept", "slope")
    models = coefs.groupBy(*by).agg(
        F.map_from_entries(F.collect_list(F.struct("formula", model))).alias("_models")
    )
    fits = [F.try_element_at("_models", F.lit(formula(*p))).alias(f"_fit{i}") for i, p in enumerate(pairs)]
    models, _ = settle(models.select(*by, *fits))
    names = {c: nan_to_null(F.col(c)).alias(c) for p in pairs for c in p}
    joined = null_safe_join(sample.select(*ids, *by, *names.values()), models, list(by))
    items = []
    for i, (dep, ind) in enumerate(pairs):
        name, fit = F.lit(formula(dep, ind)), F.col(f"_fit{i}")
        complete = F.col(dep).isNotNull() & F.col(ind).isNotNull() & fit.isNotNull()
        fitted = fit["intercept"] + fit["slope"] * F.col(ind)
        row = F.struct(
            name.alias("formula"),
            F.col(dep).alias("y"),
            F.col(ind).alias("x"),
            fitted.alias("fitted"),
            (F.col(dep) - fitted).alias("resid"),
        )
        items.append(F.when(complete, row))
    return joined.select(*ids, *by, F.inline(F.array_compact(F.array(*items))))


def mae(residuals: DataFrame, by: Sequence[str] = ("formula", STRATUM)) -> DataFrame:
    """Mean absolute residual over all replicates."""
    return residuals.groupBy(*by).agg(F.avg(F.abs("resid")).alias("mae"))


def x_ranges(pairs: DataFrame, by: Sequence[str] = ("formula", STRATUM)) -> DataFrame:
    """Range of the independent variable over the complete pairs."""
    rows = pairs.dropna("any", subset=["y", "x"])
    return rows.groupBy(*by).agg(F.min("x").alias("min"), F.max("x").alias("max"))


def sample_ranges(
    sample: DataFrame, pairs: Sequence[tuple[str, str]] = PAIRS, by: Sequence[str] = (STRATUM,)
) -> DataFrame:
    """Equals :func:`x_ranges` over :func:`pair_long`, from one aggregation over the sampled rows."""
    aggs, ranges = [], []
    for i, (dep, ind) in enumerate(pairs):
        x = F.when(nan_to_null(F.col(dep)).isNotNull(), nan_to_null(F.col(ind)))
        aggs += [F.min(x).alias(f"_lo{i}"), F.max(x).alias(f"_hi{i}")]
        ranges.append(F.struct(F.lit(formula(dep, ind)).alias("formula"), F.col(f"_lo{i}").alias("min"), F.col(f"_hi{i}").alias("max")))
    found = sample.groupBy(*by).agg(*aggs).select(*by, F.inline(F.array(*ranges)))
    return found.where(F.col("min").isNotNull()).select("formula", *by, "min", "max")


def confidence_band(
    coefs: DataFrame,
    ranges: DataFrame,
    points: int = 100,
    probs: tuple[float, float] = (0.025, 0.975),
    by: Sequence[str] = ("formula", STRATUM),
) -> DataFrame:
    """Quantiles of all replicate predictions on an even grid over the range of ``x``; never negative.

    The lines of a group are one packed array, as many as there are replicates, which is a parameter. It
    goes to each grid point, where the lines are evaluated and put in order, so no prediction is a row.
    """
    lines = coefs.groupBy(*by).agg(F.collect_list(F.struct("intercept", "slope")).alias("_lines"))
    grid = null_safe_join(lines, ranges, list(by))
    # a handful of (formula, stratum) pairs: spread the grid points before they are worked on
    grid = grid.withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).repartition(*by, "point")
    at = F.col("min") + (F.col("max") - F.col("min")) * F.col("point") / (points - 1)
    values = F.transform("_lines", lambda line: line["intercept"] + line["slope"] * F.col("_at"))
    ordered = grid.withColumn("_at", at).withColumn("_fitted", F.sort_array(F.filter(values, lambda v: v.isNotNull())))
    low, high = (clamp_negative(quantile_of(F.col("_fitted"), p)) for p in probs)
    return ordered.select(*by, "point", F.col("_at").alias("x"), low.alias("low"), high.alias("high"))


def coef_long(coefs: DataFrame, metrics: Mapping[str, str] = FORMULA_METRICS) -> DataFrame:
    """Intercept and slope rows with the metric name, for the formulas in ``metrics``."""
    name = F.col("formula")
    label = F.lit(None).cast("string")
    for text, metric in metrics.items():
        label = F.when(name == text, metric).otherwise(label)
    terms = F.array(
        F.struct(F.lit("Intercept").alias("term"), F.col("intercept").alias("estimate")),
        F.struct(F.lit("Slope").alias("term"), F.col("slope").alias("estimate")),
    )
    chosen = coefs.where(name.isin(*metrics))
    return chosen.select("sample_id", STRATUM, label.alias("metric"), F.inline(terms))


def ratio_median(
    sample: DataFrame,
    metrics: Mapping[str, str] = FORMULA_METRICS,
    pairs: Sequence[tuple[str, str]] = PAIRS,
    on_zero: str = "null",
) -> DataFrame:
    """Median of dependent over independent value per replicate and stratum, for complete pairs.

    A group holds one sample, so its size is a parameter; all formulas share one pass over the rows.
    """
    shown = [(d, i) for d, i in pairs if formula(d, i) in metrics]
    aggs, medians = [], []
    for k, (dep, ind) in enumerate(shown):
        quotient = ratio(nan_to_null(F.col(dep)), nan_to_null(F.col(ind)), on_zero)
        aggs.append(F.sort_array(F.collect_list(quotient)).alias(f"_a{k}"))
        medians.append(
            F.struct(
                F.lit(metrics[formula(dep, ind)]).alias("metric"),
                F.size(f"_a{k}").alias("_size"),
                quantile_of(F.col(f"_a{k}"), 0.5).alias("median"),
            )
        )
    packed = sample.groupBy("sample_id", STRATUM).agg(*aggs)
    rows = packed.select("sample_id", STRATUM, F.inline(F.array(*medians))).where(F.col("_size") > 0)
    return rows.select("sample_id", STRATUM, "median", "metric")
