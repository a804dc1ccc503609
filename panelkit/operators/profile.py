"""Distribution summaries: statistics tables, boxplot numbers, bins, densities and fitted lines."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelkit.functions.labels import WIDE_METRICS
from panelkit.functions.semantics import nan_to_null
from panelkit.operators.numbering import null_safe_join
from panelkit.operators.quantiles import _match, exact_quantiles
from panelkit.operators.reshape import to_long, to_wide
from panelkit.session import settle

STATISTICS = ("n", "min", "mean", "median", "max", "sd")


def _present(df: DataFrame, *columns: str) -> DataFrame:
    """Rows where all columns have a value; NaN counts as missing."""
    cleaned = df.withColumns({c: nan_to_null(F.col(c).cast("double")) for c in columns})
    return cleaned.dropna("any", subset=list(columns))


def _with_stats(df: DataFrame, by: Sequence[str], aggs: dict[str, Column]) -> DataFrame:
    """Add per-group aggregates as columns.

    Without groups they are one row, read as a scalar subquery. With groups the table of aggregates is
    joined by broadcast if its row count is small, else by a shuffle.
    """
    if not by:
        packed = F.struct(*[c.alias(n) for n, c in aggs.items()])
        one = df.agg(packed.alias("s")).scalar()
        return df.withColumns({n: one[n] for n in aggs})
    stats, _ = settle(df.groupBy(*by).agg(*[c.alias(n) for n, c in aggs.items()]))
    return _match(df, stats, by, "inner")


def summary_stats(
    df: DataFrame, columns: Sequence[str] = WIDE_METRICS, digits: int | None = None
) -> DataFrame:
    """``variable, n, min, mean, median, max, sd`` of each column, missing values left out."""
    long = _present(to_long(df, [], columns), "value")
    plain = long.groupBy("variable").agg(
        F.count("value").alias("n"),
        F.min("value").alias("min"),
        F.avg("value").alias("mean"),
        F.max("value").alias("max"),
        F.stddev_samp("value").alias("sd"),
    )
    # at most one row per column of the table
    medians = exact_quantiles(long, "value", [0.5], ["variable"])
    medians = medians.select("variable", F.col("quantiles")[0].alias("median"))
    out = plain.join(F.broadcast(medians), "variable").select("variable", *STATISTICS)
    if digits is not None:
        out = out.withColumns({s: F.round(s, digits) for s in STATISTICS[1:]})
    return out


def summary_transposed(
    df: DataFrame, columns: Sequence[str] = WIDE_METRICS, digits: int | None = None
) -> DataFrame:
    """The summary table with one row per statistic and one column per variable."""
    stats = summary_stats(df, columns, digits).withColumn("n", F.col("n").cast("double"))
    long = to_long(stats, ["variable"], STATISTICS, "metric", "value")
    return to_wide(long, ["metric"], "variable", ["value"], columns)


def boxplot_stats(df: DataFrame, by: Sequence[str], value: str, coef: float = 1.5) -> DataFrame:
    """Numbers of one boxplot per group: quartiles, whiskers, mean and the count of outliers.

    A whisker ends at the most extreme value within ``coef`` interquartile ranges of the box.
    """
    fenced = _fenced(df, by, value, coef)
    inside = (F.col(value) >= F.col("_low")) & (F.col(value) <= F.col("_high"))
    return fenced.groupBy(*by, "q1", "median", "q3").agg(
        F.count(value).alias("n"),
        F.avg(value).alias("mean"),
        F.least("q1", F.min(F.when(inside, F.col(value)))).alias("whisker_low"),
        F.greatest("q3", F.max(F.when(inside, F.col(value)))).alias("whisker_high"),
        F.count(F.when(~inside, 1)).alias("outliers"),
    )


def boxplot_outliers(df: DataFrame, by: Sequence[str], value: str, coef: float = 1.5) -> DataFrame:
    """Rows beyond the whiskers."""
    fenced = _fenced(df, by, value, coef)
    return fenced.where((F.col(value) < F.col("_low")) | (F.col(value) > F.col("_high"))).select(
        *by, value
    )


def _fenced(df: DataFrame, by: Sequence[str], value: str, coef: float) -> DataFrame:
    rows = _present(df.select(*by, value), value)
    quartiles = exact_quantiles(rows, value, [0.25, 0.5, 0.75], by)
    q = F.col("quantiles")
    boxes, _ = settle(quartiles.select(*by, q[0].alias("q1"), q[1].alias("median"), q[2].alias("q3")))
    reach = coef * (F.col("q3") - F.col("q1"))
    return _match(rows, boxes, by, "inner").withColumns(
        {"_low": F.col("q1") - reach, "_high": F.col("q3") + reach}
    )


def metric_boxplot_rows(wide: DataFrame, ids: Sequence[str] = ("id", "scenario", "veg_type")) -> DataFrame:
    """Long metrics of the rows that are complete in every metric; the plain recovery is left out."""
    complete = wide.select(*ids, *WIDE_METRICS).dropna("any")
    long = to_long(complete, ids, WIDE_METRICS)
    return long.where(~F.col("variable").isin("gpp_recovery", "precip_recovery"))


def within(df: DataFrame, limits: dict[str, tuple[float, float]]) -> DataFrame:
    """Axis limits as a row filter: rows outside leave the statistic."""
    for c, (low, high) in limits.items():
        df = df.where(F.col(c).between(low, high))
    return df


def hexbin(
    df: DataFrame,
    x: str,
    y: str,
    bins: int = 30,
    limits: tuple[tuple[float, float], tuple[float, float]] | None = None,
    by: Sequence[str] = (),
) -> DataFrame:
    """Counts per hexagon: ``x, y`` of the centre and ``count``.

    Hexagon centres form two rectangular lattices, the second shifted by half a step both ways; a point
    belongs to the nearer of its candidates (Carr et al. 1987). The step is the axis range divided by
    ``bins``, and the lattice starts at the data minimum rounded down to a whole step.
    """
    rows = _present(df.select(*by, F.col(x).alias("_x"), F.col(y).alias("_y")), "_x", "_y")
    if limits is not None:
        rows = within(rows, {"_x": limits[0], "_y": limits[1]})
    rows = _with_stats(
        rows,
        by,
        {"_x0": F.min("_x"), "_x1": F.max("_x"), "_y0": F.min("_y"), "_y1": F.max("_y")},
    )
    rise = math.sqrt(3.0)
    placed = {}
    for axis, lim in (("x", 0), ("y", 1)):
        low, high = F.col(f"_{axis}0"), F.col(f"_{axis}1")
        span = high - low if limits is None else F.lit(float(limits[lim][1] - limits[lim][0]))
        # without any spread all points share one step
        step = F.when(span > 0, span / bins).otherwise(1.0)
        placed[f"_{axis}w"] = step
        placed[f"_{axis}b"] = F.floor(low / step) * step - 1e-6
    rows = rows.withColumns(placed).withColumns(
        {
            "_u": (F.col("_x") - F.col("_xb")) / F.col("_xw"),
            "_w": (F.col("_y") - F.col("_yb")) / (F.col("_yw") * rise),
        }
    )
    u, w = F.col("_u"), F.col("_w")
    near_u, near_w = F.floor(u + 0.5), F.floor(w + 0.5)
    mid_u, mid_w = F.floor(u) + 0.5, F.floor(w) + 0.5
    first = (u - near_u) * (u - near_u) + 3 * (w - near_w) * (w - near_w)
    second = (u - mid_u) * (u - mid_u) + 3 * (w - mid_w) * (w - mid_w)
    on_first = first <= second
    cells = rows.select(
        *by,
        "_xw",
        "_xb",
        "_yw",
        "_yb",
        F.when(on_first, 2 * near_u).otherwise(2 * F.floor(u) + 1).alias("_i"),
        F.when(on_first, 2 * near_w).otherwise(2 * F.floor(w) + 1).alias("_j"),
    )
    constant = [F.max(c).alias(c) for c in ("_xw", "_xb", "_yw", "_yb")]
    counts = cells.groupBy(*by, "_i", "_j").agg(F.count(F.lit(1)).alias("count"), *constant)
    return counts.select(
        *by,
        (F.col("_xb") + F.col("_i") / 2 * F.col("_xw")).alias("x"),
        (F.col("_yb") + F.col("_j") / 2 * F.col("_yw") * rise).alias("y"),
        "count",
    )


def histogram(df: DataFrame, value: str, bins: int = 30, by: Sequence[str] = ()) -> DataFrame:
    """Counts per bin: ``xmin, xmax, count``; bins without rows are left out.

    The bin width is the range divided by ``bins - 1`` and bin borders lie half a width off its
    multiples, so bins are centred on multiples of the width; bins are closed on the right. A value that
    exceeds a border by less than 1e-8 widths counts as on the border.
    """
    rows = _present(df.select(*by, F.col(value).alias("_v")), "_v")
    rows = _with_stats(rows, by, {"_lo": F.min("_v"), "_hi": F.max("_v")})
    span = F.col("_hi") - F.col("_lo")
    width = F.when(span > 0, span / max(bins - 1, 1)).otherwise(1.0)
    half = F.lit(0.5) * F.col("_w")
    start = F.floor((F.col("_lo") - half) / F.col("_w")) * F.col("_w") + half
    if bins == 1:
        start = F.col("_lo")
    placed = rows.withColumn("_w", width).withColumn("_start", start)
    index = F.ceil((F.col("_v") - F.col("_start")) / F.col("_w") - 1e-8) - 1
    counts = (
        placed.withColumn("_i", F.greatest(index, F.lit(0)))
        .groupBy(*by, "_i")
        .agg(F.count(F.lit(1)).alias("count"), F.max("_w").alias("_w"), F.max("_start").alias("_start"))
    )
    left = F.col("_start") + F.col("_i") * F.col("_w")
    return counts.select(*by, left.alias("xmin"), (left + F.col("_w")).alias("xmax"), "count")


def density_profile(
    df: DataFrame,
    by: Sequence[str],
    value: str,
    points: int = 512,
    panel: Sequence[str] | None = None,
    tails: tuple[float, float] = (0.025, 0.975),
) -> DataFrame:
    """Gaussian kernel density of each group on an even grid, with two quantile lines.

    The bandwidth is ``0.9 min(sd, IQR / 1.34) n^(-1/5)``. With ``panel`` (a subset of ``by``) the groups
    of a panel share the mean of their bandwidths and one grid, which reaches three bandwidths past the
    data. Every value is first split over its two neighbouring grid points. A group's weights are then one
    array, which is convolved with a table of the kernel by distance: nothing is truncated, and no pair of
    grid points becomes a row.

    Meant for replicate statistics: a group holds one value per replicate, so its size is a parameter
    and its quantiles may be computed in one task. Groups are aggregated first, panels from the groups,
    and both are joined back, so a panel's rows never meet in one task.
    """
    panel = list(by if panel is None else panel)
    rows = _present(df.select(*by, F.col(value).alias("_v")), "_v")
    groups = rows.groupBy(*by).agg(
        F.percentile("_v", F.array(*[F.lit(p) for p in (0.25, 0.75, *tails)])).alias("_q"),
        F.count("_v").alias("_n"),
        F.stddev_samp("_v").alias("_sd"),
        F.min("_v").alias("_lo"),
        F.max("_v").alias("_hi"),
    )
    spread = F.least("_sd", (F.col("_q")[1] - F.col("_q")[0]) / 1.34)
    scale = F.coalesce(
        F.nullif(spread, F.lit(0.0)),
        F.nullif(F.col("_sd"), F.lit(0.0)),
        # only reached where all values of a group are equal
        F.nullif(F.abs("_lo"), F.lit(0.0)),
        F.lit(1.0),
    )
    groups = groups.withColumn("_bw", 0.9 * scale * F.pow(F.col("_n").cast("double"), F.lit(-0.2)))
    groups, _ = settle(groups.drop("_sd"))
    panels = groups.groupBy(*panel).agg(
        F.avg("_bw").alias("_bw"), F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi")
    )
    shared = null_safe_join(groups.drop("_bw", "_lo", "_hi"), panels, panel)
    low, high = F.col("_lo") - 3 * F.col("_bw"), F.col("_hi") + 3 * F.col("_bw")
    shared = shared.withColumns({"_from": low, "_d": (high - low) / (points - 1)})
    # the kernel at each distance of grid points, once for a group
    z = F.col("_d") / F.col("_bw")
    kernel = F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda k: F.exp(-0.5 * (k * z) * (k * z)))
    shared, _ = settle(shared.withColumn("_kernel", kernel))
    rows = null_safe_join(rows, shared.select(*by, "_from", "_d"), by)
    at = (F.col("_v") - F.col("_from")) / F.col("_d")
    split = F.array(
        F.struct(F.floor("_at").cast("int").alias("i"), (1 - F.col("_at") + F.floor("_at")).alias("w")),
        F.struct((F.floor("_at") + 1).cast("int").alias("i"), (F.col("_at") - F.floor("_at")).alias("w")),
    )
    weights = rows.withColumn("_at", at).select(*by, F.inline(split)).where(F.col("w") > 0)
    weights = weights.groupBy(*by, "i").agg(F.sum("w").alias("w"))
    # at most one entry for each grid point
    packed = weights.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("i", "w"))).alias("_w"))
    scale = F.col("_n") * F.col("_bw") * math.sqrt(2 * math.pi)

    def density(g: Column) -> Column:
        return F.aggregate("_w", F.lit(0.0), lambda s, e: s + e["w"] * F.get("_kernel", F.abs(g - e["i"])))

    values = F.transform(F.sequence(F.lit(0), F.lit(points - 1)), density)
    spread_out = null_safe_join(packed, shared, by).select("*", F.posexplode(values).alias("point", "_sum"))
    return spread_out.select(
        *by,
        "point",
        (F.col("_from") + F.col("point") * F.col("_d")).alias("x"),
        (F.col("_sum") / scale).alias("density"),
        F.col("_q")[2].alias("low"),
        F.col("_q")[3].alias("high"),
    )


def _t_two_sided(t: float, df: int) -> float:
    """Probability that a Student variable with ``df`` degrees of freedom lies within ``t`` of 0.

    The finite sums of Abramowitz and Stegun 26.7.3 and 26.7.4.
    """
    angle = math.atan(t / math.sqrt(df))
    cos2 = math.cos(angle) ** 2
    odd = df % 2
    term, total = math.cos(angle) if odd else 1.0, 0.0
    for k in range(odd, df - 1, 2):
        total += term
        term *= cos2 * (k + 1) / (k + 2)
    total *= math.sin(angle)
    return 2 / math.pi * (angle + total) if odd else total


def _t_exact(share: float, df: int) -> float:
    """Half width of the interval around 0 that holds ``share`` of a Student distribution."""
    low, high = 0.0, 1e4
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if _t_two_sided(mid, df) < share else (low, mid)
    return high


def _t_quantile(z: float, df: Column) -> Column:
    """Student quantile from the normal quantile ``z``: exact below 10 degrees of freedom.

    From there on its expansion in powers of 1/df, with the terms of Abramowitz and Stegun 26.7.5, whose
    error is below 1e-5.
    """
    share = math.erf(z / math.sqrt(2))
    exact = F.array(*[F.lit(_t_exact(share, k)) for k in range(1, 10)])
    terms = (
        (z**3 + z) / 4,
        (5 * z**5 + 16 * z**3 + 3 * z) / 96,
        (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384,
        (79 * z**9 + 776 * z**7 + 1482 * z**5 - 1920 * z**3 - 945 * z) / 92160,
    )
    out = F.lit(z)
    for power, term in enumerate(terms, start=1):
        out = out + term / F.pow(df, F.lit(float(power)))
    return F.when(df < 10, F.get(exact, df.cast("int") - 1)).otherwise(out)


# normal quantile of a two-sided 95 % band
Z_95 = 1.959963984540054


def smooth_line(
    df: DataFrame,
    x: str,
    y: str,
    by: Sequence[str],
    limits: dict[str, tuple[float, float]] | None = None,
    points: int = 80,
    band: bool = False,
) -> DataFrame:
    """Least-squares line of each group on an even grid over its range of ``x``.

    ``limits`` drop rows before the fit. ``band=True`` adds the 95 % band of the mean.
    """
    rows = _present(df.select(*by, x, y), x, y)
    rows = within(rows, limits or {})
    fits = rows.groupBy(*by).agg(
        F.regr_slope(y, x).alias("_b"),
        F.regr_intercept(y, x).alias("_a"),
        F.min(x).alias("_lo"),
        F.max(x).alias("_hi"),
        F.count(x).cast("double").alias("_n"),
        F.avg(x).alias("_mx"),
        F.regr_sxx(y, x).alias("_sxx"),
        F.regr_syy(y, x).alias("_syy"),
        F.regr_sxy(y, x).alias("_sxy"),
    )
    fits = fits.where(F.col("_b").isNotNull())
    grid = fits.withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    at = F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("point") / (points - 1)
    grid = grid.withColumn("x", at).withColumn("fit", F.col("_a") + F.col("_b") * F.col("x"))
    if not band:
        return grid.select(*by, "point", "x", "fit")
    free = F.col("_n") - 2
    # rounding may push the residual sum of a perfect fit below zero
    rss = F.greatest(F.col("_syy") - F.col("_sxy") * F.col("_sxy") / F.col("_sxx"), F.lit(0.0))
    lever = 1 / F.col("_n") + (F.col("x") - F.col("_mx")) * (F.col("x") - F.col("_mx")) / F.col("_sxx")
    half = F.when(free > 0, _t_quantile(Z_95, free) * F.sqrt(F.try_divide(rss, free) * lever))
    return grid.select(
        *by, "point", "x", "fit", (F.col("fit") - half).alias("low"), (F.col("fit") + half).alias("high")
    )
