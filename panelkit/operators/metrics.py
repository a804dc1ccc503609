"""Baseline, impact, recovery and stability of each cell, scenario and variable.

Input of every operator is the labelled panel (``period``, ``year``, ``phase_year``) with one row per
key and year and one column per variable.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelkit.functions.labels import METRICS, RECOVERY_ORDER, VARIABLES, VEGETATION, ordinal, relabel
from panelkit.functions.semantics import nan_to_null, packed_at, packed_pair, ratio
from panelkit.operators.keys import join_unique, marked_years, match_keys, refuse, year_marks
from panelkit.operators.reshape import to_long

KEYS = ("scenario", "x", "y")
BASE_YEAR = 2004
LABELLED = ("baseline", "impact", "recovery")
# fixed values: names of the output columns
STATES = ("s_to", "s_ti1", "ti1", "s_ti2", "ti2", "s_tr", "tr", "stability")
DIMENSIONS = (
    "lat",
    "lon",
    "id",
    "scen_code",
    "drought_intensity",
    "recovery_intensity",
    "drought_duration",
    "soil_type",
    "veg_type",
)


def panel_long(
    panel: DataFrame, keys: Sequence[str] = KEYS, variables: Sequence[str] = VARIABLES
) -> DataFrame:
    """Labelled panel with one row per variable; NaN becomes NULL."""
    long = to_long(panel, [*keys, "period", "year"], variables)
    return long.withColumn("value", nan_to_null(F.col("value").cast("double")))


def baseline_value(
    panel: DataFrame,
    base_year: int = BASE_YEAR,
    keys: Sequence[str] = KEYS,
    variables: Sequence[str] = VARIABLES,
) -> DataFrame:
    """State before the disturbance: the value of one fixed year. No shuffle."""
    rows = panel_long(panel.where(F.col("year") == base_year), keys, variables)
    return rows.select(*keys, "variable", F.col("value").alias("s_to"))


def impact_min(
    panel: DataFrame, keys: Sequence[str] = KEYS, variables: Sequence[str] = VARIABLES
) -> DataFrame:
    """Lowest impact value and its year; the earliest year wins a tie."""
    rows = panel_long(panel.where(F.col("period") == "impact"), keys, variables).dropna(subset=["value"])
    low = F.min(packed_pair(F.col("value"), F.col("year")))
    return rows.groupBy(*keys, "variable").agg(F.min("value").alias("s_ti1"), packed_at(low).alias("ti1"))


def impact_last(
    panel: DataFrame, keys: Sequence[str] = KEYS, variables: Sequence[str] = VARIABLES
) -> DataFrame:
    """Value in the last impact year, NULL values included."""
    rows = panel_long(panel.where(F.col("period") == "impact"), keys, variables)
    return rows.groupBy(*keys, "variable").agg(
        F.max_by("value", "year").alias("s_ti2"), F.max("year").alias("ti2")
    )


def recovery_point(
    panel: DataFrame,
    base: DataFrame | None = None,
    mode: str = "first",
    margin: float = 0.95,
    keys: Sequence[str] = KEYS,
    variables: Sequence[str] = VARIABLES,
) -> DataFrame:
    """Recovery value and year.

    ``mode='first'`` takes the first recovery year, which is what the study's code computes.
    ``mode='threshold'`` takes the first recovery year with ``value >= margin * s_to``, which is what
    its text describes; groups that never get there have no row. ``base`` comes from
    :func:`baseline_value` and is needed for the threshold only.
    """
    rows = panel_long(panel.where(F.col("period") == "recovery"), keys, variables)
    if mode == "threshold":
        rows = match_keys(rows, base, [*keys, "variable"]).where(F.col("value") >= margin * F.col("s_to"))
    elif mode != "first":
        raise ValueError("mode must be 'first' or 'threshold'")
    return rows.groupBy(*keys, "variable").agg(
        F.min_by("value", "year").alias("s_tr"), F.min("year").alias("tr")
    )


def _cv(value: Column, rows: Column, on_zero: str) -> Column:
    """``sd / mean`` over the rows where ``rows`` holds; NULL as soon as one of them has no value."""
    v = F.when(rows, value)
    complete = F.count(v) == F.count(F.when(rows, F.lit(1)))
    return F.when(complete, ratio(F.stddev_samp(v), F.avg(v), on_zero))


def stability(
    panel: DataFrame,
    keys: Sequence[str] = KEYS,
    variables: Sequence[str] = VARIABLES,
    on_zero: str = "null",
) -> DataFrame:
    """Coefficient of variation over baseline, impact and recovery years."""
    rows = panel_long(panel.where(F.col("period").isin(*LABELLED)), keys, variables)
    return rows.groupBy(*keys, "variable").agg(
        _cv(F.col("value"), F.lit(True), on_zero).alias("stability")
    )


def _state_aggregates(
    v: str,
    base_year: int,
    max_duration: int | None,
    recovery_len: int | None,
    mode: str,
    margin: float,
    on_zero: str,
) -> list[Column]:
    """Aggregates of one variable. All buffers are plain numbers, so Spark hash-aggregates them."""
    value, year, period, at = F.col(v), F.col("year"), F.col("period"), F.col("phase_year")
    impact, recovery = period == "impact", period == "recovery"
    aggs = [
        F.max(F.when(year == base_year, value)).alias(f"{v}.s_to"),
        F.max_by(value, F.when(impact, year)).alias(f"{v}.s_ti2"),
        _cv(value, period.isin(*LABELLED), on_zero).alias(f"{v}.stability"),
    ]
    if max_duration is None:
        lows = F.when(impact & value.isNotNull(), packed_pair(value, year))
        aggs += [F.min(F.when(impact, value)).alias(f"{v}.s_ti1"), packed_at(F.min(lows)).alias(f"{v}.ti1")]
    else:
        aggs += [F.max(F.when(impact & (at == j), value)).alias(f"{v}.i{j}") for j in range(max_duration)]
    if mode == "first":
        aggs.append(F.min_by(value, F.when(recovery, year)).alias(f"{v}.s_tr"))
    elif recovery_len is None:
        hit = F.when(recovery & (value >= margin * F.col(f"`{v}.base`")), year)
        aggs += [F.min_by(value, hit).alias(f"{v}.s_tr"), F.min(hit).alias(f"{v}.tr")]
    else:
        aggs += [F.max(F.when(recovery & (at == j), value)).alias(f"{v}.r{j}") for j in range(recovery_len)]
    return aggs


def _first_hit(values: Sequence[Column], hit, start: Column) -> tuple[Column, Column]:
    """First of ``values`` for which ``hit`` holds, and its year."""
    value, year = F.lit(None).cast("double"), F.lit(None).cast("int")
    for j in reversed(range(len(values))):
        found = F.coalesce(hit(values[j]), F.lit(False))
        value = F.when(found, values[j]).otherwise(value)
        year = F.when(found, (start + j).cast("int")).otherwise(year)
    return value, year


def _states(
    v: str, max_duration: int | None, recovery_len: int | None, mode: str, margin: float
) -> Column:
    """Struct of the states of one variable from its aggregates."""

    def agg(name: str) -> Column:
        return F.col(f"`{v}.{name}`")

    if max_duration is None:
        s_ti1, ti1 = agg("s_ti1"), agg("ti1")
    else:
        years = [agg(f"i{j}") for j in range(max_duration)]
        low = F.least(*years) if len(years) > 1 else years[0]
        s_ti1, ti1 = _first_hit(years, lambda c: c == low, F.col("_impact_start"))
    if mode == "first":
        s_tr, tr = agg("s_tr"), F.col("_recovery_first")
    elif recovery_len is None:
        s_tr, tr = agg("s_tr"), agg("tr")
    else:
        years = [agg(f"r{j}") for j in range(recovery_len)]
        s_tr, tr = _first_hit(years, lambda c: c >= margin * agg("s_to"), F.col("_recovery_start"))
    columns = (agg("s_to"), s_ti1, ti1, agg("s_ti2"), F.col("_impact_last"), s_tr, tr, agg("stability"))
    return F.struct(F.lit(v).alias("variable"), *[c.alias(n) for c, n in zip(columns, STATES, strict=True)])


def components(states: DataFrame, on_zero: str = "null") -> DataFrame:
    """Resilience components from the states, with the validity rules applied.

    If recovery ends below the end of the impact, or an impact state exceeds the baseline, all five
    metrics become NULL. A comparison with a missing state does not trigger a rule.
    """
    s_to, s_ti1, s_ti2, s_tr = (F.col(c) for c in ("s_to", "s_ti1", "s_ti2", "s_tr"))
    rules = (s_tr < s_ti2, s_ti1 > s_to, s_ti2 > s_to)
    invalid = F.lit(False)
    for rule in rules:
        invalid = invalid | F.coalesce(rule, F.lit(False))
    metrics = {
        "stability": F.col("stability"),
        "impact": 1 - ratio(s_ti1, s_to, on_zero),
        "recovery": ratio(s_tr, s_ti2, on_zero),
        "recovery_base": ratio(s_tr - s_ti2, s_to, on_zero),
        "recovery_impact": ratio(s_tr - s_ti2, s_to - s_ti1, on_zero),
    }
    return states.withColumns({m: F.when(~invalid, c) for m, c in metrics.items()})


def resilience_metrics(
    panel: DataFrame,
    base_year: int = BASE_YEAR,
    mode: str = "first",
    margin: float = 0.95,
    recovery_len: int | None = 4,
    max_duration: int | None = 4,
    keys: Sequence[str] = KEYS,
    variables: Sequence[str] = VARIABLES,
    carry: Sequence[str] = (),
    on_zero: str = "null",
) -> DataFrame:
    """States and components of all variables in one aggregation over the labelled panel.

    The panel stays wide until after the shuffle: all variables of a key share one row per year and one
    aggregation group, and the few result rows are turned long at the end. A labelled year that a key
    repeats, or that is NULL, raises an error: the aggregation marks the years it has seen in four numbers,
    enough for spans of less than 256 years. ``carry`` names attributes that are constant per key; they travel as grouping keys, which
    saves the join of :func:`enrich_metrics`. Impacts longer than ``max_duration`` years raise an error,
    and in threshold mode recoveries longer than ``recovery_len`` years; pass ``None`` for any length. All
    buffers keep their fixed width then too; the threshold needs the baseline of a key beside each of its
    rows, which a window over the same keys puts there before the aggregation, in the same exchange.
    """
    if mode not in ("first", "threshold"):
        raise ValueError("mode must be 'first' or 'threshold'")
    labelled = panel.select(*keys, *carry, "period", "year", "phase_year", *variables)
    labelled = labelled.withColumns({v: nan_to_null(F.col(v).cast("double")) for v in variables})
    impact, recovery = F.col("period") == "impact", F.col("period") == "recovery"
    if mode == "threshold" and recovery_len is None:
        group = Window.partitionBy(*keys, *carry)
        base = {f"{v}.base": F.max(F.when(F.col("year") == base_year, F.col(v))).over(group) for v in variables}
        labelled = labelled.withColumns(base)
    start = F.col("year") - F.col("phase_year")
    counted = F.col("period").isin(*LABELLED) | F.coalesce(F.col("year") == base_year, F.lit(False))
    aggs = [
        F.max(F.when(impact, start)).alias("_impact_start"),
        F.max(F.when(impact, F.col("year"))).alias("_impact_last"),
        F.max(F.when(recovery, start)).alias("_recovery_start"),
        F.min(F.when(recovery, F.col("year"))).alias("_recovery_first"),
        F.max(F.when(recovery, F.col("phase_year"))).alias("_recovery_end"),
        F.count(F.when(counted, 1)).alias("_rows"),
        *year_marks(F.col("year"), counted, base_year),
    ]
    for v in variables:
        aggs += _state_aggregates(v, base_year, max_duration, recovery_len, mode, margin, on_zero)
    wide = labelled.groupBy(*keys, *carry).agg(*aggs).where(F.col("_rows") > 0)
    wide = refuse(wide, F.col("_rows") != marked_years(), "a key repeats a year or lacks it", keys)
    if max_duration is not None:
        too_long = F.col("_impact_last") - F.col("_impact_start") >= max_duration
        message = F.lit(f"an impact lasts longer than max_duration = {max_duration} years")
        wide = wide.withColumn(
            "_impact_last", F.when(too_long, F.raise_error(message)).otherwise(F.col("_impact_last"))
        )
    if mode == "threshold" and recovery_len is not None:
        message = F.lit(f"a recovery lasts longer than recovery_len = {recovery_len} years")
        start = F.col("_recovery_start")
        too_long = F.col("_recovery_end") >= recovery_len
        wide = wide.withColumn("_recovery_start", F.when(too_long, F.raise_error(message)).otherwise(start))
    per_variable = [_states(v, max_duration, recovery_len, mode, margin) for v in variables]
    states = wide.select(*keys, *carry, F.inline(F.array(*per_variable)))
    long = components(states, on_zero)
    return long.select(
        *keys, "variable", *STATES[:-1], "stability", *METRICS[1:], *carry
    )


def enrich_metrics(
    metrics: DataFrame,
    panel: DataFrame,
    keys: Sequence[str] = KEYS,
    dimensions: Sequence[str] = DIMENSIONS,
) -> DataFrame:
    """Inner join of the metrics with the distinct cell and scenario attributes of the panel.

    NULL keys match each other. Attributes that change within a key raise an error.
    """
    found = panel.select(*keys, *dimensions).distinct()
    return join_unique(metrics, found, list(keys), "attributes", "inner")


def cohort(
    metrics: DataFrame,
    min_impact: float = 0.10,
    vegetation: Mapping[int, str] = VEGETATION,
    soil: int = 7,
    max_duration: int = 2,
) -> DataFrame:
    """Rows to analyse, with vegetation names and the order of the recovery classes.

    The impact limit applies to each long row, so one variable of a cell can stay without the other.
    The conditions are plain comparisons and reach the Parquet scan.
    """
    codes = sorted(vegetation)
    kept = metrics.where(
        (F.col("impact") > min_impact)
        & ~F.isnan("impact")
        & (F.col("veg_type") >= codes[0])
        & (F.col("veg_type") <= codes[-1])
        & (F.col("soil_type") == soil)
        & (F.col("drought_duration") <= max_duration)
    )
    out = kept.withColumn("veg_type", relabel(F.col("veg_type"), vegetation))
    if "recovery_intensity" in out.columns:
        order = ordinal(F.col("recovery_intensity"), RECOVERY_ORDER)
        out = out.withColumn("recovery_order", order)
    return out
