"""Scenario design, forcing schedule and period labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelkit.operators.keys import match_keys
from panelkit.operators.reshape import code, to_long

# fixed values of the study design
DROUGHTS = ("D1", "D2", "D3")
RECOVERIES = ("N", "W3", "W2", "W1")
DURATIONS = (4, 3, 2, 1)
CONTROL = "scen_01"


def scenario_design(
    spark: SparkSession,
    droughts: Sequence[str] = DROUGHTS,
    recoveries: Sequence[str] = RECOVERIES,
    durations: Sequence[int] = DURATIONS,
) -> DataFrame:
    """The control scenario and every combination of drought, recovery and duration.

    Scenario names carry the position, so the table joins by name and never by row order.
    """
    total = len(droughts) * len(recoveries) * len(durations)
    i = F.col("id") - 1
    per_drought = len(recoveries) * len(durations)

    def pick(levels: Sequence, position: Column) -> Column:
        return F.get(F.array(*[F.lit(v) for v in levels]), position.cast("int"))

    control = F.col("id") == 0
    drought = F.when(control, F.lit("N")).otherwise(pick(droughts, F.floor(i / per_drought)))
    recovery = F.when(control, F.lit("N")).otherwise(
        pick(recoveries, F.floor(i / len(durations)) % len(recoveries))
    )
    duration = F.when(control, F.lit(0)).otherwise(pick(durations, i % len(durations)))
    return (
        spark.range(total + 1)
        .select(
            F.concat(F.lit("scen_"), F.lpad((F.col("id") + 1).cast("string"), 2, "0")).alias("scenario"),
            drought.alias("drought_intensity"),
            recovery.alias("recovery_intensity"),
            duration.cast("int").alias("drought_duration"),
        )
        .withColumn("scen_code", code(["drought_intensity", "recovery_intensity", "drought_duration"]))
    )


def schedule_long(
    schedule: DataFrame, classes: DataFrame, slots: Sequence[str], scenario: str = "scen"
) -> DataFrame:
    """Schedule (one column per simulated year) to one row per scenario and time slot, with its class.

    Slot columns are named ``X1, X2, ...``; the scenario label changes from ``scen_01`` to ``Scen[01]``.
    ``classes`` has one row per year with columns ``Year`` and ``Class``.
    """
    long = to_long(schedule, [scenario], slots, "Time", "Year")
    label = F.concat(F.translate(scenario, "s_", "S["), F.lit("]"))
    return match_keys(long, classes.select("Year", "Class"), ["Year"], "left").select(
        label.alias("Scen"),
        F.regexp_replace("Time", "X", "").cast("int").alias("Time"),
        "Year",
        "Class",
    )


def label_periods(
    panel: DataFrame,
    start: int = 2003,
    baseline_len: int = 2,
    recovery_len: int = 4,
    control: str | None = CONTROL,
    year: Column | None = None,
    duration: str = "drought_duration",
) -> DataFrame:
    """Add ``period``, ``year`` and ``phase_year`` (0-based year inside the period).

    Baseline years come first, then as many impact years as the scenario's drought lasts, then the
    recovery years; later years are normal. Years before ``start`` have neither period nor year. The
    control scenario has no disturbance and is dropped.
    """
    if control is not None:
        panel = panel.where(F.col("scenario") != control)
    y = year if year is not None else F.year("time")
    offset = (y - start).cast("int")
    d = F.col(duration)
    impact_at, recovery_at = F.lit(baseline_len), baseline_len + d
    normal_at = baseline_len + d + recovery_len
    period = (
        F.when(offset < 0, F.lit(None))
        .when(offset < impact_at, "baseline")
        .when(offset < recovery_at, "impact")
        .when(offset < normal_at, "recovery")
        .when(offset >= normal_at, "normal")
    )
    begin = (
        F.when(F.col("period") == "baseline", 0)
        .when(F.col("period") == "impact", impact_at)
        .when(F.col("period") == "recovery", recovery_at)
        .when(F.col("period") == "normal", normal_at)
    )
    return panel.withColumns(
        {"period": period, "year": F.when(offset >= 0, y.cast("int"))}
    ).withColumn("phase_year", (F.col("year") - start - begin).cast("int"))
