"""Study-shaped tables derived from the driver tables (definitions in FIXTURES.md)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelkit.functions.labels import CLASS_METRICS, relabel
from panelkit.operators import classify, design, metrics, regress, resample, reshape
from panelkit.operators.rollup import enrich_panel
from panelkit.session import keep, keep_bucketed

START, BASELINE_LEN, RECOVERY_LEN, BASE_YEAR, MAX_DURATION = 1995, 2, 2, 1996, 3
SOURCES = ("view", "click", "purchase", "signup", "error")
REFERENCE = "purchase"
REPS, SAMPLE, SEED = 20, 10, 2021


def stations() -> Column:
    return F.col("Source").isin("view", "click")


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def observations(spark: SparkSession, sf: str) -> DataFrame:
    """One row per line item: scenario, cell, time and the two variables."""
    part = table(spark, sf, "part").select("p_partkey", F.col("p_type").alias("scenario"))
    lines = table(spark, sf, "lineitem").select(
        "l_partkey",
        F.col("l_suppkey").alias("id"),
        F.col("l_shipdate").alias("ts"),
        F.col("l_quantity").alias("precip"),
        (F.col("l_extendedprice") / 1000).alias("gpp"),
    )
    return lines.join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        "scenario", "id", *_xy(), "ts", "precip", "gpp"
    )


def _xy() -> list:
    return [(F.col("id") % 10).cast("int").alias("x"), F.floor(F.col("id") / 10).cast("int").alias("y")]


def scenarios(spark: SparkSession, sf: str) -> DataFrame:
    """Scenario factors from the alphabetical position of each part type (a handful of rows)."""
    types = table(spark, sf, "part").select(F.col("p_type").alias("scenario")).distinct()
    o = F.row_number().over(Window.orderBy("scenario")) - 1
    recovery = F.element_at(F.array(*[F.lit(r) for r in ("N", "W3", "W2", "W1")]), F.col("o") % 4 + 1)
    return (
        types.withColumn("o", o)
        .select(
            "scenario",
            F.concat(F.lit("D"), (F.floor(F.col("o") / 2) + 1).cast("string")).alias("drought_intensity"),
            recovery.alias("recovery_intensity"),
            (F.col("o") % 3 + 1).cast("int").alias("drought_duration"),
        )
        .withColumn(
            "scen_code", reshape.code(["drought_intensity", "recovery_intensity", "drought_duration"])
        )
    )


def cells(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"))
    return s.select(
        "id",
        *_xy(),
        (F.col("id") / 10 - 10).alias("lat"),
        (F.col("id") / 20 - 40).alias("lon"),
        F.when(F.col("id") % 5 == 0, 6).otherwise(7).alias("soil_type"),
        (7 + F.col("id") % 4).cast("int").alias("veg_type"),
    )


def panel(spark: SparkSession, sf: str) -> DataFrame:
    year = F.year("ts").alias("year")
    return (
        observations(spark, sf)
        .groupBy("scenario", "x", "y", year)
        .agg(F.sum("precip").alias("precip"), F.sum("gpp").alias("gpp"))
    )


def enriched(spark: SparkSession, sf: str) -> DataFrame:
    return enrich_panel(panel(spark, sf), scenarios(spark, sf), cells(spark, sf))


def labelled(spark: SparkSession, sf: str, full: bool = False) -> DataFrame:
    if full:
        rows = enriched(spark, sf)
    else:
        factors = scenarios(spark, sf).select("scenario", "drought_duration")
        rows = panel(spark, sf).join(factors, "scenario", "left")
    return design.label_periods(
        rows, START, BASELINE_LEN, RECOVERY_LEN, control=None, year=F.col("year")
    )


def resilience(spark: SparkSession, sf: str, mode: str = "first") -> DataFrame:
    return metrics.resilience_metrics(
        labelled(spark, sf),
        base_year=BASE_YEAR,
        mode=mode,
        recovery_len=RECOVERY_LEN,
        max_duration=MAX_DURATION,
    )


def resilience_carried(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.resilience_metrics(
        labelled(spark, sf, full=True),
        base_year=BASE_YEAR,
        recovery_len=RECOVERY_LEN,
        max_duration=MAX_DURATION,
        carry=metrics.DIMENSIONS,
    )


def cohort(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.cohort(resilience_carried(spark, sf))


def wide(spark: SparkSession, sf: str) -> DataFrame:
    return reshape.metrics_wide(cohort(spark, sf))


def _units(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(
        F.dayofmonth("ts").alias("Year"),
        F.floor(F.hour("ts") / 6).cast("int").alias("Month"),
        "event_type",
        "value",
    )


def annual_wide(spark: SparkSession, sf: str) -> DataFrame:
    sums = _units(spark, sf).groupBy("Year", "event_type").agg(F.sum("value").alias("value"))
    return reshape.to_wide(sums, ["Year"], "event_type", ["value"], SOURCES)


def monthly_wide(spark: SparkSession, sf: str) -> DataFrame:
    sums = _units(spark, sf).groupBy("Year", "Month", "event_type").agg(F.sum("value").alias("value"))
    return reshape.to_wide(sums, ["Year", "Month"], "event_type", ["value"], SOURCES)


def series(spark: SparkSession, sf: str) -> DataFrame:
    return classify.series_long(annual_wide(spark, sf), ["Year"], SOURCES)


def subseries(spark: SparkSession, sf: str) -> DataFrame:
    return classify.series_long(monthly_wide(spark, sf), ["Year", "Month"], SOURCES)


def classified(spark: SparkSession, sf: str) -> DataFrame:
    """Computed once: most results read it several times."""
    return classify.classify_by_quantiles(keep(series(spark, sf)), stations())


def distances(rows: DataFrame) -> DataFrame:
    return classify.class_distance(rows, classify.class_summary(rows, stations()), REFERENCE)


def chosen_years(rows: DataFrame) -> DataFrame:
    """Stand-in for the hand-picked years: the unit closest to each station statistic."""
    named = distances(rows).withColumnsRenamed(
        {"Min_Dif": "Min", "Mean_Dif": "Mean", "Max_Dif": "Max"}
    )
    long = reshape.to_long(named, ["Year", "Condition"], ["Min", "Mean", "Max"], "Metric", "dif")
    best = (
        long.dropna("any")
        .groupBy("Condition", "Metric")
        .agg(F.min(F.struct("dif", "Year"))["Year"].alias("Year"))
    )
    names = {f"{c}|{m}": k for (c, m), k in CLASS_METRICS.items()}
    return best.select(relabel(F.concat_ws("|", "Condition", "Metric"), names).alias("Class"), "Year")


def schedule(spark: SparkSession, sf: str) -> DataFrame:
    """Schedule-shaped table: one row per scenario, seven slots with a unit each."""
    e = table(spark, sf, "events").select(
        F.concat(F.lit("scen_"), F.lpad((F.col("user_id") % 49 + 1).cast("string"), 2, "0")).alias("scen"),
        F.concat(F.lit("X"), (F.col("event_id") % 7 + 1).cast("string")).alias("slot"),
        F.dayofmonth("ts").alias("day"),
    )
    days = e.groupBy("scen", "slot").agg(F.max("day").alias("day"))
    return reshape.to_wide(days, ["scen"], "slot", ["day"], [f"X{i}" for i in range(1, 8)])


def sample(spark: SparkSession, sf: str) -> DataFrame:
    return resample.resample(
        wide(spark, sf),
        "veg_type",
        SAMPLE,
        REPS,
        block=F.floor(F.col("id") / 64),
        order=["id", "scenario"],
        seed=SEED,
        method="md5",
    )


def study_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as complete metric rows in four strata, enough of them for the study's sample sizes."""
    lines = table(spark, sf, "lineitem")
    columns = sorted({c for p in regress.PAIRS for c in p})
    measures = ("l_discount", "l_tax", "l_quantity", "l_extendedprice")
    values = {
        c: F.col(measures[i % 4]) / (1 + i) + F.pmod(F.xxhash64(F.lit(i), "l_orderkey", "l_linenumber"), F.lit(1000)) / 1000
        for i, c in enumerate(columns)
    }
    return lines.select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"),
        F.col("l_returnflag").alias("scenario"),
        (7 + F.col("l_suppkey") % 4).cast("string").alias("veg_type"),
        *[v.alias(c) for c, v in values.items()],
    )


# The study's own size: replicates, rows of each in a stratum, grid points of densities, rows shown.
STUDY_REPS, STUDY_SAMPLE, STUDY_POINTS, STUDY_SHOWN = 5000, 500, 512, 3000
# Line items may share an id; rows alike in all of these are alike in every column.
STUDY_ORDER = ["id", "gpp_impact", "precip_impact", "gpp_recovery_base", "gpp_recovery_impact", "gpp_stability", "scenario"]

_DRAWN: dict[tuple[str, str, int, int], DataFrame] = {}


def study_sample(spark: SparkSession, sf: str) -> DataFrame:
    """Replicates of the study's own size, drawn once in a session and stored in buckets of a sample."""
    key = (spark.sparkContext.applicationId, sf, STUDY_REPS, STUDY_SAMPLE)
    if key not in _DRAWN:
        rows = study_rows(spark, sf)
        drawn = resample.resample(rows, "veg_type", STUDY_SAMPLE, STUDY_REPS, F.floor(F.col("id") / 4096), STUDY_ORDER, SEED)
        _DRAWN[key] = keep_bucketed(drawn, ["sample_id", "veg_type"])
    return _DRAWN[key]


def pairs(spark: SparkSession, sf: str) -> DataFrame:
    return regress.pair_long(sample(spark, sf), complete=True)


def coefs(spark: SparkSession, sf: str) -> DataFrame:
    return regress.fit_sample(sample(spark, sf))


def residuals(spark: SparkSession, sf: str) -> DataFrame:
    drawn = keep(sample(spark, sf))
    return regress.sample_residuals(drawn, regress.fit_sample(drawn))
