"""Classification of years by station quantiles and the tables derived from it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelkit.functions.labels import CLASS_METRICS, CLASSES, CONDITIONS, ordinal, relabel
from panelkit.functions.semantics import nan_to_null
from panelkit.operators.keys import join_unique, match_keys
from panelkit.operators.quantiles import cumulative_share, quantile_values
from panelkit.operators.reshape import to_long
from panelkit.session import settle

# fixed values of the study
PROBS = (0.05, 0.40, 0.60, 0.95)


def series_long(wide: DataFrame, ids: Sequence[str], sources: Sequence[str]) -> DataFrame:
    """Wide series (one column per source) to ``ids, Source, Precip``; NaN becomes NULL."""
    long = to_long(wide, ids, sources, "Source", "Precip")
    return long.withColumn("Precip", nan_to_null(F.col("Precip").cast("double")))


def plot_series(long: DataFrame, exclude: Sequence[str] = (), min_year: int = 1976) -> DataFrame:
    """Complete rows of the annual series from ``min_year`` on, without the excluded sources.

    The study compares dates with the number 1975, which amounts to 1976 and later; pass 1975 for the
    limit its text intends.
    """
    date = F.make_date("Year", F.lit(1), F.lit(1)).alias("Year")
    kept = long.where((F.col("Year") >= min_year) & ~F.col("Source").isin(*exclude)).dropna("any")
    return kept.select(date, "Source", "Precip")


def is_station(source: str | Column, grid_mark: str = "GLDAS") -> Column:
    """True for station sources: their name does not contain the mark of gridded products."""
    c = F.col(source) if isinstance(source, str) else source
    return ~c.contains(grid_mark)


def classify_by_quantiles(
    long: DataFrame,
    train: Column,
    probs: Sequence[float] = PROBS,
    labels: Sequence[str] = CONDITIONS,
    value: str = "Precip",
    out: str = "Condition",
) -> DataFrame:
    """Label every row by cut points pooled over the ``train`` rows only.

    Dry is ``[q1, q2)``, Normal ``[q2, q3]`` and Wet ``(q3, q4]``; values outside have no label. The cut
    points are four numbers and enter the plan as literals.
    """
    cuts = quantile_values(long.where(train), value, probs)
    v = nan_to_null(F.col(value))
    q1, q2, q3, q4 = (F.lit(q).cast("double") for q in cuts)
    label = (
        F.when((v >= q1) & (v < q2), labels[0])
        .when((v >= q2) & (v <= q3), labels[1])
        .when((v > q3) & (v <= q4), labels[2])
    )
    return long.withColumn(out, label)


def class_summary(classified: DataFrame, stations: Column) -> DataFrame:
    """Minimum, mean and maximum of the station values per condition."""
    rows = classified.where(stations & F.col("Condition").isNotNull())
    return rows.groupBy("Condition").agg(
        F.min("Precip").alias("min"), F.avg("Precip").alias("mean"), F.max("Precip").alias("max")
    )


def class_distance(classified: DataFrame, summary: DataFrame, reference: str) -> DataFrame:
    """Distance of the reference source's years to the station statistics of their condition.

    Normal years are compared with the mean only. The summary is broadcast after its rows are counted.
    """
    rows = classified.where(
        (F.col("Source") == reference) & F.col("Condition").isNotNull() & F.col("Precip").isNotNull()
    ).select("Year", "Condition", F.col("Precip").alias("reference"))
    edge = F.col("Condition") != "Normal"
    return rows.join(settle(summary)[0], "Condition").select(
        "Year",
        "Condition",
        "reference",
        F.when(edge, F.abs(F.col("reference") - F.col("min"))).alias("Min_Dif"),
        F.abs(F.col("reference") - F.col("mean")).alias("Mean_Dif"),
        F.when(edge, F.abs(F.col("reference") - F.col("max"))).alias("Max_Dif"),
    )


def class_targets(summary: DataFrame) -> DataFrame:
    """Class, condition and metric with the station value each class stands for, in class order."""
    named = summary.withColumnsRenamed({"min": "Min", "mean": "Mean", "max": "Max"})
    long = to_long(named, ["Condition"], ["Mean", "Min", "Max"], "Metric", "Precip")
    pairs = {f"{c}|{m}": k for (c, m), k in CLASS_METRICS.items()}
    label = relabel(F.concat_ws("|", "Condition", "Metric"), pairs)
    targets = long.withColumn("Class", label).dropna("any")
    return targets.select("Class", "Condition", "Metric", "Precip").orderBy(
        ordinal(F.col("Class"), CLASSES)
    )


def station_sample(classified: DataFrame, stations: Column, trim: bool = True) -> DataFrame:
    """Station values for the empirical distribution.

    With ``trim`` the years without a condition (below the lowest or above the highest cut) are left
    out, as in the study; without it all station values count.
    """
    needed = ["Precip", "Condition"] if trim else ["Precip"]
    return classified.where(stations).dropna("any", subset=needed).select("Precip")


def ecdf_rank(queries: DataFrame, query: str, sample: DataFrame, out: str = "Quantile") -> DataFrame:
    """Add the share of the sample that is not larger than the query value."""
    return cumulative_share(queries, query, sample, "Precip", out)


def year_report(
    class_years: DataFrame, distances: DataFrame, targets: DataFrame, sample: DataFrame
) -> DataFrame:
    """Chosen years with their reference value, station value, metric and quantile, by quantile.

    ``class_years`` has one row per class (``Class, Year``) and every join is by class or year.
    """
    years = settle(class_years.select("Class", "Year"))[0]
    chosen = distances.select("Year", F.col("reference").alias("GLDAS")).join(years, "Year")
    ranked = ecdf_rank(chosen, "GLDAS", sample)
    stations = settle(targets.select("Class", F.col("Precip").alias("Stations"), "Metric"))[0]
    return (
        ranked.join(stations, "Class")
        .select("Class", "Year", "GLDAS", "Stations", "Metric", "Quantile")
        .orderBy("Quantile", "Class")
    )


def year_classes(class_years: DataFrame, classified: DataFrame, reference: str) -> DataFrame:
    """Chosen years with the reference source's value, in class order."""
    values = classified.where(F.col("Source") == reference).select("Year", "Precip")
    found = join_unique(class_years.select("Class", "Year"), values, ["Year"], "years of the reference")
    return found.select("Class", "Year", "Precip").orderBy(ordinal(F.col("Class"), CLASSES))


def enrich_subperiods(sub: DataFrame, classified: DataFrame) -> DataFrame:
    """Attach the condition of the whole period to its parts; periods without parts drop out."""
    return join_unique(sub, classified.drop("Precip"), ["Source", "Year"], "whole periods", "inner")


def highlight_series(enriched: DataFrame, class_years: DataFrame, reference: str) -> DataFrame:
    """Parts of the chosen years of the reference source, complete rows only."""
    rows = enriched.where(F.col("Source") == reference)
    return match_keys(rows, class_years.select("Year", "Class"), ["Year"], "left").dropna("any")


def station_year_classes(classified: DataFrame, years: DataFrame, stations: Column) -> DataFrame:
    """Complete station years with the chosen class of the year.

    Both sides have a value column: ``Precip_01`` is the station's, ``Precip_02`` the reference's.
    """
    left = classified.where(stations).dropna("any").withColumnRenamed("Precip", "Precip_01")
    right = years.select("Year", "Class", F.col("Precip").alias("Precip_02"))
    return match_keys(left, right, ["Year"], "left")
