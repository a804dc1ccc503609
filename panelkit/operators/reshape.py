"""Wide and long forms of a table, and nested groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelkit.functions.labels import METRICS, VARIABLES
from panelkit.operators.keys import refuse


def to_long(
    df: DataFrame, ids: Sequence[str], values: Sequence[str], name: str = "variable", value: str = "value"
) -> DataFrame:
    """One row per id and value column; NULL values stay."""
    return df.select(*ids, *values).unpivot(list(ids), list(values), name, value)


def to_wide(
    df: DataFrame,
    ids: Sequence[str],
    name: str,
    values: Sequence[str],
    levels: Sequence[str],
    label: str = "{level}",
) -> DataFrame:
    """One column per level of ``name`` and value column; a repeated ``(ids, name)`` raises an error.

    Conditional maxima do this in one hash aggregation, where ``pivot`` needs two shuffles, and count the
    rows of each level as they go.
    """
    counts = [F.count(F.when(F.col(name) == level, 1)).alias(f"_rows_{i}") for i, level in enumerate(levels)]
    repeated = F.lit(False)
    for i in range(len(counts)):
        repeated = repeated | (F.col(f"_rows_{i}") > 1)
    cells = [
        F.max(F.when(F.col(name) == level, F.col(v))).alias(label.format(level=level, value=v))
        for level in levels
        for v in values
    ]
    wide = refuse(df.groupBy(*ids).agg(*cells, *counts), repeated, f"rows repeat a level of {name}", ids)
    return wide.drop(*[f"_rows_{i}" for i in range(len(counts))])


def metrics_wide(
    metrics: DataFrame,
    ids: Sequence[str] = ("id", "scenario", "veg_type"),
    variables: Sequence[str] = VARIABLES,
    metric_names: Sequence[str] = METRICS,
) -> DataFrame:
    """Long metrics to one row per cell and scenario with ``{variable}_{metric}`` columns."""
    return to_wide(metrics, ids, "variable", metric_names, variables, "{level}_{value}")


def code(parts: Sequence[str | Column], sep: str = "-") -> Column:
    """Join columns into one code such as ``D1-N-4``."""
    return F.concat_ws(sep, *parts)


def nest(df: DataFrame, by: Sequence[str], into: str, columns: Sequence[str]) -> DataFrame:
    """Rows of each group as an array of structs.

    For handing small groups to a caller; operators of this library keep flat rows and keys, because
    one nested group has to fit into one row.
    """
    return df.groupBy(*by).agg(F.collect_list(F.struct(*columns)).alias(into))


def unnest(df: DataFrame, column: str) -> DataFrame:
    """Array of structs back to rows; empty groups vanish."""
    keep = [c for c in df.columns if c != column]
    return df.select(*keep, F.inline(column))
