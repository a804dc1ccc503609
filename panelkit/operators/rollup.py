"""Grids to rows, daily to monthly to yearly values, and cell attributes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelkit.operators.keys import full_by_key, join_unique
from panelkit.operators.numbering import number_rows

CELL_KEYS = ("id", "x", "y")
BLOCK_CELLS = 16_384


def grid_explode(df: DataFrame, values: Sequence[str], nx: int, out: str = "pos") -> DataFrame:
    """One row per grid cell from row-major arrays (x runs fastest), several variables side by side.

    Positions are 0-based; the arrays of one row must have equal length.
    """
    keep = [c for c in df.columns if c not in values]
    cells = df.select(*keep, F.posexplode(F.arrays_zip(*values)).alias(out, "_cell"))
    x, y = (F.col(out) % nx).cast("int"), F.floor(F.col(out) / nx).cast("int")
    return cells.select(
        *keep, x.alias("x"), y.alias("y"), *[F.col("_cell")[v].alias(v) for v in values]
    )


def monthly_rollup(
    df: DataFrame, keys: Sequence[str], values: Sequence[str], time: str = "ts", out: str = "time"
) -> DataFrame:
    """Monthly sums per key; a month without any value stays NULL."""
    month = F.trunc(F.col(time).cast("date"), "MM").alias(out)
    return df.groupBy(*keys, month).agg(*[F.sum(v).alias(v) for v in values])


def null_outliers(df: DataFrame, limits: Mapping[str, float]) -> DataFrame:
    """Values farther from zero than their limit become NULL."""
    return df.withColumns({c: F.when(F.abs(c) <= lim, F.col(c)) for c, lim in limits.items()})


def yearly_rollup(
    df: DataFrame, keys: Sequence[str], values: Sequence[str], time: str = "time"
) -> DataFrame:
    """Yearly sums per key. Missing months count as 0, so a year without any value is 0, not NULL."""
    year = F.trunc(time, "YEAR").alias("time")
    return df.groupBy(*keys, year).agg(*[F.coalesce(F.sum(v), F.lit(0.0)).alias(v) for v in values])


def yearly_panel(
    daily: DataFrame,
    keys: Sequence[str],
    values: Sequence[str],
    limits: Mapping[str, float],
    time: str = "ts",
) -> DataFrame:
    """Daily rows to yearly rows; the outlier rule applies to the monthly sums in between.

    Two small shuffles: the map side already adds up the days of a month. One aggregation with twelve
    monthly columns was measured to be slower.
    """
    monthly = monthly_rollup(daily, keys, values, time)
    return yearly_rollup(null_outliers(monthly, limits), keys, values)


def cell_id(cells: DataFrame, out: str = "id") -> DataFrame:
    """Number the cells 1, 2, ... in the order of x, then y. ``(x, y)`` must be unique.

    Pieces of grid columns are the blocks of the numbering, so no task orders more than
    ``BLOCK_CELLS`` cells at a time, however long a column is.
    """
    block = F.struct(F.col("x"), F.floor(F.col("y") / BLOCK_CELLS).alias("piece"))
    numbered = number_rows(cells, block, ["x", "y"], out)
    return numbered.withColumn(out, F.col(out) + 1)


def cell_attributes(*tables: DataFrame, keys: Sequence[str] = CELL_KEYS) -> DataFrame:
    """Full join of attribute tables on the cell keys, in one exchange.

    NULL keys match each other. A key that one table repeats raises an error when the job meets it.
    """
    return full_by_key(tables, list(keys))


def enrich_panel(panel: DataFrame, scenarios: DataFrame, cells: DataFrame) -> DataFrame:
    """Attach scenario factors and cell attributes; rows without a match keep NULLs.

    NULL keys match each other. Both attribute tables have one row per key; a repeated one, which would
    multiply panel rows, raises an error. The cell table grows with the grid, so its join strategy is
    left to the optimizer.
    """
    rows = join_unique(panel, scenarios, ["scenario"], "scenarios")
    return join_unique(rows, cells, ["x", "y"], "cells")
