"""Consecutive row numbers over a total order, without sorting the table in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelkit.session import keep


def block_counts(df: DataFrame, block: Column, by: Sequence[str] = ()) -> DataFrame:
    """Rows per block of each group: ``by, _block, _n``."""
    blocked = df.withColumn("_block", block)
    return blocked.groupBy(*by, "_block").agg(F.count(F.lit(1)).alias("_n"))


def block_starts(df: DataFrame, block: Column, by: Sequence[str] = ()) -> DataFrame:
    """Rows before each block inside its group: ``by, _block, _n, _start``.

    Blocks are dealt to partitions by ranges. Running totals inside a partition and over the partitions
    of a group give the starts, so a group with very many blocks spreads over many tasks.
    """
    counts = block_counts(df, block, by).repartitionByRange(*by, "_block")
    counts = keep(counts.withColumn("_part", F.spark_partition_id()))
    parts = counts.groupBy(*by, "_part").agg(F.sum("_n").alias("_pn"))
    earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(*by, "_part", F.coalesce(F.sum("_pn").over(earlier), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*by, "_part").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("_start", F.coalesce(F.sum("_n").over(inside), F.lit(0)))
    joined = null_safe_join(starts, parts, [*by, "_part"])
    return joined.select(*by, "_block", "_n", (F.col("_start") + F.col("_before")).alias("_start"))


def number_rows(
    df: DataFrame, block: Column, order: Sequence[str], out: str, by: Sequence[str] = ()
) -> DataFrame:
    """Add ``out``: 0-based position of each row inside its ``by`` group.

    ``block`` must not decrease along ``order`` and should hold few rows per value. Rows are ranked
    inside their block, and the block starts come from running totals of the block counts
    (:func:`block_starts`). NULL groups are groups of their own; rows whose block is NULL come first, in
    one block.
    """
    return _numbered(df, block, order, out, by, block_starts(df, block, by))


def _numbered(
    df: DataFrame, block: Column, order: Sequence[str], out: str, by: Sequence[str], starts: DataFrame
) -> DataFrame:
    inside = Window.partitionBy(*by, "_block").orderBy(*order)
    ranked = df.withColumn("_block", block).withColumn("_rank", F.row_number().over(inside) - 1)
    return (
        null_safe_join(ranked, starts.drop("_n"), [*by, "_block"])
        .withColumn(out, (F.col("_start") + F.col("_rank")).cast("bigint"))
        .drop("_block", "_start", "_rank")
    )


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join on keys that may be NULL; the keys come once."""
    right = right.withColumnsRenamed({k: f"_t_{k}" for k in keys})
    match = F.lit(True)
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"_t_{k}"))
    joined = left.join(right, match, how)
    return joined if how == "left_semi" else joined.drop(*[f"_t_{k}" for k in keys])
