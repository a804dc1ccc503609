"""Running totals over a range-sorted table, without a window over the whole table."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelkit.session import keep


def running_totals(
    df: DataFrame, by: Sequence[str], order: Sequence, value: str, out: str
) -> DataFrame:
    """Add ``out``: the sum of ``value`` over all earlier rows of the row's ``by`` group.

    The table is range-partitioned and sorted by ``by`` and ``order``, so a hot group spreads over many
    tasks. Each task adds up its own rows, the sums of the tasks are stored with their partition, and
    one row per task and group, few rows as groups are consecutive, turns them into starts. The sorted
    table is written once, so rows that tie keep their place in whatever reads it.

    Missing values count as 0; NULL groups are groups of their own.
    """
    by = list(by)
    schema = T.StructType([*df.schema.fields, T.StructField("_part", T.LongType()), T.StructField(out, T.LongType())])
    own, names = df.columns, schema.names

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, total = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            amount = np.asarray(batch.column(value).fill_null(0)).astype(np.int64)
            upto = np.cumsum(amount)
            before = upto - amount
            new = np.zeros(len(amount), bool)
            for name in by:
                column = batch.column(name)
                new[1:] |= _differs(column)
            first = tuple(batch.column(name)[0].as_py() for name in by)
            starts = np.flatnonzero(new)
            carried = total if first == last else 0
            base = np.zeros(len(starts) + 1, np.int64)
            base[0], base[1:] = -carried, before[starts]
            before -= base[np.cumsum(new)]
            last = tuple(batch.column(name)[-1].as_py() for name in by)
            total = int(before[-1] + amount[-1])
            part = batch.column("_part")
            columns = [batch.column(c) for c in own]
            yield pa.RecordBatch.from_arrays([*columns, part, pa.array(before)], names=names)

    # a small table needs few tasks; the number follows the setting for shuffles
    ordered = df.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order)
    ordered = ordered.withColumn("_part", F.spark_partition_id().cast("bigint"))
    local = keep(ordered.mapInArrow(add_up, schema))
    totals = local.groupBy(*by, "_part").agg(F.sum(F.coalesce(F.col(value), F.lit(0))).alias("_sum"))
    earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(
        *[F.col(c).alias(f"_s_{c}") for c in by],
        F.col("_part").alias("_s_part"),
        F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_start"),
    )
    match = F.col("_part") == F.col("_s_part")
    for c in by:
        match = match & F.col(c).eqNullSafe(F.col(f"_s_{c}"))
    joined = local.join(starts, match)
    return joined.withColumn(out, F.col(out) + F.col("_start")).select(*df.columns, out)


def _differs(column: pa.Array) -> np.ndarray:
    """Whether each value but the first differs from the one before it."""
    codes = column.dictionary_encode(null_encoding="encode").indices
    codes = np.asarray(codes)
    return codes[1:] != codes[:-1]
