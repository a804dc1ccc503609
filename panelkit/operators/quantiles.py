"""Exact quantiles of groups of any size.

``percentile`` keeps every distinct value of a group in one task, which is fine where a parameter
bounds the group (replicates, sample size) and impossible where the group grows with the data. The
operators here find the wanted ranks by counting instead: rows are counted per bucket of their sort
key, the bucket that contains a rank is split again, and only the rows of the last, small bucket are
ever ordered. Each pass is one scan with map-side aggregation, so a group that holds a third of all
rows costs its map tasks nothing extra and ships only bucket counts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelkit.functions.semantics import nan_to_null, sort_key
from panelkit.session import keep, settle

# Right shifts of the sort key: 10 mantissa bits first, then 11 more each time. A bucket of the last
# level holds at most 2**20 distinct doubles (2**21 around zero).
SHIFTS = (42, 31, 20)

# Buckets with at most this many rows are ordered right away.
ORDER_ROWS = 1_000_000


def _null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    cond = F.lit(True)
    for k in keys:
        cond = cond & left[k].eqNullSafe(right[f"_t_{k}"])
    return cond


def _match(df: DataFrame, targets: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Equi-join on keys that may be NULL."""
    renamed = targets.withColumnsRenamed({k: f"_t_{k}" for k in keys})
    joined = df.join(renamed, _null_safe(df, renamed, keys), how)
    return joined if how == "left_semi" else joined.drop(*[f"_t_{k}" for k in keys])


def _wanted(probs: Sequence[float]) -> Column:
    """Type-7 ranks of a group of ``_n`` rows: the two neighbours of position ``(n - 1) p``."""
    items = []
    for i, p in enumerate(probs):
        pos = (F.col("_n") - 1) * F.lit(float(p))
        for side, rank in enumerate((F.floor(pos), F.ceil(pos))):
            items.append(
                F.struct(
                    F.lit(i).alias("prob"),
                    F.lit(side).alias("side"),
                    (pos - F.floor(pos)).alias("frac"),
                    rank.cast("bigint").alias("rank"),
                )
            )
    return F.array(*items)


def _locate(hist: DataFrame, keys: Sequence[str], unit: str) -> DataFrame:
    """Pick, per group, the rows of ``hist`` whose cumulative count range contains a wanted rank.

    ``hist`` has ``_cnt`` per (keys, unit) and the array ``_want``; ranks in the result count from
    the start of the picked unit.
    """
    upto = Window.partitionBy(*keys).orderBy(unit).rowsBetween(Window.unboundedPreceding, 0)
    ranged = hist.withColumn("_upto", F.sum("_cnt").over(upto)).withColumn(
        "_below", F.col("_upto") - F.col("_cnt")
    )
    inside = F.filter(
        "_want", lambda w: (w["rank"] >= F.col("_below")) & (w["rank"] < F.col("_upto"))
    )
    shifted = F.transform(inside, lambda w: w.withField("rank", w["rank"] - F.col("_below")))
    return ranged.withColumn("_want", shifted).where(F.size("_want") > 0).drop("_upto", "_below")


def exact_quantiles(
    df: DataFrame, value: str, probs: Sequence[float], by: Sequence[str] = ()
) -> DataFrame:
    """One row per group with ``n`` and the array ``quantiles`` (linear interpolation, type 7).

    NULL and NaN values are left out. The counting passes run when the function is called; only bucket
    counts and the wanted buckets leave the executors.
    """
    by = list(by)
    v = F.col(value).cast("double")
    rows = df.select(*by, nan_to_null(v).alias("_v")).where(F.col("_v").isNotNull())
    rows = rows.withColumn("_key", sort_key(F.col("_v")))

    def bucket(shift: int) -> Column:
        return F.shiftright("_key", shift)

    hist = rows.groupBy(*by, bucket(SHIFTS[0]).alias("_b")).agg(F.count(F.lit(1)).alias("_cnt"))
    total = F.sum("_cnt").over(Window.partitionBy(*by))
    hist = hist.withColumn("_n", total).withColumn("_want", _wanted(probs))
    targets, _ = settle(_locate(hist, by, "_b"))

    depth = 0
    while depth + 1 < len(SHIFTS) and _largest(targets) > ORDER_ROWS:
        shift, finer = SHIFTS[depth], SHIFTS[depth + 1]
        hits = _match(rows.withColumn("_b", bucket(shift)), targets, [*by, "_b"], "left_semi")
        hist = hits.groupBy(*by, "_b", bucket(finer).alias("_f")).agg(F.count(F.lit(1)).alias("_cnt"))
        hist = _match(hist, targets.drop("_cnt"), [*by, "_b"], "inner")
        found = _locate(hist, [*by, "_b"], "_f").drop("_b").withColumnRenamed("_f", "_b")
        targets, _ = settle(found.select(*by, "_b", "_cnt", "_n", "_want"))
        depth += 1

    hits = _match(
        rows.withColumn("_b", bucket(SHIFTS[depth])), targets, [*by, "_b"], "left_semi"
    )
    counted = hits.groupBy(*by, "_b", "_v").agg(F.count(F.lit(1)).alias("_cnt"))
    counted = _match(counted, targets.drop("_cnt"), [*by, "_b"], "inner")
    found = _locate(counted, [*by, "_b"], "_v").select(*by, "_n", "_v", F.inline("_want"))
    ends = [
        F.max(F.when((F.col("prob") == i) & (F.col("side") == s), F.col("_v"))).alias(f"_q{i}_{s}")
        for i in range(len(probs))
        for s in (0, 1)
    ]
    fracs = [F.max(F.when(F.col("prob") == i, F.col("frac"))).alias(f"_f{i}") for i in range(len(probs))]
    per_group = found.groupBy(*by, "_n").agg(*ends, *fracs)
    values = [
        _between(F.col(f"_q{i}_0"), F.col(f"_q{i}_1"), F.col(f"_f{i}")) for i in range(len(probs))
    ]
    return per_group.select(*by, F.col("_n").alias("n"), F.array(*values).alias("quantiles"))


def quantile_of(values: Column, p: float) -> Column:
    """Type-7 quantile of an ascending array without NULLs; NULL if it is empty."""
    pos = (F.size(values) - 1) * F.lit(float(p))
    low, high = F.get(values, F.floor(pos).cast("int")), F.get(values, F.ceil(pos).cast("int"))
    return _between(low, high, pos - F.floor(pos))


def bounded_quantiles(
    df: DataFrame, value: str, probs: Sequence[float], by: Sequence[str]
) -> DataFrame:
    """Type-7 quantiles of groups whose size is bounded by a parameter, as the array ``quantiles``.

    For replicate statistics, where a group holds one value per replicate or per drawn row. The values
    of a group meet in one sorted array, and the map side already packs them, so the shuffle carries
    bare numbers instead of rows with their keys. NULL values are left out.
    """
    packed = df.groupBy(*by).agg(F.sort_array(F.collect_list(F.col(value).cast("double"))).alias("_a"))
    found = [quantile_of(F.col("_a"), p) for p in probs]
    return packed.select(*by, F.array(*found).alias("quantiles"))


def _between(low: Column, high: Column, frac: Column) -> Column:
    """Interpolation; equal ends stay as they are, as infinity times a zero weight would give NaN."""
    return F.when(low == high, low).otherwise((1 - frac) * low + frac * high)


def _largest(targets: DataFrame) -> int:
    return targets.agg(F.max("_cnt")).first()[0] or 0


def pooled_quantiles(
    df: DataFrame, value: str, probs: Sequence[float], names: Sequence[str] | None = None
) -> DataFrame:
    """Quantiles of a whole column as rows ``quantile, probability, value``."""
    names = list(names or [f"{p * 100:g}%" for p in probs])
    found = exact_quantiles(df, value, probs)
    label = F.array(*[F.lit(n) for n in names])
    prob = F.array(*[F.lit(float(p)) for p in probs])
    return found.select(
        F.inline(F.arrays_zip(label.alias("quantile"), prob.alias("probability"), F.col("quantiles")))
    ).toDF("quantile", "probability", "value")


def quantile_values(df: DataFrame, value: str, probs: Sequence[float]) -> list[float]:
    """Quantiles of a whole column as numbers, to be used as literals in later expressions."""
    row = exact_quantiles(df, value, probs).first()
    return [None] * len(probs) if row is None else list(row["quantiles"])


# Distinct values of a bucket of the cumulative share, at most, are 2 to this power.
SHARE_SHIFT = 20


def cumulative_share(queries: DataFrame, query: str, sample: DataFrame, value: str, out: str) -> DataFrame:
    """Add ``out``: share of the sample that is not larger than the query value.

    Sample and query values are counted together per distinct value, and running totals over the values
    give the shares: inside buckets of neighbouring values, over the buckets of a partition of the value
    range, and over the partitions, so no task orders more than one of these. NULL and NaN queries and
    queries against an empty sample have no share.
    """
    q = nan_to_null(F.col(query).cast("double"))
    rows = queries.withColumn("_q", q)
    s = sample.select(nan_to_null(F.col(value).cast("double")).alias("_v")).where("_v is not null")
    both = s.select("_v", F.lit(1).alias("_c"), F.lit(False).alias("_asked")).unionByName(
        rows.where("_q is not null").select(F.col("_q").alias("_v"), F.lit(0).alias("_c"), F.lit(True).alias("_asked"))
    )
    # 0.0 + v makes -0.0 and 0.0 one value, as in comparisons
    counts = both.groupBy((F.lit(0.0) + F.col("_v")).alias("_v")).agg(
        F.sum("_c").alias("_c"), F.max("_asked").alias("_asked")
    )
    counts = keep(counts.withColumn("_b", F.shiftright(sort_key(F.col("_v")), SHARE_SHIFT)))
    totals = counts.groupBy("_b").agg(F.sum("_c").alias("_bc"))
    totals = keep(totals.repartitionByRange("_b").withColumn("_part", F.spark_partition_id()))
    parts = totals.groupBy("_part").agg(F.sum("_bc").alias("_pc"))
    # one row per partition
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(
        "_part",
        F.coalesce(F.sum("_pc").over(earlier), F.lit(0)).alias("_before"),
        F.sum("_pc").over(Window.partitionBy()).alias("_all"),
    )
    inside = Window.partitionBy("_part").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.withColumn("_start", F.coalesce(F.sum("_bc").over(inside), F.lit(0))).join(parts, "_part")
    starts = starts.select("_b", (F.col("_start") + F.col("_before")).alias("_start"), "_all")
    upto = Window.partitionBy("_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.withColumn("_inside", F.sum("_c").over(upto)).where("_asked").join(starts, "_b")
    share = F.try_divide(F.col("_start") + F.col("_inside"), F.col("_all"))
    shares = ranked.select(F.col("_v").alias("_asked_v"), share.alias(out))
    return rows.join(shares, F.lit(0.0) + F.col("_q") == F.col("_asked_v"), "left").drop("_q", "_asked_v")
