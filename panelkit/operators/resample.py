"""Random samples that depend only on a seed and on row keys, so a lost task redraws the same rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelkit.operators.numbering import block_starts, null_safe_join
from panelkit.operators.quantiles import _match
from panelkit.session import keep, settle


def random_bits(parts: Sequence[str | Column], method: str = "xxhash64") -> Column:
    """60 pseudo-random bits as a non-negative BIGINT.

    ``md5`` is slower and gives the same value in any SQL engine.
    """
    if method == "xxhash64":
        return F.shiftrightunsigned(F.xxhash64(*parts), 4)
    if method != "md5":
        raise ValueError("method must be 'xxhash64' or 'md5'")
    text = F.concat_ws("|", *[(F.col(p) if isinstance(p, str) else p).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def resample(
    df: DataFrame,
    strata: str,
    n: int,
    reps: int,
    block: Column,
    order: Sequence[str],
    seed: int = 2021,
    method: str = "xxhash64",
) -> DataFrame:
    """Draw ``n`` rows per stratum without replacement, ``reps`` times over; adds ``sample_id``.

    Strata with at most ``n`` rows come back whole in every replicate. The data is never multiplied by
    the replicates: rows have a consecutive number inside their stratum, and the replicates draw numbers.
    The blocks' row counts tell in which block and at which place of it each drawn number stands, so rows
    and drawn places meet in one exchange by block: the rows of a block are put in order, and each takes
    the replicates of its place. The data is shuffled once, and the rest of the work is ``reps * n`` draws
    per stratum.

    A NULL stratum is a stratum too. ``order`` must identify the rows of a stratum, and ``block`` must not decrease along it (see
    :func:`panelkit.operators.numbering.number_rows`).
    """
    spark = df.sparkSession
    starts = keep(block_starts(df, block, [strata]))
    sizes = starts.groupBy(strata).agg(F.sum("_n").alias("_size"))
    drawn = draw_positions(sizes, strata, n, reps, seed, method)
    both = df.withColumn("_block", block).unionByName(_drawn_places(drawn, starts, strata), allowMissingColumns=True)
    total = starts.agg(F.sum("_n")).first()[0] or 0
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // TASK_ROWS)
    both = both.repartition(tasks, strata, "_block")
    of_block = Window.partitionBy(strata, "_block")
    in_order = of_block.orderBy(F.asc_nulls_first("_rank"), *order)
    ranked = both.withColumn("_rank", F.coalesce("_rank", F.row_number().over(in_order) - 1))
    # a place holds one row, and if it was drawn the replicates stand right before it
    before = F.lag("_samples").over(of_block.orderBy("_rank", F.isnull("_samples")))
    taken = ranked.withColumn("_drawn", before).where(F.isnull("_samples") & F.isnotnull("_drawn"))
    return taken.select(*df.columns, F.explode("_drawn").alias("sample_id"))


# Rows that a task puts in order, about, where the data has more than all tasks of a shuffle would take.
TASK_ROWS = 500_000
# Numbers of a stratum that are looked up together.
SPAN = 256


def _drawn_places(drawn: DataFrame, starts: DataFrame, strata: str) -> DataFrame:
    """``strata, _block, _rank, _samples``: the place in its block of each drawn number, and who drew it."""
    # the draws are dealt out after they are exploded, so the shuffle sees their true size
    wanted = drawn.repartition(strata, "_pos").groupBy(strata, "_pos")
    wanted = wanted.agg(F.collect_list("sample_id").alias("_samples"))
    wanted = wanted.withColumn("_span", F.expr(f"_pos div {SPAN}"))
    spans = F.sequence(F.expr(f"_start div {SPAN}"), F.expr(f"(_start + _n - 1) div {SPAN}"))
    blocks = starts.withColumn("_span", F.explode(spans))
    found = null_safe_join(wanted.hint("shuffle_merge"), blocks, [strata, "_span"])
    found = found.where((F.col("_pos") >= F.col("_start")) & (F.col("_pos") < F.col("_start") + F.col("_n")))
    return found.select(strata, "_block", (F.col("_pos") - F.col("_start")).alias("_rank"), "_samples")


# Rounds of the keyed permutation; an even number leaves both halves in their places.
ROUNDS = 6
# Values of its smaller half, at most, and so more than the numbers beyond a stratum that it may give.
HALF = 64


def draw_positions(
    sizes: DataFrame, strata: str, n: int, reps: int, seed: int, method: str = "xxhash64"
) -> DataFrame:
    """``strata, sample_id, _pos``: the row numbers each replicate takes from each stratum.

    One rule for all sizes: each replicate and stratum has a permutation of its own, and takes the places
    to which that moves the first numbers. The permutation is a Feistel network over ``half * other``
    numbers, the fewest in rows of ``half`` that cover the stratum, so it gives fewer than ``half``
    numbers beyond it; so many more are moved, and of what lies in the stratum the first ``n`` count. A
    stratum of at most ``n`` rows comes back whole. The work is linear in ``n``, and each replicate and
    stratum is one row with an array of about ``n`` numbers, so its size is a parameter.
    """
    groups = sizes.withColumn("sample_id", F.explode(F.sequence(F.lit(1), F.lit(reps))))
    # few small rows with much work each: a given number of tasks, as adaptive execution would join them
    tasks = int(sizes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    groups = groups.repartition(tasks, strata, "sample_id").where("_size > 0")
    groups = groups.withColumn("_size", F.col("_size").cast("bigint"))
    groups = groups.withColumn("_half", F.least(F.lit(HALF), F.ceil(F.sqrt("_size"))).cast("bigint"))
    groups = groups.withColumn("_other", F.expr("(_size + _half - 1) div _half"))
    size, half, other = F.col("_size"), F.col("_half"), F.col("_other")

    def swapped(pair: Column, k: Column) -> Column:
        bits = random_bits([F.lit(seed), F.col("sample_id"), F.col(strata), k, pair["r"]], method)
        moved = F.pmod(pair["l"] + bits, F.when(k % 2 == 1, half).otherwise(other))
        return F.struct(pair["r"].alias("l"), moved.alias("r"))

    def moved(j: Column) -> Column:
        start = F.struct(F.pmod(j, half).alias("l"), F.floor(j / half).alias("r"))
        rounds = F.sequence(F.lit(1), F.lit(ROUNDS))
        return F.aggregate(rounds, start, swapped, lambda pair: pair["r"] * half + pair["l"])

    wanted = F.least(size, F.lit(n).cast("bigint"))
    tried = F.transform(F.sequence(F.lit(0).cast("bigint"), wanted + half * other - size - 1), moved)
    drawn = F.slice(F.filter(tried, lambda p: p < size), F.lit(1), wanted.cast("int"))
    return groups.select(strata, "sample_id", F.explode(drawn).alias("_pos"))


def sample_per_group(
    df: DataFrame,
    group: Sequence[str],
    n: int,
    key: Sequence[str],
    seed: int = 2021,
    method: str = "xxhash64",
) -> DataFrame:
    """``n`` random rows per group without replacement; smaller groups come back whole.

    Rows are taken in the order of a hash of their ``key``, which must identify them. A first pass
    counts rows per power-of-two band of the hash and group, which tells how small a hash has to be for
    at least ``n`` rows to pass; the second pass shuffles only about that many. The result equals
    ordering whole groups.
    """
    group = list(group)
    rows = df.withColumn("_h", random_bits([F.lit(seed), *key], method))
    band = F.floor(-8 * F.log2((F.col("_h") + 1) / F.lit(float(1 << 60)))).cast("int")
    rows = rows.withColumn("_k", band)
    counts = rows.groupBy(*group, "_k").agg(F.count(F.lit(1)).alias("_c"))
    downto = Window.partitionBy(*group).orderBy(F.desc("_k")).rowsBetween(Window.unboundedPreceding, 0)
    enough = F.max(F.when(F.col("_sum") >= n, F.col("_k")))
    lowest = F.min("_k")
    cuts = (
        counts.withColumn("_sum", F.sum("_c").over(downto))
        .groupBy(*group)
        .agg(F.coalesce(enough, lowest).alias("_cut"))
    )
    cuts, _ = settle(cuts)
    kept = _match(rows, cuts, group, "inner").where(F.col("_k") >= F.col("_cut"))
    first = Window.partitionBy(*group).orderBy("_h", *key)
    return (
        kept.withColumn("_rank", F.row_number().over(first))
        .where(F.col("_rank") <= n)
        .drop("_h", "_k", "_cut", "_rank")
    )
