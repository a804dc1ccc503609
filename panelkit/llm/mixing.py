"""Mixing sources to target weights by random order, prefix sums and exact cuts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelkit.llm.prefix import running_totals
from panelkit.llm.words import WORD

# More sources than this are refused: their targets are worked out in one place.
MAX_SOURCES = 100_000


def word_count(text: str) -> Column:
    """Number of words of a text; NULL counts as empty."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("bigint")


def cycled_weights(sources: Sequence[str | None], cycle: Sequence[float] = (3.0, 1.0, 2.0)) -> dict:
    """Weights by the place of a source in code point order, NULL last, repeating ``cycle``."""
    ordered = sorted((s for s in sources if s is not None)) + [None] * (None in sources)
    return {s: float(cycle[i % len(cycle)]) for i, s in enumerate(ordered)}


def fill_targets(
    sizes: Mapping, weights: Mapping, budget: float, max_epochs: float
) -> dict:
    """Share ``budget`` by weight; no target exceeds ``max_epochs`` times its source's size.

    What sources above their limit leave over is shared among the others by weight, until none is above.
    A source without words has the target 0.
    """
    limit = {s: max_epochs * n for s, n in sizes.items()}
    targets = {s: 0.0 for s, n in sizes.items() if not n}
    open_, left = [s for s in sizes if s not in targets], float(budget)
    while open_:
        share = left / sum(weights[s] for s in open_)
        full = [s for s in open_ if share * weights[s] > limit[s]]
        if not full:
            targets |= {s: share * weights[s] for s in open_}
            break
        targets |= {s: float(limit[s]) for s in full}
        left -= sum(limit[s] for s in full)
        open_ = [s for s in open_ if s not in targets]
    return targets


def mix_sources(
    docs: DataFrame,
    key: str = "doc_id",
    source: str = "source",
    text: str = "text",
    weights: Mapping | None = None,
    share: float = 1.5,
    max_epochs: float = 2.0,
    seed: int = 7,
) -> DataFrame:
    """How many words of each document a mix takes: ``key, source, size, source_size, target, taken``.

    A document's size is its number of words. Each source gets a target (:func:`fill_targets`) of all
    words times ``share``. Its documents are put in an order that a hash of seed and key makes random,
    and running totals of their sizes lay them on a line; the mix takes the line from its start to the
    target, going through it again as often as needed. So a source's taken words equal its target
    rounded down, the document at the cut gives a part of its words, and nothing exceeds
    ``ceil(max_epochs)`` times its size.

    ``weights`` gives a weight per source, by default :func:`cycled_weights`. The order depends on key,
    size and seed only, so reruns agree; rows that repeat a key are documents of their own, and where
    they tie in size either may be the one at the cut. NULL texts have size 0, NULL sources are a source
    of their own, NULL keys are allowed. An empty table gives an empty result.
    """
    sized = docs.select(F.col(key).alias("_id"), F.col(source).alias("_source"), word_count(text).alias("size"))
    sized = sized.withColumn("_order", F.xxhash64(F.lit(seed), F.col("_id"), F.col("size")))
    line = running_totals(sized, ["_source"], ["_order", "_id", "size"], "size", "_before")
    rows = line.groupBy("_source").agg(F.sum("size").alias("n")).limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    sizes = {r["_source"]: r["n"] for r in rows}
    targets = fill_targets(
        sizes, weights or cycled_weights(list(sizes)), share * sum(sizes.values()), max_epochs
    )
    table = docs.sparkSession.createDataFrame(
        [(s, int(n), float(targets[s])) for s, n in sizes.items()],
        "_s string, source_size bigint, target double",
    )
    joined = line.join(F.broadcast(table), F.col("_source").eqNullSafe(F.col("_s")))
    rounds = F.floor(F.col("target")).cast("bigint")
    whole = F.when(F.col("source_size") > 0, F.floor(rounds / F.col("source_size"))).otherwise(0).cast("bigint")
    rest = rounds - whole * F.col("source_size")
    last = F.greatest(F.lit(0).cast("bigint"), F.least(F.col("size"), rest - F.col("_before")))
    return joined.select(
        F.col("_id").alias(key),
        F.col("_source").alias(source),
        "size",
        "source_size",
        "target",
        (whole * F.col("size") + last).alias("taken"),
    )


def mixed_documents(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", **options) -> DataFrame:
    """The documents of the mix with all their columns, as often as the mix takes them.

    A document is taken whole: it comes ``taken / size`` times, rounded to the nearest number, so only
    those at a cut differ from :func:`mix_sources`. Documents without words are left out; rows that
    repeat key, source and size come equally often.
    """
    counts = mix_sources(docs, key, source, text, **options).where(F.col("size") > 0)
    counts = counts.groupBy(
        F.col(key).alias("_k"), F.col(source).alias("_s"), F.col("size").alias("_n")
    ).agg(F.round(F.sum("taken") / F.sum("size")).cast("int").alias("_times"))
    own = {c: f"_c{i}" for i, c in enumerate(docs.columns)}
    rows = docs.select(*[F.col(f"`{c}`").alias(v) for c, v in own.items()])
    same = (
        F.col(own[key]).eqNullSafe(F.col("_k"))
        & F.col(own[source]).eqNullSafe(F.col("_s"))
        & (word_count(own[text]) == F.col("_n"))
    )
    joined = rows.join(counts.where(F.col("_times") > 0), same)
    again = joined.withColumn("_again", F.explode(F.sequence(F.lit(1), F.col("_times"))))
    return again.select(*[F.col(v).alias(c) for c, v in own.items()])
