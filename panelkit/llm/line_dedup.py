"""Repeated runs of lines by a distributed suffix array, with DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelkit.llm.words import WORD
from panelkit.session import keep

# Shortest repeated run, in words, whose later copies are deleted.
MIN_WORDS = 50

# Rows of a block whose running totals one task works out.
BLOCK_BITS = 12


def _text(text: str) -> Column:
    return F.coalesce(F.col(text), F.lit(""))


def _lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Lines with a word: ``_d, _x, _i, _pos, _h1, _h2, _w``, with two independent hashes and word counts."""
    rows = docs.select(F.col(key).alias("_d"), F.xxhash64(_text(text)).alias("_x"), _text(text).alias("_t"))
    split = rows.select("_d", "_x", F.posexplode(F.split("_t", "\n")).alias("_pos", "_line"))
    lines = split.select(
        "_d",
        "_x",
        "_pos",
        F.xxhash64("_line").alias("_h1"),
        F.xxhash64(F.lit(1), "_line").alias("_h2"),
        F.regexp_count("_line", F.lit(WORD)).cast("bigint").alias("_w"),
    ).where("_w > 0")
    return lines


def _repeated(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")


def _islands(rows: DataFrame, by: list[str], place: str, out: str) -> DataFrame:
    """Number the stretches of consecutive places of each group."""
    order = Window.partitionBy(*by).orderBy(place)
    return rows.withColumn(out, F.col(place) - F.row_number().over(order))


def _before(groups: DataFrame, keys: list[str]) -> DataFrame:
    """Order groups by their keys and add ``_start``, the sum of ``_n`` over all groups before.

    Totals run inside blocks, over the blocks of a piece and over the pieces, so no task meets more than
    a block, however the keys are distributed.
    """
    ordered = groups.repartitionByRange(*keys).sortWithinPartitions(*keys)
    ordered = keep(ordered.withColumn("_id", F.monotonically_increasing_id()))
    ordered = ordered.withColumn("_block", F.shiftright("_id", BLOCK_BITS))
    blocks = ordered.groupBy("_block").agg(F.sum("_n").alias("_sum"))
    blocks = blocks.withColumn("_piece", F.shiftright("_block", BLOCK_BITS))
    pieces = blocks.groupBy("_piece").agg(F.sum("_sum").alias("_all"))
    earlier = Window.orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.select("_piece", F.coalesce(F.sum("_all").over(earlier), F.lit(0)).alias("_from"))
    earlier = Window.partitionBy("_piece").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_upto", F.coalesce(F.sum("_sum").over(earlier), F.lit(0))).join(pieces, "_piece")
    blocks = blocks.select("_block", (F.col("_from") + F.col("_upto")).alias("_from"))
    earlier = Window.partitionBy("_block").orderBy("_id").rowsBetween(Window.unboundedPreceding, -1)
    inside = ordered.withColumn("_upto", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    return inside.join(blocks, "_block").select(*keys, "_n", (F.col("_from") + F.col("_upto")).alias("_start"))


def suffix_ranks(symbols: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Suffix array by prefix doubling: every suffix ``_p, _end, _rank``, and the ranks of each level.

    ``symbols`` has a row ``_p, _end, _rank, _n`` per place of the sequences: places of one sequence are
    consecutive numbers up to ``_end``, ``_rank`` is the number of symbols in all sequences that are smaller than
    this one, and ``_n`` how often it occurs.

    A rank is the place in the suffix array where the suffixes that agree so far begin. A level doubles
    the number of symbols looked at: suffixes of one rank are told apart by the rank of what follows, and
    each part starts where the parts before it end. Who stands alone or has reached the end of the
    sequence is settled, has its last rank and leaves; suffixes that are equal to their ends share one.
    The ``k``-th level holds ``_p, _rank`` of the suffixes that agree with another one in ``2 ** k`` symbols.
    """
    alone = (F.col("_n") == 1) | (F.col("_next") == -1)
    settled = [symbols.where("_n = 1").select("_p", "_end", "_rank")]
    active = symbols.where("_n > 1").select("_p", "_end", "_rank")
    levels, step = [], 1
    while True:
        levels.append(active.where(F.col("_end") - F.col("_p") + 1 >= step).select("_p", "_rank"))
        if active.isEmpty():
            break
        every = active
        for part in settled:
            every = every.unionByName(part)
        ahead = every.select(F.col("_p").alias("_q"), F.col("_rank").alias("_next"))
        match = (F.col("_p") + step == F.col("_q")) & (F.col("_p") + step <= F.col("_end"))
        pairs = active.join(ahead, match, "left").withColumn("_next", F.coalesce("_next", F.lit(-1)))
        pairs = keep(pairs.select("_p", "_end", "_rank", "_next"))
        parts = keep(pairs.groupBy("_rank", "_next").agg(F.count(F.lit(1)).alias("_n")))
        parts = keep(_before(parts, ["_rank", "_next"]))
        bases = parts.groupBy("_rank").agg(F.min("_start").alias("_base"))
        moved = F.col("_rank") + F.col("_start") - F.col("_base")
        parts = keep(parts.join(bases, "_rank").select("_rank", "_next", "_n", moved.alias("_new")))
        named = pairs.join(parts, ["_rank", "_next"]).select("_p", "_end", F.col("_new").alias("_rank"), "_n", "_next")
        named = keep(named)
        settled.append(named.where(alone).select("_p", "_end", "_rank"))
        active = named.where(~alone).select("_p", "_end", "_rank")
        step *= 2
    every = settled[0]
    for part in settled[1:]:
        every = every.unionByName(part)
    return keep(every), levels


def common_prefixes(ranks: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """Different suffixes in the order of the suffix array: ``_rank, _n, _first, _lcp``.

    ``_n`` suffixes are equal and ``_first`` is the first place of them. As ranks are places in the array, the
    next suffix has the rank ``_rank + _n``. ``_lcp`` is the number of symbols shared with the suffix before, 0
    for the first: from the deepest level down, what both agree in is passed and the rest looked up.
    """
    least = F.min(F.struct("_p", "_end")).alias("_least")
    classes = ranks.groupBy("_rank").agg(F.count(F.lit(1)).alias("_n"), least)
    classes = keep(classes.select("_rank", "_n", F.col("_least._p").alias("_first"), F.col("_least._end").alias("_end")))
    above = classes.select(
        (F.col("_rank") + F.col("_n")).alias("_rank"), F.col("_first").alias("_a"), F.col("_end").alias("_a_end")
    )
    below = classes.select("_rank", F.col("_first").alias("_b"), F.col("_end").alias("_b_end"))
    pairs = keep(above.join(below, "_rank").withColumn("_lcp", F.lit(0).cast("bigint")))
    for k in reversed(range(len(levels))):
        for side in ("_a", "_b"):
            level = levels[k].select(F.col("_p").alias(f"{side}_p"), F.col("_rank").alias(f"{side}_rank"))
            at = F.col(side) + F.col("_lcp")
            pairs = pairs.join(level, (at == F.col(f"{side}_p")) & (at <= F.col(f"{side}_end")), "left")
        more = F.when(F.col("_a_rank") == F.col("_b_rank"), 2**k).otherwise(0)
        pairs = keep(pairs.select("_rank", "_a", "_a_end", "_b", "_b_end", (F.col("_lcp") + more).alias("_lcp")))
    found = classes.drop("_end").join(pairs.select("_rank", "_lcp"), "_rank", "left")
    return found.withColumn("_lcp", F.coalesce("_lcp", F.lit(0)))


def _intervals(windows: DataFrame) -> DataFrame:
    """Add ``_from``, the rank where the interval of common prefixes of ``_len`` that holds a row begins.

    Rows are ``_rank, _lcp, _len`` and more. An interval begins where the suffix before shares less than
    ``_len`` lines. All suffixes of an interval have the same stretches, so they follow each other here
    too, and the beginning is the last one so far: inside a block of ranks, or else in blocks before.
    """
    begins = F.when(F.col("_lcp") < F.col("_len"), F.col("_rank"))
    rows = windows.withColumns({"_begin": begins, "_block": F.shiftright("_rank", BLOCK_BITS)})
    rows = keep(rows)
    blocks = rows.groupBy("_len", "_block").agg(F.max("_begin").alias("_last"))
    blocks = blocks.withColumn("_piece", F.shiftright("_block", BLOCK_BITS))
    pieces = blocks.groupBy("_len", "_piece").agg(F.max("_last").alias("_last"))
    earlier = Window.partitionBy("_len").orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.select("_len", "_piece", F.max("_last").over(earlier).alias("_far"))
    earlier = Window.partitionBy("_len", "_piece").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_near", F.max("_last").over(earlier)).join(pieces, ["_len", "_piece"])
    blocks = blocks.select("_len", "_block", F.greatest("_near", "_far").alias("_before"))
    here = Window.partitionBy("_len", "_block").orderBy("_rank").rowsBetween(Window.unboundedPreceding, 0)
    inside = rows.withColumn("_here", F.max("_begin").over(here)).join(blocks, ["_len", "_block"])
    found = inside.withColumn("_from", F.greatest("_here", "_before"))
    return found.drop("_begin", "_block", "_here", "_before")


def _windows(active: DataFrame, min_words: int) -> DataFrame:
    """Shortest stretches of enough words: from each line on, and up to each line: ``_p, _len``."""
    by = Window.partitionBy("_end")
    upto = by.orderBy("_p").rowsBetween(Window.unboundedPreceding, 0)
    ends = active.withColumn("_to", F.sum("_w").over(upto))
    ends = ends.withColumn("_from", F.col("_to") - F.col("_w"))
    ahead = F.count(F.lit(1)).over(by.orderBy("_from").rangeBetween(0, min_words - 1))
    back = F.count(F.lit(1)).over(by.orderBy("_to").rangeBetween(1 - min_words, 0))
    total = F.max("_to").over(by)
    sized = ends.select("_p", "_to", "_from", ahead.alias("_ahead"), back.alias("_back"), total.alias("_total"))
    forward = F.when(
        F.col("_total") - F.col("_from") >= min_words, F.struct(F.col("_p"), F.col("_ahead").alias("_len"))
    )
    backward = F.when(
        F.col("_to") >= min_words,
        F.struct((F.col("_p") - F.col("_back") + 1).alias("_p"), F.col("_back").alias("_len")),
    )
    both = F.array_distinct(F.array_compact(F.array(forward, backward)))
    return sized.select(F.inline(both)).distinct()


def repeated_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """Lines in later copies of repeated runs: ``key, _x, n_lines, removed_lines``, one row per document.

    A run is a stretch of consecutive lines of a document, lines without words left aside, and counts if
    it has ``min_words`` words or more. A line is removed when it lies in such a run that also stands
    earlier in the corpus: in a document with a smaller key, or further up in the same one. What stands
    first is never removed. ``removed_lines`` are places in the text split at newlines, from 0.

    Lines are numbered; one that occurs once breaks the sequence. :func:`suffix_ranks` builds the suffix
    array over the sequences, :func:`common_prefixes` the longest common prefixes of neighbours. Every run
    is covered by its shortest stretches of ``min_words`` words; the copies of a stretch of ``n`` lines
    are the interval of the array whose common prefixes have ``n`` lines or more. The one that stands
    first in the corpus stays, the others are deleted, and neighbouring stretches join up to the maximal
    repeated runs.

    Rows that repeat key and text are one document and come once. NULL keys sort first; NULL and empty
    texts have one empty line and lose nothing; an empty table gives an empty result. Lines are told by
    two independent 64-bit hashes. Groups are combined before they are shuffled, so a line that a third
    of the documents share is no bottleneck.
    """
    lines = _lines(docs, key, text).distinct()
    place = Window.partitionBy("_d", "_x").orderBy("_pos")
    lines = keep(lines.withColumn("_i", F.row_number().over(place).cast("bigint")))

    # what occurs once cannot be in a repeated run and breaks the sequence
    symbols = keep(_before(keep(_repeated(lines, ["_h1", "_h2"])), ["_h1", "_h2"]))
    active = lines.join(symbols, ["_h1", "_h2"])
    active = active.select("_d", "_x", "_i", "_pos", "_w", F.col("_start").alias("_rank"), "_n")
    active = _islands(active, ["_d", "_x"], "_i", "_run")
    # places in the order of the corpus; a document stays in one partition, so its places are consecutive
    active = keep(active).repartitionByRange("_d", "_x").sortWithinPartitions("_d", "_x", "_i")
    active = keep(active.withColumn("_p", F.monotonically_increasing_id()))
    run = Window.partitionBy("_d", "_x", "_run")
    active = keep(active.withColumn("_end", F.max("_p").over(run)).drop("_run", "_i"))

    ranks, levels = suffix_ranks(active.select("_p", "_end", "_rank", "_n"))
    classes = keep(common_prefixes(ranks, levels))
    stretches = _windows(active, min_words).join(classes, F.col("_p") == F.col("_first")).drop("_p")
    stretches = keep(_intervals(stretches))
    copies = stretches.groupBy("_len", "_from").agg(F.min("_first").alias("_stays"), F.sum("_n").alias("_copies"))
    copies = stretches.select("_rank", "_len", "_from").join(copies.where("_copies > 1"), ["_len", "_from"])
    # both sides are stored tables, so adaptive execution can split the suffix that very many share
    later = ranks.select("_rank", "_p").join(keep(copies.select("_rank", "_len", "_stays")), "_rank")
    later = later.where("_p <> _stays").groupBy("_p").agg(F.max("_len").alias("_len"))

    gone = later.select(F.explode(F.sequence("_p", F.col("_p") + F.col("_len") - 1)).alias("_p")).distinct()
    gone = active.join(gone, "_p", "left_semi")
    per_doc = gone.groupBy("_d", "_x").agg(F.sort_array(F.collect_list("_pos")).alias("_gone"))
    every = docs.select(
        F.col(key).alias("_d"), F.xxhash64(_text(text)).alias("_x"), F.size(F.split(_text(text), "\n")).alias("n_lines")
    ).distinct()
    joined = _same(every, per_doc, ["_d", "_x"], "left")
    removed = F.coalesce("_gone", F.array().cast("array<int>")).alias("removed_lines")
    return joined.select(F.col("_d").alias(key), "_x", "n_lines", removed)


def _same(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Equi-join on keys of which the document's may be NULL."""
    right = right.withColumnsRenamed({k: f"_r{k}" for k in keys})
    match = F.lit(True)
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"_r{k}"))
    joined = left.join(right, match, how)
    return joined if how == "left_semi" else joined.drop(*[f"_r{k}" for k in keys])


def drop_repeated_lines(
    docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS
) -> DataFrame:
    """``docs`` without the lines of :func:`repeated_lines`; NULL texts stay NULL, rows are not merged."""
    found = repeated_lines(docs, key, text, min_words).select(
        F.col(key).alias("_d"), F.col("_x"), F.col("removed_lines").alias("_gone")
    )
    own = {c: f"_c{i}" for i, c in enumerate(docs.columns)}
    rows = docs.select(*[F.col(f"`{c}`").alias(v) for c, v in own.items()])
    match = F.col(own[key]).eqNullSafe(F.col("_d")) & (F.xxhash64(_text(own[text])) == F.col("_x"))
    joined = rows.join(found.where(F.size("_gone") > 0), match, "left")
    rest = F.filter(F.split(own[text], "\n"), lambda _, i: ~F.array_contains("_gone", i))
    clean = F.when(F.col("_gone").isNull(), F.col(own[text])).otherwise(F.array_join(rest, "\n"))
    return joined.select(*[(clean if c == text else F.col(v)).alias(c) for c, v in own.items()])
