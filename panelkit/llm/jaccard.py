"""Exact n-gram Jaccard join with set-relation skipping, and the components of its links.

Documents are sets of word n-grams. Identical sets are one set from the start. A pair of sets with a
Jaccard index of at least ``num / den`` misses at most ``n - ceil(n * num / den)`` of each set's ``n``
members, which the steps use three times: to drop sets that share too few members with any other, to
index the others by their rarest members only, and to skip the positions of lists inside a block where
sizes do not fit. How many sets hold a member is counted for sorted, packed runs of members, so no member
moves as a row of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelkit.llm.components import connected_components
from panelkit.llm.packed import in_order, occurrences, pack, unpack
from panelkit.llm.prefix import running_totals
from panelkit.llm.words import Texts, chunks, combine, mix, windows
from panelkit.session import discard, keep, settle

# Sets that a task compares with each other; larger clusters are cut into blocks of so many.
BLOCK = 256
# Sets of small clusters that are handed to Python together.
GROUP = 256
# Text, or hashes, of the documents whose members move together, in bytes; one long text is taken whole.
BLOCK_BYTES = 8 << 20
# Share of a set's members that the first look takes beyond those a partner may lack.
FIRST = 0.05

_SIGN = np.uint64(1 << 63)


def _sets(texts: Texts, size: int) -> Iterator[np.ndarray]:
    """Sorted distinct n-gram hashes of each document; with fewer words, its whole sequence is one."""
    hashes = texts.hashes()
    grams = windows(hashes, size)
    for first, count in zip(texts.first.tolist(), texts.counts.tolist(), strict=False):
        if count >= size:
            yield np.unique(grams[first : first + count - size + 1])
        elif count:
            yield combine([hashes[first + k : first + k + 1] for k in range(count)])
        else:
            yield np.zeros(0, np.uint64)


def _signed(values: np.ndarray) -> np.ndarray:
    return (values ^ _SIGN).view(np.int64)


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)])
    flat = _signed(np.concatenate(arrays)) if arrays else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))


def _least_partner(n, num: int, den: int):
    """Smallest size of a set linked to one of ``n`` members, for numbers and columns."""
    return F.ceil(n * num / den) if isinstance(n, Column) else -(-n * num // den)


def _extra(n, share: float):
    """Members a look takes beyond those that a partner may lack; grows with ``n``."""
    return F.floor(n * share) + 1 if isinstance(n, Column) else int(n * share) + 1


def _look(n, share: float, num: int, den: int):
    """How many of its smallest members a set shows in a look."""
    taken = n - _least_partner(n, num, den) + _extra(n, share)
    return F.least(n, taken) if isinstance(n, Column) else min(n, taken)


def _sorted_blocks(rows: list[pa.Array], names: list[str], number: int, arrays: list[np.ndarray]) -> pa.RecordBatch:
    """One block row: columns of its rows as lists, all their hashes sorted, and which row has each."""
    flat = np.concatenate([np.zeros(0, np.uint64), *arrays])
    owner = np.repeat(np.arange(len(arrays), dtype="<u4"), [len(a) for a in arrays])
    order = np.argsort(flat)
    packed = [pa.array([pack(v[order])], pa.binary()) for v in (flat.astype("<u8"), owner)]
    lists = [pa.ListArray.from_arrays(pa.array([0, len(r)], pa.int32()), r) for r in rows]
    return pa.RecordBatch.from_arrays([pa.array([number]), *packed, *lists], names=["_block", "_hashes", "_owner", *names])


def _heads(docs: DataFrame, key: str, text: str, size: int, num: int, den: int) -> DataFrame:
    """Blocks of documents, ``_block, _hashes, _owner`` and lists of the rows' ``_id, _x, _n, _d1, _d2``.

    The hashes are what the first look shows of each set.
    """
    kind = docs.select(key).schema[0].dataType.simpleString()
    names = ["_id", "_x", "_n", "_d1", "_d2"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, rows, heads, held = TaskContext.get().partitionId() << 33, [], [], 0

        def block() -> pa.RecordBatch:
            return _sorted_blocks([pa.concat_arrays(c) for c in zip(*rows, strict=True)], names, number, heads)

        for batch in batches:
            for i, j, texts in chunks(batch.column(2), lower=True):
                sets = list(_sets(texts, size))
                n = np.array([len(s) for s in sets], np.int64)
                rows.append([*[batch.column(c).slice(i, j - i) for c in (0, 1)], pa.array(n), *[pa.array(d) for d in _digests(sets)]])
                heads += [s[: _look(len(s), FIRST, num, den)] for s in sets]
                held += len(texts.buf)
                if held >= BLOCK_BYTES:
                    yield block()
                    number, rows, heads, held = number + 1, [], [], 0
        if rows:
            yield block()

    lists = f"_id array<{kind}>, " + ", ".join(f"{c} array<bigint>" for c in names[1:])
    return _texts(docs, key, text).mapInArrow(run, f"_block bigint, _hashes binary, _owner binary, {lists}")


def _first_look(blocks: DataFrame) -> DataFrame:
    """``_id, _x, _n, _d1, _d2, _known``: each document, and how many of the members shown stand elsewhere."""
    n_blocks = blocks.count()
    kind = blocks.schema["_id"].dataType.elementType.simpleString()
    names = ["_id", "_x", "_n", "_d1", "_d2"]

    def run(block: pa.Table, answers: pa.Table) -> pa.Table:
        owner = unpack(block.column("_owner")[0].as_py(), "<u4")
        rows = [block.column(c).combine_chunks().values for c in names]
        known = np.bincount(owner, in_order(answers) > 1, len(rows[0])).astype(np.int64)
        return pa.table([*rows, pa.array(known)], names=[*names, "_known"])

    own = blocks.drop("_hashes").repartition(max(n_blocks // 2, 1), "_block")
    answers = occurrences(blocks, n_blocks).repartition(max(n_blocks // 2, 1), "_block")
    schema = f"_id {kind}, _x bigint, _n bigint, _d1 bigint, _d2 bigint, _known bigint"
    return own.groupBy("_block").cogroup(answers.groupBy("_block")).applyInArrow(run, schema)


def _texts(docs: DataFrame, key: str, text: str) -> DataFrame:
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(key).alias("_id"), F.xxhash64(body).alias("_x"), body.alias("_text"))


def _digests(sets: list[np.ndarray]) -> list[np.ndarray]:
    seeds = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
    sums = [np.array([mix(s + m).sum(dtype=np.uint64) for s in sets], np.uint64) for m in seeds]
    return [d.view(np.int64) for d in sums]


def _whole_sets(texts: DataFrame, size: int) -> DataFrame:
    """``_set, _n, _tokens`` of rows ``_set, _n, _d1, _d2, _text``; rows of another set are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, part in chunks(batch.column(4), lower=True):
                sets = list(_sets(part, size))
                own = [batch.column(c).slice(i, j - i) for c in range(4)]
                same = [np.asarray(c) == d for c, d in zip(own[2:], _digests(sets), strict=True)]
                columns = [*own[:2], _lists(sets)]
                out = pa.RecordBatch.from_arrays(columns, names=["_set", "_n", "_tokens"])
                yield out.filter(pa.array(same[0] & same[1]))

    columns = texts.select("_set", "_n", "_d1", "_d2", "_text")
    return columns.mapInArrow(run, "_set bigint, _n bigint, _tokens array<bigint>")


def link_block(tokens: list[np.ndarray], num: int, den: int, read: list[int] | None = None) -> np.ndarray:
    """Component of each of some sets of sorted members under their links, compared exactly.

    Sets are placed by size, so index lists are in order of size too, and a set's possible partners after
    it are a run of places that ends where sizes no longer fit. Lists are entered at the first such place
    and left at the last; what lies outside is skipped. A set that is very like one already done starts
    from that one's overlaps, as far as its run goes, and there only visits the lists of the members in
    which the two differ. ``read`` gets the number of list entries read.
    """
    sizes = np.array([len(t) for t in tokens])
    order = np.argsort(sizes, kind="stable")
    sizes = sizes[order]
    flat, ids = np.unique(np.concatenate([tokens[i] for i in order]), return_inverse=True)
    m = len(order)
    # an entry is its list and then its place, so one search finds a place in any list
    entries = np.sort(ids * m + np.repeat(np.arange(m), sizes))
    places = entries % m
    ends = np.cumsum(sizes)
    members = [ids[e - n : e] for e, n in zip(ends, sizes, strict=True)]
    until = np.searchsorted(sizes, sizes * den // num, "right")
    overlap = np.zeros((m, m), np.int32)
    root = np.arange(m)

    def visit(some: np.ndarray, first: int, last: int) -> np.ndarray:
        """How many of some members the sets of places ``first`` to ``last`` hold."""
        if not len(some) or first >= last:
            return np.zeros(max(last - first, 0), np.int64)
        begin, end = np.searchsorted(entries, some * m + first), np.searchsorted(entries, some * m + last)
        counts = end - begin
        at = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts - begin, counts)
        if read is not None:
            read.append(len(at))
        return np.bincount(places[at] - first, minlength=last - first)

    for i in range(m):
        first, last = i + 1, int(until[i])
        like = int(np.argmax(overlap[:i, i])) if i else 0
        known = min(int(until[like]), last) if i else first
        if i and first < known and sizes[like] + sizes[i] - 2 * overlap[like, i] < sizes[i]:
            gone = np.setdiff1d(members[like], members[i], assume_unique=True)
            new = np.setdiff1d(members[i], members[like], assume_unique=True)
            overlap[i, first:known] = overlap[like, first:known] - visit(gone, first, known) + visit(new, first, known)
        else:
            known = first
        overlap[i, known:last] = visit(members[i], known, last)
        o = overlap[i, first:last].astype(np.int64)
        linked = np.flatnonzero(den * o >= num * (sizes[i] + sizes[first:last] - o)) + first
        if len(linked):
            roots = np.unique(root[np.append(linked, i)])
            root[np.isin(root, roots)] = roots[0]
    out = np.empty(m, np.int64)
    out[order] = order[root]
    return out


def _links(rows: DataFrame, task: list[str], bucket: Column, num: int, den: int) -> DataFrame:
    """Links ``a, b`` that span the components inside each ``task`` of rows ``_set, _tokens``."""

    def run(table: pa.Table) -> pa.Table:
        frame = table.select(["_set", *task]).to_pandas()
        lists = table.column("_tokens").combine_chunks()
        ends, flat = np.asarray(lists.offsets), np.asarray(lists.values)
        a, b = [], []
        for _, at in frame.groupby(task).indices.items():
            if len(at) > 1:
                sets = frame["_set"].to_numpy()[at]
                root = link_block([flat[ends[i] : ends[i + 1]] for i in at], num, den)
                other = np.flatnonzero(root != np.arange(len(at)))
                a.append(sets[root[other]])
                b.append(sets[other])
        empty = np.zeros(0, np.int64)
        return pa.table({"a": np.concatenate([empty, *a]), "b": np.concatenate([empty, *b])})

    return rows.withColumn("_bucket", bucket).groupBy("_bucket").applyInArrow(run, "a bigint, b bigint")


def _blocks(rows: DataFrame, by: str, order: list[str]) -> DataFrame:
    """Add ``_block``: consecutive runs of ``BLOCK`` rows of each ``by`` group in the given order."""
    ranked = running_totals(rows.withColumn("_one", F.lit(1)), [by], order, "_one", "_rank")
    return ranked.withColumn("_block", F.floor(F.col("_rank") / BLOCK)).drop("_one", "_rank")


def _whole_blocks(whole: DataFrame) -> DataFrame:
    """Blocks of whole sets: ``_block, _hashes, _owner`` and lists of their ``_set, _n``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, rows, sets, held = TaskContext.get().partitionId() << 33, [], [], 0
        for batch in batches:
            for r in range(batch.num_rows):
                rows.append([c.slice(r, 1) for c in batch.columns[:2]])
                sets.append(np.asarray(batch.column(2)[r].values).view(np.uint64) ^ _SIGN)
                held += len(sets[-1])
                if held >= BLOCK_BYTES // 8:
                    yield _sorted_blocks([pa.concat_arrays(c) for c in zip(*rows, strict=True)], ["_set", "_n"], number, sets)
                    number, rows, sets, held = number + 1, [], [], 0
        if rows:
            yield _sorted_blocks([pa.concat_arrays(c) for c in zip(*rows, strict=True)], ["_set", "_n"], number, sets)

    schema = "_block bigint, _hashes binary, _owner binary, _set array<bigint>, _n array<bigint>"
    return whole.select("_set", "_n", "_tokens").mapInArrow(run, schema)


def _rarest(blocks: DataFrame, num: int, den: int) -> DataFrame:
    """``_set, _h``: the rarest members of each set, as many as must hold one of any partner's."""
    n_blocks = blocks.count()

    def run(block: pa.Table, answers: pa.Table) -> pa.Table:
        owner, hashes = unpack(block.column("_owner")[0].as_py(), "<u4"), unpack(block.column("_hashes")[0].as_py(), "<u8")
        held = in_order(answers)
        sets, n = (np.asarray(block.column(c).combine_chunks().values) for c in ("_set", "_n"))
        # the hashes are sorted, so equal counts stay in their order
        some = np.flatnonzero(held > 1)
        some = some[np.lexsort((held[some], owner[some]))]
        own = owner[some]
        known = np.bincount(own, minlength=len(sets))
        room = known - _least_partner(n, num, den) + 1
        rank = np.arange(len(own)) - np.repeat(np.cumsum(known) - known, known)
        some = some[rank < room[own]]
        return pa.table([pa.array(sets[owner[some]]), pa.array(_signed(hashes[some]))], names=["_set", "_h"])

    own = blocks.repartition(max(n_blocks // 2, 1), "_block")
    answers = occurrences(blocks, n_blocks).repartition(max(n_blocks // 2, 1), "_block")
    return own.groupBy("_block").cogroup(answers.groupBy("_block")).applyInArrow(run, "_set bigint, _h bigint")


def _candidates(whole: DataFrame, num: int, den: int) -> DataFrame:
    """Clusters ``_set, _cluster``: linked sets are always in the same one.

    Members are ordered by how many sets hold them, rarest first. A linked set has at least
    ``_least_partner`` of a set's members, so leaving out one less than that of its last members keeps
    one in common. Members that only one set holds are nobody's partner and no index entries, and a set
    with too few others has no partner at all. Each list joins its sets to its smallest one.
    """
    blocks = keep(_whole_blocks(whole))
    keys = keep(_rarest(blocks, num, den))
    discard(blocks)
    least = keys.groupBy("_h").agg(F.min("_set").alias("_least"), F.max("_set").alias("_most")).where("_least < _most")
    edges = keys.join(least, "_h").where("_set <> _least").select(F.col("_set").alias("a"), F.col("_least").alias("b"))
    return connected_components(edges.distinct()).toDF("_set", "_cluster")


def _components(whole: DataFrame, num: int, den: int) -> DataFrame:
    """Components ``node, comp`` of the links among the sets; sets without links are left out."""
    clusters = _candidates(whole, num, den)
    sized = clusters.join(whole.select("_set", "_n"), "_set")
    placed = keep(_blocks(sized, "_cluster", ["_n", "_set"]))
    buckets = F.lit(max(1, placed.count() // GROUP))
    near = F.pmod(F.hash("_cluster", "_block"), buckets)
    tokens = whole.select("_set", "_tokens")
    links = keep(_links(placed.join(tokens, "_set"), ["_cluster", "_block"], near, num, den))
    large = placed.where("_block > 0").select("_cluster").distinct()
    if large.isEmpty():
        return connected_components(links)

    # components of a large cluster meet through their smallest sets first, which leaves little to do
    members = placed.join(large, "_cluster", "left_semi").select("_set", "_n", "_cluster")

    def labelled(links: DataFrame) -> DataFrame:
        comps = connected_components(links)
        named = members.join(comps, members["_set"] == comps["node"], "left")
        return named.select("_set", "_n", "_cluster", F.coalesce("comp", "_set").alias("_comp"))

    leaders = labelled(links).where("_set = _comp").drop("_comp")
    leaders = _blocks(leaders, "_cluster", ["_n", "_set"])
    # few narrow rows beside all members of all sets: what is small must not have those shuffled
    leaders, _ = settle(leaders)
    more = _links(leaders.join(tokens, "_set"), ["_cluster", "_block"], near, num, den)
    links = keep(links.unionByName(more))

    # then blocks that are not of one component are compared pair by pair
    blocks = keep(_blocks(labelled(links), "_cluster", ["_comp", "_n", "_set"]))
    stats = blocks.groupBy("_cluster", "_block").agg(
        F.min("_comp").alias("_c0"), F.max("_comp").alias("_c1"), F.min("_n").alias("_n0"), F.max("_n").alias("_n1")
    )
    left = stats.select("_cluster", *[F.col(c).alias(f"_l{c}") for c in ("_block", "_c0", "_c1", "_n0", "_n1")])
    pairs = left.join(stats, "_cluster").where(
        (F.col("_l_block") <= F.col("_block"))
        & ((F.col("_l_c0") != F.col("_c1")) | (F.col("_l_c1") != F.col("_c0")))
        & (F.col("_l_n1") * den >= F.col("_n0") * num)
        & (F.col("_n1") * den >= F.col("_l_n0") * num)
    )
    pairs = pairs.select("_cluster", F.col("_l_block").alias("_a"), F.col("_block").alias("_b"))
    sides = pairs.select("*", F.explode(F.array_distinct(F.array("_a", "_b"))).alias("_block"))
    work, _ = settle(blocks.join(sides, ["_cluster", "_block"]))
    more = _links(work.join(tokens, "_set"), ["_cluster", "_a", "_b"], F.hash("_cluster", "_a", "_b"), num, den)
    return connected_components(links.unionByName(more))


def _classes(docs: DataFrame, key: str, text: str, size: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """Rows ``_id, _x, _d1, _d2, _n``, and of each set ``_d1, _d2, _n, _least``, its component's first row."""
    heads = keep(_heads(docs, key, text, size, num, den))
    same = ["_d1", "_d2", "_n"]
    rows = keep(_first_look(heads))
    discard(heads)
    sets = rows.where("_n > 0").groupBy(*same).agg(
        F.min(F.struct(F.col("_id").isNull().alias("none"), "_id", "_x")).alias("_least"), F.max("_known").alias("_known")
    )
    sets = keep(sets.withColumn("_set", F.monotonically_increasing_id()))
    whole = _alive(docs, sets, key, text, size, num, den)
    rows = rows.drop("_known")
    comps = _components(whole, num, den)

    named = sets.join(comps, sets["_set"] == comps["node"], "left")
    named = keep(named.select(*same, "_least", F.coalesce("comp", "_set").alias("_comp")))
    least = named.groupBy("_comp").agg(F.min("_least").alias("_least"))
    return rows, named.drop("_least").join(least, "_comp").select(*same, "_least")


def _alive(docs: DataFrame, sets: DataFrame, key: str, text: str, size: int, num: int, den: int) -> DataFrame:
    """The whole sets of which enough of the first members occur elsewhere; the others have no links.

    Copies of a set count as occurrences elsewhere, which lets their set through and harms nothing.
    """
    first = sets.select("_set", *[F.col(c).alias(f"_f{c}") for c in ("_d1", "_d2", "_n")], "_known", "_least._id", "_least._x")
    first = first.withColumnsRenamed({"_id": "_f_id", "_x": "_f_x"})
    alive = first.where(F.col("_known") >= _extra(_least_partner(F.col("_f_n"), num, den), FIRST)).drop("_known")
    # the sets left grow with the input, so they are never broadcast
    one = (F.col("_x") == F.col("_f_x")) & F.col("_id").eqNullSafe(F.col("_f_id"))
    texts = _texts(docs, key, text).hint("merge").join(alive, one)
    return keep(_whole_sets(texts.withColumnsRenamed({f"_f{c}": c for c in ("_d1", "_d2", "_n")}), size))


def jaccard_components(
    docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 4, num: int = 85, den: int = 100
) -> DataFrame:
    """One row per input row: ``key, n_shingles, component_id``.

    Words are runs of other than ASCII white space, with A-Z in lower case. A document's set is that of
    its distinct ``size``-word n-grams; with fewer words, the whole sequence is its one member. Two
    documents are linked when ``den * intersection >= num * union``, and ``component_id`` is the
    smallest key that links reach. Documents without words, NULL or empty texts, have an empty set and
    are linked with nothing. NULL keys are ignored for the smallest key unless a component has no other;
    rows that repeat a key are documents of their own. An empty table gives an empty result; other
    columns are ignored.

    Members are 64-bit hashes of the n-grams and identical sets are told by a 128-bit digest; everything
    else is exact: no set of candidates is capped, and no pairs are listed within a group of copies.
    """
    rows, classes = _classes(docs, key, text, size, num, den)
    joined = rows.join(classes, ["_d1", "_d2", "_n"], "left")
    component = F.when(F.col("_n") > 0, F.col("_least._id")).otherwise(F.col("_id"))
    return joined.select(F.col("_id").alias(key), F.col("_n").alias("n_shingles"), component.alias("component_id"))


def drop_near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 4, num: int = 85, den: int = 100
) -> DataFrame:
    """The rows of ``docs``, all columns, without all but one of each component: that of the smallest key.

    Documents without words all stay. Of rows that repeat key and text, one stays.
    """
    rows, classes = _classes(docs, key, text, size, num, den)
    joined = rows.join(classes, ["_d1", "_d2", "_n"], "left")
    first = F.col("_id").eqNullSafe(F.col("_least._id")) & (F.col("_x") == F.col("_least._x"))
    chosen = joined.where((F.col("_n") == 0) | first).groupBy(F.col("_id").alias("_k"), F.col("_x").alias("_kx"))
    chosen = keep(chosen.agg(F.count(F.lit(1)).alias("_times")))
    own = {c: f"_c{i}" for i, c in enumerate(docs.columns)}
    named = docs.select(*[F.col(f"`{c}`").alias(v) for c, v in own.items()])
    hashed = named.withColumn("_kx2", F.xxhash64(F.coalesce(F.col(own[text]), F.lit(""))))
    match = F.col(own[key]).eqNullSafe(F.col("_k")) & (F.col("_kx2") == F.col("_kx"))
    stay = hashed.join(chosen.select("_k", "_kx"), match, "left_semi")
    if not chosen.where("_times > 1").isEmpty():
        stay = stay.dropDuplicates([own[key], "_kx2"])
    return stay.select(*[F.col(v).alias(c) for c, v in own.items()])
