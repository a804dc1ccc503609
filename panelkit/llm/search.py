"""Ranked lexical search of many items over all documents, by pipelined term partitioning.

The documents are cut into shards of bounded size, and the terms of the items into owners that hold
about equally many postings, rarest terms first. The items travel in bundles: for every shard, a bundle
carries a sparse accumulator of integer scores for each of its items from one owner to the next, where a
cogroup brings it together with the owner's postings of that shard. Before it goes on, documents that
cannot be among the shard's best any more leave it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelkit.llm.terms import Vocabulary, term_chunks
from panelkit.session import discard, keep, new_path, remove_at_end

# Pairs of item and term that are searched together; more items are searched in several turns.
PAIRS = 1 << 17
# Documents and bytes of text of a shard; a longer document is a shard of its own.
SHARD_DOCS, SHARD_BYTES = 8192, 16 << 20
# Stages that a bundle passes.
OWNERS = 4
# Items that travel together.
BUNDLE = 64


@dataclass(frozen=True)
class Items:
    """Some items with their terms: item ``i`` has the numbers ``terms[first[i]:first[i + 1]]``."""

    names: pa.Array
    first: np.ndarray
    terms: np.ndarray
    vocabulary: np.ndarray


def _item_terms(items: DataFrame, item: str, text: str) -> DataFrame:
    """``_item, _name, _term``: the distinct terms of each row; a row is an item of its own."""
    kind = items.select(item).schema[0].dataType.simpleString()
    rows = keep(items.select(F.col(item).alias("_name"), F.col(text).alias("_text")).withColumn("_item", F.monotonically_increasing_id()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, _, texts in term_chunks(batch.column(2)):
                pairs = np.unique(np.stack([texts.doc.astype(np.uint64), texts.hashes()]), axis=1)
                at = pa.array(pairs[0].astype(np.int64) + i)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(at), batch.column(1).take(at), pa.array(pairs[1].view(np.int64))], names=["_item", "_name", "_term"]
                )

    return keep(rows.select("_item", "_name", "_text").mapInArrow(run, f"_item bigint, _name {kind}, _term bigint"))


def _turn(pairs: DataFrame) -> Items:
    """The items of one turn, at most about ``PAIRS`` pairs of them, as arrays."""
    table = pairs.toArrow().sort_by([("_item", "ascending"), ("_term", "ascending")])
    item = table.column("_item").to_numpy()
    start = np.flatnonzero(np.diff(item, prepend=-1)) if len(item) else np.zeros(0, np.int64)
    vocabulary, terms = np.unique(table.column("_term").to_numpy().view(np.uint64), return_inverse=True)
    names = table.column("_name").combine_chunks().take(pa.array(start))
    return Items(names, np.append(start, len(item)), terms, vocabulary)


def _postings(keys: np.ndarray) -> list[np.ndarray]:
    """Terms, ends, documents and frequencies of hits ``term << 32 | document``."""
    found, tf = np.unique(keys, return_counts=True)
    terms = (found >> np.uint64(32)).astype("<i4")
    start = np.flatnonzero(np.diff(terms, prepend=-1))
    docs = found & np.uint64(0xFFFFFFFF)
    docs = docs.astype("<u2" if not len(docs) or docs.max() < 1 << 16 else "<u4")
    return [terms[start], np.append(start, len(found))[1:].astype("<i4"), docs, tf.astype("<u4")]


def _index(docs: DataFrame, key: str, text: str, vocabulary: np.ndarray) -> DataFrame:
    """One row for each shard: keys and lengths of its documents, and the postings of known terms.

    ``_terms`` are the numbers of the shard's terms; the postings of the term at place ``i`` end at
    ``_ends[i]`` in ``_docs``, which are places in ``_ids``, and ``_tf``.
    """
    kind = docs.select(key).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, number = Vocabulary(vocabulary), TaskContext.get().partitionId() << 33
        for batch in batches:
            ids, begun, sizes, hits, size = batch.column(0), 0, [], [], 0

            def shard(end: int, ids=ids) -> pa.RecordBatch:
                lists = pa.ListArray.from_arrays(pa.array([0, end - begun], pa.int32()), ids.slice(begun, end - begun))
                packed = [np.concatenate(sizes).astype("<i8"), *_postings(np.concatenate(hits))]
                columns = [pa.array([number]), lists, *[pa.array([p.tobytes()], pa.binary()) for p in packed]]
                return pa.RecordBatch.from_arrays(columns, names=["_shard", "_ids", "_sizes", "_terms", "_ends", "_docs", "_tf"])

            for i, j, texts in term_chunks(batch.column(1)):
                if sizes and (j - begun > SHARD_DOCS or size + len(texts.buf) > SHARD_BYTES):
                    yield shard(i)
                    number, begun, sizes, hits, size = number + 1, i, [], [], 0
                at, terms = known.find(texts.hashes())
                place = (texts.doc[at] + (i - begun)).astype(np.uint64)
                hits.append(terms.astype(np.uint64) << np.uint64(32) | place)
                sizes.append(texts.counts)
                size += len(texts.buf)
            if sizes:
                yield shard(batch.num_rows)
                number += 1

    schema = f"_shard bigint, _ids array<{kind}>, _sizes binary, _terms binary, _ends binary, _docs binary, _tf binary"
    return docs.select(F.col(key).alias("_id"), F.col(text).alias("_text")).mapInArrow(run, schema)


def _statistics(index: DataFrame, n_terms: int) -> tuple[int, int, np.ndarray]:
    """Documents with terms, all their terms, and how many documents hold each term of the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, some, total = np.zeros(n_terms, np.int64), 0, 0
        for batch in batches:
            for sizes, terms, ends in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                sizes, terms, ends = np.frombuffer(sizes, "<i8"), np.frombuffer(terms, "<i4"), np.frombuffer(ends, "<i4")
                held[terms] += np.diff(ends, prepend=0)
                some, total = some + int((sizes > 0).sum()), total + int(sizes.sum())
        seen = np.flatnonzero(held)
        term, n = np.append(seen, [-1, -2]), np.append(held[seen], [some, total])
        yield pa.RecordBatch.from_arrays([pa.array(term), pa.array(n)], names=["term", "n"])

    rows = index.select("_sizes", "_terms", "_ends").mapInArrow(run, "term bigint, n bigint")
    counts = rows.groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    n = np.zeros(n_terms + 2, np.int64)
    n[counts.column("term").to_numpy()] = counts.column("n").to_numpy()
    return int(n[-1]), int(n[-2]), n[:n_terms]


def _owners(held: np.ndarray) -> np.ndarray:
    """The owner of each term: equal shares of all postings, in order of how many a term has."""
    order = np.argsort(held, kind="stable")
    upto = np.cumsum(held[order])
    owner = np.empty(len(held), np.int64)
    owner[order] = np.minimum((upto - 1) * OWNERS // max(int(upto[-1]) if len(upto) else 0, 1), OWNERS - 1)
    return np.maximum(owner, 0)


def _owned(index: DataFrame, owner: np.ndarray, n_docs: int, n_terms: int) -> list[DataFrame]:
    """A table for each owner: per shard, its postings with what a unit of weight earns in each document.

    ``_later`` and ``_most`` are the shard's terms that later owners have, and the most that each earns.
    """
    spark = index.sparkSession
    names = ["_owner", "_shard", "_ids", "_n", "_terms", "_ends", "_docs", "_earned", "_later", "_most"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                number, ids, *packed = (c.slice(r, 1) for c in batch.columns)
                sizes, terms, ends, docs, tf = (p[0].as_buffer() for p in packed)
                sizes, terms, ends, tf = np.frombuffer(sizes, "<i8"), np.frombuffer(terms, "<i4"), np.frombuffer(ends, "<i4"), np.frombuffer(tf, "<u4")
                docs = np.frombuffer(docs, "<u2" if 2 * len(tf) == len(docs) else "<u4")
                length = 50 + 50 * sizes * n_docs // max(n_terms, 1)
                often = tf.astype(np.int64)
                earned = (1_000_000_000 * often // (1000 * often + 20 * length[docs])).astype("<u4")
                begin = np.append(0, ends[:-1])
                most = np.maximum.reduceat(earned, begin) if len(terms) else earned
                own = owner[terms]
                of_posting = np.repeat(own, ends - begin)
                for o in range(OWNERS):
                    mine, later = own == o, own > o
                    # the last owner's rows name the documents that are left
                    keys = ids if o == OWNERS - 1 else pa.ListArray.from_arrays(pa.array([0, 0], pa.int32()), ids.values.slice(0, 0))
                    arrays = [
                        terms[mine], np.cumsum((ends - begin)[mine]).astype("<i4"), docs[of_posting == o], earned[of_posting == o],
                        terms[later], most[later],
                    ]
                    columns = [pa.array([o], pa.int32()), number, keys, pa.array([len(sizes)])]
                    columns += [pa.array([a.tobytes()], pa.binary()) for a in arrays]
                    yield pa.RecordBatch.from_arrays(columns, names=names)

    kind = index.schema["_ids"].dataType.simpleString()
    schema = f"_owner int, _shard bigint, _ids {kind}, _n bigint, " + ", ".join(f"{c} binary" for c in names[4:])
    path = new_path(spark)
    index.mapInArrow(run, schema).write.partitionBy("_owner").parquet(path)
    remove_at_end(spark, path)
    owned = spark.read.schema(schema).parquet(path)
    return [owned.where(F.col("_owner") == o).drop("_owner") for o in range(OWNERS)]


class _Postings:
    """An owner's postings of one shard, for items whose terms have the given weights."""

    def __init__(self, row: pa.Table):
        part = {c: row.column(c)[0].as_py() for c in ("_terms", "_ends", "_docs", "_earned", "_later", "_most")}
        self.n = row.column("_n")[0].as_py()
        self.terms, self.ends = np.frombuffer(part["_terms"], "<i4"), np.frombuffer(part["_ends"], "<i4")
        self.earned = np.frombuffer(part["_earned"], "<u4")
        self.docs = np.frombuffer(part["_docs"], "<u2" if 2 * len(self.earned) == len(part["_docs"]) else "<u4")
        self.later, self.most = np.frombuffer(part["_later"], "<i4"), np.frombuffer(part["_most"], "<u4")

    def add(self, scores: np.ndarray, terms: np.ndarray, weights: np.ndarray) -> None:
        """Add what the owned ones of some terms earn to the scores of the shard's documents."""
        for i, w in _matches(self.terms, terms, weights):
            part = slice(self.ends[i - 1] if i else 0, self.ends[i])
            scores[self.docs[part]] += w * self.earned[part].astype(np.int64)

    def rest(self, terms: np.ndarray, weights: np.ndarray) -> int:
        """The most that the later owners can still add to a document."""
        return sum(w * int(self.most[i]) for i, w in _matches(self.later, terms, weights))


def _matches(known: np.ndarray, terms: np.ndarray, weights: np.ndarray) -> Iterator[tuple[int, int]]:
    if len(known):
        at = np.minimum(np.searchsorted(known, terms), len(known) - 1)
        same = np.flatnonzero(known[at] == terms)
        yield from zip(at[same].tolist(), weights[same].tolist(), strict=True)


def _within_reach(scores: np.ndarray, rest: int, top: int) -> np.ndarray:
    """Documents that may be among the best ``top`` yet, if each gains between 0 and ``rest``."""
    held = np.flatnonzero(scores)
    if len(held) > top:
        least = np.partition(scores[held], len(held) - top)[len(held) - top]
        held = held[scores[held] + rest >= least]
    return held


def _stage(bundles: DataFrame, owned: DataFrame, items: Items, weights: np.ndarray, top: int) -> DataFrame:
    """The bundles after an owner has added its part: ``_shard, _bundle, _ends, _docs, _scores``."""

    def run(state: pa.Table, row: pa.Table) -> pa.Table:
        postings, out = _Postings(row), []
        for number, ends, docs, sums in zip(*(state.column(c).to_pylist() for c in ("_bundle", "_ends", "_docs", "_scores")), strict=True):
            ends, docs, sums = np.frombuffer(ends, "<i4"), np.frombuffer(docs, "<u4"), np.frombuffer(sums, "<i8")
            first, new_docs, new_sums = number * BUNDLE, [np.zeros(0, "<u4")], [np.zeros(0, "<i8")]
            last = min(first + BUNDLE, len(items.names))
            for k, i in enumerate(range(first, last)):
                scores = np.zeros(postings.n, np.int64)
                if len(ends):
                    part = slice(ends[k - 1] if k else 0, ends[k])
                    scores[docs[part]] = sums[part]
                terms = items.terms[items.first[i] : items.first[i + 1]]
                postings.add(scores, terms, weights[terms])
                left = _within_reach(scores, postings.rest(terms, weights[terms]), top)
                new_docs.append(left.astype("<u4"))
                new_sums.append(scores[left])
            upto = np.cumsum([len(d) for d in new_docs[1:]]).astype("<i4")
            out.append((number, upto.tobytes(), np.concatenate(new_docs).tobytes(), np.concatenate(new_sums).tobytes()))
        columns = [pa.array([o[c] for o in out], t) for c, t in enumerate((pa.int64(), *[pa.binary()] * 3))]
        return pa.table([state.column("_shard"), *columns], names=["_shard", "_bundle", "_ends", "_docs", "_scores"])

    schema = "_shard bigint, _bundle bigint, _ends binary, _docs binary, _scores binary"
    return bundles.groupBy("_shard").cogroup(owned.groupBy("_shard")).applyInArrow(run, schema)


def _selected(bundles: DataFrame, last: DataFrame, items: Items, names: str, top: int) -> DataFrame:
    """``_item, _shard, _id, _score``: each item's best documents of every shard."""
    kind = last.schema["_ids"].dataType.elementType.simpleString()

    def run(state: pa.Table, row: pa.Table) -> pa.Table:
        ids = row.column("_ids").combine_chunks().values
        place = np.empty(len(ids), np.int64)
        place[pc.sort_indices(ids).to_numpy()] = np.arange(len(ids))
        item, doc, score = [], [], []
        for number, ends, docs, sums in zip(*(state.column(c).to_pylist() for c in ("_bundle", "_ends", "_docs", "_scores")), strict=True):
            docs, sums, start = np.frombuffer(docs, "<u4"), np.frombuffer(sums, "<i8"), 0
            for k, end in enumerate(np.frombuffer(ends, "<i4").tolist()):
                best = start + np.lexsort((place[docs[start:end]], -sums[start:end]))[:top]
                item.append(np.full(len(best), number * BUNDLE + k))
                doc.append(docs[best])
                score.append(sums[best])
                start = end
        item, doc, score = (np.concatenate([np.zeros(0, np.int64), *a]).astype(np.int64) for a in (item, doc, score))
        shard = pa.array(np.full(len(item), row.column("_shard")[0].as_py()))
        columns = [pa.array(item), items.names.take(pa.array(item)), shard, ids.take(pa.array(doc)), pa.array(score)]
        return pa.table(columns, names=["_item", "_name", "_shard", "_id", "_score"])

    schema = f"_item bigint, _name {names}, _shard bigint, _id {kind}, _score bigint"
    last = last.select("_shard", "_ids")
    return bundles.groupBy("_shard").cogroup(last.groupBy("_shard")).applyInArrow(run, schema)


def ranked_search(
    docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", query: str = "text",
    top: int = 50, pairs: int = PAIRS,
) -> DataFrame:
    """The ``top`` best documents of each item: ``item, rank, key, score``, best first.

    With N documents that have terms, L terms in them, n in one document, df documents that hold a term
    and tf of it in the document, a term's weight is ``floor(1000 * ln((2N + 2) / (2df + 1)))``, a
    document's m is ``50 + 50nN div L``, and its score is the sum over the item's distinct terms of
    ``weight * (10**9 * tf div (1000 * tf + 20m))``, in whole numbers. Equal scores are ordered by key.

    All statistics come from whole texts of all documents. A document leaves an accumulator only when as
    many documents of its shard as are asked for stay ahead of it whatever later owners add, so results
    are exact. Postings move once, to the stage of their owner; the accumulators that move hold about
    ``top`` documents per item and shard. Items are searched in turns of at most about ``pairs`` pairs of
    item and term, which bounds what tasks hold of them; a single item is never divided.

    NULL and empty texts hold no terms; an item without terms, or without documents that hold one, has no
    rows. Every row of ``docs`` is a document and every row of ``items`` an item of its own, also if it
    repeats another; NULL keys come last among equal scores. Empty tables give an empty result; other
    columns are ignored.
    """
    names = items.select(item).schema[0].dataType.simpleString()
    found = _item_terms(items, item, query)
    turns = max(1, -(-found.count() // pairs))
    results = None
    for turn in range(turns):
        mine = _turn(found.where(F.pmod(F.xxhash64("_item"), F.lit(turns)) == turn))
        if not len(mine.names):
            continue
        part = _search(docs, key, text, mine, names, top)
        results = part if results is None else results.unionByName(part)
    if results is None:
        kind = docs.select(key).schema[0].dataType.simpleString()
        results = docs.sparkSession.createDataFrame([], f"_name {names}, rank int, _id {kind}, _score bigint")
    return results.select(F.col("_name").alias(item), "rank", F.col("_id").alias(key), F.col("_score").alias("score"))


def _search(docs: DataFrame, key: str, text: str, items: Items, names: str, top: int) -> DataFrame:
    index = keep(_index(docs, key, text, items.vocabulary))
    n_docs, n_terms, held = _statistics(index, len(items.vocabulary))
    weights = np.floor(1000 * np.log((2 * n_docs + 2) / (2 * held + 1))).astype(np.int64)
    owned = _owned(index, _owners(held), n_docs, n_terms)
    numbers = F.sequence(F.lit(0), F.lit(-(-len(items.names) // BUNDLE) - 1))
    empty = [F.lit(b"").alias(c) for c in ("_ends", "_docs", "_scores")]
    bundles = owned[0].select("_shard", F.explode(numbers.cast("array<bigint>")).alias("_bundle"), *empty)
    for part in owned:
        before, bundles = bundles, keep(_stage(bundles, part.drop("_ids"), items, weights, top))
        if part is not owned[0]:
            discard(before)
    chosen = _selected(bundles, owned[-1], items, names, top)

    # the best of some shards first, so that no task gets all of an item's
    best = [F.col("_score").desc(), F.col("_id").asc_nulls_last()]
    some = Window.partitionBy("_item", F.pmod("_shard", F.lit(61))).orderBy(*best)
    every = Window.partitionBy("_item").orderBy(*best)
    chosen = chosen.withColumn("rank", F.row_number().over(some)).where(F.col("rank") <= top)
    return chosen.withColumn("rank", F.row_number().over(every)).where(F.col("rank") <= top)
