"""Stupid-backoff language-model scores from relational n-gram counts."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelkit.llm.packed import pack, unpack
from panelkit.llm.tokens import forget, word_tokenizer
from panelkit.session import keep

# Text whose n-grams are combined before they move; a longer document is a block of its own.
BLOCK_BYTES = 8 << 20
# Texts given to the tokenizer at a time.
STEP = 256
# Parts that n-grams are dealt to by a hash, at least; with more blocks there are more.
PARTS = 256
# Largest id of a tokenizer, as tokens are kept in 16 bits and 0 marks the end of a text.
MAX_ID = (1 << 16) - 2


def _blocks(docs: DataFrame, tokenizer: str, key: str, text: str, block_bytes: int) -> DataFrame:
    """``_block, _ids, _sizes, _tokens``: runs of documents with their tokens, each one more than its id."""
    kind = docs.select(key).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, number = word_tokenizer(tokenizer), TaskContext.get().partitionId() << 33
        ids, arrays, held = [], [], 0

        def block() -> pa.RecordBatch:
            keys = pa.concat_arrays(ids)
            lists = pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys)
            sizes = np.array([len(t) for t in arrays], "<i8").tobytes()
            columns = [pa.array([number]), lists, pa.array([sizes], pa.binary()), pa.array([pack(np.concatenate(arrays).astype("<u2"))], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names=["_block", "_ids", "_sizes", "_tokens"])

        for batch in batches:
            for i in range(0, batch.num_rows, STEP):
                values = [(v or "").encode() for v in batch.column(1).slice(i, STEP).to_pylist()]
                size = sum(map(len, values))
                if arrays and held + size > block_bytes:
                    yield block()
                    number, ids, arrays, held = number + 1, [], [], 0
                ids.append(batch.column(0).slice(i, STEP))
                arrays += [(np.frombuffer(t, "<u4") + np.uint32(1)).astype(np.uint16) for t in words.encode(values)]
                held += size
        if arrays:
            yield block()

    rows = docs.select(F.col(key).alias("_id"), F.col(text).alias("_text"))
    return rows.mapInArrow(run, f"_block bigint, _ids array<{kind}>, _sizes binary, _tokens binary")


class _Grams:
    """The n-grams of a block, each length numbered in order, and which stands at each token.

    ``pairs`` are the distinct pairs of neighbours, ``fan`` how many different tokens follow each, ``thirds``
    these tokens, with 0 for the end of a text, and ``own`` how often each of these triples stands there.
    ``pair_at`` and ``triple_at`` give the numbers of those that start at the tokens ``starts``.
    """

    def __init__(self, sizes: np.ndarray, tokens: np.ndarray, order: int):
        ends = np.cumsum(sizes)
        near = np.zeros((3, len(tokens)), np.uint16)
        near[0] = tokens
        last = ends[sizes > 0] - 1
        for k in (1, 2)[: order - 1]:
            near[k, :-1] = near[k - 1, 1:]
            near[k, last] = 0
        # a block is worked on in one piece, so what is as long as its tokens is narrow and changed in place
        self.starts = np.flatnonzero(near[1]).astype(np.int32)
        known = np.zeros(1 << 16, np.uint64)
        present = np.flatnonzero(np.bincount(tokens, minlength=1))
        known[present] = np.arange(1, len(present) + 1, dtype=np.uint64)
        bits, room = np.uint64(len(present).bit_length()), np.uint64(len(self.starts).bit_length())
        key = np.zeros(len(self.starts), np.uint64)
        for row in near:
            key <<= bits
            key |= known[row[self.starts]]
        # numbers of distinct tokens are small, so a triple and its place mostly fit into one sortable word
        if 3 * int(bits) + int(room) <= 64:
            key <<= room
            key |= np.arange(len(key), dtype=np.uint64)
            key.sort()
            place = (key & np.uint64((1 << int(room)) - 1)).astype(np.int32)
            key >>= room
        else:
            place = np.argsort(key, kind="stable")
            key = key[place]
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        key >>= bits
        other = np.ones(len(key), bool)
        other[1:] = key[1:] != key[:-1]
        self.pair_at, self.triple_at = (np.empty(len(key), np.int32) for _ in range(2))
        self.pair_at[place] = np.cumsum(other, dtype=np.int32) - 1
        self.triple_at[place] = np.cumsum(new, dtype=np.int32) - 1
        at = self.starts[place[new]]
        self.thirds = near[2, at]
        self.own = np.diff(np.append(np.flatnonzero(new), len(key)))
        head = np.flatnonzero(other[new])
        self.fan = np.diff(np.append(head, len(at)))
        self.pairs = near[0, at[head]].astype(np.uint32) << np.uint32(16) | near[1, at[head]]

    def dealt(self, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs in order of their part, the triples in the same order, and the part of each pair."""
        h = self.pairs.astype(np.uint64) * np.uint64(0x9E3779B1) & np.uint64(0xFFFFFFFF)
        h ^= h >> np.uint64(15)
        h = h * np.uint64(0x85EBCA77) & np.uint64(0xFFFFFFFF)
        part = (h * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        fan = self.fan[order]
        begin = (np.cumsum(self.fan) - self.fan)[order]
        triples = np.arange(fan.sum()) + np.repeat(begin - (np.cumsum(fan) - fan), fan)
        return order, triples, part[order]


def _block_grams(sizes: bytes, tokens: bytes, order: int) -> tuple[np.ndarray, np.ndarray, _Grams]:
    sizes, tokens = np.frombuffer(sizes, "<i8"), unpack(tokens, "<u2")
    return sizes, tokens, _Grams(sizes, tokens, order)


def _exploded(blocks: DataFrame, parts: int, order: int) -> DataFrame:
    """``_part, _block, _pairs, _fan, _thirds, _own``: the n-grams of each block, dealt by a hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # the worker may have tokenized before, and what it remembers of that is not needed any more
            forget()
            for number, sizes, tokens in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                _, _, grams = _block_grams(sizes, tokens, order)
                order_, triples, part = grams.dealt(parts)
                first = np.flatnonzero(np.diff(part, prepend=-1))
                fan, upto = grams.fan[order_].astype("<u2"), np.append(0, np.cumsum(grams.fan[order_]))
                pairs, thirds, own = grams.pairs[order_].astype("<u4"), grams.thirds[triples].astype("<u2"), grams.own[triples].astype("<u4")
                rows = []
                for i, j in zip(first.tolist(), [*first[1:].tolist(), len(part)], strict=True) if len(part) else []:
                    some = slice(upto[i], upto[j])
                    rows.append(tuple(map(pack, (pairs[i:j], fan[i:j], thirds[some], own[some]))))
                columns = [pa.array(part[first]), pa.array(np.full(len(first), number))]
                columns += [pa.array([r[c] for r in rows], pa.binary()) for c in range(4)]
                yield pa.RecordBatch.from_arrays(columns, names=["_part", "_block", "_pairs", "_fan", "_thirds", "_own"])

    schema = "_part bigint, _block bigint, _pairs binary, _fan binary, _thirds binary, _own binary"
    return blocks.select("_block", "_sizes", "_tokens").mapInArrow(run, schema)


def _entries(table: pa.Table, r: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs, triples and numbers of triples of a row of exploded n-grams."""
    pairs, fan, thirds, own = (unpack(table.column(c)[r].as_py(), k) for c, k in (("_pairs", "<u4"), ("_fan", "<u2"), ("_thirds", "<u2"), ("_own", "<u4")))
    pairs = pairs.astype(np.uint64)
    return pairs, np.repeat(pairs, fan) << np.uint64(16) | thirds, own


def _count_table(exploded: DataFrame, min_count: int) -> DataFrame:
    """``_part, _pairs, _pair_counts, _triples, _triple_counts``: sorted n-grams with their counts.

    A pair stands as often as the triples that begin with it, the end of a text being a third token.
    N-grams below ``min_count`` are left out.
    """

    def run(table: pa.Table) -> pa.Table:
        rows = [_entries(table, r)[1:] for r in range(table.num_rows)]
        triples, at = np.unique(np.concatenate([t for t, _ in rows]), return_inverse=True)
        # sums of whole numbers, exact up to 2 ** 53
        counts = np.bincount(at, np.concatenate([n for _, n in rows])).astype("<i8")
        pairs = triples >> np.uint64(16)
        first = np.flatnonzero(np.append(True, pairs[1:] != pairs[:-1]))
        pairs, of_pairs = pairs[first], np.add.reduceat(counts, first)
        often, frequent = (of_pairs >= min_count), (counts >= min_count) & (triples & np.uint64(0xFFFF) > 0)
        packed = [pairs[often], of_pairs[often], triples[frequent], counts[frequent]]
        columns = [table.column("_part").slice(0, 1), *[pa.array([pack(p)], pa.binary()) for p in packed]]
        return pa.table(columns, names=["_part", "_pairs", "_pair_counts", "_triples", "_triple_counts"])

    schema = "_part bigint, _pairs binary, _pair_counts binary, _triples binary, _triple_counts binary"
    return exploded.groupBy("_part").applyInArrow(run, schema)


def _found(known: np.ndarray, counts: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The counts of the wanted n-grams, 0 for others than the known ones."""
    if not len(known):
        return np.zeros(len(wanted), "<i8")
    at = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
    return np.where(known[at] == wanted, counts[at], 0).astype("<i8")


def _joined(exploded: DataFrame, counts: DataFrame) -> DataFrame:
    """``_block, _part, _pair_counts, _triple_counts``: the counts of each block's n-grams, in its order."""

    def run(table: pa.Table, known: pa.Table) -> pa.Table:
        pairs, of_pairs, triples, of_triples = (
            unpack(known.column(c)[0].as_py(), k)
            for c, k in (("_pairs", "<u8"), ("_pair_counts", "<i8"), ("_triples", "<u8"), ("_triple_counts", "<i8"))
        )
        out = [[], []]
        for r in range(table.num_rows):
            two, three, _ = _entries(table, r)
            out[0].append(pack(_found(pairs, of_pairs, two)))
            out[1].append(pack(_found(triples, of_triples, three)))
        columns = [table.column("_block"), table.column("_part"), *[pa.array(o, pa.binary()) for o in out]]
        return pa.table(columns, names=["_block", "_part", "_pair_counts", "_triple_counts"])

    schema = "_block bigint, _part bigint, _pair_counts binary, _triple_counts binary"
    return exploded.groupBy("_part").cogroup(counts.groupBy("_part")).applyInArrow(run, schema)


def _token_counts(blocks: DataFrame) -> np.ndarray:
    """How often each token stands in the corpus; one number for each that the tokenizer has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 16, np.int64)
        for batch in batches:
            for tokens in batch.column(0).to_pylist():
                total += np.bincount(unpack(tokens, "<u2"), minlength=1 << 16)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["token", "n"])

    counts = blocks.select("_tokens").mapInArrow(run, "token bigint, n bigint").groupBy("token").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(1 << 16, np.int64)
    out[counts.column("token").to_numpy()] = counts.column("n").to_numpy()
    return out


def backoff_scores(
    place: np.ndarray, counts: Iterable[np.ndarray], alpha: float, min_count: int, total: int
) -> tuple[np.ndarray, np.ndarray]:
    """Log score of each token, and whether it backed off.

    ``counts`` gives for each length, one after the other, the count of the n-gram that ends at each token,
    0 where the document is too short. A token is scored by the longest of them whose count reaches
    ``min_count``: its count divided by that of its context, times ``alpha`` for each shorter step taken.
    The last resort is the token's share of the corpus.
    """
    longest, used, score, shorter = 0, np.zeros(len(place), np.int8), np.zeros(0), np.zeros(0, np.int64)
    for longest, now in enumerate(counts):
        if longest:
            at = np.flatnonzero(now >= max(min_count, 1))
            score[at] = np.log(now[at] / np.maximum(shorter[at - 1], 1))
            used[at] = longest
            del at
        else:
            score = np.maximum(now, 1) / max(total, 1)
            np.log(score, out=score)
        shorter = now
    reach = np.minimum(place, longest).astype(np.int8)  # tokens of context at hand
    score += (reach - used) * np.float64(math.log(alpha))
    return score, used < reach


def _own_counts(
    tokens: np.ndarray, place: np.ndarray, grams: _Grams, known: pa.Table, single: np.ndarray, parts: int, order: int
) -> Iterator[np.ndarray]:
    """For each length, how often the n-gram that ends at each token of a block stands in the corpus."""
    yield single[tokens]
    pairs, triples, _ = grams.dealt(parts)
    known = known.sort_by("_part")
    named = ("_pair_counts", pairs, grams.pair_at), ("_triple_counts", triples, grams.triple_at)
    for k, (name, moved, at) in enumerate(named[: order - 1], 1):
        in_order = np.zeros(len(moved), np.int64)
        in_order[moved] = np.concatenate([np.zeros(0, np.int64), *[unpack(c.as_py(), "<i8") for c in known.column(name)]])
        # the n-gram that starts at a token ends k tokens later
        long = grams.starts + k < len(tokens)
        counts = np.zeros(len(tokens), np.int64)
        counts[grams.starts[long] + k] = in_order[at[long]]
        del in_order, long
        counts[place < k] = 0
        yield counts


def _scored(blocks: DataFrame, answers: DataFrame, single: np.ndarray, kind: str, parts: int, order: int, alpha: float, min_count: int) -> DataFrame:
    """``_id, n_tokens, n_backoff, log_score`` of the documents of each block."""
    total = int(single.sum())

    def run(block: pa.Table, known: pa.Table) -> pa.Table:
        pa.default_memory_pool().release_unused()
        sizes, tokens, grams = _block_grams(block.column("_sizes")[0].as_py(), block.column("_tokens")[0].as_py(), order)
        place = np.arange(len(tokens), dtype=np.int32) - np.repeat((np.cumsum(sizes) - sizes).astype(np.int32), sizes)
        counts = _own_counts(tokens, place, grams, known, single, parts, order)
        del grams, known
        logs, back = backoff_scores(place, counts, alpha, min_count, total)
        doc, n = np.repeat(np.arange(len(sizes)), sizes), len(sizes)
        ids = block.column("_ids").combine_chunks().values
        sums = [pa.array(np.bincount(doc, back, n).astype(np.int64)), pa.array(np.bincount(doc, logs, n).astype(np.float64))]
        return pa.table([ids, pa.array(sizes), *sums], names=["_id", "n_tokens", "n_backoff", "log_score"])

    schema = f"_id {kind}, n_tokens bigint, n_backoff bigint, log_score double"
    return blocks.groupBy("_block").cogroup(answers.groupBy("_block")).applyInArrow(run, schema)


def lm_scores(
    docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text",
    order: int = 3, alpha: float = 0.4, min_count: int = 2, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Score of every document: ``key, n_tokens, n_backoff, log_score, mean_log_score``.

    The counts come from all documents. Each task tokenizes its documents once and keeps the tokens in
    blocks. The n-grams of the blocks, one entry for each n-gram of a block, are dealt by a hash of their
    first two tokens; each part is added up to a table of n-grams with their counts, and the same exploded
    n-grams are joined with it. What a block gets back it turns into the log scores
    (:func:`backoff_scores`) of its tokens, summed per document. An n-gram has one entry per block at most,
    so none is hot; single tokens are counted in a table as long as the vocabulary. The numbers of parts
    and of tasks follow that of the blocks.

    N-grams below ``min_count`` are taken as unseen, single tokens never are. The counts include the
    document that is scored, so with a ``min_count`` of 1 an n-gram that stands only there would be its
    own evidence: it would score up to log 1, and no text of the corpus would ever back off.

    N-grams are of the tokenizer's ids and exact: a tokenizer with an id beyond ``MAX_ID`` is refused, and
    so is an ``order`` beyond 3. Empty and NULL texts have no tokens, the score 0 and no mean; rows that
    repeat a key are scored one by one, NULL keys too, and rows that repeat each other may be in different
    blocks; an empty table gives an empty result; other columns are ignored.
    """
    if not 1 <= order <= 3:
        raise ValueError("order must be 1, 2 or 3")
    if word_tokenizer(tokenizer).largest_id() > MAX_ID:
        raise ValueError(f"the tokenizer has ids beyond {MAX_ID}")
    kind = docs.select(key).schema[0].dataType.simpleString()
    blocks = keep(_blocks(docs, tokenizer, key, text, block_bytes))
    n_blocks = blocks.count()
    parts = max(PARTS, n_blocks // 2)
    single = _token_counts(blocks)
    # the sum and the join read the same shuffled n-grams
    exploded = _exploded(blocks, parts, order).repartition(max(parts // 8, 1), "_part")
    answers = _joined(exploded, _count_table(exploded, min_count)).repartition(max(n_blocks // 2, 1), "_block")
    scored = _scored(blocks.repartition(max(n_blocks // 2, 1), "_block"), answers, single, kind, parts, order, alpha, min_count)
    mean = F.when(F.col("n_tokens") > 0, F.col("log_score") / F.col("n_tokens"))
    return scored.select(F.col("_id").alias(key), "n_tokens", "n_backoff", "log_score", mean.alias("mean_log_score"))
