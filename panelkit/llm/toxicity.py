"""Toxicity scores from a factorization machine over hashed terms."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelkit.llm.terms import Vocabulary, term_chunks
from panelkit.llm.words import Texts, mix
from panelkit.session import keep

# Labelled texts the machine is fitted on, about; a sample by hash where there are more.
TRAIN_ROWS = 20_000
# Terms it has weights for, at most: half by association with the label, half by frequency.
TERMS = 1 << 14
# Labelled texts that must hold a term; and how many standard deviations its share of the label must lie
# from that of all, or which share of the texts must hold it.
MIN_ROWS, APART, FREQUENT = 4, 3.0, 0.02
# Length of each term's vector.
FACTORS = 8
EPOCHS, BATCH, RATE, PENALTY = 12, 256, 0.1, 1e-5
# Bytes of the beginnings of words that are terms too, so that endings do not matter.
STEMS = (4, 5)


def text_terms(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Document and hash of every term: words, and the beginnings of longer ones."""
    docs, hashes = [texts.doc], [texts.hashes()]
    for width in STEMS:
        long = np.flatnonzero(texts.ends - texts.starts > width)
        raw = np.zeros(len(long), np.uint64)
        for k in range(width):
            raw = raw << np.uint64(8) | texts.buf[texts.starts[long] + k].astype(np.uint64)
        docs.append(texts.doc[long])
        hashes.append(mix(raw + np.uint64(width << 56)))
    return np.concatenate(docs), np.concatenate(hashes)


@dataclass(frozen=True)
class Machine:
    """Weight and vector of each known term; ``bias`` belongs to every text."""

    terms: np.ndarray
    bias: float
    weights: np.ndarray
    vectors: np.ndarray

    def margins(self, doc: np.ndarray, term: np.ndarray, n: int) -> np.ndarray:
        """Log-odds of ``n`` texts from the distinct pairs of text and term number, sorted by text."""
        linear = np.bincount(doc, self.weights[term], n)
        sums = _sums(self.vectors[term].astype(np.float64), doc, n)
        squares = _sums(self.vectors[term].astype(np.float64) ** 2, doc, n)
        return self.bias + linear + 0.5 * (sums**2 - squares).sum(1)


def _sums(rows: np.ndarray, group: np.ndarray, n: int) -> np.ndarray:
    """Sums of the rows of each group; rows are sorted by group."""
    out = np.zeros((n, rows.shape[1]))
    start = np.flatnonzero(np.diff(group, prepend=-1))
    if len(start):
        out[group[start]] = np.add.reduceat(rows, start, axis=0)
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit_machine(terms: np.ndarray, rows: list[np.ndarray], labels: np.ndarray, factors: int = FACTORS, seed: int = 7) -> Machine:
    """Fit log-loss by adaptive steps over small batches; ``rows`` hold term numbers below ``len(terms)``.

    A term's vector moves with the sum of the vectors beside it, so pairs of terms get a weight of their
    own, as the product of their vectors. The same rows in the same order give the same machine.
    """
    random = np.random.default_rng(seed)
    n, m = len(rows), len(terms)
    share = (labels.sum() + 0.5) / (n + 2)
    bias, weights = float(np.log(share / (1 - share))), np.zeros(m)
    vectors = random.normal(0, 0.05, (m, factors))
    # starting above zero, so that rare terms take small steps
    seen = [np.full(1, 1e-4), np.full(m, 1e-4), np.full((m, factors), 1e-4)]
    batch = min(BATCH, max(8, n // 40))
    for epoch in range(EPOCHS if n else 0):
        rate = RATE / (1 + 0.3 * epoch)
        order = random.permutation(n)
        for i in range(0, n, batch):
            part = order[i : i + batch]
            size = np.array([len(rows[r]) for r in part])
            doc = np.repeat(np.arange(len(part)), size)
            term = np.concatenate([rows[r] for r in part])
            v = vectors[term]
            sums = _sums(v, doc, len(part))
            margin = bias + np.bincount(doc, weights[term], len(part)) + 0.5 * (sums**2 - _sums(v**2, doc, len(part))).sum(1)
            error = (_sigmoid(margin) - labels[part]) / len(part)
            by_term = np.argsort(term, kind="stable")
            start = np.flatnonzero(np.diff(term[by_term], prepend=-1))
            used = term[by_term][start]
            slope = error[doc]
            # the length of a text bounds what its many pairs may move at once
            bend = (slope / np.sqrt(size[doc]))[:, None] * (sums[doc] - v)
            steps = [np.array([error.sum()])]
            if len(used):
                steps += [np.add.reduceat(slope[by_term], start) + PENALTY * weights[used]]
                steps += [np.add.reduceat(bend[by_term], start, axis=0) + PENALTY * vectors[used]]
            seen[0] += steps[0] ** 2
            bias -= float(rate * steps[0][0] / np.sqrt(seen[0][0]))
            if len(used):
                seen[1][used] += steps[1] ** 2
                seen[2][used] += steps[2] ** 2
                weights[used] -= rate * steps[1] / np.sqrt(seen[1][used])
                vectors[used] -= rate * steps[2] / np.sqrt(seen[2][used])
    return Machine(terms, bias, weights, vectors.astype(np.float32))


def _labelled(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, train_rows: int) -> DataFrame:
    """``_row, _label, _terms``: distinct terms of the labelled texts taken for fitting.

    Rows that repeat key and text count once. The sample is by a hash of both, so it is the same for any
    order of rows, and at most about ``train_rows`` are read as text.
    """
    marks = labels.where(F.col(label).isNotNull()).groupBy(F.col(key).alias("_k")).agg(F.max(F.col(label).cast("int")).alias("_label"))
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key).alias("_id"), body.alias("_text"), F.xxhash64(key, body).alias("_row"))
    taken = keep(rows.drop("_text").join(marks, F.col("_id") == F.col("_k")).select("_id", "_row", "_label").distinct())
    count = taken.count()
    if count > train_rows:
        # signed 64-bit hashes are spread evenly
        limit = int(-(2**63) + 2**64 * (train_rows / count))
        taken = taken.where(F.col("_row") < limit)
    # about as many rows as the parameter allows, so they may go to every task
    small = F.broadcast(taken.select(F.col("_id").alias("_k"), F.col("_row").alias("_r"), "_label"))
    texts = rows.join(small, (F.col("_id") == F.col("_k")) & (F.col("_row") == F.col("_r"))).select("_row", "_label", "_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, part in term_chunks(batch.column(2)):
                doc, hashes = text_terms(part)
                order = np.lexsort((hashes, doc))
                doc, hashes = doc[order], hashes[order]
                new = np.ones(len(doc), bool)
                new[1:] = (doc[1:] != doc[:-1]) | (hashes[1:] != hashes[:-1])
                ends = np.append(0, np.cumsum(np.bincount(doc[new], minlength=j - i)))
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(hashes[new].view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), lists], names=["_row", "_label", "_terms"])

    found = keep(texts.mapInArrow(run, "_row bigint, _label int, _terms array<bigint>"))
    return found.dropDuplicates(["_row"])


def _chosen_terms(rows: DataFrame, terms: int) -> np.ndarray:
    """Hashes of the terms that get weights, sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            label = np.repeat(np.asarray(batch.column(0)), np.diff(np.asarray(lists.offsets)))
            hashes, at = np.unique(np.asarray(lists.flatten()), return_inverse=True)
            bad = np.bincount(at, label > 0, len(hashes)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(hashes), pa.array(np.bincount(at, minlength=len(hashes))), pa.array(bad)], names=["_h", "_n", "_bad"])

    counts = rows.select("_label", "_terms").mapInArrow(run, "_h bigint, _n bigint, _bad bigint")
    counts = counts.groupBy("_h").agg(F.sum("_n").alias("_n"), F.sum("_bad").alias("_bad")).where(F.col("_n") >= MIN_ROWS)
    counts = keep(counts)
    total = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum((F.col("_label") > 0).cast("int")), F.lit(0)).alias("bad")).first()
    # how far the share of labelled rows lies from that of all, in standard deviations
    share = (total["bad"] + 0.5) / (total["n"] + 1)
    apart = F.abs(F.col("_bad") - F.col("_n") * share) / F.sqrt(F.col("_n") * share * (1 - share))
    kinds = (apart, apart >= APART), (F.col("_n"), F.col("_n") >= FREQUENT * total["n"])
    hashes = [r["_h"] for order, fit in kinds for r in counts.where(fit).orderBy(order.desc(), "_h").limit(terms // 2).collect()]
    return np.unique(np.array(hashes, np.int64).view(np.uint64))


def train_machine(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic",
    train_rows: int = TRAIN_ROWS, terms: int = TERMS,
) -> Machine:
    """The machine fitted on labelled documents; see :func:`toxicity_scores`."""
    rows = _labelled(docs, labels, key, text, label, train_rows)
    chosen = _chosen_terms(rows, terms)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Vocabulary(chosen)
        for batch in batches:
            lists = batch.column(2)
            doc = np.repeat(np.arange(batch.num_rows), np.diff(np.asarray(lists.offsets)))
            at, found = known.find(np.asarray(lists.flatten()).view(np.uint64))
            ends = np.append(0, np.cumsum(np.bincount(doc[at], minlength=batch.num_rows)))
            packed = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(found.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), packed], names=["_row", "_label", "_known"])

    def fit(table: pa.Table) -> pa.Table:
        table = table.sort_by("_row")
        rows = [np.asarray(r.values) for r in table.column("_known")]
        machine = fit_machine(chosen, rows, (table.column("_label").to_numpy() > 0).astype(float))
        packed = machine.weights.astype("<f8"), machine.vectors.astype("<f4")
        return pa.table([pa.array([machine.bias]), *[pa.array([p.tobytes()], pa.binary()) for p in packed]], names=["bias", "weights", "vectors"])

    # one task fits the bounded sample; what it gets are the numbers of known terms
    numbered = rows.mapInArrow(number, "_row bigint, _label int, _known array<int>").withColumn("_all", F.lit(1))
    fitted = numbered.groupBy("_all").applyInArrow(fit, "bias double, weights binary, vectors binary").first()
    if fitted is None:
        return fit_machine(chosen, [], np.zeros(0))
    vectors = np.frombuffer(fitted["vectors"], "<f4").reshape(len(chosen), FACTORS)
    return Machine(chosen, fitted["bias"], np.frombuffer(fitted["weights"], "<f8"), vectors)


def score_documents(docs: DataFrame, machine: Machine, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, score, predicted`` of every row by a fitted machine."""
    kind = docs.select(key).schema[0].dataType.simpleString()
    terms = max(len(machine.terms), 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Vocabulary(machine.terms)
        for batch in batches:
            for i, j, part in term_chunks(batch.column(1)):
                doc, hashes = text_terms(part)
                at, number = known.find(hashes)
                pairs = np.unique(doc[at] * terms + number)
                score = _sigmoid(machine.margins(pairs // terms, pairs % terms, j - i))
                columns = [batch.column(0).slice(i, j - i), pa.array(score), pa.array((score >= 0.5).astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, names=["_id", "score", "predicted"])

    scored = docs.select(F.col(key).alias("_id"), F.col(text).alias("_text")).mapInArrow(run, f"_id {kind}, score double, predicted int")
    return scored.withColumnRenamed("_id", key)


def toxicity_scores(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic",
    train_rows: int = TRAIN_ROWS, terms: int = TERMS,
) -> DataFrame:
    """One row per input row: ``key, score, predicted``.

    The terms of a text are its words (digits, letters and characters beyond ASCII, A-Z in lower case) and
    the first four and five bytes of longer ones, each counted once, as 64-bit hashes. A second-order
    factorization machine gives every known term a weight and a vector; the score is the logistic function
    of the bias, the weights and the products of the vectors of all pairs of a text's terms. So pairs that
    are toxic only together are learnt, which weights alone cannot add up.

    It learns from documents whose key ``labels`` gives a ``label``; nothing but text is an input. At most
    about ``train_rows`` labelled texts are taken, a sample by hash where there are more, and at most
    ``terms`` terms get weights: both bound what a single task fits and what is sent to all others. Every
    row is scored by its whole text, without any shuffle.

    A key with several labels has the largest; labels that are NULL or match no row teach nothing. Rows
    that repeat a key are scored one by one, NULL keys too. NULL and empty texts score the bias, which is
    the share of label 1 at first; without any labels all scores are 0.25. An empty table gives an empty
    result; other columns are ignored.
    """
    machine = train_machine(docs, labels, key, text, label, train_rows, terms)
    return score_documents(docs, machine, key, text)
