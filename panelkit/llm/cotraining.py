"""A quality classifier by co-training a view of the text with a view of the page's metadata."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelkit.llm.words import Texts, chunks, mix
from panelkit.session import discard, keep

# Labelled rows, at most, on which the views are calibrated; they are kept from training.
CALIBRATION_ROWS = 20_000
# Share of the labelled documents set aside for that.
CALIBRATION_SHARE = 0.2

_PUNCTUATION = [c for c in range(33, 127) if not chr(c).isalnum()]
_FIELDS = {"source": 32, "lang": 8, "chars": 18, "lines": 10, "line_chars": 12}  # slots per field
N_TEXT = len(_PUNCTUATION) + 12
N_META = sum(_FIELDS.values()) + 1


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return np.sqrt(part / np.maximum(whole, 1))


def text_view(texts: Texts) -> np.ndarray:
    """Content of each document: characters, word shapes and repetition, as shares."""
    n = len(texts.offsets) - 1
    size = np.diff(texts.offsets)
    doc = np.repeat(np.arange(n), size)
    kinds = np.bincount(doc * 256 + texts.buf, minlength=n * 256).reshape(n, 256)
    letters = kinds[:, 65:91].sum(1) + kinds[:, 97:123].sum(1)
    columns = [_share(kinds[:, c], size) for c in _PUNCTUATION]
    columns += [_share(kinds[:, 65:91].sum(1), letters), _share(kinds[:, 48:58].sum(1), size)]
    columns += [_share(kinds[:, 128:].sum(1), size), _share(letters, size)]
    words, width = texts.counts, texts.ends - texts.starts
    hashes = texts.hashes()
    own = texts.doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    distinct = _distinct(mix(hashes + own), texts.doc, n)
    next_ = texts.doc[1:] == texts.doc[:-1]
    pairs = mix(hashes[:-1] + mix(hashes[1:] + own[1:]))[next_]
    n_pairs = np.bincount(texts.doc[1:][next_], minlength=n)
    distinct_pairs = _distinct(pairs, texts.doc[1:][next_], n)
    same = np.bincount(texts.doc[1:][next_], (hashes[1:] == hashes[:-1])[next_], n)
    last = texts.buf[texts.ends - 1] if len(texts.ends) else np.zeros(0, np.uint8)
    marked = ~(((last | 32) >= 97) & ((last | 32) <= 122) | (last >= 128))
    columns += [
        _share(words - distinct, words),
        _share(n_pairs - distinct_pairs, n_pairs),
        _share(same, words),
        _share(np.bincount(texts.doc, marked, n), words),
        _share(np.bincount(texts.doc, width <= 3, n), words),
        _share(np.bincount(texts.doc, width > 12, n), words),
        np.log1p(words) / 10,
        np.ones(n),
    ]
    return np.stack(columns, 1).astype(np.float32)


def _distinct(values: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    _, first = np.unique(values, return_index=True)
    return np.bincount(doc[first], minlength=n)


def _slot(value: str | None, slots: int) -> int:
    """Slot of a value by all of its bytes, eight at a time; one of up to eight is only multiplied."""
    raw = (value or "").encode()
    key = 0
    for i in range(0, max(len(raw), 1), 8):
        key ^= key >> 29
        key = (key ^ int.from_bytes(raw[i : i + 8].rjust(8, b"\0"), "big")) * 0x9E3779B97F4A7C15 % (1 << 64)
    return key * slots >> 64


def meta_slots(texts: Texts, source: list, lang: list) -> np.ndarray:
    """Slot of each field of the metadata: source, language, and the page's length and lines."""
    size = np.diff(texts.offsets)
    breaks = np.zeros(len(texts.buf) + 1, np.int64)
    np.cumsum(texts.buf == 10, out=breaks[1:])
    lines = breaks[texts.offsets[1:]] - breaks[texts.offsets[:-1]] + 1
    level = {"chars": size, "lines": lines, "line_chars": size // lines}
    columns = [np.array([_slot(v, _FIELDS[f]) for v in values]) for f, values in (("source", source), ("lang", lang))]
    columns += [np.minimum(np.log2(v + 1).astype(int), _FIELDS[f] - 1) for f, v in level.items()]
    return np.stack(columns, 1).astype(np.int16)


def meta_view(slots: np.ndarray) -> np.ndarray:
    """The slots as indicator columns."""
    out = np.zeros((len(slots), N_META), np.float32)
    start = 0
    for i, n in enumerate(_FIELDS.values()):
        out[np.arange(len(slots)), start + slots[:, i]] = 1
        start += n
    out[:, -1] = 1
    return out


@dataclass(frozen=True)
class Models:
    """Weights of the two views, and the line that turns each one's margin into calibrated log-odds."""

    text: np.ndarray = field(default_factory=lambda: np.zeros(N_TEXT))
    meta: np.ndarray = field(default_factory=lambda: np.zeros(N_META))
    text_line: tuple[float, float] = (1.0, 0.0)
    meta_line: tuple[float, float] = (1.0, 0.0)
    prior: float = 0.0

    def log_odds(self, views: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        pairs = zip(views, (self.text, self.meta), (self.text_line, self.meta_line), strict=True)
        return tuple(a * (x @ w) + b for x, w, (a, b) in pairs)

    def scores(self, views: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Probability of good quality by the text, by the metadata, and by both."""
        a, b = self.log_odds(views)
        return _sigmoid(a), _sigmoid(b), _sigmoid(a + b - self.prior)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def features(docs: DataFrame, key: str, text: str, source: str, lang: str) -> DataFrame:
    """``_id, _text_view, _meta``: both views of every document, packed."""
    kind = docs.select(key).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, texts in chunks(batch.column(1)):
                rest = [batch.column(c).slice(i, j - i).to_pylist() for c in (2, 3)]
                a, b = text_view(texts), meta_slots(texts, *rest)
                packed = [pa.array([row.tobytes() for row in v], pa.binary()) for v in (a, b)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *packed], names=["_id", "_a", "_b"])

    columns = docs.select(
        F.col(key).alias("_id"), F.col(text).alias("_t"), F.col(source).cast("string").alias("_s"), F.col(lang).cast("string").alias("_l")
    )
    return columns.mapInArrow(run, f"_id {kind}, _a binary, _b binary")


def _views(frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    a = np.frombuffer(b"".join(frame["_a"]), np.float32).reshape(-1, N_TEXT)
    b = np.frombuffer(b"".join(frame["_b"]), np.int16).reshape(-1, len(_FIELDS))
    return a.astype(np.float64), meta_view(b).astype(np.float64)


def _fit(rows: DataFrame, models: Models, teacher: Models | None, confident: float, rounds: int, ridge: float) -> Models:
    """Newton steps of both views' logistic regressions over all rows.

    A view learns from the labelled rows and, with a teacher, from the unlabelled rows of which the
    teacher's *other* view is confident. Tasks send sums per cell of the equations, whose number is fixed.
    """
    weights = [models.text, models.meta]
    for _ in range(rounds):
        now = [w.copy() for w in weights]

        def add_up(frames: Iterator[pd.DataFrame], now=now) -> Iterator[pd.DataFrame]:
            sums = [np.zeros((len(w) + 1, len(w))) for w in now]
            for frame in frames:
                views = _views(frame)
                label = frame["_label"].to_numpy(float)
                known = ~np.isnan(label)
                odds = teacher.log_odds(views) if teacher is not None else None
                for v, x in enumerate(views):
                    y, use = np.nan_to_num(label), known
                    if odds is not None:
                        sure = ~known & (np.abs(odds[1 - v]) >= confident)
                        y, use = np.where(sure, odds[1 - v] > 0, y), known | sure
                    x, y = x[use], y[use]
                    p = _sigmoid(x @ now[v])
                    sums[v][0] += x.T @ (y - p)
                    sums[v][1:] += x.T @ (x * (p * (1 - p))[:, None])
            flat = np.concatenate([s.ravel() for s in sums])
            at = np.flatnonzero(flat)
            yield pd.DataFrame({"cell": at, "value": flat[at]})

        cells = rows.select("_a", "_b", "_label").mapInPandas(add_up, "cell bigint, value double")
        table = cells.groupBy("cell").agg(F.sum("value").alias("value")).toPandas()
        flat = np.zeros(sum((len(w) + 1) * len(w) for w in weights))
        flat[table["cell"].to_numpy(int)] = table["value"].to_numpy(float)
        start = 0
        for v, w in enumerate(weights):
            d = len(w)
            block = flat[start : start + (d + 1) * d].reshape(d + 1, d)
            start += (d + 1) * d
            step = np.linalg.solve(block[1:] + ridge * np.eye(d), block[0] - ridge * w)
            weights[v] = w + step * min(1.0, 8.0 / max(np.abs(step).max(), 1e-9))
    return Models(weights[0], weights[1])


def _calibrated(models: Models, held: pd.DataFrame) -> Models:
    """Fit each view's line from margin to log-odds on the rows set aside."""
    y = held["_held"].to_numpy(float)
    if not len(y):
        return models
    prior = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    lines = []
    for x, w in zip(_views(held), (models.text, models.meta), strict=True):
        margin = np.stack([x @ w, np.ones(len(y))], 1)
        line = np.array([0.0, prior])
        for _ in range(20):
            p = _sigmoid(margin @ line)
            hessian = margin.T @ (margin * (p * (1 - p))[:, None]) + 1e-3 * np.eye(2)
            line += np.linalg.solve(hessian, margin.T @ (y - p) - 1e-3 * (line - [0.0, prior]))
        lines.append((float(line[0]), float(line[1])))
    return Models(models.text, models.meta, lines[0], lines[1], prior)


def train(rows: DataFrame, rounds: int = 2, confidence: float = 0.98, ridge: float = 1.0) -> Models:
    """Co-train on rows ``_a, _b, _label, _held``; unlabelled rows have neither label.

    Rows set aside that the calibration does not take are trained on.
    """
    place = F.xxhash64("_id")
    held = rows.where("_held IS NOT NULL").select("_id", "_a", "_b", "_held", place.alias("_place"))
    held = held.orderBy("_place").limit(CALIBRATION_ROWS + 1).toPandas()
    if len(held) > CALIBRATION_ROWS:
        # rows that repeat a key go the same way
        cut = int(held["_place"].iloc[-1])
        held = held[held["_place"] < cut]
        spare = F.col("_held").isNotNull() & (place >= cut)
        rows = rows.withColumn("_label", F.when(spare, F.col("_held")).otherwise(F.col("_label")))
    confident = float(np.log(confidence / (1 - confidence)))
    models = _calibrated(_fit(rows, Models(), None, confident, 6, ridge), held)
    for _ in range(rounds):
        models = _calibrated(_fit(rows, models, models, confident, 3, ridge), held)
    return models


def train_on(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source",
    lang: str = "lang", label: str = "quality", rounds: int = 2, confidence: float = 0.98,
) -> tuple[Models, DataFrame]:
    """The trained models, and the stored views of every document: ``_id, _a, _b``.

    Of several labels of a key the majority counts, ties are good; NULL labels do not count.
    """
    stored = keep(features(docs, key, text, source, lang))
    votes = labels.where(F.col(label).isNotNull()).groupBy(F.col(key).alias("_k"))
    votes = votes.agg(F.when(F.avg(F.col(label).cast("double")) >= 0.5, 1.0).otherwise(0.0).alias("_y"))
    held = F.pmod(F.xxhash64(F.lit(1), "_k"), F.lit(1000)) < int(1000 * CALIBRATION_SHARE)
    rows = keep(
        stored.join(votes, stored["_id"] == votes["_k"], "left").select(
            "_id", "_a", "_b", F.when(~held, F.col("_y")).alias("_label"), F.when(held, F.col("_y")).alias("_held")
        )
    )
    models = train(rows, rounds, confidence)
    discard(rows)
    return models, stored


def quality_scores(docs: DataFrame, labels: DataFrame, key: str = "doc_id", threshold: float = 0.5, **options) -> DataFrame:
    """Quality of every document: ``key, text_score, metadata_score, score, kept``.

    Two classifiers see a document: one its text (characters, word shapes, repetition), one its
    metadata (source, language, length, lines). Both start from the labelled documents. In each round,
    each is trained again on the labelled documents and on all unlabelled ones of which the other is
    confident. Their log-odds are calibrated on a fifth of the labelled documents, at most
    ``CALIBRATION_ROWS``, which training leaves out, and added, with the prior counted once; a view without information adds nothing. A document is
    kept if the combined probability reaches ``threshold``.

    Training passes over all other documents; the calibration rows are chosen by a hash. ``options`` are those of :func:`train_on`. NULL texts are empty, NULL source and language are
    values of their own, rows that repeat a key are scored one by one. Without labels all scores are 0.5
    and everything is kept; an empty table gives an empty result; other columns are ignored.
    """
    models, stored = train_on(docs, labels, key, **options)
    kind = docs.select(key).schema[0].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            frame = pd.DataFrame({"_a": batch.column(1).to_pylist(), "_b": batch.column(2).to_pylist()})
            scores = [pa.array(v) for v in models.scores(_views(frame))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *scores], names=["_id", "_s1", "_s2", "_s3"])

    scored = stored.mapInArrow(score, f"_id {kind}, _s1 double, _s2 double, _s3 double")
    return scored.select(
        F.col("_id").alias(key),
        F.col("_s1").alias("text_score"),
        F.col("_s2").alias("metadata_score"),
        F.col("_s3").alias("score"),
        (F.col("_s3") >= threshold).alias("kept"),
    )


def keep_good(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source",
    lang: str = "lang", threshold: float = 0.5, **options,
) -> DataFrame:
    """The rows of ``docs``, all columns, that :func:`quality_scores` keeps; judged where they are."""
    models, stored = train_on(docs, labels, key, text, source, lang, **options)
    discard(stored)
    at = [docs.columns.index(c) for c in (text, source, lang)]

    def good(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, texts in chunks(batch.column(at[0])):
                rest = [batch.column(c).slice(i, j - i).cast(pa.string()).to_pylist() for c in at[1:]]
                views = text_view(texts), meta_view(meta_slots(texts, *rest))
                yield batch.slice(i, j - i).filter(pa.array(models.scores(views)[2] >= threshold))

    return docs.mapInArrow(good, docs.schema)
