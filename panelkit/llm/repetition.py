"""Quality rules on repetition: how much of a text lies inside duplicated word n-grams and lines."""

from __future__ import annotations

from collections.abc import Collection, Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelkit.llm.words import Texts, chunks, mix

# Published limits for the share of characters inside duplicated n-grams and lines.
COVERAGE_LIMITS = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
LINE_LIMIT = 0.20

# Characters that count as symbols.
SYMBOLS = "#*$%&|<>"

_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[[ord(c) for c in SYMBOLS]] = True
_NEWLINE = 10
_APART = np.uint64(0x9E3779B97F4A7C15)
# An odd number and its inverse modulo 2**64.
_BASE = 0xD1342543DE82EF95
_INVERSE = pow(_BASE, -1, 1 << 64)


def _repeated(values: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each position: whether its document holds the value twice or more, and whether held before."""
    order = np.argsort(mix(values.astype(np.uint64) + doc.astype(np.uint64) * _APART), kind="stable")
    v, d = values[order], doc[order]
    same = (v[1:] == v[:-1]) & (d[1:] == d[:-1])
    often, again = np.zeros(len(v), bool), np.zeros(len(v), bool)
    often[1:] |= same
    often[:-1] |= same
    again[1:] = same  # the order is stable, so the first of equal values is the earliest
    out, before = np.empty(len(v), bool), np.empty(len(v), bool)
    out[order], before[order] = often, again
    return out, before


class RollingHashes:
    """Hashes of windows of any length over a row of values, two operations for each window.

    The values before a place make a polynomial modulo 2**64 in an odd base. The window's part of it is
    the difference of two of them, and an inverse power of the base moves it to where all windows are
    compared, so each place costs the same for every length.
    """

    def __init__(self, values: np.ndarray):
        power, inverse = (np.full(len(values), b, np.uint64) for b in (_BASE, _INVERSE))
        power[:1] = inverse[:1] = 1
        self.inverse = np.cumprod(inverse)
        self.upto = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * np.cumprod(power), out=self.upto[1:])

    def windows(self, n: int) -> np.ndarray:
        """Hash of the ``n`` values from each place on; the last ``n - 1`` places have none."""
        if len(self.upto) <= n:
            return np.zeros(0, np.uint64)
        return mix((self.upto[n:] - self.upto[:-n]) * self.inverse[: len(self.upto) - n])


def _covered(texts: Texts, hashes: np.ndarray, sizes: Collection[int]) -> dict[int, np.ndarray]:
    """For each size: words that lie in a window of so many words that their document repeats.

    A repeated window starts with a repeated shorter one, so each size looks only where the one before
    it found something.
    """
    at, rolling = np.arange(len(hashes)), RollingHashes(hashes)
    out = {}
    for n in sorted(sizes):
        grams = rolling.windows(n)
        at = at[at < len(grams)]
        at = at[texts.doc[at] == texts.doc[at + n - 1]]
        often, _ = _repeated(grams[at], texts.doc[at])
        at = at[often]
        edge = np.zeros(len(hashes) + 1, np.int64)
        edge[at] += 1
        edge[at + n] -= 1
        out[n] = np.cumsum(edge[:-1]) > 0
    return out


def _sum(texts: Texts, amount: np.ndarray) -> np.ndarray:
    """Sum over each document's words."""
    total = np.zeros(len(amount) + 1, np.int64)
    np.cumsum(amount, out=total[1:])
    return total[texts.first[1:]] - total[texts.first[:-1]]


def _lines(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document of every line that has a word."""
    if not len(texts.starts):
        return (np.zeros(0, np.int64),) * 3
    cuts = np.flatnonzero(texts.buf == _NEWLINE)
    starts = np.union1d(cuts + 1, texts.offsets[:-1])
    starts = starts[starts < len(texts.buf)]
    ends = np.minimum(np.append(starts[1:], len(texts.buf)), len(texts.buf))
    # a line ends before its newline, or where its document ends
    closed = (ends > 0) & (texts.buf[np.maximum(ends - 1, 0)] == _NEWLINE) & (ends > starts)
    ends = ends - closed
    has = np.searchsorted(texts.starts, ends) > np.searchsorted(texts.starts, starts)
    starts, ends = starts[has], ends[has]
    return starts, ends, np.searchsorted(texts.offsets, starts, "right") - 1


def measure(texts: Texts) -> dict[str, np.ndarray]:
    """The measures of each document."""
    hashes = texts.hashes()
    head = (texts.buf & 0xC0) != 0x80
    upto = np.zeros(len(head) + 1, np.int64)
    np.cumsum(head, out=upto[1:])
    chars = upto[texts.ends] - upto[texts.starts]
    marks = np.zeros(len(head) + 1, np.int64)
    np.cumsum(_IS_SYMBOL[texts.buf], out=marks[1:])
    out = {
        "n_words": texts.counts.astype(np.int64),
        "word_chars": _sum(texts, chars),
        "n_symbols": marks[texts.offsets[1:]] - marks[texts.offsets[:-1]],
    }
    starts, ends, doc = _lines(texts)
    view = memoryview(texts.buf)
    ids: dict[bytes, int] = {}
    line = np.array([ids.setdefault(bytes(view[s:e]), len(ids)) for s, e in zip(starts, ends, strict=True)], np.int64)
    _, again = _repeated(line, doc)
    width = upto[ends] - upto[starts]
    n = len(texts.offsets) - 1
    out["n_dup_lines"] = np.bincount(doc, again, n).astype(np.int64)
    out["dup_line_chars"] = np.bincount(doc, again * width, n).astype(np.int64)
    out["line_chars"] = np.bincount(doc, width, n).astype(np.int64)
    covered = _covered(texts, hashes, {8, *COVERAGE_LIMITS})
    out["n_repeat_words"] = _sum(texts, covered[8])
    for size in COVERAGE_LIMITS:
        out[f"chars_{size}"] = _sum(texts, covered[size] * chars)
    return out


def repetition_rules(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    limits: Mapping[int, float] = COVERAGE_LIMITS,
    line_limit: float = LINE_LIMIT,
) -> DataFrame:
    """Measures of every document and the verdict ``kept``, one row per row, without a shuffle.

    ``n_words``; ``word_chars``, code points in words; ``n_symbols``; ``n_dup_lines``, lines with a word
    that equal an earlier line of the text; ``n_repeat_words``, words in 8-word windows that the text
    holds twice or more; ``chars_5`` to ``chars_10``, code points of words in such windows of other
    lengths; ``dup_line_chars`` of ``line_chars``. ``base_failed``: under 20 words or more than 30 % of
    the words repeat. A document is kept if it does not fail and neither the share of characters in
    duplicated n-grams nor that in duplicated lines exceeds its limit.

    Windows are compared by 64-bit rolling hashes, lines by their bytes. Empty and NULL texts measure 0
    and fail; NULL keys and repeated rows are judged like others; an empty table gives an empty result.
    """
    kind = docs.select(key).schema[0].dataType.simpleString()
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "dup_line_chars", "line_chars"]
    names += [f"chars_{n}" for n in COVERAGE_LIMITS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, texts in chunks(batch.column(1)):
                found = measure(texts)
                columns = [batch.column(0).slice(i, j - i), *[pa.array(found[n]) for n in names]]
                yield pa.RecordBatch.from_arrays(columns, names=["_id", *names])

    schema = ", ".join([f"_id {kind}", *[f"{n} bigint" for n in names]])
    found = docs.select(F.col(key).alias("_id"), F.col(text).alias("_text")).mapInArrow(run, schema)
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    over = F.col("dup_line_chars") > line_limit * F.col("line_chars")
    for n, limit in limits.items():
        over = over | (F.col(f"chars_{n}") > limit * F.col("word_chars"))
    verdict = [failed.alias("base_failed"), (~failed & ~over).alias("kept")]
    return found.select(F.col("_id").alias(key), *names[:5], *verdict, *names[5:])
