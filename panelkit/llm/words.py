"""Words of UTF-8 text as numpy arrays.

A word is a maximal run of bytes other than the six ASCII white-space characters, so it equals the
pattern ``[^\\x20\\x09-\\x0D]+``. Words are represented by 64-bit hashes; two different words share one
with probability about 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

WORD = r"[^\x20\x09-\x0D]+"
# Bytes of text that a task turns into arrays at a time; one longer text is still taken whole.
CHUNK = 2 << 20

_RANDOM = np.random.default_rng(20210)
_BYTE = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_STEP = np.uint64(int(_RANDOM.integers(1 << 62, 1 << 63)) * 2 + 1)
_PLACE = [np.uint64(int(x) * 2 + 1) for x in _RANDOM.integers(1 << 61, 1 << 62, 64)]
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BYTE[_SPACE] = 0
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def combine(parts: list[np.ndarray]) -> np.ndarray:
    """One hash for each position of several equally long arrays of hashes, order counts."""
    total = np.zeros(len(parts[0]), np.uint64)
    for place, part in zip(_PLACE, parts, strict=False):
        total += mix(part + place) * place
    return mix(total)


def windows(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of the ``n`` values from each position on; the last ``n - 1`` positions have none."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    return combine([h[k : len(h) - n + 1 + k] for k in range(n)])


class Texts:
    """Some documents: their bytes laid end to end, with the document of every word."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray, lower: bool = False):
        self.buf = _LOWER[buf] if lower else buf
        self.offsets = offsets
        inside = np.zeros(len(buf) + 1, bool)
        inside[:-1] = ~_SPACE[buf]
        before = np.zeros(len(buf) + 1, bool)
        before[1:] = inside[:-1]
        before[offsets] = False
        self.starts = np.flatnonzero(inside & ~before)
        after = np.ones(len(buf) + 1, bool)
        after[:-1] = ~inside[1:]
        after[offsets[1:] - 1] = True
        self.ends = np.flatnonzero(inside & after) + 1
        self.first = np.searchsorted(self.starts, offsets)  # index of each document's first word
        self.counts = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(offsets) - 1), self.counts)

    def hashes(self) -> np.ndarray:
        """Hash of each word."""
        out = np.empty(len(self.starts), np.uint64)
        i = 0
        while i < len(self.starts):
            stop = int(np.searchsorted(self.starts, self.starts[i] + CHUNK))
            lo, hi = int(self.starts[i]), int(self.ends[stop - 1])
            begin = self.starts[i:stop] - lo
            span = np.diff(np.append(begin, hi - lo))
            place = np.arange(hi - lo) - np.repeat(begin, span)
            power = np.ones(int(span.max()) + 1, np.uint64)
            power[1:] = _STEP
            value = _BYTE[self.buf[lo:hi]] * np.cumprod(power)[place]
            length = (self.ends[i:stop] - self.starts[i:stop]).astype(np.uint64)
            out[i:stop] = mix(np.add.reduceat(value, begin) + length)
            i = stop
        return out


def chunks(column: pa.Array, lower: bool = False) -> Iterator[tuple[int, int, Texts]]:
    """Split a string column into runs of rows of bounded size: ``first row, end row, texts``.

    Missing texts count as empty.
    """
    column = column.cast(pa.large_string()).fill_null("")
    _, places, data = column.buffers()
    offsets = np.frombuffer(places, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + CHUNK, "right")) - 1)
        lo, hi = int(offsets[i]), int(offsets[j])
        yield i, j, Texts(raw[lo:hi], offsets[i : j + 1] - lo, lower)
        i = j
