"""Terms of UTF-8 text as 64-bit hashes, and look-up of hashes in a vocabulary.

A term is a maximal run of digits, letters A-Z and a-z, and characters beyond ASCII, with only A-Z put in
lower case. Different terms share a hash with probability about 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from panelkit.llm.words import CHUNK, Texts

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

# Every other ASCII character becomes a space, so that words of the outcome are the terms.
_BYTE = np.arange(256, dtype=np.uint8)
_BYTE[[b for b in range(128) if not chr(b).isalnum()]] = 0x20
_BYTE[65:91] += 32


def term_chunks(column: pa.Array) -> Iterator[tuple[int, int, Texts]]:
    """Runs of rows of bounded size, ``first row, end row, texts``, whose words are the terms.

    Missing texts count as empty; one very long text is taken whole.
    """
    column = column.cast(pa.large_string()).fill_null("")
    _, places, data = column.buffers()
    offsets = np.frombuffer(places, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + CHUNK, "right")) - 1)
        lo, hi = int(offsets[i]), int(offsets[j])
        yield i, j, Texts(_BYTE[raw[lo:hi]], offsets[i : j + 1] - lo)
        i = j


class Vocabulary:
    """Sorted distinct hashes; a table of bits turns most others away before the search."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = hashes
        bits = max(12, int(len(hashes) * 16).bit_length())
        self.mask = np.uint64((1 << bits) - 1)
        self.bits = np.zeros(1 << bits, bool)
        self.bits[hashes & self.mask] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of known hashes in the array given, and their numbers in the vocabulary."""
        at = np.flatnonzero(self.bits[hashes & self.mask])
        number = np.searchsorted(self.hashes, hashes[at])
        number[number == len(self.hashes)] = 0
        known = self.hashes[number] == hashes[at] if len(self.hashes) else np.zeros(len(at), bool)
        return at[known], number[known]
