"""Token ids of whole texts with a public tokenizer, one dictionary look-up per word."""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np

# A task remembers the ids of the words it met last: between once and twice so many.
CACHE_WORDS = 350_000
# New words given to the tokenizer as one text.
RUN = 500

# A character that is a token of its own between spaces and never joins others.
_MARK = "\x01"
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = True
_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) != "'"]] = True

# What tokenizers differ in: cases, white space kept or joined, letters beside punctuation and digits.
_PROBE = "The Quick brown-fox,  (don't) JUMPED\tover:\n\n 12 lazy_dogs2 x.Y! Über-ÖL it's\u00a0wor\u0301ld ... \u6f22\u5b57 END"

_READY: dict[str, WordTokenizer] = {}


class WordTokenizer:
    """Token ids as little-endian 32-bit bytes, for tokenizers that lower case and drop white space.

    Such a tokenizer treats runs of letters and of other characters one by one and never joins them over
    white space. So A-Z may be put in lower case and letters parted from punctuation that follows, and
    the ids of a text are those of its words in turn; a word that was met before is not encoded again.
    An apostrophe stays where it is, as it may start a contraction. Texts that might hold a special
    token or the mark between words are encoded as they are. A tokenizer that is not of this kind is found
    out by a probe when it is loaded, and then all texts are encoded as they are.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        mark = self.tokenizer.encode(_MARK, add_special_tokens=False).ids
        self.mark = mark[0] if len(mark) == 1 else None
        self.now: dict[bytes, bytes] = {}
        self.before: dict[bytes, bytes] = {}
        self.by_word = self.mark is not None
        self.by_word = self.by_word and next(self.encode([_PROBE.encode()])) == self._whole(_PROBE.encode())

    def largest_id(self) -> int:
        return max(self.tokenizer.get_vocab(with_added_tokens=True).values(), default=0)

    def _whole(self, text: bytes) -> bytes:
        return _packed(self.tokenizer.encode(text.decode(), add_special_tokens=False).ids)

    def encode(self, texts: list[bytes]) -> Iterator[bytes]:
        """The ids of each text; ``texts`` should hold a bounded number of bytes."""
        plain = [self.by_word and b"<|" not in t and b"\x01" not in t for t in texts]
        words = [_parted(t.lower()).split() if p else None for t, p in zip(texts, plain, strict=True)]
        self._learn([ws for ws in words if ws])
        ids = self.now.__getitem__
        for t, ws in zip(texts, words, strict=True):
            if ws is None:
                yield self._whole(t)
            else:
                yield b"".join(map(ids, ws))

    def _learn(self, words: list[list[bytes]]) -> None:
        if len(self.now) > CACHE_WORDS:
            self.before, self.now = self.now, {}
        now, before, new = self.now, self.before, []
        for w in set().union(*words):
            if w not in now:
                if w in before:
                    now[w] = before[w]
                else:
                    new.append(w)
        runs = [f" {_MARK} ".join(map(bytes.decode, new[k : k + RUN])) + f" {_MARK}" for k in range(0, len(new), RUN)]
        for k, found in enumerate(self.tokenizer.encode_batch_fast(runs, add_special_tokens=False)):
            ids = np.array(found.ids, "<u4")
            ends = np.flatnonzero(ids == self.mark).tolist()
            raw = ids.tobytes()
            starts = [0, *[e + 1 for e in ends[:-1]]]
            part = new[k * RUN : (k + 1) * RUN]
            now.update((w, raw[4 * s : 4 * e]) for w, s, e in zip(part, starts, ends, strict=True))


def _parted(text: bytes) -> bytes:
    """A space between a letter a-z and punctuation that follows it."""
    raw = np.frombuffer(text, np.uint8)
    if len(raw) < 2:
        return text
    at = np.flatnonzero(_LETTER[raw[:-1]] & _PUNCTUATION[raw[1:]]) + 1
    return np.insert(raw, at, 32).tobytes() if len(at) else text


def _packed(ids: list[int]) -> bytes:
    return np.array(ids, "<u4").tobytes()


def word_tokenizer(path: str) -> WordTokenizer:
    """The tokenizer of a file; a Python worker keeps it, with its words, from task to task."""
    if path not in _READY:
        _READY[path] = WordTokenizer(path)
    return _READY[path]


def forget() -> None:
    """Drop the tokenizers of this Python worker, with the words they remember."""
    _READY.clear()
