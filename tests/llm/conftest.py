from __future__ import annotations

import random

import pytest

# names that the operators use inside, as further columns of the input
CLASH = ["_id", "_text", "_n", "size", "kept", "host", "_set", "_h", "_d", "_block", "key", "_c0"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} int" for c in CLASH)
WORDS = [a + b for a in ("ka", "lo", "mi", "nu", "re", "sa") for b in ("", "n", "r", "st", "da", "pel")]


def prose(seed: int, n: int, line: int = 12) -> str:
    r = random.Random(seed)
    words = [r.choice(WORDS) + r.choice(WORDS) + r.choice("abcdefgh") for _ in range(n)]
    return "\n".join(" ".join(words[i : i + line]) for i in range(0, n, line))


def changed(text: str, seed: int, share: float) -> str:
    r = random.Random(seed)
    return " ".join("x" + w if r.random() < share else w for w in text.split())


@pytest.fixture(scope="session")
def documents(spark):
    """A table from ``(doc_id, text)`` or ``(doc_id, text, source)`` rows, with clashing columns."""

    def make(rows):
        full = []
        for row in rows:
            doc_id, text, source = (*row, "s1")[:3]
            full.append((doc_id, text, "en", source, None if text is None else len(text), *[7] * len(CLASH)))
        return spark.createDataFrame(full, SCHEMA)

    return make


@pytest.fixture(scope="session")
def tricky():
    """Missing and empty texts, white space only, long, repeated and tying rows, missing keys."""
    long = prose(1, 30_000, 40)
    return [
        (1, None, "a"), (2, "", None), (3, " \n\t ", "a"), (4, "one", "b"), (5, "one two three", "b"),
        (6, long, "a"), (7, long, None), (8, prose(2, 90), "c"), (8, prose(2, 90), "c"), (9, prose(2, 90), "c"),
        (None, prose(3, 60), "a"), (None, None, "a"), (10, prose(4, 200), "a"), (11, changed(prose(4, 200), 5, 0.01), "d"),
        (12, "Ünï cödé 漢字 " * 30, "d"), (13, "one\x1cword ONE one", "b"), (5, "one two three four", "b"),
    ]
