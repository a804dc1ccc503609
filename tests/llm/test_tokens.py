from __future__ import annotations

import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from panelkit.llm import tokens

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("size", [3, 350_000])
def test_ids_equal_those_of_whole_texts(monkeypatch, size):
    monkeypatch.setattr(tokens, "CACHE_WORDS", size)
    r = random.Random(5)
    pieces = ["a", "The", "it's", "I'LL", "don't,", "x.,y", "...", "é", "É,", "é.", "漢字", "ß!", " ", "\n", "\t", " ", " ",
              "\x1c", "\x00", "\x01", "12", "3a4", "a_b", "<|", "|>", "<|endoftext|>", "<|ENDOFTEXT|>", "'s", "s'", "'", "''", "≠",
              "K", "İ", "ΑΣ", "σς", "😀", "🏳️‍🌈", "{-~", "[]", "\\", "`"]
    texts = ["", " ", *["".join(r.choice(pieces) for _ in range(r.randrange(1, 25))) for _ in range(3000)]]
    exact = Tokenizer.from_file(PATH)
    words = tokens.WordTokenizer(PATH)
    for i in range(0, len(texts), 50):
        part = texts[i : i + 50]
        for t, ids in zip(part, words.encode([t.encode() for t in part]), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == exact.encode(t, add_special_tokens=False).ids, t


def test_other_tokenizers_encode_whole_texts():
    path = public_tokenizers.path("byte_bpe_50k.json")
    exact, words = Tokenizer.from_file(path), tokens.WordTokenizer(path)
    texts = ["The Cat  sat.\n\nOn, a Mat", "", " x", "don't STOP"]
    assert not words.by_word and tokens.WordTokenizer(PATH).by_word
    for t, ids in zip(texts, words.encode([t.encode() for t in texts]), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == exact.encode(t, add_special_tokens=False).ids
