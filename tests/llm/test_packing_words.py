"""Ids of whole texts from words that a worker keeps."""

import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from ledgerloom.llm import packing
from ledgerloom.llm.queries import tokenizer_file
from ledgerloom.llm.words import Recent


@pytest.mark.parametrize("words", [5, 1 << 18])
def test_ids_are_the_tokenizers_however_texts_are_put_together(monkeypatch, words):
    monkeypatch.setattr(packing, "WORDS", words)
    rng = random.Random(words)
    letters = list("abcXYZ'stéÉİΣσ̸́.,!?#$%&|<>=09中 \t\n\x0b\x0c\r  \x1c\x85~_`-\U0001f600")
    texts = ["".join(rng.choices(letters, k=rng.randrange(60))) for _ in range(600)] + ["The the THE, the.### don't we'll été Été, ÉTÉ!!", "", " ", "a b " * 50]
    file = tokenizer_file("word_bpe_49k.json")
    plain, encode = Tokenizer.from_file(file), packing.encoder(file)
    for part in (texts[:300], texts, []):
        want = [np.array(plain.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in part]
        assert list(encode([t.encode() for t in part])) == want


def test_recent_words_are_worked_out_once_and_old_ones_go():
    asked = []
    recent = Recent(lambda ws: [asked.append(w) or w * 2 for w in ws], bound=40_000, slice_=7)
    often = [b"often", b""]
    for k in range(200):
        words = [*often, *(f"{k}-{i}".encode() for i in range(20))]
        assert recent.values(words) == [w * 2 for w in words]
    assert asked.count(b"often") == asked.count(b"") == 1 and recent.get(b"0-0") is None
    assert len(recent.young) + len(recent.old) < 400
