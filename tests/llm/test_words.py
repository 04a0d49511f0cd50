"""Word hashes by numpy: the words of the contract's pattern, whatever the blocks."""

import random

import numpy as np
import pyarrow as pa

import brute
from corpusloom.llm import words as w


def test_hashes_follow_the_words():
    r = random.Random(1)
    signs = "abcXYZ019 \t\n-_.,'éÉ日𝔘\x00\x7f/:@[`{"
    texts = ["".join(r.choice(signs) for _ in range(r.randint(0, 60))) for _ in range(300)] + [None, "", "  ", "a" * 5000, "Aa aA"]
    hashes, bounds = w.word_hashes(texts)
    assert len(bounds) == len(texts) + 1 and bounds[-1] == len(hashes)
    of_word, of_hash = {}, {}
    for text, first, stop in zip(texts, bounds, bounds[1:]):
        found = brute.WORD.findall(brute.ascii_lower(text))
        assert len(found) == stop - first
        for word, h in zip(found, hashes[first:stop].tolist()):
            assert of_word.setdefault(word, h) == h and of_hash.setdefault(h, word) == word


def test_long_texts_in_pieces(monkeypatch):
    texts = [" ".join(f"w{i % 91}é" for i in range(4000)), None, "x" * 300, "tail"]
    whole = w.word_hashes(texts)
    monkeypatch.setattr(w, "BLOCK_BYTES", 64)
    parts = w.word_hashes(texts)
    assert np.array_equal(whole[0], parts[0]) and np.array_equal(whole[1], parts[1])


def test_blocks_hold_every_text_once():
    texts = pa.array(["a" * 10, None, "b" * 100, "", "c" * 30, "d"], pa.string())
    assert list(w.blocks(texts, 40)) == [(0, 2), (2, 3), (3, 6)]
    assert list(w.blocks(pa.array([], pa.string()), 40)) == []
    out = list(w.in_blocks([texts, texts.slice(2)], lambda part: [len(t or "") for t in part], pa.int64()))
    assert [o.to_pylist() for o in out] == [[10, 0, 100, 0, 30, 1], [100, 0, 30, 1]]


def test_grams_tell_order_and_size():
    hashes, _ = w.word_hashes(["a b c a b"])
    two, three = w.gram_hashes(hashes, 2), w.gram_hashes(hashes, 3)
    assert two[0] == two[3] and len(set(two.tolist())) == 3 and not set(two.tolist()) & set(three.tolist())
    assert len(w.gram_hashes(hashes, 6)) == 0
