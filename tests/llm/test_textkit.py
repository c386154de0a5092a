import random

import numpy as np

from tabdelta.llm.textkit import shingle_set, window_hashes, words_of


def test_equal_windows_hash_alike_and_others_apart():
    rng = random.Random(1)
    words = [rng.choice([b"a", b"bb", b"ccc", b"\xc3\xa9t\xc3\xa9"]) for _ in range(3000)]
    hashes = window_hashes(words, 3)
    plain = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    assert len(hashes) == len(plain)
    assert len(set(hashes.tolist())) == len(set(plain)) == len(set(zip(hashes.tolist(), plain, strict=True)))


def test_hashes_do_not_depend_on_place_or_white_space():
    text = "one two three four five"
    long = "x" * 700_000 + " " + text + " " + "y " * 400_000
    inside = window_hashes(words_of(long), 5)
    assert np.isin(shingle_set("One\ttwo \n three  four five", 5), inside).all()
    assert len(window_hashes(words_of(long), 1)) == 400_006


def test_word_longer_than_a_block():
    word = b"z" * 1_500_000
    a, b = window_hashes([b"a", word, b"b"], 2), window_hashes([b"q", b"a", word], 2)
    assert a[0] == b[1] and a[0] != a[1]


def test_few_words_and_none():
    assert len(shingle_set("one two", 5)) == 1
    assert len(shingle_set("", 5)) == len(shingle_set(None, 5)) == len(shingle_set(" \n", 5)) == 0
    assert words_of("É A B") == ["É".encode(), "a b".encode()]  # only A-Z fold; other spaces belong to words
