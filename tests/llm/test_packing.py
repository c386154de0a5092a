import zlib
from collections import defaultdict

import numpy as np
import pytest

from tabdelta.llm import packing as P
from tabdelta.llm.queries import END_ID, tokenizer_path

from .conftest import words


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


def whole(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, END_ID]


def test_words_on_their_own_give_the_ids_of_the_text(tokenizer):
    texts = ["The cat's  house—naïve\n\tÜber 12,345 it's fine x <|endoftext|> end", "", " ", None, "é ́x I'll we'RE ΑΣ ΟΔΟΣ", "日本語 テキスト\r\nx"]
    texts += ["<|STARTOFTEXT|>", "a <|endoftext|>b", "A<|EndOfText|>", "x<|startoftext|><|endoftext|>\nY", "<| endoftext |>"]
    got = P.Encoder(tokenizer_path()).encode(texts)
    for text, ids in zip(texts, got, strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == whole(tokenizer, text)[:-1], text


def check(rows, texts, tokenizer, capacity):
    pieces = defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
    for i, text in texts.items():
        ids = np.array(whole(tokenizer, text), "<u4")
        own = sorted(pieces[i], key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own)))
        assert [r.start for r in own] == [capacity * k for k in range(len(own))]
        assert sum(r.length for r in own) == len(ids) and all(r.length == capacity for r in own[:-1])
        for r in own:
            assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def best_fit(lengths, capacity):
    gaps: list[int] = []
    for size in lengths:
        k = min((k for k, g in enumerate(gaps) if g >= size), key=lambda k: gaps[k], default=None)
        if k is None:
            gaps.append(capacity - size)
        else:
            gaps[k] -= size
    return len(gaps)


def test_pieces_and_places(docs_of, rng, tokenizer):
    texts = {i: " ".join(words(rng, rng.choice([1, 5, 30, 60, 200]))) for i in range(120)}
    texts |= {500: None, 501: "", 502: " ".join(words(rng, 3000))}
    docs = docs_of(list(texts.items()))
    rows = P.pack_documents(docs, tokenizer_path(), END_ID, capacity=256).collect()
    n = check(rows, texts, tokenizer, 256)
    assert n <= best_fit(sorted((r.length for r in rows), reverse=True), 256) + 1
    grouped = P.pack_documents(docs, tokenizer_path(), END_ID, capacity=256, group=40).collect()
    assert check(grouped, texts, tokenizer, 256) <= n * 1.15 + 3


def test_sequences_hold_the_documents(docs_of, tokenizer):
    texts = {1: "one two three", 2: "four five", 3: None, 4: "six " * 40}
    got = [r.ids for r in P.sequences(docs_of(list(texts.items())), tokenizer_path(), END_ID, capacity=16).collect()]
    assert sorted(x for s in got for x in s) == sorted(x for t in texts.values() for x in whole(tokenizer, t))
    assert max(map(len, got)) <= 16


def test_repeated_rows_null_ids_and_empty_table(docs_of):
    docs = docs_of([(1, "a b"), (1, "a b"), (None, "c")])
    assert P.pack_documents(docs, tokenizer_path(), END_ID).count() == 3
    assert P.pack_documents(docs_of([]), tokenizer_path(), END_ID).count() == 0


def test_large_ids_beside_null_and_clashing_columns(spark, docs_of, tokenizer):
    ids = [2**60 + 1, None, 2**60 + 3, -(2**60) - 5]
    got = P.pack_documents(docs_of([(i, "a b") for i in ids]), tokenizer_path(), END_ID).collect()
    assert sorted((r.doc_id for r in got), key=str) == sorted(ids, key=str)
    rows = [(2**60 + k if k % 3 else None, 5 + k, None if k % 2 else "x", 7, k) for k in range(20)]
    pieces = spark.createDataFrame(rows, "_group long, length long, offset string, sequence_id int, _packed_in long")
    packed = P.pack(pieces, capacity=64, group=8)
    assert packed.columns == ["_group", "length", "_packed_in", "sequence_id", "offset"]
    assert sorted(((r._group, r.length, r._packed_in) for r in packed.collect()), key=str) == sorted(((a, b, e) for a, b, _, _, e in rows), key=str)


def test_sum_of_squares_by_definition():
    r = np.random.default_rng(2)
    lengths = r.integers(1, 21, 300)
    sequence, offset = P.sum_of_squares(lengths, 20)
    gaps: dict[int, int] = {}
    for size, s, o in zip(lengths.tolist(), sequence.tolist(), offset.tolist(), strict=True):

        def cost(changed):
            n = np.bincount([g for g in changed.values() if 0 < g < 20], minlength=21)
            return int((n**2).sum())

        options = {k: cost({**gaps, k: g - size}) for k, g in gaps.items() if g >= size}
        assert options[s] == min(options.values()) if options else s == len(gaps)
        assert o == 20 - gaps.get(s, 20)
        gaps[s] = gaps.get(s, 20) - size


def test_letters_that_fall_apart_keep_their_mark_with_the_signs_behind():
    odd = ["İ, x İ.", "सक़, a", "it's don't, 'tis' rock'n'roll,", "a_b_ c__ 9, x²., ²,", "fiﬁ. ß!! ΑΣ,", "é, a̸≮ b&&&", "x.́ y,̂", "日本, 한.", "a" * 3000 + ",", "z" + "." * 30, "", " "]
    encoder = P.Encoder(tokenizer_path())
    want = [np.array(x.ids, "<u4").tobytes() for x in encoder.tokenizer.encode_batch_fast(odd, add_special_tokens=False)]
    assert encoder.encode(odd) == want
    assert encoder.encode(odd[::-1]) == want[::-1]


def test_words_that_go_are_learned_again(monkeypatch):
    monkeypatch.setattr(P, "_KNOWN", 40)
    encoder = P.Encoder(tokenizer_path())
    texts = [" ".join(f"{a}{b}{sign}" for b in "xyzuvw") for a in "abcdefgh" for sign in ("", ",", "&&&")] * 2
    want = [np.array(x.ids, "<u4").tobytes() for x in encoder.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    assert [encoder.encode([t])[0] for t in texts] == want
    assert len(encoder.words) <= 40 + 6
