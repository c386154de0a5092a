"""Spelling variants against a comparison of all words."""

import re
import zlib
from collections import Counter

from tabdelta.llm import spelling as S


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute(rows):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            if len(run) >= 7:
                n[run] += 1
    n = {w: c for w, c in n.items() if c >= 2}
    around = {w: [v for v in n if near(w, v)] for w in n}
    form = {}
    for w, vs in around.items():
        best = min(vs, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {w: (n[w], len(around[w]), form[w], n.get(form[w]), root(w)) for w in n}


def result(df):
    rows = df.collect()
    out = {r["word"]: (r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in rows}
    assert len(out) == len(rows)
    return out


def corpus(rng):
    base = ["letters", "sentence", "écrivain", "straßeüber", "aaaaaaaa", "Hannover", "mississippi", "bookkeeper"]
    rows = []
    for i in range(60):
        text = []
        for w in base:
            text += [w.upper() if rng.random() < 0.1 else w] * rng.randint(1, 4)
            k = rng.randrange(len(w))
            text.append(rng.choice([w[:k] + w[k + 1 :], w[:k] + "q" + w[k + 1 :], w[:k] + w[k] + w[k:], w + "s", "x" + w]))
        rng.shuffle(text)
        rows.append((i, rng.choice([" ", ", ", "1"]).join(text)))
    return rows


def test_variants_match_plain_python(docs_of, rng, odd):
    rows = corpus(rng) + odd + [(77, "abcdefg abcdefg abcdef abcdef"), (None, "lettersq lettersq"), (78, "×÷Àbcdef " * 3), (79, "z" * 5000 + " " + "z" * 5000 + " " + "z" * 5001)] * 2
    want = brute(rows)
    assert result(S.spelling_variants(docs_of(rows))) == want
    assert any(v[2] for v in want.values()) and any(v[1] > 1 for v in want.values())


def test_crowded_segments_are_split(docs_of, rng):
    want = brute(rows := corpus(rng))
    for crowd in (1, 3):
        assert result(S.spelling_variants(docs_of(rows), crowd=crowd)) == want


def test_forms_are_followed(docs_of):
    rows = [(i, " ".join(["abcdefgh"] * 500 + ["abcdefgx"] * 40 + ["abcdefyx"] * 3)) for i in range(3)]
    got, want = result(S.spelling_variants(docs_of(rows))), brute(rows)
    assert got == want and got["abcdefyx"][4] == "abcdefgh" and got["abcdefyx"][2] == "abcdefgx"


def test_empty(docs_of):
    assert S.spelling_variants(docs_of([])).collect() == [] == S.spelling_variants(docs_of([(1, "too few of any")])).collect()
