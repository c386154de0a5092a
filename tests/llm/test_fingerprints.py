"""I-Match fingerprints against plain Python."""

import hashlib
import random
import re
from collections import Counter

import pytest
import xxhash

from tabdelta.llm import fingerprints as P

from .conftest import words


def spark_hash(value, seed=42):
    data = value.encode() if isinstance(value, str) else value.to_bytes(8, "little", signed=True)
    return int.from_bytes(xxhash.xxh64_intdigest(data, seed).to_bytes(8, "little"), "little", signed=True)


def terms(text):
    return {w for w in re.split(r"[\x00-/:-@\[-`{-\x7F]+", (text or "").lower()) if w}


def in_subset(k, level, term):
    """Whether subset ``k`` holds a term: Spark's hash of the number and the term's hash."""
    first = xxhash.xxh64_intdigest(k.to_bytes(4, "little"), 42)
    return xxhash.xxh64_intdigest(spark_hash(term).to_bytes(8, "little", signed=True), first) % (1 << level) == 0


def brute(rows, low=P.LOW, high=P.HIGH):
    """Likeness of pairs of texts from the sets of their terms in each subset."""
    df = Counter(t for _, text in rows for t in terms(text))
    n = len(rows)
    held = {t: c > n / 2**low for t, c in df.items() if c >= n / 2**high}

    def parts(text):
        own = {t for t in terms(text) if t in held}
        band = {t for t in own if not held[t]}
        if not own:
            return "=" + (text or "")
        chosen = band or own
        return "b" if band else "c", [frozenset(t for t in chosen if in_subset(k, level, t)) for k, level in enumerate(P.LEVELS)]

    def likeness(a, b):
        x, y = parts(a), parts(b)
        if x == y:
            return 1.0
        if isinstance(x, str) or isinstance(y, str) or x[0] != y[0]:
            return 0.0
        either = [(p, q) for p, q in zip(x[1], y[1], strict=True) if p or q]
        return sum(p == q for p, q in either) / len(either)

    return likeness


def edit(text, after):
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


@pytest.fixture
def corpus(rng):
    vocabulary = words(rng, 400)
    rows = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 90)))) for k in range(60)]
    rows += [(100 + k, rows[5][1]) for k in range(5)] + [(200, rows[7][1].upper() + "!"), (201, "é𝒳 ünï" * 9), (202, None), (203, ""), (204, "?!"), (205, "?!")]
    return rows


def test_likeness_and_edits_match_plain_python(docs_of, corpus):
    got = {r["doc_id"]: r for r in P.fingerprint_edits(docs_of(corpus, 5)).collect()}
    likeness = brute(corpus)
    order = sorted(corpus)
    assert len(got) == len(corpus)
    prints = {}
    for k, (i, text) in enumerate(order):
        own, after = text or "", order[(k + 1) % len(order)][1] or ""
        changed = edit(own, after)
        r = got[i]
        assert r["n_chars"] == len(own) and r["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
        assert r["near_edited"] == pytest.approx(likeness(own, changed)) and r["near_next"] == pytest.approx(likeness(own, after)), (i, own)
        assert prints.setdefault(own, r["fingerprint"]) == r["fingerprint"]
    assert len({r["fingerprint"] for r in got.values()}) > 60
    # case and marks don't matter, nor does the order of words
    assert got[200]["fingerprint"] == got[7]["fingerprint"] and got[202]["fingerprint"] == got[203]["fingerprint"] != got[204]["fingerprint"]


def test_edited_texts_are_nearer_than_the_next(docs_of, corpus):
    rows = P.fingerprint_edits(docs_of([x for x in corpus if x[0] < 60 and len(x[1]) > 100])).collect()
    assert sum(r["near_edited"] > r["near_next"] for r in rows) > 0.8 * len(rows)


def test_pairs_over_many_ranges(spark, docs_of):
    rows = [(i * 7 - 300, f"t{i}") for i in range(500)]
    random.Random(3).shuffle(rows)
    got = P.with_next(docs_of(rows, 4), "doc_id", "text").where("NOT guest").collect()
    order = [t for _, t in sorted(rows)]
    assert {r["text"]: r["next_text"] for r in got} == dict(zip(order, order[1:] + order[:1], strict=True)) and len(got) == 500
    assert len({r["range"] for r in got}) > 10


def test_odd_rows(spark, docs_of, odd):
    rows = [*odd, *odd, (904, "one"), (904, "two"), (None, None)]
    docs = docs_of(rows).selectExpr("*", "1 AS range", "'x' AS fingerprint", "2 AS place")
    got = P.fingerprint_edits(docs).collect()
    assert len(got) == len(rows) and all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
    one = P.fingerprint_edits(docs_of([(1, "alone with itself")])).first()
    assert one["near_next"] == 1 and one["edited_sha256"] == hashlib.sha256(edit("alone with itself", "alone with itself").encode()).hexdigest()
    assert P.fingerprint_edits(docs_of([])).collect() == []
    texts = docs_of([(1, "b c"), (2, "x y")]).selectExpr("cast(doc_id AS string) AS name", "text")
    assert P.fingerprint_edits(texts, "name").count() == 2
