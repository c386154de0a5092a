import re
from collections import Counter

import numpy as np

from tabdelta.llm.quality_rules import count_text, fit_label_model, keep_good, quality_rules


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [s for s in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", s)]
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    many = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if many[g] > 1 for k in range(3)}
    seen, dup = set(), 0
    for s in lines:
        dup += s in seen
        seen.add(s)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def test_counts_match_brute_force(rng):
    texts = [None, "", " \n ", "a b a b a b", "one\none\n one\ntwo", "é# ü|ß\n<x> & $", "x " * 5000]
    texts += ["\n".join(" ".join(rng.choice(["ab", "c#", "dé", "e"]) for _ in range(rng.randint(0, 6))) for _ in range(20)) for _ in range(30)]
    for text in texts:
        assert count_text(text)[:5] == brute(text), text


def test_em_finds_good_and_bad_rules():
    r = np.random.default_rng(0)
    truth = r.random(20_000) < 0.8
    right = np.array([0.95, 0.9, 0.85, 0.6])
    votes = np.where(r.random((20_000, 4)) < right, truth[:, None], ~truth[:, None]).astype(int)
    votes[r.random(votes.shape) < 0.2] = 2
    rows, n = np.unique(votes, axis=0, return_counts=True)
    model = fit_label_model(rows, n.astype(float))
    assert np.allclose(model.good, right, atol=0.04) and abs(model.prior - 0.8) < 0.03


def test_rules_that_say_good_of_everything_do_not_outvote_others():
    # two rules see the junk, three call everything good
    votes = np.array([[1, 1, 1, 1, 1], [0, 0, 1, 1, 1], [1, 2, 1, 1, 1]])
    model = fit_label_model(votes, np.array([900.0, 80.0, 20.0]))
    odds = np.log(model.prior / (1 - model.prior)) + (votes == 1) @ np.log(model.good / (1 - model.bad)) + (votes == 0) @ np.log((1 - model.good) / model.bad)
    assert (odds > 0).tolist() == [True, False, True]
    assert (model.good + model.bad >= 1.05 - 1e-9).all()


def posterior(row, rules, model):
    """The posterior of a row of counts, by plain arithmetic."""
    odds = model.prior / (1 - model.prior)
    for name, g, b in zip(rules, model.good, model.bad, strict=True):
        odds *= {0: (1 - g) / b, 1: g / (1 - b), 2: 1.0}[row[f"vote_{name}"]]
    return odds / (1 + odds)


def test_verdicts_match_a_second_computation(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = [r.asDict() for r in quality_rules(docs).collect()]
    assert list(rows[0])[:8] == ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    names = [c.removeprefix("vote_") for c in rows[0] if c.startswith("vote_")]
    taught = Counter(tuple(r[f"vote_{n}"] for n in names) for r in rows if not r["base_failed"])
    model = fit_label_model(np.array(list(taught)), np.array(list(taught.values()), float))
    for r in rows:
        words, chars, symbols, dup, repeat = brute(texts[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (words, chars, symbols, dup, repeat)
        assert r["base_failed"] == (words < 50 or 100 * repeat > 50 * words)
        p = posterior(r, names, model)
        assert abs(r["p_quality"] - p) < 1e-9 and r["kept"] == (not r["base_failed"] and p >= 0.5)
        share = symbols / max(words, 1)
        assert r["vote_symbols"] == (0 if share > 0.1 else 1 if share <= 0.02 else 2)


def clean(rng, n=120):
    return " ".join(rng.choice(["the", "of", "cat", "dog", "house", "tree"]) + rng.choice(["", "s", "ly", "er", "ing"]) for _ in range(n)) + "."


def test_verdicts_and_edge_cases(docs_of, rng, odd):
    good = [(i, clean(rng)) for i in range(60)]
    junk = [(100 + i, " ".join(w + "&&&" for w in clean(rng).split())) for i in range(8)]
    short = [(200, clean(rng, 20)), (201, "one two three " * 60)]
    docs = docs_of([*good, *junk, *short, *odd, good[0]])
    rows = [r.asDict() for r in quality_rules(docs).collect()]
    assert len(rows) == docs.count()
    kept = Counter(r["doc_id"] for r in rows if r["kept"])
    assert kept == Counter([*range(60), 0])
    assert all(r["base_failed"] for r in rows if r["doc_id"] in (None, 200, 201, 901, 902, 903))
    again = keep_good(docs.withColumnRenamed("n_chars", "n_words"))
    assert again.columns == ["doc_id", "text", "lang", "source", "n_words"]
    assert Counter(r["doc_id"] for r in again.collect()) == kept


def test_empty_table(docs_of):
    assert quality_rules(docs_of([])).count() == 0 and keep_good(docs_of([])).count() == 0
