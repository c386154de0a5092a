"""LM scoring, importance resampling and language identification against brute force."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest

from tabdelta.llm import importance as I
from tabdelta.llm import language_id as L
from tabdelta.llm import lm_scoring as M

from .conftest import words


def corpus(rng, n=80):
    rows = []
    for i in range(n):
        pool = "abcde" if i % 3 else "vwxyz"
        rows.append((i, " ".join(rng.choice(pool) * rng.randint(1, 2) for _ in range(rng.randint(1, 60)))))
    return rows


# LM scoring -----------------------------------------------------------------------


def brute_scores(rows, target, min_share):
    texts = [(i, (t or "").lower().split()) for i, t in rows]
    total = [sum(len(w) for _, w in texts), sum(len(w) for i, w in texts if i in target)]
    n = [Counter(x for _, w in texts for x in w), Counter(x for i, w in texts if i in target for x in w)]
    least = max(2, min_share * total[0])
    vocab = {w for w, k in n[0].items() if k >= least}

    def ids(w):
        return ["<s>", *(x if x in vocab else "<unk>" for x in w)]

    pairs = [Counter(p for i, w in texts for p in zip(ids(w), ids(w)[1:], strict=False) if m == 0 or i in target) for m in (0, 1)]
    kept = {p for p, k in pairs[0].items() if k >= least}
    out = []
    for i, w in texts:
        if not w:
            out.append((i, 0, None))
            continue
        bits = [0.0, 0.0]
        for h, x in zip(ids(w), ids(w)[1:], strict=False):
            for m in (0, 1):
                unk = total[m] - sum(n[m][v] for v in vocab)
                size = total[m] + len(vocab) + 2
                p1 = ((n[m][x] if x in vocab else unk) + 1) / size
                follow = sum(k for (a, b), k in pairs[m].items() if a == h and (a, b) in kept)
                seen = pairs[m][h, x] if (h, x) in kept else 0
                bits[m] -= math.log2((seen + M.PRIOR * p1) / (follow + M.PRIOR))
        out.append((i, len(w), (bits[1] - bits[0]) / len(w)))
    return out


@pytest.mark.parametrize("min_share", [2e-6, 0.02])
def test_scores_match_brute_force(spark, docs_of, rng, odd, min_share):
    rows = [*corpus(rng), *odd]
    target = {i for i in range(80) if i % 3 == 0}
    ids = spark.createDataFrame([(i,) for i in [*target, None, 3]], "doc_id long")
    got = M.cross_entropy_difference(docs_of([*rows, rows[7]]), ids, min_share=min_share)
    want = brute_scores([*rows, rows[7]], target, min_share)
    key = lambda r: (str(r[0]), r[1])
    have = sorted(((r.doc_id, r.n_tokens, r.score) for r in got.collect()), key=key)
    for a, b in zip(have, sorted(want, key=key), strict=True):
        assert a[:2] == b[:2] and (a[2] is None) == (b[2] is None) and (a[2] is None or abs(a[2] - b[2]) < 1e-9), (a, b)
    by = {r.doc_id: r.score for r in got.collect()}
    assert np.mean([by[i] for i in target]) < 0 < np.mean([by[i] for i in range(80) if i not in target])


def whole_scores(rows, target):
    texts = [(i, (t or "").lower().split()) for i, t in rows]
    own = [[w for i, w in texts if m == 0 or i in target] for m in (0, 1)]
    n = [Counter(x for w in ws for x in w) for ws in own]
    pairs = [Counter(p for w in ws for p in zip(["<s>", *w], w, strict=False)) for ws in own]
    follow = [Counter(h for w in ws for h in ["<s>", *w][: len(w)]) for ws in own]
    out = []
    for i, w in texts:
        bits = [0.0, 0.0]
        for h, x in zip(["<s>", *w], w, strict=False):
            for m in (0, 1):
                p1 = (n[m][x] + 1) / (n[m].total() + len(n[0]) + 2)
                bits[m] -= math.log2((pairs[m][h, x] + M.PRIOR * p1) / (follow[m][h] + M.PRIOR))
        out.append((i, len(w), (bits[1] - bits[0]) / len(w) if w else None))
    return out


@pytest.mark.parametrize("chunk", [200, 8 << 20])
def test_models_hold_every_word_and_bigram(spark, docs_of, rng, odd, monkeypatch, chunk):
    monkeypatch.setattr(M, "CHUNK_BYTES", chunk)
    rows = [*corpus(rng), *odd, (500, "once seen words only here"), (501, "ABC é ü c"), (502, "x" * 3000)]
    rows.append(rows[7])
    target = {i for i in range(80) if i % 3 == 0} | {500}
    got = M.cross_entropy_difference(docs_of(rows), spark.createDataFrame([(i,) for i in target], "doc_id long"))
    key = lambda r: (str(r[0]), r[1])
    have = sorted(((r.doc_id, r.n_tokens, r.score) for r in got.collect()), key=key)
    for a, b in zip(have, sorted(whole_scores(rows, target), key=key), strict=True):
        assert a[:2] == b[:2] and (a[2] is None) == (b[2] is None) and (a[2] is None or abs(a[2] - b[2]) < 1e-9), (a, b)


def test_scores_of_empty_tables(spark, docs_of):
    none = spark.createDataFrame([], "doc_id long")
    assert M.cross_entropy_difference(docs_of([]), none).count() == 0
    assert M.cross_entropy_difference(docs_of([(1, "a b a")]), none).first().n_tokens == 3


# importance resampling ------------------------------------------------------------


def test_weights_and_sample_match_brute_force(spark, docs_of, rng, odd):
    rows = [*corpus(rng), *odd]
    target = {i for i in range(80) if i % 3 == 0}
    ids = spark.createDataFrame([(i,) for i in target], "doc_id long")
    got = {r.doc_id: r for r in I.resample(docs_of(rows), ids, share=0.3, buckets=512).collect()}
    raw, own = np.zeros(512), np.zeros(512)
    for i, t in rows:
        for b in I.features(t, 512):
            raw[b] += 1
            own[b] += i in target
    expected = raw * own.sum() / raw.sum()
    weight = np.log((own + I.SMOOTHING) / (expected + I.SMOOTHING))
    for i, t in rows:
        assert abs(got[i].log_weight - weight[I.features(t, 512)].sum()) < 1e-9
    keys = sorted((r.sample_key for r in got.values()), reverse=True)
    assert sorted(r.sample_key for r in got.values() if r.kept) == sorted(keys[: math.ceil(0.3 * len(rows))])
    assert len(I.features("A b c")) == 5 and len(I.features("a")) == 1 and len(I.features(None)) == 0


def test_gumbel_noise_is_gumbel():
    noise = I.gumbel(np.arange(200_000), 1)
    assert abs(noise.mean() - 0.5772) < 0.01 and abs(noise.std() - math.pi / math.sqrt(6)) < 0.01
    assert (noise == I.gumbel(np.arange(200_000), 1)).all() and (noise != I.gumbel(np.arange(200_000), 2)).all()


def test_kth_largest(spark, rng):
    values = [rng.choice([1.0, 2.0, rng.random() * 1e6, -rng.random()]) for _ in range(3000)]
    table = spark.createDataFrame([(v,) for v in values], "x double").cache()
    for k in (1, 2, 700, 1500, 2999, 3000):
        assert I.kth_largest(table, "x", k, bins=16, few=20) == sorted(values, reverse=True)[k - 1]


def test_resample_of_empty_tables(spark, docs_of):
    none = spark.createDataFrame([], "doc_id long")
    assert I.resample(docs_of([]), none).count() == 0
    assert {r.log_weight for r in I.resample(docs_of([(1, "a b"), (2, None)]), none).collect()} == {0.0}


def test_resample_with_names_for_ids(spark):
    docs = spark.createDataFrame([(f"d{i}" if i % 9 else None, f"word{i % 7} again") for i in range(90)], "doc_id string, text string")
    got = I.resample(docs, docs.where("doc_id > 'd5'").select("doc_id"), share=0.5).collect()
    assert len(got) == 90 and len({r.sample_key for r in got if r.doc_id}) == 80 and 45 <= sum(r.kept for r in got) <= 55


# language identification ----------------------------------------------------------


def brute_profile(texts):
    n = Counter()
    for t in texts:
        n.update(brute_grams(t))
    return [g for g, _ in sorted(n.items(), key=lambda x: (-x[1], [ord(c) for c in x[0]] if len(x[0]) > 1 else [ord(x[0])]))]


def brute_grams(text):
    out = []
    for w in L._NOT_LETTERS.sub(" ", text.lower()).split():
        padded = f" {w} "
        for n in (1, 2, 3):
            out += [padded[i : i + n] for i in range(len(padded) - n + 1) if padded[i : i + n].strip()]
    return out


def key(gram):
    out = 0
    for c in gram:
        out = (out << 21) | ord(c)
    return out


def test_grams_and_ranks_match_brute_force():
    text = "Été l'été, 12 x_y Straße! a"
    got = Counter(L.grams(text).tolist())
    assert got == Counter(map(key, brute_grams(text)))
    ranks = L.ranked(L.grams(text), 10).tolist()
    assert ranks == [k for k, _ in sorted(got.items(), key=lambda x: (-x[1], x[0]))[:10]]


def test_held_out_accuracy_and_edge_cases(spark, rng, odd):
    letters = {"aa": "abcde aei", "bb": "vwxyz aei", "cc": "pqrst éüö"}
    rows = []
    for i in range(300):
        lang = list(letters)[i % 3]
        rows.append((i, " ".join(words(rng, 30, letters[lang].replace(" ", ""))), lang))
    rows += [(i, t, "aa") for i, t in odd] + [(950, "12345 --", "aa"), (952, "½", "aa"), (953, "² ③ Ⅷ १", "aa"), (951, "no language given here", None), rows[4]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    profiles = L.learn_profiles(docs.where(~L.held_out()), train_docs=60)
    assert profiles.names == ["aa", "bb", "cc"]
    got = L.identify(docs.withColumnRenamed("lang", "score"), profiles)
    found = got.collect()
    assert len(found) == len(rows) and got.columns == ["doc_id", "lang_pred", "score"]
    by = {r.doc_id: r for r in found}
    held = [r for r in rows if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 4 == 2 and r[0] < 300]
    assert held and all(by[i].lang_pred == lang for i, _, lang in held)
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (901, 902, 903, 950, 952, 953))
    assert all(0 <= r.score <= 1 for r in found)
    held_ids = {r.doc_id for r in docs.where(L.held_out()).collect()}
    assert held_ids == {r[0] for r in rows if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 4 == 2}


def test_no_language_is_lost_beyond_the_bound(spark):
    english, german = "the very same english text", "ein deutscher satz mit anderen wörtern"
    rows = [(i, english, "en") for i in range(30)] + [(100 + i, f"{german} {i}", "de") for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    for bound in (1, 3):
        profiles = L.learn_profiles(docs.select("text", "lang"), train_docs=bound)
        assert profiles.names == ["de", "en"] and profiles.predict(english)[0] == "en" and profiles.predict(german)[0] == "de"


def test_the_bound_is_filled(spark):
    rows = [("same", "x")] * 50_000 + [("other words", "y")] * 10
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(6)
    counts = {}
    learn, L.gram_counts = L.gram_counts, lambda picked, lang, text: counts.update({r[0]: r[1] for r in picked.groupBy(lang).count().collect()}) or learn(picked, lang, text)
    try:
        assert L.learn_profiles(docs).names == ["x", "y"]
    finally:
        L.gram_counts = learn
    assert counts == {"x": L.TRAIN_DOCS, "y": 10}


def test_distance_by_definition():
    profiles = L.Profiles.of({"x": np.array([5, 3, 9]), "y": np.array([7, 5])})
    own = np.array([5, 7, 3])
    far = {"x": abs(0 - 0) + L.PROFILE + abs(1 - 2), "y": abs(1 - 0) + abs(0 - 1) + L.PROFILE}
    L_ranked, L_grams = L.ranked, L.grams
    try:
        L.ranked, L.grams = lambda keys, most=0: own, lambda t: own
        name, score = profiles.predict("anything")
    finally:
        L.ranked, L.grams = L_ranked, L_grams
    best = min(far, key=lambda k: (far[k], k))
    assert name == best and abs(score - (1 - far[best] / (L.PROFILE * 3))) < 1e-12


def test_language_of_empty_tables(spark, docs_of):
    profiles = L.learn_profiles(docs_of([]))
    assert L.identify(docs_of([]), profiles).count() == 0
    assert L.identify(docs_of([(1, "abc")]), profiles).first().lang_pred == "und"
