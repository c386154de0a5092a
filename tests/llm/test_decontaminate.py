from tabdelta.llm.decontaminate import decontaminate, remove_contaminated

from .conftest import words


def plain(text, width):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}


def brute(docs, items, width, least):
    out = []
    for d, t in docs:
        for i, s in items:
            n = len((s or "").split())
            k = min(width, n)
            want = plain(s, k) if n else set()
            if d is not None and i is not None and want and len(want & plain(t, k)) >= least * len(want):
                out.append((d, i, len(want & plain(t, k)), len(want)))
    return sorted(out)


def test_matches_brute_force(spark, docs_of, rng, odd):
    items = [(i, " ".join(words(rng, n))) for i, n in enumerate([2, 4, 5, 6, 9, 15, 24, 40, 41, 70, 130])]
    items += [(50, None), (51, ""), (None, "x y z u v w"), items[4]]
    docs = [(100 + k, " ".join(words(rng, rng.randint(0, 3000)))) for k in range(20)]
    for k, (i, s) in enumerate(items):
        if s and i is not None:
            w = s.split()
            docs.append((200 + k, " ".join(words(rng, 900)) + " " + s.upper() + "\n" + " ".join(words(rng, 700))))
            half = len(w) // 2
            docs.append((300 + k, " ".join([*w[:half], *words(rng, 50), *w[half:]])))
            docs.append((400 + k, " ".join(w[: max(1, len(w) * 85 // 100)])))
    docs += [*odd, docs[30]]
    table = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate(docs_of(docs), table, block=4)
    assert sorted((r.doc_id, r.item_id, r.n_shared, r.n_item) for r in got.collect()) == brute(docs, items, 5, 0.8)
    left = remove_contaminated(docs_of(docs), table)
    hit = {d for d, *_ in brute(docs, items, 5, 0.8)}
    assert sorted(str(r.doc_id) for r in left.collect()) == sorted(str(d) for d, _ in docs if d not in hit)


def test_items_scattered_over_long_documents(spark, docs_of, rng):
    """Items in pieces of some words, hundreds of words apart, are found by the share of their minima; recall is measured."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    items = [(i, " ".join(words(rng, n, letters))) for i, n in enumerate([20, 30, 50, 80, 120, 200, 400] * 6)]
    docs = []
    for i, text in items:
        w, out = text.split(), []
        step = max(len(w) // rng.randint(1, 3), 12)
        for at in range(0, len(w), step):  # pieces overlap by four words, so that no shingle is lost
            out += [*w[max(at - 4, 0) : at + step], *words(rng, rng.randint(200, 900), letters)]
        docs.append((i, " ".join(out)))
    want = brute(docs, items, 5, 0.8)
    got = decontaminate(docs_of(docs), spark.createDataFrame(items, "item_id long, text string"), block_bytes=5000)
    found = {(r.doc_id, r.item_id, r.n_shared, r.n_item) for r in got.collect()}
    assert len(want) == len(items) and found <= set(want) and len(found) >= 0.99 * len(want)


def test_empty_tables(spark, docs_of):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate(docs_of([(1, "a b c d e f")]), none).count() == 0
    assert decontaminate(docs_of([]), spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")).count() == 0
