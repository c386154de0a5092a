"""The filter audit against counts made by hand."""

from itertools import permutations

from tabdelta.llm import filter_audit as A

LABELS = "doc_id long, quality int, toxic int"


def fails(text):
    words = (text or "").encode().split()
    out = ""
    if len(words) < 200:
        out += "A"
    if 100 * len(set(words)) < 50 * len(words):
        out += "B"
    if 100 * sum("A" <= c <= "Z" for c in text or "") > 2 * len(text or ""):
        out += "C"
    if any(c in "#$%&*|" for c in text or ""):
        out += "D"
    return out


def brute(rows, labels):
    good, toxic = {i for i, q, _ in labels if q == 1}, {i for i, _, t in labels if t == 1}
    docs = []
    for i, text, part in rows:
        copy = i is not None and any(j is not None and j < i and (t or "") == (text or "") for j, t, _ in rows)
        docs.append((part or "", fails(text) + "E" * copy, i in good and i is not None, i in toxic and i is not None))
    out = {}
    for part in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == part]
        total = dict.fromkeys("ABCDE", 0)
        for order in map("".join, permutations("ABCDE")):
            left = own
            for step, f in enumerate(order, 1):
                gone = [d for d in left if f in d[1]]
                left = [d for d in left if f not in d[1]]
                total[f] += len(gone)
                failing = [d for d in own if f in d[1]]
                out[part, order, step] = [len(left), len(gone), len(failing) - len(gone), sum(d[1] == f for d in failing), sum(d[2] for d in gone), sum(d[3] for d in gone)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(total[order[step - 1]])
    return out


def result(df):
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    rows = df.collect()
    out = {(r["part"], r["filter_order"], r["step"]): [r[n] for n in names] for r in rows}
    assert len(out) == len(rows)
    return out


def make(spark, rows, labels, partitions=3):
    docs = spark.createDataFrame([(i, t, p, 1, "x") for i, t, p in rows], "doc_id long, text string, source string, fails int, part string")
    return docs.repartition(partitions), spark.createDataFrame(labels, LABELS)


def test_counts_match_plain_python(spark, rng):
    pieces = ["word ", "Word ", "a b c d ", "$5 ", "Ä ", "\n", "x" * 40 + " "]
    rows = []
    for i in range(150):
        n = rng.choice([3, 150, 260])
        text = "".join(rng.choice(pieces) if rng.random() < 0.5 else f"w{rng.randint(0, 400)} " for _ in range(n))
        rows.append((i, text, rng.choice(["s0", "s1", None, "only here" if i == 7 else "s0"])))
    rows += [(1000 + k, rows[k % 9][1], "s1") for k in range(30)] + [(2000, None, "s2"), (2001, "", "s2"), (None, None, "s2"), (2001, "", "s2")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in [*range(0, 150, 2), *range(1000, 1010), 5, 5, None]]
    docs, known = make(spark, rows, labels)
    assert result(A.audit(docs, known)) == brute(rows, labels)


def test_blocks_give_the_same_counts(spark, monkeypatch):
    rows = [(i, "A b" if i % 3 else "#", f"s{i % 5}") for i in range(200)]
    docs, known = make(spark, rows, [(i, i % 2, i % 7 == 0) for i in range(0)] or [(1, 1, 1)], 2)
    want = brute(rows, [(1, 1, 1)])
    monkeypatch.setattr(A, "BLOCK", 16)
    assert result(A.audit(docs, known)) == want


def test_no_documents_and_no_labels(spark):
    docs, known = make(spark, [], [])
    assert A.audit(docs, known).collect() == []
    docs, known = make(spark, [(1, "one", "s")], [])
    assert len(result(A.audit(docs, known))) == 600
