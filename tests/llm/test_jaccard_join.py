import numpy as np
import pytest

from tabdelta.llm import jaccard_join as J
from tabdelta.llm.textkit import shingle_set

from .conftest import words


def plain(text, width):
    w = (text or "").encode().lower().split()
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + width]) for i in range(max(len(w) - width + 1, 1)))


def brute(rows, width, num, den):
    rows = [(i, plain(t, width)) for i, t in rows if i is not None]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            x, y = rows[a][1], rows[b][1]
            if x and y and den * len(x & y) >= num * len(x | y):
                up[find(a)] = find(b)
    low, links = {}, [0] * len(rows)
    for k, (i, s) in enumerate(rows):
        low[find(k)] = min(low.get(find(k), i), i)
        links[k] = sum(bool(s and y) and den * len(s & y) >= num * len(s | y) for _, y in rows) - bool(s)
    return sorted((i, len(s), low[find(k)] if s else i, links[k]) for k, (i, s) in enumerate(rows))


def found(table):
    return sorted((r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in table.collect())


def near(rng, base, edits):
    w = list(base)
    for _ in range(edits):
        w[rng.randrange(len(w))] = "".join(words(rng, 1)) + "x"
    return w


def corpus(rng):
    rows, i = [], 0
    for n in (1, 3, 5, 20, 45, 62, 66, 90, 130, 255, 260, 600, 2500):
        base = words(rng, n)
        for edits in (0, 0, 1, 1, 2, max(n // 60, 1), max(n // 40, 1), n // 20, n // 10):
            rows.append((i, " ".join(near(rng, base, edits))))
            i += 1
    chain = words(rng, 300)  # each links with the next one only
    for _ in range(8):
        rows.append((i, " ".join(chain)))
        chain = near(rng, chain, 6)
        i += 1
    passage = " ".join(words(rng, 40))
    for _ in range(60):
        rows.append((i, " ".join(words(rng, rng.randint(5, 60))) + " " + passage))
        i += 1
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("width", "num", "den"), [(4, 85, 100), (5, 80, 100), (3, 60, 100)])
def test_matches_brute_force(docs_of, rng, odd, width, num, den):
    rows = [*corpus(rng), *odd]
    rows += [rows[3], (7000, rows[9][1].upper())]
    got = J.jaccard_components(docs_of(rows), width=width, num=num, den=den)
    assert found(got) == brute(rows, width, num, den)


def test_large_groups_in_chunks(docs_of, rng, monkeypatch):
    monkeypatch.setattr(J, "CHUNK", 16)
    monkeypatch.setattr(J, "_SHORT", 8)
    monkeypatch.setattr(J, "BLOCK", 40)
    base = words(rng, 150)
    rows = [(i, " ".join(near(rng, base, 1 + i % 4))) for i in range(150)] + [(500 + i, " ".join(base)) for i in range(100)]
    got = J.jaccard_components(docs_of(rows))
    assert found(got) == brute(rows, 4, 85, 100)


def test_hub_of_copies_that_are_not_alike(docs_of, rng):
    base = words(rng, 200)
    rows = [(900, " ".join(base))] + [(i, " ".join(near(rng, base, 5))) for i in range(120)]
    got = J.jaccard_components(docs_of(rows))
    assert found(got) == brute(rows, 4, 85, 100)


def test_cells_in_pieces_keep_all_pairs(spark, monkeypatch):
    """A cell cut by ranges and into chunks goes on under one name; small ones are named by their members."""
    r = np.random.default_rng(6)
    rows = [(7, int(c)) for c in range(900)] + [(int(k), int(c)) for k, c in zip(r.integers(100, 400, 800), r.integers(0, 300, 800), strict=True)]
    rows += [(k, 5000 + k % 3) for k in range(1000, 1040)] + [(1, 1), (2000, 2000)]
    keyed = spark.createDataFrame(rows + rows[:50], "key long, cls long")
    got = J._shared_cells(keyed.repartitionByRange(7, "key", "cls").sortWithinPartitions("key", "cls")).distinct().collect()
    cells, chunks = {}, {}
    for x in got:
        cells.setdefault(x.cell, set()).add(x.cls)
        chunks.setdefault((x.cell, x.chunk), set()).add(x.cls)
    want = {}
    for key, cls in rows:
        want.setdefault(key, set()).add(cls)
    shared = {frozenset(v) for v in want.values() if len(v) > 1}
    assert shared <= {frozenset(v) for v in cells.values()} and {frozenset(v) for v in cells.values() if len(v) > 1} <= shared
    assert cells[7] == set(range(900)) and max(map(len, chunks.values())) <= J.CHUNK


def test_similar_sets_always_share_a_cell():
    r = np.random.default_rng(3)
    for num, den in ((85, 100), (80, 100), (9, 10), (1, 2)):
        sim = J.Similarity(num, den)
        for _ in range(400):
            n = int(r.integers(1, 900))
            a = np.unique(r.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2))
            spare = sim.differ(n)
            lost = int(r.integers(0, spare + 1))
            b = np.unique(np.concatenate([r.permutation(a)[lost:], r.integers(0, 1 << 63, max(spare - lost, 0)).astype(np.uint64)]))
            both = len(np.intersect1d(a, b))
            if len(b) and not np.array_equal(a, b) and den * both >= num * (len(a) + len(b) - both):
                assert np.intersect1d(J.cell_keys(a, sim), J.cell_keys(b, sim)).size, (num, n, lost)


def test_tree_finds_all_that_the_bound_allows():
    r = np.random.default_rng(4)
    sim = J.Similarity(85, 100)
    base = r.poisson(3, (40, 128))
    points = (np.repeat(base, 10, axis=0) + r.poisson(0.1, (400, 128))).astype(np.uint16)
    sizes = points.sum(axis=1, dtype=np.int64)
    found = {(int(a), int(b)) for q, x, _ in J.RTree(points, sizes).search(points, sizes, sim) for a, b in zip(q, x, strict=True)}
    bound = np.minimum(points[:, None], points[None]).sum(axis=2)
    want = bound >= sim.overlap(sizes[:, None] + sizes[None])
    assert found == set(zip(*map(np.ndarray.tolist, np.nonzero(want)), strict=True)) and 400 < len(found) < 160_000


def test_folded_points_are_points_of_fewer_groups():
    r = np.random.default_rng(5)
    sets = [np.unique(r.integers(0, 1 << 63, n).astype(np.uint64)) for n in (40, 100, 1000)]
    got = J.folded([J.point(s) for s in sets], np.array([len(s) for s in sets]))
    want = [np.bincount((s & np.uint64(63)).astype(np.int64), minlength=64) for s in sets]
    assert (got == np.array(want)).all()


def test_one_of_each(docs_of, rng):
    base = words(rng, 100)
    rows = [(5, " ".join(base)), (3, " ".join(near(rng, base, 1))), (9, " ".join(words(rng, 100))), (10, None), (11, None), (None, " ".join(base))]
    docs = docs_of(rows)
    got = J.one_of_each(docs)
    assert got.columns == docs.columns
    assert sorted(str(r.doc_id) for r in got.collect()) == ["10", "11", "3", "9", "None"]


def test_empty_table_and_no_pairs(docs_of):
    assert J.jaccard_components(docs_of([])).count() == 0
    assert [tuple(r) for r in J.jaccard_components(docs_of([(4, "a b c d e")])).collect()] == [(4, 2, 4, 0)]
    assert len(shingle_set("a b c d e", 4)) == 2


def test_sets_are_shuffled_only_where_rows_repeat_or_pairs_ask(spark):
    texts = spark.createDataFrame([(i, " ".join(f"w{i}x{k}" for k in range(20))) for i in range(6)], "id long, text string")
    known = J._features(texts, 4, J.Similarity(85, 100)).select("cls", "id").collect()
    wanted = [(r["cls"], r["id"]) for r in known]

    def sets(rows: int, of):
        return J._sets(of, spark.createDataFrame([(c, i, rows) for c, i in wanted], "cls long, id long, rows long"), 4)

    once = sets(1, texts)
    assert "Aggregate" not in once._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(r["cls"] for r in once.collect()) == sorted(c for c, _ in wanted)
    assert sorted(r["cls"] for r in sets(2, texts.unionAll(texts)).collect()) == sorted(c for c, _ in wanted)
    (a, _), (b, _) = wanted[:2]
    found = J._verified(spark.createDataFrame([(a, b)], "a long, b long"), once, J.Similarity(85, 100))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("LeftSemi") == 2
    assert [tuple(r) for r in found.collect()] == [(a, b, False)]
