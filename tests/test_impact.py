"""Totals of ranges against plain sums, and rows left in blocks of a row map."""

import random

from tabdelta.operators import formulas as X
from tabdelta.operators.impact import range_totals, ranges_before_after

CELLS = "sheet string, r long, c int, cell struct<kind:tinyint,num:double,text:string,formula:string>"
FORMULAS = "id long, sheet string, formula string"


def plain(name, xs):
    if name == "COUNT":
        return float(len(xs))
    if name == "AVERAGE":
        return sum(xs) / len(xs) if xs else None
    return float({"SUM": sum, "MIN": min, "MAX": max}[name](xs)) if xs else 0.0


def test_ranges_of_all_lengths(spark):
    rng = random.Random(7)
    values = {(r, c): float(rng.randrange(-500, 500)) for r in range(0, 70_000) for c in (1, 2) if rng.random() < 0.2}
    cells = spark.createDataFrame([("S", r, c, (1, x, None, None)) for (r, c), x in values.items()], CELLS)
    spans = [(0, 0), (15, 16), (16, 31), (0, 69_999), (1, 65_535), (65_536, 69_998), (69_999, 1_048_575), (200_000, 200_001)]
    spans += [tuple(sorted(rng.randrange(70_000) for _ in range(2))) for _ in range(40)]
    names = ("SUM", "COUNT", "AVERAGE", "MIN", "MAX")
    asked = [(k, names[k % 5], a, b, 2 if k % 3 else 1) for k, (a, b) in enumerate(spans)]
    formulas = spark.createDataFrame([(k, "S", f"{n}(B{a + 1}:{'BC'[c - 1]}{b + 1})") for k, n, a, b, c in asked], FORMULAS)
    got = {r["id"]: r["value"] for r in range_totals(formulas, cells).collect()}
    for k, n, a, b, c in asked:
        want = plain(n, [x for (r, at), x in values.items() if a <= r <= b and at <= c])
        assert (got[k] is None) if want is None else abs(got[k] - want) < 1e-6, (n, a, b, c)


def test_texts_blanks_other_formulas_and_lost_references(spark):
    rows = [(0, (1, 4.0, None, None)), (1, (2, None, "x", None)), (2, (0, None, None, None)), (3, (3, 1.0, None, None))]
    cells = spark.createDataFrame([("S", r, 0, x) for r, x in rows], CELLS)
    texts = ["SUM(A1:A4)", "AVERAGE(A2:A3)", "min(A2:A3)", "SUM(A1)", "SUM(#REF!)", "SUM(A1:A2)+1", "SUM(Other!A1:A4)", None]
    formulas = spark.createDataFrame([(k, "S", t) for k, t in enumerate(texts)], FORMULAS)
    got = {r["id"]: r["value"] for r in range_totals(formulas, cells).collect()}
    assert got == {0: 4.0, 1: None, 2: 0.0, 3: 4.0, 4: None, 6: 0.0}
    moves = spark.createDataFrame([("S", 0, None), ("S", 1, 0), ("S", 2, 1), ("S", 3, 2)], "sheet string, old_row int, new_row int")
    after = spark.createDataFrame([("S", 0, 0, (1, 9.0, None, None))], CELLS)
    found = {r["id"]: (r["after_formula"], r["before_value"], r["after_value"], r["changed"]) for r in ranges_before_after(formulas, cells, after, moves).collect()}
    assert found[0] == ("SUM(A1:A3)", 4.0, 9.0, True)
    assert found[3] == ("SUM(#REF!)", 4.0, None, True)
    assert range_totals(formulas, cells.limit(0)).where("value <> 0").count() == 0


def test_rows_left_are_found_beyond_their_block(spark):
    n = 3 * X._BLOCK
    new = {k: (k if k < 100 else k - n + 200) for k in range(n) if k < 100 or k >= n - 50}
    rows = spark.createDataFrame([("S", k, new.get(k)) for k in range(n)] + [("T", 0, None)], "sheet string, old_row int, new_row int")
    got = {(r["sheet"], r["old_row"]): (r["following"], r["preceding"]) for r in X.survivors(rows).collect()}
    assert got["T", 0] == (None, None) and len(got) == n + 1
    assert got["S", 50] == (50, 50)
    assert {got["S", k] for k in (100, X._BLOCK, 2 * X._BLOCK, n - 51)} == {(150, 99)}
