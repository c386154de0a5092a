"""Formulas followed along the rows of a comparison."""

import pytest
from pyspark.sql import functions as F

from tabdelta.operators.compare import compare_sheets, compare_workbooks

CELLS = "r long, c int, cell struct<kind:tinyint,num:double,text:string,formula:string>"


def register(spark, names, edits=(), over=(), other=(), top=0):
    rows = [(top, c, (2, None, t, None)) for c, t in enumerate(("Name", "Price", "Twice"))]
    for k, n in enumerate(names):
        r = top + 1 + k
        price = float(10 * (int(n[1:]) + 1)) + (5 if n in edits else 0)
        twice = (1, 1.0, None, None) if n in over else (1, 2 * price, None, f"B{r + 1}*{3 if n in other else 2}")
        rows += [(r, 0, (2, None, n, None)), (r, 1, (1, price, None, None)), (r, 2, twice)]
    return spark.createDataFrame(rows, CELLS)


def summary(spark, rows):
    cells = [(0, 0, (2, None, "What", None)), (0, 1, (2, None, "Amount", None))]
    for k, (name, value, formula) in enumerate(rows, 1):
        cells += [(k, 0, (2, None, name, None)), (k, 1, (1, value, None, formula))]
    return spark.createDataFrame(cells, CELLS)


@pytest.fixture
def names():
    return [f"n{k}" for k in range(8)]


def test_a_row_on_top_changes_no_formula(spark, names):
    found = compare_sheets(register(spark, names), register(spark, ["n99", *names]))
    counts = found.counts().first()
    found.close()
    assert (counts["formulas_changed"], counts["real_changes"], counts["rows_added"], counts["recalculated"]) == (0, 1, 1, 0)


def test_edits_beside_moved_formulas_in_two_sheets(spark, names):
    old = {"Register": register(spark, names), "Summary": summary(spark, [("first", 20.0, "Register!C2"), ("third", 60.0, "Register!C4"), ("all", 720.0, "SUM(Register!C2:C9)")])}
    left = ["n98", "n99", *[n for n in names if n != "n4"]]
    new = {
        "Register": register(spark, left, edits=["n1"], over=["n2"], other=["n3"]),
        "Summary": summary(spark, [("first", 20.0, "Register!C4"), ("third", 61.0, "Register!C6"), ("all", 9.0, "SUM(Register!C4:C9)")]),
    }
    _, found = compare_workbooks(old, new)
    kinds = {(c.name, r["key"], r["column"]): r["kind"] for c in found for r in c.diff.cell_changes.collect()}
    rules = {(r["rule"], r["key"]) for c in found for r in c.findings.collect()}
    for c in found:
        c.close()
    assert kinds == {
        ("Register", "n1", "Price"): "value_changed", ("Register", "n1", "Twice"): "recalculated",
        ("Register", "n2", "Twice"): "formula_overwritten", ("Register", "n3", "Twice"): "formula_changed",
        ("Summary", "third", "Amount"): "recalculated", ("Summary", "all", "Amount"): "formula_changed",
    }
    assert ("CHK-01", "n2") in rules and ("RECALCULATED", None) in rules


def test_a_formula_that_keeps_its_text_while_its_row_moves_is_changed(spark, names):
    old = register(spark, names)
    new = register(spark, ["n99", *names])
    # n3 was in row 5 and named B5; now it is in row 6 and names B5 still
    stale = F.when((F.col("r") == 5) & (F.col("c") == 2), F.col("cell").withField("formula", F.lit("b5*2"))).otherwise(F.col("cell"))
    found = compare_sheets(old, new.withColumn("cell", stale))
    changes = [(r["key"], r["kind"]) for r in found.diff.cell_changes.collect()]
    found.close()
    assert changes == [("n3", "formula_changed")]
