"""Operators on small tables against brute force and literal cases."""

import io
import random
import zipfile

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tabdelta.errors import TabDeltaError
from tabdelta.operators import formulas as X
from tabdelta.operators import merge as M
from tabdelta.operators.columns import Match, match_columns, pair_sheets
from tabdelta.operators.diff import render, snapshot_diff
from tabdelta.operators.impact import self_check
from tabdelta.operators.keys import detect_key
from tabdelta.operators.report import summary
from tabdelta.operators.order import align, common_sequence, pair_in_order
from tabdelta.operators.rows import pair_by_key
from tabdelta.sources import csv as C
from tabdelta.sources import workbook as W
from tabdelta.sources.snapshots import as_cells, number_rows


def lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


@given(st.lists(st.integers(0, 5), max_size=25), st.lists(st.integers(0, 5), max_size=25))
@settings(deadline=None, max_examples=200)
def test_common_sequence_is_longest(a, b):
    got = common_sequence(np.array(a, np.int64), np.array(b, np.int64))
    assert len(got) == lcs(a, b) and all(a[i] == b[j] for i, j in got)
    assert all(x < y and u < v for (x, u), (y, v) in zip(got, got[1:], strict=False))


def rows(values):
    return pd.DataFrame({"r": range(len(values)), "hash": [hash(v) for v in values], "tokens": [list(v) for v in values]})


def test_alignment_states():
    old = [("a", "1"), ("b", "2"), ("c", "3"), ("d", "4"), ("e", "5")]
    new = [("a", "1"), ("c", "3"), ("d", "x"), ("e", "5"), ("b", "2"), ("z", "9")]
    got = {(None if pd.isna(r.old_r) else int(r.old_r), None if pd.isna(r.new_r) else int(r.new_r), r.state) for r in align(rows(old), rows(new)).itertuples()}
    assert got == {(0, 0, "same"), (2, 1, "same"), (4, 3, "same"), (3, 2, "similar"), (1, 4, "moved"), (None, 5, "added")}


def test_parts_with_much_churn_are_multisets(spark):
    old = spark.createDataFrame([("p", k, f"v{k}") for k in range(10)] + [("q", k, f"w{k}") for k in range(10)], "part string, r long, x string")
    new = spark.createDataFrame([("p", k, f"v{k}") for k in range(10)] + [("q", k, f"u{k}") for k in range(9)] + [("q", 9, "w0")], "part string, r long, x string")
    a, b = (as_cells(d).select(F.col("part.text").alias("part"), F.col("r.num").cast("long").alias("r"), "x") for d in (old, new))
    got = {(r.part, r.state, r.multiset): r["n"] for r in pair_in_order(a, b, ["x"], part="part").groupBy("part", "state", "multiset").agg(F.count("*").alias("n")).collect()}
    assert got == {("p", "same", False): 10, ("q", "same", True): 1, ("q", "removed", True): 9, ("q", "added", True): 9}


tables = st.dictionaries(st.integers(1, 30), st.tuples(st.integers(1, 999), st.sampled_from(["x", "y", "z"])), min_size=1, max_size=12)


@given(tables, tables)
@settings(deadline=None, max_examples=8, suppress_health_check=[HealthCheck.function_scoped_fixture])
def test_properties_of_comparison(spark, x, y):
    make = lambda d: spark.createDataFrame([(k, q, s) for k, (q, s) in d.items()], "k long, q long, s string")
    a, b = make(x), make(y)
    assert {r.state for r in snapshot_diff(a, a, ["k"]).row_states.collect()} == {"unchanged"}
    ab = {r.key: r.state for r in snapshot_diff(a, b, ["k"]).row_states.collect()}
    assert {k for k, s in ab.items() if s == "added"} == {str(k) for k in set(y) - set(x)}
    assert {k for k, s in ab.items() if s == "removed"} == {str(k) for k in set(x) - set(y)}
    assert {k for k, s in ab.items() if s == "changed"} == {str(k) for k in set(x) & set(y) if x[k] != y[k]}


def test_empty_keys_and_duplicates_pair_by_occurrence(spark):
    old = spark.createDataFrame([(1, "a"), (1, "a"), (None, "b"), (2, "c")], "k long, v string")
    new = spark.createDataFrame([(1, "a"), (None, "b"), (2, "c"), (2, "c")], "k long, v string")
    got = sorted((r.key, r.state) for r in snapshot_diff(old, new, ["k"]).row_states.collect())
    assert got == [("", "added"), ("", "removed"), ("1", "removed"), ("1", "unchanged"), ("2", "added"), ("2", "unchanged")]


def test_row_numbers_are_gapless(spark):
    values = list(range(500))
    random.Random(1).shuffle(values)
    got = number_rows(spark.createDataFrame([(v,) for v in values], "v long").repartition(7), "v").collect()
    assert all(r.r == r.v for r in got) and len(got) == 500


def test_keys(spark):
    df = spark.createDataFrame([(k, k // 2, f"n{k % 3}", k * 0.5) for k in range(60)], "id long, half long, name string, price double")
    assert detect_key(as_cells(df), as_cells(df), df.columns).columns == ["id"]
    two = spark.createDataFrame([(k // 10, k % 10, "x") for k in range(100)], "a long, b long, c string")
    key = detect_key(as_cells(two), as_cells(two), two.columns)
    assert (key.columns, key.mode, key.confidence) == (["a", "b"], "composite", "medium")
    none = spark.createDataFrame([("x", "y")] * 5, "a string, b string")
    assert detect_key(as_cells(none), as_cells(none), none.columns).mode == "order"
    assert detect_key(as_cells(two), as_cells(two), two.columns, given=["a"]).duplicates == 90


def test_columns_and_sheets():
    got = match_columns(["Qty", "Rate", "Total"], ["qty", "Total", "Rate (INR)"])
    assert [m.status for m in got] == ["matched"] * 3
    kinds = match_columns(["Amount"], ["Amounts"], {"Amount": 1}, {"Amounts": 2})
    assert [m.status for m in kinds] == ["removed", "added"]
    pairs = pair_sheets(["A", "b ", "Old"], ["a", "B", "New"], {("Old", "New"): 0.7})
    assert set(pairs) == {Match("A", "a", "matched"), Match("b ", "B", "matched"), Match("Old", "New", "renamed")}


CRITERIA = [
    ("5", [5.0], True), ("5", ["5"], False), ("<>5", ["x"], True), (">=2", [2.0], True), ("a*", ["Abc"], True), ("a~*", ["a*"], True), ("a~*", ["ab"], False), ("?b", ["xb"], True),
    ("<>a*", ["abc"], False), (">b", ["c"], True), (">b", [5.0], False), ("", [None], True), (None, ["x"], False), (True, [True], True),
]


@pytest.mark.parametrize(("test", "value", "want"), CRITERIA)
def test_criteria(spark, test, value, want):
    v = value[0]
    kind = 0 if v is None else 3 if isinstance(v, bool) else 1 if isinstance(v, float) else 2
    row = [((kind, float(v) if isinstance(v, (bool, float)) else None, v if isinstance(v, str) else None, None),)]
    df = spark.createDataFrame(row, "c struct<kind:tinyint,num:double,text:string,formula:string>")
    assert df.select(X.criteria(test)(F.col("c"))).first()[0] is want


def test_translation(spark):
    moves = spark.createDataFrame([("S", r, None if r in (2, 5) else r + 10) for r in range(8)], "sheet string, old_row int, new_row int")
    cases = {
        "A1+$B$2": "A11+$B$12", "SUM(A2:A6)": "SUM(A12:A15)", "A3*2": "#REF!*2", 'IF(A1="A3",Other!A3,A1)': 'IF(A11="A3",Other!A3,A11)', "SUM(A3:A3)": "SUM(#REF!)",
        "T1.x+LOG10(2)": "T1.x+LOG10(2)", "'S'!A1": "'S'!A11", "A100": "A100", "1+2": "1+2",
    }
    df = spark.createDataFrame([(k, "S", f) for k, f in enumerate(cases)], "id long, sheet string, formula string")
    got = {r.id: r.formula for r in X.translate(df, moves).collect()}
    assert [got[k] for k in range(len(cases))] == list(cases.values())


def test_merge_answers(spark):
    base = spark.createDataFrame([(1, 1.0), (2, 2.0)], "k long, p double")
    a, b = base.withColumn("p", F.col("p") + 1), base.withColumn("p", F.col("p") + 2)
    found = M.conflicts(M.classify(M.three_way(base, a, b, "k"), ["p"]))
    assert sorted(r.id for r in found.collect()) == ["CELL:Sheet1:1:p", "CELL:Sheet1:2:p"]
    answers = lambda rows: spark.createDataFrame(rows, "id string, choice string")
    with pytest.raises(TabDeltaError, match="Resolve 1"):
        M.check_answers(found, answers([("CELL:Sheet1:1:p", "A")]))
    with pytest.raises(TabDeltaError) as e:
        M.check_answers(found, answers([("CELL:Sheet1:1:p", "delete"), ("CELL:Sheet1:2:p", "A")]))
    assert e.value.code == "MERGE_INVALID_RESOLUTION"
    same = M.classify(M.three_way(base, a, base, "k"), ["p"])
    assert {r["class"] for r in same.collect()} == {"edit_a"}


def test_claimed_keys(spark):
    ins = spark.createDataFrame([("s", "1"), ("s", "2"), ("s", "2"), ("s", "3")], "sheet string, key string")
    assert {r.key for r in M.claimed_twice(ins, spark.createDataFrame([("3",)], "key string")).collect()} == {"2", "3"}


def test_summary_is_cut():
    text = summary({"real_changes": 3}, ["x" * 400] * 5)
    assert text.startswith("3 real change(s), 5 need attention.") and len(text) <= 1000 and text.count("- ") == 2


def test_csv(spark, tmp_path):
    assert C.detect_delimiter(['a;"x;y";c', "1;2;3"]) == ";" and C.detect_delimiter(["a,b", "1,2"]) == "," and C.detect_delimiter([]) == ","
    path = tmp_path / "x.csv"
    path.write_bytes('a;b\r\n"x ""q"";\ny";1,5\r\n012;2e3\r\n'.encode("windows-1252") + "é€;3\r\n".encode("windows-1252"))
    got = [tuple(r) for r in C.read_csv(spark, str(path)).collect()]
    assert got == [("a", "b"), ('x "q";\ny', "1,5"), ("012", "2e3"), ("é€", "3")]
    kinds = C.read_csv(spark, str(path)).select(C.csv_cell(F.col("_c1")).alias("c")).select("c.kind", "c.num").collect()
    assert [(r.kind, r.num) for r in kinds] == [(2, None), (2, None), (1, 2000.0), (1, 3.0)]
    C.write_csv(spark.createDataFrame([('a"b', "c,d")], "x string, y string").coalesce(1), str(tmp_path / "out"))
    assert next((tmp_path / "out").glob("*.csv")).read_bytes() == b'x,y\r\n"a""b","c,d"\r\n'


def book(sheet, styles="<x/>"):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("xl/workbook.xml", '<workbook xmlns:r="r"><sheets><sheet name="Reg" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", "<sst><si><t>Name</t></si><si><r><t>a</t></r><r><t>b</t></r></si></sst>")
        z.writestr("xl/styles.xml", styles)
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet><sheetData>{sheet}</sheetData></worksheet>")
    return data.getvalue()


def test_workbook(spark, tmp_path):
    sheet = (
        '<row><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c><c r="C1" s="1"/></row>'
        '<row><c r="A2"><v>2.5</v></c><c r="B2" s="1"><v>45000</v></c><c r="C2" t="b"><v>1</v></c><c r="D2" t="e"><v>#REF!</v></c></row>'
        '<row><c r="A3"><f t="shared" si="0" ref="A3:A4">A2*$B$2</f></c><c r="B3" t="inlineStr"><is><t>hi</t></is></c></row><row><c r="A4"><f t="shared" si="0"/><v>7</v></c></row>'
    )
    (tmp_path / "b.xlsx").write_bytes(book(sheet, '<styleSheet><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>'))
    got = {(r.r, r.c): (r.kind, r.num, r.text, r.formula) for r in W.read_workbooks(spark, str(tmp_path / "b.xlsx")).collect()}
    assert got == {
        (0, 0): (2, None, "Name", None), (0, 1): (2, None, "ab", None), (1, 0): (1, 2.5, None, None), (1, 1): (5, 45000.0, None, None), (1, 2): (3, 1.0, None, None), (1, 3): (4, None, "#REF!", None),
        (2, 0): (0, None, None, "A2*$B$2"), (2, 1): (2, None, "hi", None), (3, 0): (1, 7.0, None, "A3*$B$2"),
    }
    with pytest.raises(TabDeltaError, match="opened"):
        W.open_archive(b"no zip")
    assert W.is_date_format("dd/mm/yyyy") and not W.is_date_format('0.00"d"') and not W.is_date_format("[Red]0")


def test_sniffing(spark):
    rows = spark.createDataFrame([(bytearray(b"PK\x03\x04x"),), (bytearray(bytes.fromhex("D0CF11E0A1B11AE1") + "EncryptedPackage".encode("utf-16-le")),), (bytearray(b"a,b"),), (bytearray(b"\xe9"),)], "b binary").coalesce(1)
    got = [tuple(r) for r in rows.select(C.sniff_format(F.col("b")), C.is_encrypted(F.col("b")), C.encoding_of(F.col("b"))).collect()]
    assert [g[:2] for g in got] == [("zip", False), ("cfb", True), ("text", False), ("text", False)] and [g[2] for g in got[2:]] == ["UTF-8", "windows-1252"]


def test_reversed_rows_pair_wherever_they_stand(spark):
    """All but one of fifty reversed rows lie outside the common sequence, so order is left aside."""
    rows = [("p", i, f"t{i}") for i in range(50)]
    old = spark.createDataFrame(rows, "part string, r long, x string")
    new = spark.createDataFrame([(p, 49 - i, x) for p, i, x in rows], "part string, r long, x string")
    got = pair_in_order(old, new, ["x"], part="part").collect()
    assert len(got) == 50 and all(r.state == "same" and r.multiset and r.old_r == 49 - r.new_r for r in got)


def test_running_last_over_ranges_and_parts(spark):
    from tabdelta.sources.snapshots import running_last

    rows = [(p, i, i if i % 7 == 3 else None) for p in "ab" for i in range(200)]
    df = spark.createDataFrame(rows, "p string, o int, v int").repartition(5)

    def want(keep):
        last, out = None, []
        for r in keep:
            out.append((*r, last))
            last = r[2] if r[2] is not None else last
        return out

    got = sorted(tuple(r) for r in running_last(df, ["o"], F.col("v"), "before", "p").collect())
    assert got == sorted(want(rows[:200]) + want(rows[200:]))
    one = sorted((tuple(r) for r in running_last(df, ["p", "o"], F.col("v"), "before").collect()), key=lambda r: r[:2])
    assert one == want(rows)


def test_rows_of_a_hot_key_and_without_a_key(spark):
    old = spark.createDataFrame([(1, i) for i in range(300)] + [(None, i) for i in range(50)] + [(2, 0)], "k int, v int")
    new = spark.createDataFrame([(1, i) for i in range(280)] + [(None, i) for i in range(40)] + [(3, 0)], "k int, v int")
    pairs = pair_by_key(old, new, ["k"], ["k"], order=F.col("v")).collect()
    both = [r for r in pairs if r.old and r.new]
    assert len(both) == 280 and all(r.old.v == r.new.v for r in both)
    assert sum(r.new is None for r in pairs) == 20 + 50 + 1 and sum(r.old is None for r in pairs) == 40 + 1


def test_comparison_of_sheets_and_workbooks(spark):
    from tabdelta.operators import compare as C

    schema = "r long, c int, cell struct<kind:tinyint,num:double,text:string,formula:string>"

    def sheet(rows):
        out = []
        for r, values in rows:
            for c, v in enumerate(values):
                if v is not None:
                    out.append((r, c, (2, None, v, None) if isinstance(v, str) else (1, float(v), None, None)))
        return spark.createDataFrame(out, schema)

    body = [(f"INV-{i:04d}", f"Customer {i % 3}", 100 + i) for i in range(12)]
    old = sheet([(0, ["Sales"]), (2, ["Invoice No", "Customer", "Amount"]), *[(3 + i, x) for i, x in enumerate(body)], (15, ["Total", None, 5])])
    changed = [(a, b, 999 if a == "INV-0004" else v) for a, b, v in body if a != "INV-0007"] + [("INV-0100", "Customer 1", 7)]
    new = sheet([(0, ["Sales"]), (1, ["note"]), (4, ["Invoice No.", "Custmer", "Amount"]), *[(5 + i, x) for i, x in enumerate(changed)], (17, ["Total", None, 5])])
    found = C.compare_sheets(old, new, name="Sales")
    assert (found.old_table.header_row, found.new_table.header_row, found.key.columns) == (2, 4, ["Invoice No."])
    assert [m.status for m in found.columns] == ["matched", "matched", "renamed"]
    states = {r.key: r.state for r in found.diff.row_states.collect()}
    assert states["INV-0004"] == "changed" and states["INV-0007"] == "removed" and states["INV-0100"] == "added" and list(states.values()).count("unchanged") == 10
    assert {(r.rule, r.key) for r in found.findings.collect()} == {("CELL_EDIT", "INV-0004"), ("ROW_REMOVED", "INV-0007"), ("ROW_ADDED", "INV-0100"), ("CHK-09", None)}
    moves = {r.old_row: r.new_row for r in C.row_map(found, 17).collect()}
    assert moves[0] == 2 and moves[3] == 5 and moves[10] is None and moves[11] == 12 and moves[15] == 17 and C.column_map(found, 5) == {0: 0, 1: 1, 2: 2, 3: 3, 4: 4}
    assert found.counts().first().real_changes == 3
    found.close()
    pairs = C.pair_workbooks({"Sales": old, "Extra": old}, {"Sales ": new, "Added": sheet([(0, ["x", "y"]), (1, [1, 2])])})
    assert {(m.old, m.new, m.status) for m in pairs} == {("Sales", "Sales ", "matched"), ("Extra", None, "removed"), (None, "Added", "added")}


def test_comparison_without_a_key_or_a_header(spark):
    from tabdelta.operators import compare as C

    old = spark.createDataFrame([("a", 1), ("b", 2), ("b", 2), ("c", 3), ("c", 3), ("d", 4)], "x string, y int").coalesce(1)
    new = spark.createDataFrame([("a", 1), ("b", 2), ("b", 2), ("c", 3), ("c", 9), ("d", 4), ("d", 4)], "x string, y int").coalesce(1)
    found = C.compare_tables(old, new)
    assert found.key.mode == "order" and found.matched_by.first().matched_by == "order"
    assert sorted(r.state for r in found.diff.row_states.collect()) == ["added", "changed", *["unchanged"] * 5]
    found.close()
    bare = spark.createDataFrame([(5 + r, c, (1, float(r * c), None, None)) for r in range(4) for c in range(2)], "r long, c int, cell struct<kind:tinyint,num:double,text:string,formula:string>")
    assert C.detect_table(bare) == C.Table(4, 5, 8, {0: "Column A", 1: "Column B"})


def test_merge_of_a_key_twice_in_both_copies(spark):
    base = spark.createDataFrame([(1, 1.0, "x"), (2, 2.0, "y")], "k long, p double, r string")
    a = base.unionAll(spark.createDataFrame([(1, 5.0, "x")], base.schema))
    b = base.unionAll(spark.createDataFrame([(1, 6.0, "z")], base.schema))
    rows = M.classify(M.three_way(base, a, b, "k"), ["p", "r"])
    answers = M.conflicts(rows).select("id", F.lit("A").alias("choice"), F.lit(None).cast("string").alias("typed"), F.col("key").alias("a_key"), F.col("key").alias("b_key"))
    changes = M.change_set(rows, answers)
    merged = M.merged_table(base, a, b, "k", changes, rows)
    assert sorted(tuple(r) for r in merged.collect()) == [(1, 1.0, "x"), (1, 5.0, "x"), (1, 5.0, "z"), (1, 6.0, "z"), (2, 2.0, "y")]
    assert self_check(base, merged, "k", changes, rows).first().asDict() == {"expected_rows": 5, "rows": 5, "missing_inserts": 0, "rows_not_deleted": 0, "edits_not_made": 0}
    assert M.merge_log(rows, answers).count() == changes["cell_edits"].count() == 5


def test_rows_of_a_key_meet_each_with_each(spark):
    old = spark.createDataFrame([(1, 1.0), (2, 2.0)], "k long, p double")
    new = spark.createDataFrame([(1, 1.0), (1, 7.0), (3, 3.0), (None, 4.0)], old.schema)
    diff = snapshot_diff(old, new, ["k"], each=True)
    assert sorted(tuple(r) for r in diff.row_states.collect()) == [("", "added"), ("1", "changed"), ("1", "unchanged"), ("2", "removed"), ("3", "added")]
    assert [(r.key, r.old, r.new) for r in render(diff.cell_changes).collect()] == [("1", "1", "7")]
    by_turn = snapshot_diff(old, new, ["k"]).row_states
    assert sorted(r.state for r in by_turn.where("key = '1'").collect()) == ["added", "unchanged"]


def test_composite_key_of_a_table_against_itself_reads_little(spark, monkeypatch):
    from tabdelta.operators import keys as K

    rows = spark.range(600).selectExpr("id div 30 AS a", "id % 30 AS b", "id % 3 AS c", "id % 7 AS d")
    cells = as_cells(rows)
    seen = []
    monkeypatch.setattr(K, "uniqueness", lambda x, combos, o, plain=K.uniqueness: seen.append(combos) or plain(x, combos, o))
    monkeypatch.setattr(K, "duplicates", lambda *_: pytest.fail("counted again"))
    key = detect_key(cells, cells, cells.columns)
    # of 600 rows, 20 * 3 or 7 * 30 values can't tell all apart, and three columns aren't needed
    assert seen == [[["b", "a"]]] and (sorted(key.columns), key.mode, key.duplicates) == (["a", "b"], "composite", 0)
    twice = as_cells(rows.unionAll(rows.limit(3)))
    assert detect_key(cells, twice, cells.columns).duplicates == 3
