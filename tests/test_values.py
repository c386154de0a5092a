"""Value functions against literal cases."""

import pytest
from pyspark.sql import functions as F

from tabdelta.functions import coords
from tabdelta.functions import values as V
from tabdelta.functions.similarity import jaro, jaro_winkler, normalize_header, token_set_ratio
from tabdelta.options import CompareOptions


def table(spark, values, schema="v string"):
    return spark.createDataFrame([(v,) for v in values], schema)


def mapped(spark, values, f, schema="v string"):
    return [r[0] for r in table(spark, values, schema).coalesce(1).select(f(F.col("v"))).collect()]


def test_numeric_text(spark):
    cases = {"1,23,456.78": 123456.78, "1,234": 1234.0, " 12 ": 12.0, "-5.5": -5.5, "+3": 3.0, "012": None, "0.5": 0.5, "1,2": None, "abc": None, "": None, "1e5": None, "12,34,567": 1234567.0}
    assert mapped(spark, cases, V.parse_numeric_text) == list(cases.values())
    assert mapped(spark, ["1e5", "2.5E-1"], lambda c: V.parse_numeric_text(c, exponent=True)) == [100000.0, 0.25]


def test_text_dates(spark):
    cases = {
        "2024-02-29": "2024-02-29", "2023-02-29": None, "29/02/2024": "2024-02-29", "5-Mar-24": "2024-03-05", "Mar 5 1999": "1999-03-05", "5 Sept 70": "1970-09-05", "31-12-69": "2069-12-31",
        "13/13/2020": None, "2024/1/5": "2024-01-05", "5.3.2024": None, "": None, "5-Foo-24": None,
    }
    assert [None if d is None else str(d) for d in mapped(spark, cases, V.parse_text_date)] == list(cases.values())
    assert str(mapped(spark, ["02/29/2024"], lambda c: V.parse_text_date(c, "MDY"))[0]) == "2024-02-29"


def test_number_text(spark):
    cases = {5.0: "5", 0.25: "0.25", 1e21: "1e+21", 123456789.5: "123456789.5", 1e-7: "1e-7", -3.0: "-3", 0.0001: "0.0001", 1e20: "100000000000000000000", float("nan"): "NaN"}
    assert mapped(spark, cases, V.number_text, "v double") == list(cases.values())


def test_serials_round_half_up(spark):
    assert [str(d) for d in mapped(spark, [45000.6, 45000.5, 45000.4, 1.0], V.serial_to_date, "v double")] == ["2023-03-16", "2023-03-16", "2023-03-15", "1899-12-31"]


def test_inr(spark):
    cases = {0.0: "₹0", 1234.5: "₹1,234.5", 123456.78: "₹1,23,456.78", -12345678.0: "-₹1,23,45,678", 999.999: "₹1,000"}
    assert mapped(spark, cases, V.format_inr, "v double") == list(cases.values())


def test_finding_id_is_fnv_over_the_parts(spark):
    def fnv(s):
        h = 0x811C9DC5
        for ch in s:
            h = (h ^ ord(ch)) * 0x01000193 & 0xFFFFFFFF
        return h

    got = mapped(spark, ["INV-1", "é₹"], lambda c: V.finding_id(F.lit("CHK-01"), F.lit("a→a"), c, F.lit(None)))
    assert got == [f"CHK-01-{fnv(f'CHK-01|a→a|{v}|'):08x}" for v in ("INV-1", "é₹")]


def cell(kind, num=None, text=None):
    return (kind, num, text, None)


CASES = [
    (cell(1, 5.0), cell(1, 5.009), "equal"),
    (cell(1, 5.0), cell(1, 5.02), "different"),
    (cell(1, 1.0), cell(3, 1.0), "type_changed"),
    (cell(1, 1234.0), cell(2, text="1,234"), "type_changed"),
    (cell(1, 1234.0), cell(2, text="1,235"), "different"),
    (cell(5, 45292.0), cell(2, text="01-01-2024"), "type_changed"),
    (cell(5, 45292.0), cell(2, text="02-01-2024"), "different"),
    (cell(2, text="2024-01-01"), cell(2, text="1-Jan-24"), "equal"),
    (cell(2, text=" a "), cell(2, text="a"), "equal"),
    (cell(2, text="5"), cell(2, text="5.0"), "different"),
    (cell(4, text="#REF!"), cell(4, text="#REF!"), "equal"),
    (cell(4, text="#REF!"), cell(2, text="#REF!"), "different"),
    (cell(0), cell(0), "equal"),
    (cell(0), cell(1, 0.0), "different"),
    (cell(1, float("nan")), cell(1, float("nan")), "equal"),
]


def test_compare_values_by_precedence(spark):
    kind = "struct<kind:tinyint,num:double,text:string,formula:string>"
    df = spark.createDataFrame([(a, b) for a, b, _ in CASES], f"a {kind}, b {kind}").coalesce(1)
    assert [r[0] for r in df.select(V.compare_values(F.col("a"), F.col("b"))).collect()] == [c for *_, c in CASES]


@pytest.mark.parametrize(("old", "new", "kind"), [("B2*C2", "B2*C2", "recalculated"), ("B2*C2", "B2*C3", "formula_changed"), ("B2", None, "formula_overwritten"), (None, "B2", "formula_added"), (None, None, "value_changed")])
def test_change_kinds_with_formulas(spark, old, new, kind):
    schema = "struct<kind:tinyint,num:double,text:string,formula:string>"
    df = spark.createDataFrame([((1, 1.0, None, old), (1, 2.0, None, new))], f"a {schema}, b {schema}")
    assert df.select(V.change_kind(F.col("a"), F.col("b"))).first()[0] == kind


def test_normalisation_options_and_nfc(spark):
    o = CompareOptions(ignore_case=True, ignore_spaces=True)
    assert mapped(spark, ["  A  b\n"], lambda c: V.normalize_string(c, o)) == ["a b"]
    assert [r.v for r in V.compose(table(spark, ["é", "abc", None]).coalesce(1), "v").orderBy("v").collect()] == [None, "abc", "é"]


def test_coordinates(spark):
    cols = [0, 25, 26, 701, 702, 18277]
    assert mapped(spark, cols, coords.col_to_letter, "v int") == ["A", "Z", "AA", "ZZ", "AAA", "ZZZ"]
    assert mapped(spark, ["A", "z", "AA", "ZZ", "AAA", "ZZZ"], coords.letter_to_col) == cols
    assert [None if r is None else tuple(r) for r in mapped(spark, ["$B$3", "c10", "A0", "Sheet"], coords.a1_to_rc)] == [(2, 1), (9, 2), None, None]


def test_name_similarity():
    assert normalize_header("Rate (₹)") == "rate" and normalize_header("Invoice No.") == "invoice no"
    assert abs(jaro("martha", "marhta") - 0.944444) < 1e-6 and abs(jaro_winkler("dixon", "dicksonx") - 0.813333) < 1e-6
    assert jaro("", "a") == 0 and token_set_ratio("a b", "b a") == 1 and token_set_ratio("", "") == 1
