"""Queries on values: texts, numbers, dates, tokens, addresses and flags."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import coords
from ..functions import values as V
from ..options import CompareOptions
from .fixtures import ORDERS_NEW_SQL, orders_pair, table

_TEXTS = "CASE o_orderkey % 7 WHEN 0 THEN '1,234.50' WHEN 1 THEN concat('0', CAST(o_custkey AS STRING)) WHEN 2 THEN concat('-', CAST(o_custkey AS STRING), '.25') WHEN 3 THEN 'n/a' WHEN 4 THEN concat(' ', CAST(o_custkey AS STRING), ' ') WHEN 5 THEN '12,34,567' ELSE concat(CAST(o_custkey AS STRING), 'e3') END"


def q_normalize_string(spark, sf):
    o = CompareOptions(ignore_case=True, ignore_spaces=True)
    _, new = orders_pair(spark, sf)
    return new.select("o_orderkey", V.normalize_string(F.col("o_orderpriority"), o).alias("text"))


def q_parse_numeric_text(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", F.expr(_TEXTS).alias("text"))
    return rows.select("o_orderkey", V.parse_numeric_text(F.col("text")).alias("number"), V.parse_numeric_text(F.col("text"), exponent=True).alias("csv_number"))


def q_parse_text_date(spark, sf):
    d = F.col("o_orderdate").cast("date")
    k = F.col("o_orderkey") % 6
    text = F.when(k == 0, F.date_format(d, "yyyy-MM-dd")).when(k == 1, F.date_format(d, "dd/MM/yyyy")).when(k == 2, F.date_format(d, "d-MMM-yyyy")).when(k == 3, F.date_format(d, "MMM d yyyy")).when(k == 4, F.date_format(d, "dd-MM-yy")).otherwise("31/02/2020")
    return table(spark, sf, "orders").select("o_orderkey", V.parse_text_date(text).alias("day"))


def q_serial_roundtrip(spark, sf):
    d = F.col("o_orderdate").cast("date")
    serial = V.date_to_serial(d)
    return table(spark, sf, "orders").select("o_orderkey", serial.alias("serial"), V.serial_to_date(serial + 0.4).alias("day"), V.serial_to_date(serial + 0.5).alias("next_day"))


def q_cell_token(spark, sf):
    part = table(spark, sf, "part")
    kinds = {f.name: f.dataType for f in part.schema.fields}
    token = lambda c: V.cell_token(V.typed_cell(F.col(c), kinds[c])).alias(c)
    return part.select("p_partkey", token("p_name"), token("p_size"), token("p_retailprice"))


def q_number_text(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", V.number_text(F.col("o_totalprice")).alias("price"), V.number_text(F.floor("o_totalprice").cast("double")).alias("whole"))


def q_col_letters(spark, sf):
    c = (F.col("p_partkey") * 37 % 18_278).cast("int")
    row = (F.col("p_partkey") % 1000).cast("int")
    a1 = coords.rc_to_a1(row, c)
    back = coords.a1_to_rc(a1)
    return table(spark, sf, "part").select("p_partkey", a1.alias("a1"), back["r"].alias("r"), back["c"].alias("c"))


def q_format_inr(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", V.format_inr(F.col("o_totalprice") * F.when(F.col("o_orderkey") % 3 == 0, 1000).otherwise(-1)).alias("text"))


def q_gstin_pan_valid(spark, sf):
    base = F.concat(F.lit("24AAAAA"), F.lpad((F.col("o_custkey") % 10000).cast("string"), 4, "0"), F.lit("A1Z"))
    gstin = F.concat(base, F.when(F.col("o_orderkey") % 5 == 0, "*").otherwise("5"))
    pan = F.concat(F.lit("ABCDE"), F.lpad((F.col("o_custkey") % 10000).cast("string"), 4, "0"), F.when(F.col("o_orderkey") % 7 == 0, "1").otherwise("f"))
    return table(spark, sf, "orders").select("o_orderkey", V.gstin_valid(gstin).alias("gstin_valid"), V.pan_valid(pan).alias("pan_valid"))


def _number(x):
    return V.cell(V.NUMBER, x)


def q_large_change_flag(spark, sf):
    p = F.col("o_totalprice")
    new = p * F.when(F.col("o_orderkey") % 4 == 0, 2).when(F.col("o_orderkey") % 4 == 1, -1).when(F.col("o_orderkey") % 4 == 2, 1.25).otherwise(0.25)
    return table(spark, sf, "orders").select("o_orderkey", V.large_change(_number(p), _number(new)).alias("large"))


def q_number_as_text(spark, sf):
    text = F.expr(_TEXTS)
    return table(spark, sf, "orders").select("o_orderkey", V.number_as_text(V.cell(V.STRING, None, text), True).alias("flag"))


def q_compare_values(spark, sf):
    """Equality of a price, its text and a boolean by the rules on kinds."""
    p, k = F.col("o_totalprice"), F.col("o_orderkey") % 5
    none = F.lit(None)
    kind = F.when(k == 0, V.NUMBER).when(k == 1, V.STRING).when(k == 2, V.BOOLEAN).when(k == 3, V.EMPTY).otherwise(V.STRING)
    new = V.cell(kind, F.when(k == 0, p + 0.005).when(k == 2, F.lit(1.0)), F.when(k == 1, F.concat(F.lit(" "), V.number_text(p))).when(k == 4, "x").otherwise(none))
    return table(spark, sf, "orders").select("o_orderkey", V.compare_values(_number(p), new).alias("equality"))


QUERIES = {k: v for k, v in list(globals().items()) if k.startswith("q_")}

_PLAIN = r"^[+-]?([0-9]{1,3}(,[0-9]{2,3})*(\.[0-9]+)?|[0-9]+(\.[0-9]+)?)$"
_T = _TEXTS.replace("STRING", "VARCHAR")
_GROUP = "CASE WHEN length(w) <= 3 THEN w WHEN length(w) <= 5 THEN left(w, length(w) - 3) || ',' || right(w, 3) WHEN length(w) <= 7 THEN left(w, length(w) - 5) || ',' || substr(w, length(w) - 4, 2) || ',' || right(w, 3) ELSE left(w, length(w) - 7) || ',' || substr(w, length(w) - 6, 2) || ',' || substr(w, length(w) - 4, 2) || ',' || right(w, 3) END"
_LETTER = "CASE WHEN c < 26 THEN chr(65 + c) WHEN c < 702 THEN chr(65 + c // 26 - 1) || chr(65 + c % 26) ELSE chr(65 + (c - 702) // 676) || chr(65 + ((c - 702) % 676) // 26) || chr(65 + c % 26) END"
ORACLE_SQL = {
    "q_normalize_string": rf"SELECT o_orderkey, lower(trim(regexp_replace(o_orderpriority, '\s+', ' ', 'g'))) AS text FROM {ORDERS_NEW_SQL} AS n",
    "q_parse_numeric_text": rf"""WITH t AS (SELECT o_orderkey, trim({_T}) AS s FROM orders)
SELECT o_orderkey, CASE WHEN regexp_matches(s, '{_PLAIN}') AND NOT regexp_matches(s, '^[+-]?0[0-9]') THEN TRY_CAST(replace(s, ',', '') AS DOUBLE) END AS number,
CASE WHEN regexp_matches(s, '{_PLAIN.replace(')$', ')([eE][+-]?[0-9]+)?$')}') AND NOT regexp_matches(s, '^[+-]?0[0-9]') THEN TRY_CAST(replace(s, ',', '') AS DOUBLE) END AS csv_number FROM t""",
    "q_parse_text_date": "SELECT o_orderkey, CASE WHEN o_orderkey % 6 < 5 THEN CAST(o_orderdate AS DATE) END AS day FROM orders",
    "q_serial_roundtrip": "SELECT o_orderkey, CAST(date_diff('day', DATE '1899-12-30', CAST(o_orderdate AS DATE)) AS DOUBLE) AS serial, CAST(o_orderdate AS DATE) AS day, CAST(CAST(o_orderdate AS DATE) + INTERVAL 1 DAY AS DATE) AS next_day FROM orders",
    "q_cell_token": "SELECT p_partkey, 's:' || trim(p_name) AS p_name, 'n:' || CAST(CAST(floor(CAST(p_size AS DOUBLE) / 0.01 + 0.5) AS BIGINT) AS VARCHAR) AS p_size, 'n:' || CAST(CAST(floor(p_retailprice / 0.01 + 0.5) AS BIGINT) AS VARCHAR) AS p_retailprice FROM part",
    "q_number_text": "SELECT o_orderkey, CASE WHEN o_totalprice = trunc(o_totalprice) THEN CAST(CAST(o_totalprice AS BIGINT) AS VARCHAR) ELSE CAST(o_totalprice AS VARCHAR) END AS price, CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) AS whole FROM orders",
    "q_col_letters": f"WITH t AS (SELECT p_partkey, CAST(p_partkey * 37 % 18278 AS INT) AS c, CAST(p_partkey % 1000 AS INT) AS r FROM part) SELECT p_partkey, {_LETTER} || CAST(r + 1 AS VARCHAR) AS a1, r, c FROM t",
    "q_format_inr": f"""WITH t AS (SELECT o_orderkey, o_orderkey % 3 <> 0 AS neg, CAST(round(o_totalprice * CASE WHEN o_orderkey % 3 = 0 THEN 1000 ELSE 1 END * 100) AS BIGINT) AS cents FROM orders),
u AS (SELECT *, CAST(cents // 100 AS VARCHAR) AS w, cents % 100 AS f FROM t)
SELECT o_orderkey, CASE WHEN neg AND cents <> 0 THEN '-' ELSE '' END || '₹' || {_GROUP} || CASE WHEN f = 0 THEN '' WHEN f % 10 = 0 THEN '.' || CAST(f // 10 AS VARCHAR) ELSE '.' || lpad(CAST(f AS VARCHAR), 2, '0') END AS text FROM u""",
    "q_gstin_pan_valid": "SELECT o_orderkey, o_orderkey % 5 <> 0 AS gstin_valid, o_orderkey % 7 <> 0 AS pan_valid FROM orders",
    "q_large_change_flag": "SELECT o_orderkey, o_orderkey % 4 <> 2 AS large FROM orders",
    "q_number_as_text": "SELECT o_orderkey, (o_orderkey % 7 IN (0, 2, 4, 5)) AS flag FROM orders",
    "q_compare_values": "SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'equal' WHEN 1 THEN 'type_changed' ELSE 'different' END AS equality FROM orders",
}
