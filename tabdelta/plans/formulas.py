"""Queries of spreadsheet aggregates and formula references."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.values import BOOLEAN, EMPTY, NUMBER, STRING, cell
from ..operators import formulas as X
from ..operators.impact import extended_ranges, ranges_before_after
from ..sources.snapshots import as_cells
from .fixtures import BY_PLACE, PLACED_SQL, table


def _sheet(spark, sf):
    return as_cells(table(spark, sf, "lineitem").select("l_quantity", "l_extendedprice", "l_discount", "l_returnflag", "l_linestatus"))


def _mixed(spark, sf):
    """Prices as a column with blanks, texts and booleans among the numbers."""
    k, p = F.col("o_orderkey") % 10, F.col("o_totalprice")
    kind = F.when(k == 0, EMPTY).when(k == 1, STRING).when(k == 2, BOOLEAN).otherwise(NUMBER)
    return table(spark, sf, "orders").select(cell(kind, F.when(k == 2, 1.0).when(k > 2, p), F.when(k == 1, "text")).alias("x"), "o_orderkey")


_r = lambda c: F.round(c, 2)


def q_sum(spark, sf):
    return _mixed(spark, sf).agg(_r(X.sum_of(F.col("x"))).alias("sum"), _r(X.average_of(F.col("x"))).alias("average"))


def q_minmax(spark, sf):
    return _mixed(spark, sf).agg(X.min_of(F.col("x")).alias("min"), X.max_of(F.col("x")).alias("max"))


def q_count_blank(spark, sf):
    return _mixed(spark, sf).agg(X.count_of(F.col("x")).alias("count"), X.counta_of(F.col("x")).alias("counta"), X.countblank_of(F.col("x")).alias("countblank"))


def q_sumif(spark, sf):
    return _sheet(spark, sf).agg(_r(X.sumif(F.col("l_returnflag"), "r", F.col("l_extendedprice"))).alias("by_text"), _r(X.sumif(F.col("l_quantity"), ">=40")).alias("by_number"))


def q_sumifs(spark, sf):
    return _sheet(spark, sf).agg(_r(X.sumifs(F.col("l_extendedprice"), [(F.col("l_returnflag"), "<>N"), (F.col("l_quantity"), "<10"), (F.col("l_linestatus"), "?")])).alias("sum"))


def q_countif(spark, sf):
    return _sheet(spark, sf).agg(X.countif(F.col("l_returnflag"), "A*").alias("wild"), X.countif(F.col("l_quantity"), 5).alias("number"), X.countif(F.col("l_returnflag"), "<>a").alias("other"), X.countif(F.col("l_discount"), "").alias("blank"))


def q_countifs(spark, sf):
    return _sheet(spark, sf).agg(X.countifs([(F.col("l_returnflag"), "R"), (F.col("l_linestatus"), "F"), (F.col("l_discount"), ">0.05")]).alias("n"))


def q_averageif(spark, sf):
    return _sheet(spark, sf).agg(_r(X.averageif(F.col("l_returnflag"), "A", F.col("l_extendedprice"))).alias("average"))


def q_averageifs(spark, sf):
    return _sheet(spark, sf).agg(_r(X.averageifs(F.col("l_extendedprice"), [(F.col("l_returnflag"), "A"), (F.col("l_quantity"), ">25")])).alias("average"))


def q_subtotal(spark, sf):
    x = F.col("x")
    return _mixed(spark, sf).agg(_r(X.subtotal(9, x)).alias("s9"), _r(X.subtotal(101, x)).alias("s1"), X.subtotal(3, x).alias("s3"), X.subtotal(4, x).alias("s4"), X.subtotal(7, x).alias("s7"))


def q_sumproduct(spark, sf):
    return _sheet(spark, sf).agg(_r(X.sumproduct(F.col("l_quantity"), F.col("l_extendedprice"), F.col("l_discount"))).alias("sum"))


def q_round_family(spark, sf):
    v = (F.col("o_totalprice") * F.when(F.col("o_orderkey") % 2 == 0, 1).otherwise(-1)) / 8
    return table(spark, sf, "orders").select("o_orderkey", X.round_half_away(v, 0).alias("half"), X.round_up(v, 0).alias("up"), X.round_down(v, 0).alias("down"))


def q_if_logic(spark, sf):
    x = F.col("x")
    rows = _mixed(spark, sf).select("o_orderkey", "x")
    return rows.groupBy(F.coalesce(X.if_(X.truthy(x), F.lit("yes"), F.lit("no")), F.lit("#VALUE!")).alias("outcome")).agg(F.count("*").alias("n"))


def _formulas(spark, sf):
    row = (F.col("p_partkey") + 2).cast("int")
    n = row.cast("string")
    f = F.when(row % 5 == 0, F.concat(F.lit("SUM(D2:D"), n, F.lit(")"))).when(row % 5 == 1, F.concat(F.lit('IF(A'), n, F.lit('="A1",B$'), n, F.lit("*2,Other!C3)"))).otherwise(F.concat(F.lit("B"), n, F.lit("*$C"), n))
    parts = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.lit("Register").alias("sheet"), f.alias("formula"), (row - 1).alias("r"))
    last = table(spark, sf, "part").agg(F.max("p_partkey")).first()[0] or 0
    rows = parts.sparkSession.range(0, last + 100).select(F.lit("Register").alias("sheet"), F.col("id").cast("int").alias("old_row"))
    # every tenth row is deleted; two rows come in at row 500
    new = F.when(F.col("old_row") % 10 != 9, (F.col("old_row") - F.floor((F.col("old_row") + 0) / 10) + F.when(F.col("old_row") >= 500, 2).otherwise(0)).cast("int"))
    return parts, rows.withColumn("new_row", new)


def q_formula_translate(spark, sf):
    parts, moves = _formulas(spark, sf)
    return X.translate(parts, moves)


def q_formula_equivalent(spark, sf):
    parts, moves = _formulas(spark, sf)
    moved = X.translate(parts, moves).withColumnRenamed("formula", "new")
    new = F.when(F.col("id") % 20 == 0, F.concat("new", F.lit("+1"))).otherwise(F.lower(F.replace("new", F.lit("*"), F.lit(" * "))))
    pairs = parts.withColumnRenamed("formula", "old").join(moved, "id").where("NOT old LIKE 'IF%'").select("id", "sheet", "old", new.alias("new"))
    return X.equivalent(pairs, moves)


def _totals(spark, sf, fixed):
    """A total for each part over the rows of a table up to it; the table has a row for each part."""
    parts = table(spark, sf, "part")
    text = F.concat(F.lit("SUM(Register!$D$2:$D$" if fixed else "SUM(Register!D2:D"), (F.col("p_partkey") + 2).cast("string"), F.lit(")"))
    rows = parts.select(F.col("p_partkey").alias("id"), F.lit("Summary").alias("sheet"), text.alias("formula"))
    tables = parts.agg(F.count("*").cast("int").alias("data_end")).select(F.lit("Register").alias("sheet"), F.lit(1).alias("data_start"), "data_end", F.lit(0).alias("c_first"), F.lit(3).alias("c_last"))
    return rows, tables


def q_chk02(spark, sf):
    return X.short_totals(*_totals(spark, sf, False)).select("id", "sheet", "first_missing", "last_missing")


def q_extend_ranges(spark, sf):
    return extended_ranges(*_totals(spark, sf, True))


def q_impact_ranges(spark, sf):
    """A total for every third order over up to 1,000 rows, before and after a merge that drops an order in 50 and changes another."""
    # hundredths are whole numbers, so sums are the same in any order
    placed = spark.sql(BY_PLACE, orders=table(spark, sf, "orders")).withColumn("p", F.round(F.col("p") * 100))
    n, gone = F.expr("j - (j + 42) DIV 50"), F.expr("j % 50 = 7")
    base = placed.select(F.lit("Register").alias("sheet"), F.col("j").alias("r"), F.lit(2).alias("c"), cell(F.lit(NUMBER), F.col("p")).alias("cell"))
    merged = placed.where(~gone).select(F.lit("Register").alias("sheet"), n.alias("r"), F.lit(2).alias("c"), cell(F.lit(NUMBER), F.expr("CASE WHEN j % 50 = 11 THEN p * 2 ELSE p END")).alias("cell"))
    moves = placed.select(F.lit("Register").alias("sheet"), F.col("j").cast("int").alias("old_row"), F.when(~gone, n).cast("int").alias("new_row"))
    name = F.element_at(F.array(*map(F.lit, ("SUM", "COUNT", "AVERAGE", "MIN", "MAX"))), F.expr("CAST(j DIV 3 % 5 + 1 AS INT)"))
    spans = placed.join(F.broadcast(placed.agg(F.max("j").alias("top"))), F.lit(True)).where("j % 3 = 1")
    text = F.concat(name, F.lit("(Register!C"), F.col("j") + 1, F.lit(":C"), F.least(F.expr("j + j * 7 % 1000"), F.col("top")) + 1, F.lit(")"))
    totals = spans.select(F.col("k").cast("long").alias("id"), F.lit("Summary").alias("sheet"), text.alias("formula"))
    return ranges_before_after(totals, base, merged, moves).drop("changed")


QUERIES = {k: v for k, v in list(globals().items()) if k.startswith("q_")}

_M = "SELECT o_orderkey, o_orderkey % 10 AS k, CASE WHEN o_orderkey % 10 = 2 THEN 1.0::DOUBLE WHEN o_orderkey % 10 > 2 THEN o_totalprice END AS x FROM orders"
_ROWS = "SELECT p_partkey AS id, CAST(p_partkey + 2 AS INT) AS n FROM part"
_NEW = "CASE WHEN ({0}) % 10 <> 9 THEN ({0}) - ({0}) // 10 + CASE WHEN ({0}) >= 500 THEN 2 ELSE 0 END END"
_END = _NEW.format("CASE WHEN (n - 1) % 10 = 9 THEN n - 2 ELSE n - 1 END")
_AT = f"({_NEW.format('n - 1')} + 1)"
_NAME = "CASE a.j // 3 % 5 WHEN 0 THEN 'SUM' WHEN 1 THEN 'COUNT' WHEN 2 THEN 'AVERAGE' WHEN 3 THEN 'MIN' ELSE 'MAX' END"


def _total(x: str) -> str:
    return f"CASE any_value(a.j // 3 % 5) WHEN 0 THEN sum({x}) WHEN 1 THEN count({x}) WHEN 2 THEN sum({x}) / count({x}) WHEN 3 THEN min({x}) ELSE max({x}) END"


ORACLE_SQL = {
    "q_impact_ranges": f"""WITH t AS (SELECT j, k, round(p * 100) AS p FROM {PLACED_SQL}), m AS (SELECT j, k, p, CASE WHEN j % 50 <> 7 THEN CASE WHEN j % 50 = 11 THEN p * 2 ELSE p END END AS q, CASE WHEN j % 50 <> 7 THEN j - (j + 42) // 50 END AS n, max(j) OVER () AS top FROM t)
SELECT a.k AS id, any_value({_NAME} || '(Register!C' || (a.j + 1) || ':C' || (least(a.j + a.j * 7 % 1000, a.top) + 1) || ')') AS before,
CASE WHEN min(b.n) IS NULL THEN any_value({_NAME}) || '(#REF!)' ELSE any_value({_NAME} || '(Register!C') || (min(b.n) + 1) || ':C' || (max(b.n) + 1) || ')' END AS after_formula,
{_total('b.p')} AS before_value, CASE WHEN min(b.n) IS NOT NULL THEN {_total('b.q')} END AS after_value
FROM m AS a JOIN m AS b ON b.j BETWEEN a.j AND least(a.j + a.j * 7 % 1000, a.top) WHERE a.j % 3 = 1 GROUP BY a.k""",
    "q_sum": f"SELECT round(sum(x), 2) AS sum, round(avg(x), 2) AS average FROM ({_M})",
    "q_minmax": f"SELECT min(x) AS min, max(x) AS max FROM ({_M})",
    "q_count_blank": f"SELECT count(x) AS count, count(*) FILTER (k <> 0) AS counta, count(*) FILTER (k = 0) AS countblank FROM ({_M})",
    "q_sumif": "SELECT round(sum(l_extendedprice) FILTER (l_returnflag = 'R'), 2) AS by_text, round(sum(l_quantity) FILTER (l_quantity >= 40), 2) AS by_number FROM lineitem",
    "q_sumifs": "SELECT round(sum(l_extendedprice), 2) AS sum FROM lineitem WHERE l_returnflag <> 'N' AND l_quantity < 10 AND length(l_linestatus) = 1",
    "q_countif": "SELECT count(*) FILTER (l_returnflag LIKE 'A%') AS wild, count(*) FILTER (l_quantity = 5) AS number, count(*) FILTER (l_returnflag <> 'A') AS other, count(*) FILTER (l_discount IS NULL) AS blank FROM lineitem",
    "q_countifs": "SELECT count(*) AS n FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'F' AND l_discount > 0.05",
    "q_averageif": "SELECT round(avg(l_extendedprice), 2) AS average FROM lineitem WHERE l_returnflag = 'A'",
    "q_averageifs": "SELECT round(sum(l_extendedprice) / count(*), 2) AS average FROM lineitem WHERE l_returnflag = 'A' AND l_quantity > 25",
    "q_subtotal": f"SELECT round(sum(x), 2) AS s9, round(avg(x), 2) AS s1, CAST(count(*) FILTER (k <> 0) AS DOUBLE) AS s3, max(x) AS s4, CAST(NULL AS DOUBLE) AS s7 FROM ({_M})",
    "q_sumproduct": "SELECT round(sum(l_quantity * l_extendedprice * l_discount), 2) AS sum FROM lineitem",
    "q_round_family": "WITH t AS (SELECT o_orderkey, (o_totalprice * CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE -1 END) / 8 AS v FROM orders) SELECT o_orderkey, sign(v) * floor(abs(v) + 0.5) AS half, sign(v) * ceil(abs(v)) AS up, sign(v) * floor(abs(v)) AS down FROM t",
    "q_if_logic": f"SELECT CASE WHEN k = 1 THEN '#VALUE!' WHEN k = 0 OR x = 0 THEN 'no' ELSE 'yes' END AS outcome, count(*) AS n FROM ({_M}) GROUP BY 1",
    "q_formula_translate": f"""WITH t AS ({_ROWS}) SELECT id, CASE n % 5 WHEN 0 THEN 'SUM(D2:D' || ({_END} + 1) || ')'
WHEN 1 THEN 'IF(' || coalesce('A' || {_AT}, '#REF!') || '="A1",' || coalesce('B$' || {_AT}, '#REF!') || '*2,Other!C3)' ELSE coalesce('B' || {_AT}, '#REF!') || '*' || coalesce('$C' || {_AT}, '#REF!') END AS formula FROM t""",
    "q_formula_equivalent": f"WITH t AS ({_ROWS}) SELECT id, id % 20 <> 0 AS same FROM t WHERE n % 5 <> 1",
    "q_extend_ranges": "WITH m AS (SELECT count(*) AS n FROM part) SELECT p_partkey AS id, 'D' || (p_partkey + 2) AS range_end, 'D' || (n + 1) AS new_end FROM part, m WHERE p_partkey + 1 < n",
    "q_chk02": "WITH m AS (SELECT count(*) AS n FROM part) SELECT p_partkey AS id, 'Register' AS sheet, CAST(p_partkey + 2 AS INT) AS first_missing, CAST(n AS INT) AS last_missing FROM part, m WHERE p_partkey + 1 < n AND (p_partkey + 1) / n >= 0.5",
}
