"""Pairs and triples of tables derived from the test tables by SQL that both engines run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: New version of the orders: edits by o_orderkey % 50, rows dropped and added.
ORDERS_NEW = """
SELECT o_orderkey, o_custkey, o_orderstatus,
  CASE o_orderkey % 50 WHEN 11 THEN o_totalprice * 2 WHEN 13 THEN o_totalprice + 1.0 WHEN 17 THEN o_totalprice + 0.004 WHEN 19 THEN -o_totalprice ELSE o_totalprice END AS o_totalprice,
  o_orderdate,
  CASE o_orderkey % 50 WHEN 23 THEN concat('X-', o_orderpriority) WHEN 29 THEN lower(o_orderpriority) WHEN 31 THEN concat('  ', o_orderpriority, ' ') ELSE o_orderpriority END AS o_orderpriority
FROM {orders} WHERE o_orderkey % 50 <> 7
UNION ALL SELECT o_orderkey + 1000000, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM {orders} WHERE o_orderkey % 50 = 43
"""

#: Base and two copies for merges: key k, price p, priority r, status s.
BASE = "SELECT o_orderkey AS k, o_totalprice AS p, o_orderpriority AS r, o_orderstatus AS s FROM {orders}"
COPY_A = """
SELECT k, CASE k % 60 WHEN 1 THEN p + 10 WHEN 3 THEN p + 30 WHEN 4 THEN p + 40 WHEN 5 THEN p + 50 WHEN 9 THEN p + 90 ELSE p END AS p,
  CASE k % 60 WHEN 6 THEN concat('A-', r) ELSE r END AS r, s FROM {base} WHERE k % 60 NOT IN (7, 8, 10)
UNION ALL SELECT k + CASE k % 60 WHEN 11 THEN 1000000 WHEN 13 THEN 3000000 ELSE 4000000 END, p, r, s FROM {base} WHERE k % 60 IN (11, 13, 14)
"""
COPY_B = """
SELECT k, CASE k % 60 WHEN 2 THEN p + 20 WHEN 3 THEN p + 30 WHEN 4 THEN p + 41 WHEN 6 THEN p + 60 WHEN 8 THEN p + 80 ELSE p END AS p,
  CASE k % 60 WHEN 5 THEN concat('B-', r) ELSE r END AS r, s FROM {base} WHERE k % 60 NOT IN (9, 10)
UNION ALL SELECT k + CASE k % 60 WHEN 12 THEN 2000000 WHEN 13 THEN 3000000 ELSE 4000000 END, CASE k % 60 WHEN 14 THEN p + 1 ELSE p END, r, s FROM {base} WHERE k % 60 IN (12, 13, 14)
"""

#: A sheet: a title, a header in row 3, data with a total within, two blank rows and a note.
GRID = """
SELECT 0 AS r, 0 AS c, 2 AS kind, CAST(NULL AS DOUBLE) AS num, 'Register of parts' AS text
UNION ALL SELECT 3, c, 2, NULL, text FROM (VALUES (0, 'Part'), (1, 'Brand'), (2, 'Size'), (3, 'Price')) AS h(c, text)
UNION ALL SELECT CAST(4 + p_partkey - lo AS INT), c, CASE WHEN c < 2 THEN 2 ELSE 1 END, CASE c WHEN 2 THEN CAST(p_size AS DOUBLE) WHEN 3 THEN p_retailprice WHEN 4 THEN 1.0 END, CASE c WHEN 0 THEN p_name WHEN 1 THEN p_brand END
  FROM {part} CROSS JOIN (SELECT min(p_partkey) AS lo FROM {part}) AS m CROSS JOIN (VALUES (0), (1), (2), (3), (4)) AS x(c) WHERE p_partkey - lo <> 50
UNION ALL SELECT 54, 0, 2, NULL, 'Sub total'
UNION ALL SELECT 54, 3, 1, 12.5, NULL
UNION ALL SELECT CAST(10 + max(p_partkey) - min(p_partkey) AS INT), 0, 2, NULL, 'A note after two blank rows' FROM {part}
UNION ALL SELECT CAST(11 + max(p_partkey) - min(p_partkey) AS INT), 0, 2, NULL, 'Grand Total of nothing' FROM {part}
"""


#: Order registers as sheets: a title, a header, a row an order and a total; the new one lies lower, renames a column and has notes that name removed orders.
REGISTER_OLD = """
SELECT CAST(0 AS BIGINT) AS r, 0 AS c, 2 AS kind, CAST(NULL AS DOUBLE) AS num, 'Register of orders' AS text
UNION ALL SELECT 2, c, 2, NULL, text FROM (VALUES (0, 'Order No'), (1, 'Customer'), (2, 'Price'), (3, 'Priority')) AS h(c, text)
UNION ALL SELECT 3 + o_orderkey - lo, c, CASE WHEN c = 3 THEN 2 ELSE 1 END, CASE c WHEN 0 THEN CAST(o_orderkey AS DOUBLE) WHEN 1 THEN CAST(o_custkey AS DOUBLE) WHEN 2 THEN o_totalprice END, CASE c WHEN 3 THEN o_orderpriority END
  FROM {orders} CROSS JOIN (SELECT min(o_orderkey) AS lo FROM {orders}) AS m CROSS JOIN (VALUES (0), (1), (2), (3)) AS x(c)
UNION ALL SELECT 4 + max(o_orderkey) - min(o_orderkey), 0, 2, NULL, 'Total' FROM {orders}
UNION ALL SELECT 4 + max(o_orderkey) - min(o_orderkey), 2, 1, sum(o_totalprice), NULL FROM {orders}
"""
REGISTER_NEW = """
SELECT CAST(0 AS BIGINT) AS r, 0 AS c, 2 AS kind, CAST(NULL AS DOUBLE) AS num, 'Register of orders' AS text
UNION ALL SELECT 1, 0, 2, NULL, 'second version'
UNION ALL SELECT 4, c, 2, NULL, text FROM (VALUES (0, 'Order No.'), (1, 'Customer'), (2, 'Price'), (3, 'Priorty'), (4, 'Note')) AS h(c, text)
UNION ALL SELECT * FROM (SELECT CASE WHEN o_orderkey >= 1000000 THEN 6 + hi - lo + (o_orderkey - 1000000 - lo) DIV 50 ELSE 5 + o_orderkey - lo END AS r, c, CASE WHEN c >= 3 THEN 2 ELSE 1 END AS kind, CASE c WHEN 0 THEN CAST(o_orderkey AS DOUBLE) WHEN 1 THEN CAST(o_custkey AS DOUBLE) WHEN 2 THEN o_totalprice END AS num,
  CASE c WHEN 3 THEN o_orderpriority WHEN 4 THEN CASE WHEN o_orderkey % 100 = 8 THEN CAST(o_orderkey - 1 AS STRING) ELSE 'none' END END AS text
  FROM ({new}) AS n CROSS JOIN (SELECT min(o_orderkey) AS lo, max(o_orderkey) AS hi FROM {orders}) AS m CROSS JOIN (VALUES (0), (1), (2), (3), (4)) AS x(c)) AS d
UNION ALL SELECT 8 + max(o_orderkey) - min(o_orderkey) + (max(o_orderkey) - min(o_orderkey)) DIV 50, 0, 2, NULL, 'Grand total' FROM {orders}
"""

#: The same orders with a formula in each row, and a summary that names rows of the register; j counts orders from 0.
#: In the new register every order of j % 50 = 7 is gone and the rows below move up; 11: other price, 17: typed over, 23: other formula.
BY_PLACE = "SELECT o_orderkey AS k, o_orderkey - lo AS j, o_totalprice AS p FROM {orders} CROSS JOIN (SELECT min(o_orderkey) AS lo FROM {orders}) AS m"
#: All orders in the order of their keys, without a key; in the new version those of j % 50 = 7 are gone, 17 have another price, and the first five stand last.
IN_ORDER_OLD = "SELECT j AS r, k, p, o_custkey AS c, o_orderdate AS d FROM {placed} JOIN {orders} ON k = o_orderkey"
IN_ORDER_NEW = """
SELECT CASE WHEN j < 5 THEN last - 4 + j ELSE n - 5 END AS r, k, CASE WHEN j % 50 = 17 THEN p + 1000 ELSE p END AS p, o_custkey AS c, o_orderdate AS d
  FROM (SELECT k, p, j, j - (j + 42) DIV 50 AS n FROM {placed} WHERE j % 50 <> 7) AS x JOIN {orders} ON k = o_orderkey
  CROSS JOIN (SELECT max(j) - (max(j) + 42) DIV 50 AS last FROM {placed}) AS y
"""
FORMULAS_OLD = """
SELECT CAST(2 AS BIGINT) AS r, c, 2 AS kind, CAST(NULL AS DOUBLE) AS num, text, CAST(NULL AS STRING) AS formula FROM (VALUES (0, 'Order No'), (1, 'Price'), (2, 'Twice')) AS h(c, text)
UNION ALL SELECT 3 + j, c, 1, CASE c WHEN 0 THEN CAST(k AS DOUBLE) WHEN 1 THEN p ELSE 2 * p END, NULL, CASE c WHEN 2 THEN concat('B', 4 + j, '*2') END
  FROM {placed} CROSS JOIN (VALUES (0), (1), (2)) AS x(c)
"""
FORMULAS_NEW = """
SELECT CAST(0 AS BIGINT) AS r, 0 AS c, 2 AS kind, CAST(NULL AS DOUBLE) AS num, 'second version' AS text, CAST(NULL AS STRING) AS formula
UNION ALL SELECT 4, c, 2, NULL, text, NULL FROM (VALUES (0, 'Order No'), (1, 'Price'), (2, 'Twice')) AS h(c, text)
UNION ALL SELECT 5 + n, c, 1, CASE c WHEN 0 THEN CAST(k AS DOUBLE) WHEN 1 THEN p ELSE CASE WHEN j % 50 = 17 THEN 1.0 WHEN j % 50 = 23 THEN 3 * p ELSE 2 * p END END, NULL,
  CASE WHEN c = 2 AND j % 50 = 23 THEN concat('B', 6 + n, '*3') WHEN c = 2 AND j % 50 <> 17 THEN concat('b', 6 + n, ' * 2') END
  FROM (SELECT k, j, j - (j + 42) DIV 50 AS n, CASE WHEN j % 50 = 11 THEN p + 1000 ELSE p END AS p FROM {placed} WHERE j % 50 <> 7) AS d CROSS JOIN (VALUES (0), (1), (2)) AS x(c)
"""
SUMMARY_OLD = """
SELECT CAST(0 AS BIGINT) AS r, c, 2 AS kind, CAST(NULL AS DOUBLE) AS num, text, CAST(NULL AS STRING) AS formula FROM (VALUES (0, 'What'), (1, 'Amount')) AS h(c, text)
UNION ALL SELECT 1 + j DIV 5, c, CASE c WHEN 0 THEN 2 ELSE 1 END, CASE c WHEN 1 THEN p END, CASE c WHEN 0 THEN concat('price of ', k) END, CASE c WHEN 1 THEN concat('Register!$B$', 4 + j) END
  FROM {placed} CROSS JOIN (VALUES (0), (1)) AS x(c) WHERE j % 5 = 1
"""
SUMMARY_NEW = """
SELECT CAST(0 AS BIGINT) AS r, c, 2 AS kind, CAST(NULL AS DOUBLE) AS num, text, CAST(NULL AS STRING) AS formula FROM (VALUES (0, 'What'), (1, 'Amount')) AS h(c, text)
UNION ALL SELECT 1 + j DIV 5, c, CASE c WHEN 0 THEN 2 ELSE 1 END, CASE c WHEN 1 THEN CASE WHEN j % 50 = 11 THEN p + 1000 ELSE p END END, CASE c WHEN 0 THEN concat('price of ', k) END,
  CASE c WHEN 1 THEN concat('Register!$B$', 6 + j - (j + 42) DIV 50 + CASE WHEN j % 50 = 31 THEN 1 ELSE 0 END) END
  FROM {placed} CROSS JOIN (VALUES (0), (1)) AS x(c) WHERE j % 5 = 1
"""


def orders_pair(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    orders = table(spark, sf_dir, "orders")
    return orders, spark.sql(ORDERS_NEW, orders=orders)


def merge_triple(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    base = spark.sql(BASE, orders=table(spark, sf_dir, "orders"))
    return base, spark.sql(COPY_A, base=base), spark.sql(COPY_B, base=base)


_CELL = "struct(CAST(kind AS TINYINT) AS kind, num, text, CAST(NULL AS STRING) AS formula) AS cell"


def registers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Both registers as long cells."""
    orders = table(spark, sf_dir, "orders")
    old, new = spark.sql(REGISTER_OLD, orders=orders), spark.sql(REGISTER_NEW, orders=orders, new=spark.sql(ORDERS_NEW, orders=orders))
    return tuple(x.selectExpr("CAST(r AS BIGINT) AS r", "c", _CELL) for x in (old, new))


def workbooks(spark: SparkSession, sf_dir: str) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    """Two workbooks of a register with formulas and a summary of it, as long cells."""
    placed = spark.sql(BY_PLACE, orders=table(spark, sf_dir, "orders"))

    def sheet(text: str) -> DataFrame:
        return spark.sql(text, placed=placed).selectExpr("CAST(r AS BIGINT) AS r", "c", "struct(CAST(kind AS TINYINT) AS kind, num, text, formula) AS cell")

    return {"Register": sheet(FORMULAS_OLD), "Summary": sheet(SUMMARY_OLD)}, {"Register": sheet(FORMULAS_NEW), "Summary": sheet(SUMMARY_NEW)}


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.sql(GRID, part=table(spark, sf_dir, "part"))
    return rows.selectExpr("CAST(r AS BIGINT) AS r", "c", "struct(CAST(kind AS TINYINT) AS kind, num, text, CAST(NULL AS STRING) AS formula) AS cell")


def sql(text: str, **names: str) -> str:
    """A fixture's SQL over tables or subqueries of these names."""
    return text.format(**names)


ORDERS_NEW_SQL = f"({sql(ORDERS_NEW, orders='orders')})"
BASE_SQL = f"({sql(BASE, orders='orders')})"
PLACED_SQL = f"({sql(BY_PLACE, orders='orders')})"
A_SQL = f"({sql(COPY_A, base=BASE_SQL + ' AS base')})"
B_SQL = f"({sql(COPY_B, base=BASE_SQL + ' AS base')})"
GRID_SQL = f"({sql(GRID, part='part')})"


def text_of(x: str) -> str:
    """SQL of the shortest text of a number."""
    return f"CASE WHEN {x} = trunc({x}) THEN CAST(CAST({x} AS BIGINT) AS VARCHAR) ELSE CAST({x} AS VARCHAR) END"
