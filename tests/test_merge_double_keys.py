"""The merged table of orders beyond a million: rows that the copies add have keys of other orders."""

import duckdb
import pytest

from tabdelta.queries import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def orders(tmp_path_factory):
    """Orders 0 to 119 once more from one, two, three and four million on: each row added there meets an order with another priority or the same one."""
    folder = tmp_path_factory.mktemp("orders")
    duckdb.execute(f"""COPY (SELECT k + m * 1000000 AS o_orderkey, k % 7 AS o_custkey, 'O' AS o_orderstatus, CAST(10.5 * k + m AS DOUBLE) AS o_totalprice, DATE '2024-01-01' AS o_orderdate, (1 + (k + m) % 5) || '-High' AS o_orderpriority
    FROM range(0, 120) AS a(k), range(5) AS b(m)) TO '{folder}/orders.parquet' (FORMAT PARQUET)""")
    return str(folder)


@pytest.mark.parametrize("name", ["q_merged_table", "q_impact_totals"])
def test_priorities_are_merged_as_in_the_sql(spark, orders, name):
    """an added row's other priority is an edit, but the merged table's SQL takes over no priorities except those of related edits."""
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{orders}/orders.parquet'")
    found = con.execute(ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    want = [tuple(str(v) for v in r) for r in found.fetchall()]
    got = [tuple(str(v) for v in r) for r in QUERIES[name](spark, orders).select(*names).collect()]
    assert sorted(got) == sorted(want)
