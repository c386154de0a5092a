"""Queries on orders beyond a million: rows that the fixture adds have keys of other orders."""

import duckdb
import pytest

from tabdelta.queries import ORACLE_SQL, QUERIES

NAMES = [
    "q_cell_changes_ignore_case",  # F8
    "q_cell_findings",  # F9
    "q_change_counts",  # F10
    "q_findings_ranked",  # F11
    "q_report_all_changes",  # F12
    "q_report_marked",  # F13
    "q_row_findings",  # F14
    "q_row_status",  # F15
]


@pytest.fixture(scope="module")
def orders(tmp_path_factory):
    """Orders 1 to 200 and 1,000,001 to 1,000,200: each row added meets an order that stays."""
    folder = tmp_path_factory.mktemp("orders")
    duckdb.execute(f"""COPY (SELECT k + m * 1000000 AS o_orderkey, k % 7 AS o_custkey, 'O' AS o_orderstatus, CAST(10.5 * k + m AS DOUBLE) AS o_totalprice, DATE '2024-01-01' + CAST(k % 90 AS INT) AS o_orderdate, (1 + k % 5) || '-High' AS o_orderpriority
    FROM range(1, 201) AS a(k), range(2) AS b(m)) TO '{folder}/orders.parquet' (FORMAT PARQUET)""")
    return str(folder)


@pytest.mark.parametrize("name", NAMES)
def test_rows_of_a_key_meet_each_with_each(spark, orders, name):
    got = QUERIES[name](spark, orders)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{orders}/orders.parquet'")
    found = con.execute(ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    want = [tuple(None if v is None else str(v) for v in r) for r in found.fetchall()]
    assert sorted(want, key=str) == sorted([tuple(None if v is None else str(v) for v in r) for r in got.select(*names).collect()], key=str)
