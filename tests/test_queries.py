"""Every query gives the rows of its SQL."""

import duckdb
import pytest

from tabdelta.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF)
    rows = got.collect()
    if name not in ORACLE_SQL:
        assert rows
        return
    found = duck.execute(ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(got.columns) == sorted(names)

    def plain(v):
        return None if v is None or v != v else str(v).removesuffix(" 00:00:00")

    def ordered(table, columns):
        at = [columns.index(c) for c in sorted(columns)]
        return sorted([tuple(plain(r[k]) for k in at) for r in table], key=str)

    assert ordered(rows, got.columns) == ordered(found.fetchall(), names)
