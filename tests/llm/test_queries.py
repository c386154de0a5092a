"""Queries against their SQL, and the pipeline against its stages by brute force."""

import duckdb
import pytest

import corpus_pipeline
from tabdelta.llm import queries as Q

from .test_jaccard_join import brute as brute_components
from .test_line_dedup import brute as brute_lines

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(Q.ORACLE_SQL))
def test_query_gives_the_rows_of_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(Q.ORACLE_SQL[name]).df()
    got = Q.QUERIES[name](spark, SF).toPandas()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    order = lambda df: sorted(map(tuple, df[columns].astype(object).values.tolist()), key=str)
    assert order(got) == order(want)


def test_operators_are_queries_of_the_driver():
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert {n.split("_")[0] for n in Q.QUERIES} == {f"op{k}" for k in range(1, 14)} and set(Q.QUERIES) | {"pipeline"} <= names


def test_pipeline_matches_brute_force(spark):
    from tokenizers import Tokenizer

    from tabdelta.llm.quality_rules import quality_rules
    from tabdelta.llm.textkit import words_of

    docs = Q.table(spark, SF, "documents")
    rows = {r.doc_id: r for r in docs.collect()}
    kept = {r.doc_id for r in quality_rules(docs).where("kept").collect()}
    lines = brute_lines([(i, rows[i].text, rows[i].source) for i in sorted(kept)], 10)
    lines = [(i, t) for i, t in lines if not (t != rows[i].text and not (t or "").split())]
    low = {i: c for i, _, c, _ in brute_components(lines, 5, 80, 100)}
    left = {i: t for i, t in lines if low[i] == i}
    items = [words_of(r.text) for r in Q.table(spark, SF, "benchmark").collect()]

    def grams(w):
        return {tuple(w[k : k + 5]) for k in range(len(w) - 4)}

    sought = [grams(w) for w in items]
    left = {i: t for i, t in left.items() if not any(s and len(s & grams(words_of(t))) >= 0.8 * len(s) for s in sought)}
    tokenizer = Tokenizer.from_file(Q.tokenizer_path())
    want = {i: len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for i, t in left.items()}
    got = {}
    for r in corpus_pipeline.run(spark, SF).collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
    assert got == want and 0 < len(want) < len(rows)
