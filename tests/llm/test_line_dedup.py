from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tabdelta.llm import line_dedup
from tabdelta.llm.line_dedup import remove_spread_lines, without_spread_lines


def brute(rows, least):
    sites, first = defaultdict(set), {}
    for i, text, site in rows:
        if i is None or text is None:
            continue
        for pos, line in enumerate(text.split("\n")):
            if line.strip(" \t\x0b\f\r"):
                key = line.strip(" \t\x0b\f\r")
                sites[key].add(site)
                first[key] = min(first.get(key, (i, pos)), (i, pos))
    out = []
    for i, text, site in rows:
        if i is None or text is None:
            out.append((i, text))
            continue
        left = []
        for pos, line in enumerate(text.split("\n")):
            key = line.strip(" \t\x0b\f\r")
            if not key or len(sites[key]) < least or first[key] == (i, pos):
                left.append(line)
        out.append((i, "\n".join(left)))
    return out


@pytest.fixture(params=["sparse", "crowded"])
def crowd(request, monkeypatch):
    """Bitmaps as they are, and so small that very many other lines and ids meet their bits."""
    if request.param == "crowded":
        for name, value in (("BITS", 64), ("_ROW_BITS", 16), ("ID_GROUPS", 3)):
            monkeypatch.setattr(line_dedup, name, value)


@pytest.mark.parametrize("least", [3, 10])
def test_matches_brute_force(spark, rng, least, crowd):
    common = [f"common line {k}" for k in range(12)]
    rows = []
    for i in range(300):
        lines = [f"own {i} {rng.random()}"] + [("  " if rng.random() < 0.3 else "") + c for k, c in enumerate(common) if rng.random() < 0.5 and i % 15 <= k] + [""]
        rng.shuffle(lines)
        rows.append((i, "\n".join(lines), f"s{i % 15}" if i % 17 else None))
    rows += [(400, None, "s1"), (401, "", "s1"), (402, "\n \n", None), (403, common[11], ""), (404, "é—ü", "s1"), (None, common[0], "s2"), rows[5]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = remove_spread_lines(docs, least=least)
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted(brute(rows, least), key=str)


def test_far_from_the_threshold_the_sketch_decides(spark):
    rows = [(i, "spread\nnarrow" if i % 50 < 3 else "spread", f"site{i % 50}") for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    left = {r.doc_id: r.text for r in remove_spread_lines(docs, least=10).collect()}
    assert left[0] == "spread\nnarrow" and left[50] == "narrow" and left[3] == ""


def test_stage_keeps_columns_counts_text_and_drops_what_it_emptied(spark):
    rows = [(i, "all the same", f"s{i}", 12) for i in range(12)] + [(50, "all the same\nand more", "s1", 21), (51, None, "s1", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    got = {r.doc_id: (r.text, r.n_chars) for r in without_spread_lines(docs).collect()}
    assert got == {0: ("all the same", 12), 50: ("and more", 8), 51: (None, None)}


def test_clashing_columns_and_repeated_ids(spark, crowd):
    rows = [(f"d{i}", f"é same line\nown {i}" if i else "é same line", f"s{i}", i) for i in range(12)] + [("d3", "é same line", "s3", 99)]
    docs = spark.createDataFrame(rows, "key string, text string, source string, _gone int").withColumn("doc", F.lit(1)).withColumn("_doc", F.lit(2)).withColumn("pos", F.lit(3))
    got = remove_spread_lines(docs, id_col="key")
    assert got.columns == [*docs.columns, "n_lines", "n_removed"]
    assert sorted((r.key, r._gone, r.text, r.n_removed) for r in got.collect()) == sorted((k, n, "é same line" if k == "d0" else t.removeprefix("é same line").lstrip("\n"), int(k != "d0")) for k, t, _, n in rows)


def test_empty_table_and_clashing_columns(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, source string, n_lines int")
    got = remove_spread_lines(empty)
    assert got.count() == 0 and got.columns == ["doc_id", "text", "source", "n_lines", "n_removed"]


def test_lines_near_the_threshold_in_very_many_documents(spark):
    rows = [(i, f"on nine\non ten\nown {i}", f"s{i % 9}") for i in range(900)] + [(1000, "on ten", "s9")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    got = {r.doc_id: r.text for r in remove_spread_lines(docs, least=10).collect()}
    assert got[0] == "on nine\non ten\nown 0" and got[1000] == "" and all(got[i] == f"on nine\nown {i}" for i in range(1, 900))
