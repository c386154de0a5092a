"""CSV files read in blocks by many tasks."""

import csv
import random

import pytest
from pyspark.sql import functions as F

from tabdelta.sources.csv import numeric_columns, read_csv, read_csv_table, split_fields


@pytest.fixture
def blocks(spark):
    """Files are cut into blocks of some hundred bytes."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {k: spark.conf.get(k) for k in names}
    spark.conf.set(names[0], "300")
    spark.conf.set(names[1], "0")
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def read(spark, path, **o):
    """Records in their order, without empty fields at the end."""
    rows = read_csv(spark, str(path), place=True, **o).orderBy("_place").drop("_place").collect()
    return [[x or "" for x in r] for r in rows]


def padded(rows):
    width = max(map(len, rows), default=0)
    return [[*r, *[""] * (width - len(r))] for r in rows]


def test_a_plain_file(spark, tmp_path, blocks):
    rows = [["k", "a", "b"], *[[str(k), f"text {k}", "007" if k % 2 else ""] for k in range(400)]]
    (tmp_path / "x.csv").write_text("".join(",".join(r) + "\r\n" for r in rows))
    assert read_csv(spark, str(tmp_path / "x.csv")).rdd.getNumPartitions() > 4
    assert read(spark, tmp_path / "x.csv") == rows


@pytest.mark.parametrize("seed", range(6))
def test_newlines_and_quotes_across_blocks(spark, tmp_path, blocks, seed):
    rng = random.Random(seed)
    pieces = ["a", "b c", ",", '"', "\n", "\n\n", ";", "\u00e9", "\u4e2d", "0" * 40, ""]
    rows = [["".join(rng.choices(pieces, k=rng.randrange(5))) for _ in range(rng.randrange(2, 5))] for _ in range(300)]
    rows[150][0] = "long\n" * 400
    with open(tmp_path / "x.csv", "w", newline="", encoding="utf-8") as f:
        csv.writer(f, lineterminator=rng.choice(["\n", "\r\n"]), quoting=rng.choice([csv.QUOTE_MINIMAL, csv.QUOTE_ALL])).writerows(rows)
    assert read(spark, tmp_path / "x.csv", delimiter=",") == padded(rows)


def test_odd_files(spark, tmp_path, blocks):
    cases = {
        "blank": ("a,b\n\n1,2\n", [["a", "b"], ["", ""], ["1", "2"]]),
        "open": ('a,b\n1,"x\ny,2\n', [["a", "b"], ["1", "x\ny,2"]]),
        "inch": ('a,b\n5"x"y,2\n3,4', [["a", "b"], ["5xy", "2"], ["3", "4"]]),
        "ragged": ("a\n1,2,3\n", [["a", "", ""], ["1", "2", "3"]]),
        "cr": ("a,b\r1,2\r", [["a", "b"], ["1", "2"]]),
        "bom": ("\ufeffa,b\n1,2\n", [["a", "b"], ["1", "2"]]),
    }
    for name, (text, want) in cases.items():
        (tmp_path / name).write_bytes(text.encode())
        assert read(spark, tmp_path / name, delimiter=",") == want, name
    (tmp_path / "empty").write_bytes(b"")
    assert read_csv(spark, str(tmp_path / "empty")).count() == 0


def test_encodings_by_file(spark, tmp_path, blocks):
    """A byte that UTF-8 doesn't have, in one block of many, tells the encoding of all of its file."""
    text = "".join(f"{k};caf\u00e9 \u20ac\n" for k in range(200))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "w.csv").write_bytes(text.encode("cp1252"))
    (tmp_path / "in" / "u.csv").write_bytes(text.encode())
    got = read_csv(spark, str(tmp_path / "in"), delimiter=";")
    assert {(r._c1, r["count"]) for r in got.groupBy("_c1").count().collect()} == {("caf\u00e9 \u20ac", 400)}


def test_fields(spark):
    cases = {'""': [""], '"",x': ["", "x"], '""""': ['"'], '"a""b","c,d"': ['a"b', "c,d"], '"a""': ['a"'], '"a""b': ['a"b'], ",": ["", ""], 'x"y,z"w': ["xy,zw"], '"a" ,b': ["a ", "b"]}
    rows = spark.createDataFrame([(k,) for k in cases], "r string").select("r", split_fields(F.col("r"), ",").alias("f")).collect()
    assert {r.r: r.f for r in rows} == {k: [*v, ""] for k, v in cases.items()}


def test_columns_of_numbers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("k,code,price,none,k\n1,007,1.5,,2\n2,8,-2,,3\n")
    (tmp_path / "b.csv").write_text("k,code,price\n1,7,x\n")
    a, b = (read_csv_table(spark, str(tmp_path / f"{n}.csv")) for n in "ab")
    assert a.columns == ["k", "code", "price", "none", "k (2)"]
    assert numeric_columns([a]) == {"k": "bigint", "price": "double", "k (2)": "bigint"}
    assert numeric_columns([a, b]) == {"k": "bigint", "k (2)": "bigint"}
