"""Numbers and running values over more rows than one range holds."""

import pytest
from pyspark.sql import functions as F

from tabdelta.operators.rows import number_within, pair_as_multiset
from tabdelta.sources.snapshots import number_rows, running_last

N = 500_000


@pytest.fixture
def many(spark):
    """Rows with a payload, in an order of their own; adaptive execution splits and joins partitions."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    yield spark.range(N).select(((F.col("id") * 7919) % N).alias("v"), F.sha2(F.col("id").cast("string"), 256).alias("payload"), F.lit("all").alias("g"))
    for k, v in before.items():
        spark.conf.set(k, v)


def stored(df, tmp_path):
    """Rows as an action leaves them that needs every column."""
    df.write.parquet(str(tmp_path / "rows"))
    return df.sparkSession.read.parquet(str(tmp_path / "rows"))


def test_numbers_have_no_gaps(many, tmp_path):
    got = stored(number_rows(many, "v"), tmp_path)
    row = got.agg(F.count("*").alias("n"), F.countDistinct("r").alias("d"), F.max("r").alias("top"), F.count_if(F.col("r") != F.col("v")).alias("wrong"), F.countDistinct("payload").alias("p")).first()
    assert tuple(row) == (N, N, N - 1, 0, N)


@pytest.mark.parametrize("hot", [1_000, 10_000_000])
def test_numbers_within_groups(many, tmp_path, hot):
    rows = many.withColumn("g", F.when(F.col("v") % 3 == 0, F.lit(None).cast("string")).when(F.col("v") < 1000, F.col("v").cast("string")).otherwise("hot"))
    got = stored(number_within(rows, ["g"], "v", "k", hot), tmp_path)
    by = got.groupBy("g").agg(F.count("*").alias("n"), F.countDistinct("k").alias("d"), F.min("k").alias("low"), F.max("k").alias("top"))
    assert by.where("n <> d OR low <> 1 OR top <> n").count() == 0 and got.count() == N
    assert got.where("g IS NULL AND k <> v / 3 + 1").count() == 0


def test_running_values(many, tmp_path):
    value = F.when(F.col("v") % 1000 == 0, F.col("v"))
    got = stored(running_last(many, ["v"], value, "last"), tmp_path)
    assert got.where("NOT (last <=> nullif((v - 1) div 1000 * 1000, CASE WHEN v = 0 THEN 0 END))").count() == 0 and got.count() == N


def test_running_values_within_parts(many, tmp_path):
    rows = many.withColumn("g", (F.col("v") % 3).cast("string"))
    got = stored(running_last(rows, ["v"], F.when(F.col("v") < 3, F.col("v")), "last", part="g"), tmp_path)
    assert got.where("v >= 3 AND (last IS NULL OR last <> v % 3) OR v < 3 AND last IS NOT NULL").count() == 0 and got.count() == N


def test_a_table_pairs_with_itself(many, tmp_path):
    rows = many.select("g", F.when(F.col("v") % 2 == 0, "even").otherwise("odd").alias("h"), "payload")
    pairs = pair_as_multiset(rows, rows, ["g", "h"], ["g", "h"])
    got = stored(pairs, tmp_path)
    assert got.count() == N == got.where("old IS NOT NULL AND new IS NOT NULL").select("old.payload").distinct().count()
