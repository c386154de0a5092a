"""Intermediate tables."""

import time

from pyspark.sql import functions as F

from tabdelta.llm.scratch import Scratch


def test_shuffles_behind_a_saved_table_are_deleted(spark):
    """Files of a shuffle go once its outcome is written, also if the driver has memory to spare."""
    held = lambda: spark._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker().shuffleStatuses().size()
    scratch, before = Scratch(spark, "test"), held()
    tables = [scratch.save(spark.range(1000).groupBy((F.col("id") % (k + 3)).alias("k")).count()) for k in range(5)]
    until = time.time() + 20
    while held() > before + 1 and time.time() < until:
        time.sleep(0.2)
    assert held() <= before + 1  # the last one goes with the next table
    assert [t.count() for t in tables] == [3, 4, 5, 6, 7]


def test_shuffle_files_go_as_a_table_is_saved(spark):
    """Files of the shuffles behind a table go when it is written, even if its plan is still held."""

    def files():
        found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {n for n in (found.apply(k).getName() for k in range(found.size())) if n.startswith("shuffle_")}

    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, was = files(), spark.conf.get(setting)
    df = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()
    table = Scratch(spark, "test").save(df)
    until = time.time() + 5
    while files() - before and time.time() < until:
        time.sleep(0.2)
    assert not files() - before
    assert table.count() == df.count() == 7
    assert spark.conf.get(setting) == was
