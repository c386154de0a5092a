"""Connected components of a graph given by its edges, as DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``node, comp`` of every node of ``edges(a, b)``; ``comp`` is the least node reachable.

    Each round a node takes the least label among its neighbours and its own, and then the
    label of that label, so labels travel twice as far each round.
    """
    both = scratch.save(edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    table = scratch.save(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("comp")))
    while True:
        labels = table.select("node", "comp")
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("comp").alias("near"))
        lower = labels.join(near, labels["node"] == near["a"]).select("node", F.col("comp").alias("old"), F.least("comp", "near").alias("comp"))
        jump = labels.select(F.col("node").alias("at"), F.col("comp").alias("further"))
        step = lower.join(jump, lower["comp"] == jump["at"], "left").select("node", "old", F.least("comp", F.coalesce("further", "comp")).alias("comp"))
        new = scratch.save(step)
        scratch.drop(table)
        table = new
        if table.where(F.col("old") != F.col("comp")).isEmpty():
            scratch.drop(both)
            return table.select("node", "comp")
