"""Reports of a comparison: all changes, marked sheets, removed rows and a summary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.values import scalar_text
from ..sources.snapshots import running_last
from .diff import REMOVED


def all_changes(findings: DataFrame, changes: DataFrame) -> DataFrame:
    """Findings with the old and new value of their cell."""
    values = changes.select("key", "column", scalar_text(F.col("old")).alias("old"), scalar_text(F.col("new")).alias("new"))
    return findings.join(values, ["key", "column"], "left").select("rule", "severity", "key", "column", "old", "new", "title")


def marked_cells(changes: DataFrame, findings: DataFrame) -> DataFrame:
    """``key, column, mark, old``: recalculated, changed, or high where a high finding stands."""
    high = findings.where("severity = 'high' AND column IS NOT NULL").select("key", "column").distinct().withColumn("high", F.lit(True))
    mark = F.when(F.col("kind") == "recalculated", "recalculated").when(F.col("high"), "high").otherwise("changed")
    return changes.join(high, ["key", "column"], "left").select("key", "column", mark.alias("mark"), scalar_text(F.col("old")).alias("old"))


def removed_rows(old: DataFrame, states: DataFrame, key: str, order: str) -> DataFrame:
    """``key, after``: removed rows and the nearest row before them, in ``order``, that is left."""
    gone = states.where(F.col("state") == REMOVED).select(F.col("key").alias("_k")).withColumn("gone", F.lit(True))
    rows = old.select(F.col(key).cast("string").alias("key"), F.col(order).alias("_o")).join(gone, F.col("key") == F.col("_k"), "left")
    found = running_last(rows.select("key", "_o", "gone"), ["_o"], F.when(F.col("gone").isNull(), F.col("key")), "after")
    return found.where("gone").select("key", "after")


def summary(counts: dict[str, int], high: list[str], most: int = 1000) -> str:
    """A few lines to pass on: the counts and the findings of high severity, cut to ``most`` characters."""
    lines = [f"{counts.get('real_changes', 0)} real change(s), {len(high)} need attention."]
    for text in high:
        if len("\n".join(lines)) + len(text) + 3 > most:
            break
        lines.append(f"- {text}")
    return "\n".join(lines)[:most]
