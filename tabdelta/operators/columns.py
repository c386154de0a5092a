"""Matching the columns and the sheets of two workbooks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.similarity import jaccard, jaro_winkler, normalize_header, overlap, token_set_ratio
from ..functions.values import is_empty, named, row_hash
from ..options import CompareOptions


@dataclass(frozen=True)
class Match:
    """Names of a matched, renamed, added or removed column or sheet."""

    old: str | None
    new: str | None
    status: str


def dominant_kinds(cells: DataFrame) -> DataFrame:
    """``c, kind``: the most frequent kind of the filled cells of each column of long cells; the first seen of equals."""
    seen = cells.where(~is_empty(F.col("cell"))).groupBy("c", F.col("cell.kind").alias("kind")).agg(F.count("*").alias("n"), F.min("r").alias("first"))
    return seen.groupBy("c").agg(F.max_by("kind", F.struct("n", -F.col("first"))).alias("kind"))


def match_columns(old: list[str], new: list[str], old_kinds: dict[str, int] | None = None, new_kinds: dict[str, int] | None = None, least: float = 0.85) -> list[Match]:
    """Equal headers first, then the most similar ones; headers only, so on the driver.

    A pair whose dominant kinds differ counts for 0.7 of its similarity.
    """
    a, b = [normalize_header(x) for x in old], [normalize_header(x) for x in new]
    free = list(range(len(new)))
    out: list[Match] = []
    rest = []
    for i, h in enumerate(a):
        j = next((j for j in free if b[j] == h), None)
        if j is None:
            rest.append(i)
            continue
        free.remove(j)
        out.append(Match(old[i], new[j], "matched"))
    for i in rest:
        best, score = None, 0.0
        for j in free:
            s = max(jaro_winkler(a[i], b[j]), token_set_ratio(a[i], b[j]))
            if old_kinds and new_kinds and old_kinds.get(old[i]) != new_kinds.get(new[j]):
                s *= 0.7
            if s > score:
                best, score = j, s
        if best is not None and score >= least:
            free.remove(best)
            out.append(Match(old[i], new[best], "renamed"))
        else:
            out.append(Match(old[i], None, "removed"))
    return out + [Match(None, new[j], "added") for j in free]


def signature(cells: DataFrame, columns: list[str], row: str = "r", rows: int = 200, o: CompareOptions = CompareOptions()) -> DataFrame:
    """``headers, hashes`` of a sheet: normalised headers, and hashes of its first rows."""
    some = cells.where(F.col(row) < rows).agg(F.collect_set(row_hash([named(c) for c in columns], o)).alias("hashes"))
    return some.select(F.array(*[F.lit(normalize_header(c)) for c in columns]).alias("headers"), "hashes")


def sheet_scores(old: DataFrame, new: DataFrame) -> DataFrame:
    """``old, new, score`` of every pair of signatures ``sheet, headers, hashes``.

    One row a sheet: workbooks hold a few dozen at most.
    """
    a = old.select(F.col("sheet").alias("old"), F.col("headers").alias("ha"), F.col("hashes").alias("ra"))
    b = new.select(F.col("sheet").alias("new"), F.col("headers").alias("hb"), F.col("hashes").alias("rb"))
    score = 0.6 * jaccard(F.array_distinct("ha"), F.array_distinct("hb")) + 0.4 * overlap(F.col("ra"), F.col("rb"))
    return a.join(F.broadcast(b), F.lit(True)).select("old", "new", score.alias("score"))


def pair_sheets(old: list[str], new: list[str], scores: dict[tuple[str, str], float], least: float = 0.6) -> list[Match]:
    """Sheets of the same name, then of the same name but for case and space, then the most similar."""
    left, right = list(old), list(new)
    out: list[Match] = []
    for key in (lambda s: s, lambda s: " ".join(s.lower().split())):
        for x in list(left):
            y = next((y for y in right if key(y) == key(x)), None)
            if y is not None:
                left.remove(x)
                right.remove(y)
                out.append(Match(x, y, "matched"))
    for (x, y), s in sorted(scores.items(), key=lambda t: -t[1]):
        if s >= least and x in left and y in right:
            left.remove(x)
            right.remove(y)
            out.append(Match(x, y, "renamed"))
    return out + [Match(x, None, "removed") for x in left] + [Match(None, y, "added") for y in right]


def greedy_pairs(scores: DataFrame, least: float) -> DataFrame:
    """The best partner of each old sheet by score, from ``old, new, score``."""
    place = F.row_number().over(Window.partitionBy("old").orderBy(F.desc("score"), "new"))
    return scores.where(F.col("score") >= least).withColumn("k", place).where("k = 1").drop("k")
