"""Pairing the rows of two snapshots by key or as a multiset; ``order`` pairs them in order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import cell_of, cell_token, matching_key, named
from ..options import CompareOptions
from ..sources.scratch import Scratch
from ..sources.snapshots import in_ranges

#: Rows of a group numbered in one task at most.
HOT = 200_000


def row_place() -> Column:
    """The place of a row in its table as it is read; the order in which double rows are taken by default."""
    return F.monotonically_increasing_id()


def pair_by_key(old: DataFrame, new: DataFrame, old_keys: list[str], new_keys: list[str], o: CompareOptions = CompareOptions(), order: Column | None = None, each: bool = False) -> DataFrame:
    """``old, new`` row structs: the k-th row of a key pairs with the k-th; a side is null if unmatched.

    Columns are typed or cells.  Rows with an empty key cell match nothing.  Both sides go
    through one shuffle by key, in which rows without a key are spread on their own; there
    the rows of a key are numbered by ``order`` on each side, and equal numbers meet.  With ``each``, every
    row of a key meets every one of the other side, as in a join.
    """
    place = order if order is not None else row_place()
    kinds = [df.schema for df in (old, new)]

    def side(df: DataFrame, keys: list[str], k: int) -> DataFrame:
        names = ["old", "new"]
        # a key that no row has twice stands for a missing one
        key = F.coalesce(matching_key([cell_of(df, c) for c in keys], o), F.concat(F.lit(f"\u0000{k}:"), row_place().cast("string")))
        if each:
            return df.select(key.alias("_key"), F.struct(*map(named, df.columns)).alias(names[k]))
        structs = [F.struct(*map(named, df.columns)).alias(names[k]) if i == k else F.lit(None).cast(kinds[i]).alias(names[i]) for i in (0, 1)]
        return df.select(key.alias("_key"), F.lit(k).alias("_side"), place.alias("_place"), *structs)

    if each:
        return side(old, old_keys, 0).join(side(new, new_keys, 1), "_key", "full_outer").select("old", "new")
    both = side(old, old_keys, 0).unionByName(side(new, new_keys, 1)).repartition("_key")
    number = F.row_number().over(Window.partitionBy("_key", "_side").orderBy("_place"))
    met = Window.partitionBy("_key", "_k").orderBy("_side")
    rows = both.withColumn("_k", number).select("_side", "old", "new", F.lead("new").over(met).alias("_new"), F.lag("_side").over(met).alias("_before"))
    # an old row takes the new one after it; a new row stands alone if no old one is before it
    return rows.where((F.col("_side") == 0) | F.col("_before").isNull()).select("old", F.when(F.col("_side") == 0, F.col("_new")).otherwise(F.col("new")).alias("new"))


def number_within(rows: DataFrame, groups: list[str], place: str, name: str, hot: int = HOT) -> DataFrame:
    """``rows`` with their number from 1 within ``groups``, by ``place``; a group of any size is numbered.

    Groups of up to ``hot`` rows are numbered by one shuffle.  Larger ones, of which there
    are few, are sorted in ranges, and a group that goes on from one range into the next goes on with its numbers.
    """
    large = rows.groupBy(*groups).agg(F.count("*").alias("_n")).where(F.col("_n") > hot).select(*groups)
    large = Scratch(rows.sparkSession, "numbers").save(large)
    number = lambda *parts: F.row_number().over(Window.partitionBy(*groups, *parts).orderBy(place)).cast("long")
    if large.isEmpty():
        return rows.select("*", number().alias(name))
    within = [F.col(f"_a.{g}").eqNullSafe(F.col(f"_b.{g}")) for g in groups]
    met = reduce(lambda x, y: x & y, within)
    few = rows.alias("_a").join(F.broadcast(large.alias("_b")), met, "left_anti").select("*", number().alias(name))
    many = in_ranges(rows.alias("_a").join(F.broadcast(large.alias("_b")), met, "left_semi"), [*groups, place])
    sizes = many.groupBy("_p", *groups).agg(F.count("*").alias("_size"), F.min("_k").alias("_first"))
    earlier = F.coalesce(F.sum("_size").over(Window.partitionBy(*groups).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("_p", *groups, (F.lit(1) + earlier - F.col("_first")).alias("_shift"))
    same = reduce(lambda x, y: x & y, [F.col(f"_a.{g}").eqNullSafe(F.col(f"_b.{g}")) for g in ["_p", *groups]])
    numbered = many.alias("_a").join(F.broadcast(starts.alias("_b")), same).select(*[F.col(f"_a.{c}").alias(c) for c in rows.columns], (F.col("_k") + F.col("_shift")).alias(name))
    return few.unionByName(numbered)


def pair_as_multiset(old: DataFrame, new: DataFrame, old_columns: list[str], new_columns: list[str], o: CompareOptions = CompareOptions(), order: Column | None = None) -> DataFrame:
    """Rows with equal values pair, the k-th with the k-th; columns are compared by position.

    Values are equal if 128 bits of hash of their tokens are.  A row that a large share of all
    rows equal is spread by its number.
    """

    def hashed(df: DataFrame, columns: list[str], side: str) -> DataFrame:
        tokens = F.array(*[cell_token(cell_of(df, c), o) for c in columns])
        rows = df.select(F.xxhash64(tokens).alias("_h1"), F.xxhash64(F.lit(1), tokens).alias("_h2"), (order if order is not None else row_place()).alias("_place"), F.struct(*map(named, df.columns)).alias(side))
        return number_within(rows, ["_h1", "_h2"], "_place", "_k").drop("_place")

    keys = ["_h1", "_h2", "_k"]
    return hashed(old, old_columns, "old").join(hashed(new, new_columns, "new"), keys, "full_outer").select("old", "new")
