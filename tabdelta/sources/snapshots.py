"""Typed tables as snapshots: one row a record, one cell struct a column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.values import EMPTY, cell_of, is_empty, typed_cell
from .scratch import Scratch


def read_snapshot(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """A Parquet table; only ``columns`` are read if given."""
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def as_cells(df: DataFrame) -> DataFrame:
    """``df`` with every column as a cell struct, under its name; cells stay as they are."""
    return df.select(*[cell_of(df, c).alias(c) for c in df.columns])


def cells_long(df: DataFrame, row: str, columns: list[str] | None = None) -> DataFrame:
    """``r, c, column, cell`` of the cells that aren't empty; ``row`` holds each row's number."""
    names = columns or [c for c in df.columns if c != row]
    kinds: dict[str, T.DataType] = {f.name: f.dataType for f in df.schema.fields}
    parts = [F.struct(F.lit(k).alias("c"), F.lit(n).alias("column"), typed_cell(F.col(n), kinds[n]).alias("cell")) for k, n in enumerate(names)]
    return df.select(F.col(row).cast("long").alias("r"), F.explode(F.array(*parts)).alias("x")).select("r", "x.*").where(~is_empty(F.col("cell")))


def in_ranges(df: DataFrame, order: list[str]) -> DataFrame:
    """``df`` sorted in ranges of ``order``: ``_p`` is the number of a row's range, ``_k`` its place there from 0.

    The ranges are written once and read by all that follows.  Planned twice, Spark would sample
    and cut them anew, and numbers of one plan would not fit the rows of the other.
    """
    spread = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    table = Scratch(df.sparkSession, "ranges").save(spread)
    return _places(table, df.columns)


def _places(table: DataFrame, columns: list[str]) -> DataFrame:
    # the upper bits are the partition that wrote a row, the lower 33 the row's place in it
    return table.select(*columns, F.shiftright("_at", 33).alias("_p"), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)).alias("_k"))


def _numbered(local: DataFrame, columns: list[str], name: str) -> DataFrame:
    """Places in ranges as numbers; the sizes of the ranges, a table of one row each, shift them."""
    sizes = local.groupBy("_p").agg(F.count("*").alias("_n"))
    before = sizes.select("_p", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return local.join(F.broadcast(before), "_p").select(*columns, (F.col("_before") + F.col("_k")).cast("long").alias(name))


def number_rows(df: DataFrame, *order: str, name: str = "r") -> DataFrame:
    """``df`` with rows numbered from 0 in ``order``; rows that it doesn't tell apart are numbered in any order.

    Rows are sorted in ranges and no task sorts everything.
    """
    return _numbered(in_ranges(df, list(order)), df.columns, name)


def number_as_read(df: DataFrame, name: str = "r") -> DataFrame:
    """``df`` with rows numbered from 0 as they are read; they are written once, so that numbers stay."""
    table = Scratch(df.sparkSession, "rows").save(df.withColumn("_at", F.monotonically_increasing_id()))
    return _numbered(_places(table, df.columns), df.columns, name)


def running_last(df: DataFrame, order: list[str], value: Column, name: str, part: str | None = None) -> DataFrame:
    """``df`` with the last value that isn't null of the rows before each row in ``order``, within ``part``.

    As with ``number_rows``, ranges of the order are gone through on their own, and what the ranges
    before leave behind is carried on, a row for each part that a range begins with.
    """
    parts = [part] if part else []
    local = in_ranges(df.withColumn("_v", value), [*parts, *order])
    own = Window.partitionBy("_p", *parts).orderBy("_k").rowsBetween(Window.unboundedPreceding, -1)
    # only the part at the start of a range can have begun before it
    heads = local.where("_k = 0").select("_p", *parts)
    left = local.where("_v IS NOT NULL").groupBy("_p", *parts).agg(F.max_by("_v", "_k").alias("_left"))
    if parts:
        left = left.join(F.broadcast(heads.select(*parts).distinct()), parts, "left_semi")
    ranges = heads.unionByName(left.select("_p", *parts)).distinct().join(left, ["_p", *parts], "left")
    before = Window.partitionBy(*(parts or [F.lit(0)])).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    carried = ranges.withColumn("_carried", F.last("_left", ignorenulls=True).over(before)).drop("_left").where("_carried IS NOT NULL")
    seen = local.withColumn("_local", F.last("_v", ignorenulls=True).over(own))
    return seen.join(F.broadcast(carried), ["_p", *parts], "left").select(*df.columns, F.coalesce("_local", "_carried").alias(name))


def filled(cell: str) -> Column:
    return F.col(cell)["kind"] != EMPTY


def union_sheets(sheets: dict[str, DataFrame]) -> DataFrame:
    """Long cells of several sheets under their names."""
    out = None
    for name, cells in sheets.items():
        part = cells.select(F.lit(name).alias("sheet"), "*")
        out = part if out is None else out.unionByName(part)
    return out
