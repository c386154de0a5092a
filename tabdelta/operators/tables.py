"""Finding the table inside a sheet of long cells ``r, c, cell``."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.coords import col_to_letter
from ..functions.values import NUMBER, STRING, is_empty, trim
from ..sources.snapshots import running_last

#: Rows looked at for a header.
HEADER_ROWS = 30
TOTAL = r"(?i)^(grand\s+)?(sub\s*)?total\b"


def _filled(cells: DataFrame) -> DataFrame:
    return cells.where(~is_empty(F.col("cell")))


def first_text(cells: DataFrame) -> DataFrame:
    """``r, text``: the text of the first filled cell of each row; null if that is no text."""
    first = _filled(cells).groupBy("r").agg(F.min_by("cell", "c").alias("x"))
    return first.select("r", F.when(F.col("x.kind") == STRING, F.col("x.text")).alias("text"))


def totals_rows(cells: DataFrame) -> DataFrame:
    """``r, label`` of rows that begin with a total's label.

    Rows without such a text in any cell are left behind before the first cells of rows are sought.
    """
    label = (F.col("cell.kind") == STRING) & trim(F.col("cell.text")).rlike(TOTAL)
    asked = cells.where(label).select("r").distinct()
    return first_text(cells.join(asked, "r", "left_semi")).where(trim(F.col("text")).rlike(TOTAL)).select("r", trim(F.col("text")).alias("label"))


def header_scores(cells: DataFrame) -> DataFrame:
    """``r, texts, score`` of rows that may be the header.

    At least two texts, and texts in three cells of five; the score is the number of distinct
    texts times the share of their columns that are filled in two of the next three rows.
    """
    top = _filled(cells.where(F.col("r") < HEADER_ROWS + 3))
    text = (F.col("cell.kind") == STRING) & (trim(F.col("cell.text")) != "")
    next3 = Window.partitionBy("c").orderBy("r").rangeBetween(1, 3)
    marked = top.select("r", "c", text.alias("text"), F.lower(trim(F.col("cell.text"))).alias("word"), F.count("*").over(next3).alias("below")).where(F.col("r") < HEADER_ROWS)
    rows = marked.groupBy("r").agg(
        F.count("*").alias("filled"), F.count_if("text").alias("texts"), F.count_distinct(F.when(F.col("text"), F.col("word"))).alias("words"), F.count_if(F.col("text") & (F.col("below") >= 2)).alias("followed")
    )
    good = rows.where((F.col("texts") >= 2) & (F.col("texts") / F.col("filled") >= 0.6))
    return good.select("r", "texts", (F.col("words") * F.col("followed") / F.col("texts")).alias("score"))


def header_row(cells: DataFrame) -> DataFrame:
    """``header_row``: the row of the best score, the first of equals; no row if the sheet has no header."""
    return header_scores(cells).where("score > 0").agg(F.max_by("r", F.struct("score", -F.col("r"))).alias("header_row")).where("header_row IS NOT NULL")


def data_range(cells: DataFrame, start: int) -> DataFrame:
    """``data_start, data_end``: the data ends where two rows together are blank; totals count as neither."""
    rows = _filled(cells.where(F.col("r") >= start)).select("r").distinct()
    totals = totals_rows(cells).select("r").withColumn("total", F.lit(True))
    marked = rows.join(totals, "r", "left")
    # rows that are blank between a filled row and the one before
    gaps = running_last(marked, ["r"], F.col("r"), "before").withColumn("blank", F.col("r") - F.coalesce("before", F.lit(start - 1)) - 1)
    stop = gaps.agg(F.min(F.when(F.col("blank") >= 2, F.col("r"))).alias("stop"))
    kept = gaps.where(F.col("total").isNull()).join(F.broadcast(stop), F.lit(True)).where(F.col("stop").isNull() | (F.col("r") < F.col("stop")))
    return kept.agg(F.lit(start).cast("long").alias("data_start"), F.coalesce(F.max("r"), F.lit(start - 1)).cast("long").alias("data_end"))


def table_columns(cells: DataFrame, header: int, start: int, end: int) -> DataFrame:
    """``c, header, synthetic``: header texts, and letters for columns without one that are filled to a fifth."""
    rows = max(end - start + 1, 1)
    named = cells.where(F.col("r") == header).select("c", F.when((F.col("cell.kind") == STRING) & (trim(F.col("cell.text")) != ""), trim(F.col("cell.text"))).alias("text"))
    fill = _filled(cells.where(F.col("r").between(start, end))).groupBy("c").agg((F.count("*") / rows).alias("fill"))
    both = fill.join(named, "c", "full_outer")
    out = both.select("c", F.coalesce("text", F.concat(F.lit("Column "), col_to_letter(F.col("c")))).alias("header"), F.col("text").isNull().alias("synthetic"), "fill")
    return out.where(~F.col("synthetic") | (F.col("fill") >= 0.2)).drop("fill")


def numeric_shares(cells: DataFrame) -> DataFrame:
    """``c, numeric``: whether nine in ten filled cells of a column are numbers."""
    return _filled(cells).groupBy("c").agg((F.count_if(F.col("cell.kind") == NUMBER) / F.count("*") >= 0.9).alias("numeric"))
