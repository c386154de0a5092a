"""Removal of boilerplate lines that spread over many sites.

A HyperLogLog sketch of the sites of each line hash says roughly on how many distinct
sites the line stands.  Sketches are built within tasks and merged by aggregation, so a
line that a third of all documents hold costs a shuffled row for each task.  Lines whose
estimate is near the threshold get exact distinct counts; the others are far enough
from it for the sketch to decide.

What then looks lines up takes the same path at every size.  A bitmap of fixed size, in which each
sought line sets a bit, is sent to the executors; only lines that meet a bit are shuffled, as keys and
places, and joined with the lines sought.  Only documents that may lose a line are joined with what they lose.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from .scratch import Scratch
from .textkit import map_text

#: Log of the number of registers of a sketch: a standard error of 1.6 %.
LG_K = 12
#: Estimates within this share of the threshold are counted exactly: over ten standard errors.
NEAR = 0.2
#: Bits of the bitmap of sought lines, 16 MB; the more lines there are, the more others meet a bit and are shuffled.
BITS = 1 << 27
#: Groups of document ids; those that hold a document that loses a line are broadcast.
ID_GROUPS = 1 << 20
#: Bits that one row of a bitmap holds in Spark.
_ROW_BITS = 1 << 15
_BLANK = " \t\x0b\x0c\r"
#: Stands for the site of documents without one.
_NO_SITE = "\x01"
#: Seeds of the two hashes of a line: Spark's hash of 1 and of 2, so that workers make the keys that Spark makes.
_SEEDS = [xxhash.xxh64_intdigest(k.to_bytes(4, "little"), 42) for k in (1, 2)]


def line_keys(line: Column) -> list[Column]:
    """128 bits of hash of a line."""
    return [F.xxhash64(F.lit(1), line).alias("k1"), F.xxhash64(F.lit(2), line).alias("k2")]


def lines_of(docs: DataFrame, id_col: str, text_col: str, site_col: str) -> DataFrame:
    """``doc, site, pos, k1, k2`` of each line with a word, blank space around it taken off."""
    rows = _sources(docs, id_col, text_col, site_col).select("doc", "site", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    line = _trimmed(F.col("line"))
    return rows.where(line != "").select("doc", "site", "pos", *line_keys(line))


def _sources(docs: DataFrame, id_col: str, text_col: str, site_col: str) -> DataFrame:
    return docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc"), F.coalesce(F.col(site_col).cast("string"), F.lit(_NO_SITE)).alias("site"), F.col(text_col).alias("text"))


def _trimmed(line: Column) -> Column:
    return F.btrim(line, F.lit(_BLANK))


def _bitmap(keys: DataFrame) -> np.ndarray:
    """A bitmap of ``BITS`` bits in which each ``k1`` of ``keys`` sets one; its size doesn't depend on them."""
    at = F.pmod("k1", F.lit(BITS))
    rows = keys.select(at.alias("at")).groupBy(F.floor(F.col("at") / _ROW_BITS).alias("row")).agg(F.bitmap_construct_agg(F.col("at") % _ROW_BITS).alias("bits")).collect()
    out = np.zeros(BITS // 8, np.uint8)
    for r in rows:
        start, part = r["row"] * _ROW_BITS // 8, np.frombuffer(r["bits"], np.uint8)[: _ROW_BITS // 8]
        out[start : start + len(part)] = part
    return out


def marked_lines(docs: DataFrame, bitmap: np.ndarray, id_col: str, text_col: str, site_col: str) -> DataFrame:
    """Rows of ``lines_of`` whose ``k1`` meets a bit of the bitmap; these hold all lines that it was made of."""
    known = docs.sparkSession.sparkContext.broadcast(bitmap)
    rows = _sources(docs, id_col, text_col, site_col)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        doc, pos, lines = [], [], []
        for k, text in enumerate(batch.column(2).to_pylist()):
            for at, line in enumerate(text.split("\n") if text else ()):
                if line := line.strip(_BLANK):
                    doc.append(k)
                    pos.append(at)
                    lines.append(line.encode("utf-8", "surrogatepass"))
        k1 = np.array([xxhash.xxh64_intdigest(x, _SEEDS[0]) for x in lines], np.uint64).view(np.int64)
        bit = k1 % (8 * len(known.value))
        met = np.flatnonzero(known.value[bit >> 3] >> (bit & 7).astype(np.uint8) & 1)
        if not len(met):
            return None
        k2 = np.array([xxhash.xxh64_intdigest(lines[i], _SEEDS[1]) for i in met.tolist()], np.uint64).view(np.int64)
        of = pa.array(np.array(doc, np.int64)[met])
        return pa.RecordBatch.from_arrays([batch.column(0).take(of), batch.column(1).take(of), pa.array(np.array(pos, np.int32)[met]), pa.array(k1[met]), pa.array(k2)], ["doc", "site", "pos", "k1", "k2"])

    schema = StructType([rows.schema["doc"], rows.schema["site"], StructField("pos", IntegerType()), StructField("k1", LongType()), StructField("k2", LongType())])
    return map_text(rows, run, schema)


def spread_lines(docs: DataFrame, least: int, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source") -> DataFrame:
    """Keys of lines on ``least`` or more distinct sites, with their first place by document and position."""
    lines = lines_of(docs, id_col, text_col, site_col)
    sketched = lines.groupBy("k1", "k2").agg(F.hll_sketch_agg("site", LG_K).alias("sketch"), F.min(F.struct("doc", "pos")).alias("first"))
    rough = sketched.select("k1", "k2", "first", F.hll_sketch_estimate("sketch").alias("sites"))
    slack = max(1.0, NEAR * least)
    table = Scratch(docs.sparkSession, "line_dedup").save(rough.where(F.col("sites") >= least - slack))
    sure = table.where(F.col("sites") > least + slack).select("k1", "k2", "first")
    near = table.where(F.col("sites") <= least + slack)
    # the sites of a line are made distinct before lines meet, so a line in very many documents is a few rows
    sites = marked_lines(docs, _bitmap(near), id_col, text_col, site_col).select("k1", "k2", "site").distinct()
    exact = near.select("k1", "k2", "first").join(sites, ["k1", "k2"]).groupBy("k1", "k2").agg(F.first("first").alias("first"), F.count("*").alias("sites"))
    return sure.unionAll(exact.where(F.col("sites") >= least).select("k1", "k2", "first"))


def remove_spread_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    site_col: str = "source",
    least: int = 10,
    keep_first: bool = True,
) -> DataFrame:
    """``docs`` without lines found on ``least`` or more sites; also ``n_lines`` and ``n_removed``.

    Lines are what stands between newlines, compared without white space at their ends;
    lines without a word are left alone and not counted.  With ``keep_first`` the first
    occurrence of a line, by document id and position, stays, so that what many
    sites copy is left once.  A null site is a site of its own.

    A text is shuffled only if its document is in one of ``ID_GROUPS`` groups of ids of which one loses a line.

    Null and empty texts stay as they are, with 0 lines.  Rows with a null id stay
    as they are and their lines don't count.  Rows repeated with the same id count as one
    document: a first occurrence stays in each of them.  All columns of ``docs`` stay, but
    ``n_lines`` and ``n_removed`` replace columns of that name.  An empty table stays empty.
    """
    scratch = Scratch(docs.sparkSession, "line_dedup")
    spread = scratch.save(spread_lines(docs, least, id_col, text_col, site_col))
    hits = marked_lines(docs, _bitmap(spread), id_col, text_col, site_col).join(spread, ["k1", "k2"])
    if keep_first:
        hits = hits.where((F.col("doc") != F.col("first.doc")) | (F.col("pos") != F.col("first.pos")))
    gone = scratch.save(hits.groupBy("doc").agg(F.collect_set("pos").alias("gone")))

    base = docs.drop("n_lines", "n_removed").select(F.col(id_col).alias("doc"), F.struct(*[c for c in docs.columns if c not in ("n_lines", "n_removed")]).alias("row"))
    group = lambda c: F.pmod(F.xxhash64(c), F.lit(ID_GROUPS)).cast("int")
    groups = F.broadcast(scratch.save(gone.select(group("doc").alias("group")).distinct()))
    rows = base.withColumn("group", F.when(F.col("doc").isNotNull(), group("doc")))
    # merged at every size: a broadcast of what is lost would hold while inputs are small only
    touched = rows.join(groups, "group", "left_semi").join(gone.hint("merge"), "doc", "left")
    others = rows.join(groups, "group", "left_anti").withColumn("gone", F.lit(None).cast("array<int>"))
    return touched.unionByName(others).select(*_left(docs, text_col))


def _left(docs: DataFrame, text_col: str) -> list[Column]:
    """Columns of ``docs`` from ``row``, without the lines at the places in ``gone``."""
    value, parts = F.col("row")[text_col], F.split(F.col("row")[text_col], "\n")
    left = F.filter(parts, lambda x, i: ~F.array_contains("gone", i))
    text = F.when(F.col("gone").isNull(), value).otherwise(F.array_join(left, "\n"))
    lost = F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone"))
    counted = F.when(F.col("doc").isNull() | value.isNull(), 0).otherwise(F.size(F.filter(parts, lambda x: _trimmed(x) != "")))
    own = [text.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns if c not in ("n_lines", "n_removed")]
    return [*own, counted.cast("long").alias("n_lines"), lost.cast("long").alias("n_removed")]


def without_spread_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", chars_col: str = "n_chars", **options) -> DataFrame:
    """``docs`` with its own columns after the removal.

    Documents of which no word is left go; ``chars_col``, if there is one, counts the new text.
    """
    clean = remove_spread_lines(docs, id_col, text_col, site_col, **options)
    emptied = (F.col("n_removed") > 0) & (F.col("n_removed") == F.col("n_lines"))
    chars = F.when(F.col("n_removed") > 0, F.length(text_col).cast("long")).otherwise(F.col(chars_col)) if chars_col in docs.columns else None
    return clean.where(~emptied).select(*[chars.alias(c) if c == chars_col else F.col(c) for c in docs.columns if c in clean.columns])
