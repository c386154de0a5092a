"""How filters act together: what each one removes in every order, from a packed bitmap index.

Each document becomes a few flags: the filters it fails and its labels.  A task packs its documents'
flags into bitsets, a word-aligned run for each part of the corpus.  For each subset of the filters one
AND-NOT leaves the documents that pass all of it, and popcounts give their number by part, all of
them and by label.  Summed over tasks, these counts of subsets hold every order: a filter removes what passes
the filters before it less what passes these and itself.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch
from .textkit import map_text

FILTERS = "ABCDE"
#: Filter E, which needs the whole table, comes last.
_COPY = 1 << 4
_MARKS = re.compile(rb"[#$%&*|]")
_CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
#: Documents packed together at most.
BLOCK = 1 << 20


def failures(text: str) -> int:
    """Filters A to D that a text fails, as bits."""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    few = len(words) < 200
    repeated = 100 * len(set(words)) < 50 * len(words)
    loud = 100 * (len(data) - len(data.translate(None, _CAPITALS))) > 2 * len(text)
    return few | repeated << 1 | loud << 2 | (_MARKS.search(data) is not None) << 3


def flag_rows(docs: DataFrame, id_col: str, text_col: str, part_col: str) -> DataFrame:
    """``doc, part, fails, text_hash`` of each document; the hash is of 128 bits."""
    kind = dict(docs.dtypes)[id_col]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [t or "" for t in batch.column(2).to_pylist()]
        fails = pa.array([failures(t) for t in texts], pa.int32())
        hashes = pa.array([hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=16).digest() for t in texts], pa.binary())
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), fails, hashes], ["doc", "part", "fails", "text_hash"])

    rows = docs.select(F.col(id_col).alias("doc"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.col(text_col).cast("string").alias("text"))
    return map_text(rows, run, f"doc {kind}, part string, fails int, text_hash binary")


def subset_counts(rows: DataFrame) -> DataFrame:
    """``part, subset, passed, good, toxic``: documents that pass all filters of each subset, by part.

    ``rows`` has ``part, fails, good, toxic``; subsets are bits of filters.
    """
    n = len(FILTERS)

    def counted(parts: np.ndarray, fails: np.ndarray, labels: list[np.ndarray]) -> pa.RecordBatch:
        names, codes = np.unique(parts, return_inverse=True)
        order = np.argsort(codes, kind="stable")
        sizes = np.bincount(codes, minlength=len(names))
        # each part's run of bits starts with a word of its own
        words = -(-sizes // 64)
        starts = np.concatenate([[0], np.cumsum(words)[:-1]])
        within = np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        place = np.repeat(starts * 64, sizes) + within

        def packed(flags: np.ndarray) -> np.ndarray:
            bits = np.zeros(int(words.sum()) * 64, bool)
            bits[place] = flags[order]
            return np.packbits(bits, bitorder="little").view(np.uint64)

        failing = [packed((fails >> k & 1).astype(bool)) for k in range(n)]
        masks = [packed(np.ones(len(codes), bool)), *map(packed, labels)]
        found = np.empty((1 << n, len(masks), len(names)), np.int64)
        left: dict[int, np.ndarray] = {}
        for subset in range(1 << n):
            top = subset.bit_length() - 1
            left[subset] = masks[0] if not subset else left[subset ^ 1 << top] & ~failing[top]
            for k, mask in enumerate(masks):
                found[subset, k] = np.add.reduceat(np.bitwise_count(left[subset] & mask).astype(np.int64), starts)
        columns = [pa.array(np.tile(names, 1 << n).astype(object), pa.string()), pa.array(np.repeat(np.arange(1 << n, dtype=np.int32), len(names)))]
        return pa.RecordBatch.from_arrays([*columns, *(pa.array(found[:, k].ravel()) for k in range(len(masks)))], ["part", "subset", "passed", "good", "toxic"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []

        def emit() -> pa.RecordBatch:
            parts, fails, good, toxic = (np.concatenate(x) for x in zip(*held, strict=True))
            return counted(parts, fails, [good, toxic])

        for batch in batches:
            if batch.num_rows:
                held.append([batch.column(c).to_numpy(zero_copy_only=False) for c in ("part", "fails", "good", "toxic")])
            if sum(len(x[1]) for x in held) >= BLOCK:
                yield emit()
                held.clear()
        if held:
            yield emit()

    counts = rows.select("part", "fails", "good", "toxic").mapInArrow(run, "part string, subset int, passed long, good long, toxic long")
    return counts.groupBy("part", "subset").agg(*[F.sum(c).alias(c) for c in ("passed", "good", "toxic")])


def _report(counts: DataFrame) -> DataFrame:
    """All orders and steps of each part, from the counts of its subsets."""
    n, every = len(FILTERS), (1 << len(FILTERS)) - 1
    arrays = [F.transform(F.array_sort(F.collect_list(F.struct("subset", F.col(c).alias("n")))), lambda x: x["n"]).alias(c) for c in ("passed", "good", "toxic")]
    parts = counts.groupBy("part").agg(*arrays)
    passed = F.col("passed")

    def share(f: int) -> Column:
        """What filter ``f`` removes over all orders: for each set before it, the orders that begin so."""
        total = F.lit(0).cast("long")
        for before in range(1 << n):
            if not before >> f & 1:
                k = before.bit_count()
                total += (passed[before] - passed[before | 1 << f]) * F.lit(factorial(k) * factorial(n - 1 - k))
        return total

    steps = []
    for order in permutations(range(n)):
        before = 0
        for step, f in enumerate(order, 1):
            steps.append(("".join(FILTERS[k] for k in order), step, f, before, before | 1 << f, every ^ 1 << f, 1 << f))
            before |= 1 << f
    kinds = "filter_order string, step int, f int, before int, after int, others int, alone int"
    names = [k.split()[0] for k in kinds.split(", ")]
    plan = F.from_json(F.lit(json.dumps([dict(zip(names, s, strict=True)) for s in steps])), f"array<struct<{kinds.replace(' ', ':').replace(',:', ', ')}>>")
    each = parts.select("part", "passed", "good", "toxic", F.array(*[share(f) for f in range(n)]).alias("shares")).select("*", F.inline(plan))
    lost = lambda c: F.col(c)[F.col("before")] - F.col(c)[F.col("after")]
    failing = passed[F.lit(0)] - passed[F.col("alone")]
    return each.select(
        "part", "filter_order", "step",
        passed[F.col("after")].alias("kept"), lost("passed").alias("removed"), (failing - lost("passed")).alias("redundant"),
        (passed[F.col("others")] - passed[F.lit(every)]).alias("unique_fails"), lost("good").alias("good_lost"), lost("toxic").alias("toxic_lost"),
        F.col("shares")[F.col("f")].alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """One row for each part, order of the filters and step.

    Filters fail a text of under 200 words (A), with fewer distinct words than half of its words (B),
    with over 2 % of capitals A-Z (C), with one of ``#$%&*|`` (D), and a text that a smaller id has too (E).

    Null texts are empty, a null part is the empty one.  A row with a null id is no copy and has no
    label; rows repeated with one id count each and aren't copies of each other.  A document is good
    (toxic) if any of its labels says so.  Further columns are ignored; without documents there are no rows.
    """
    scratch = Scratch(docs.sparkSession, "filter_audit")
    rows = scratch.save(flag_rows(docs, id_col, text_col, part_col))
    firsts = rows.where(F.col("doc").isNotNull()).groupBy("text_hash").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where("first < last").select("text_hash", "first")
    known = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("doc")).agg(F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"))
    copies = rows.join(firsts, "text_hash", "left").select("doc", "part", F.when(F.col("doc") > F.col("first"), F.col("fails").bitwiseOR(F.lit(_COPY))).otherwise(F.col("fails")).alias("fails"))
    flagged = copies.join(known, "doc", "left").select("part", "fails", *[(F.coalesce(c, F.lit(0)) == 1).alias(c) for c in ("good", "toxic")])
    return _report(scratch.save(subset_counts(flagged)))
