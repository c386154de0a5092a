"""Spelling variants: words one edit from a far more frequent word, by an even-partition pigeonhole join.

If two words differ by one edit, one of two segments of the shorter word is whole in the longer one.
Each word is indexed under its two even segments, which its length fixes; a word probes with the segments of
its own length and with those of words one shorter, whose second one is shifted by one place.  Words
that meet are candidates; they are told apart by one edit and each pair counts once.

A segment that very many words share makes no product of them: the rest of such a word is split in
two again, and the words meet under all but one quarter, all but one eighth, and so on, until few share
a key.  A rest of one code point is shared by as many words as there are letters at most.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch
from .textkit import slices

SHORTEST = 7
LEAST = 2
#: A form is this many times as frequent as its variant.
RATIO = 10
#: Words that share a key at most before the rest of them is split.
CROWD = 512
#: Distinct words that a task keeps before their counts are passed on.
_FLUSH = 400_000
_RUN = re.compile(f"[A-Za-zÀ-ÿ]{{{SHORTEST},}}")


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``word, n`` of all words of ``SHORTEST`` code points or more.

    Words are runs of Latin letters, A-Z in lower case.  Where 31 divides the crc32 of
    ``<id>:<word>``, the word loses the code point at that crc32 modulo its length.
    """

    def emit(held: dict[str, int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, int] = {}
        for whole in batches:
            for batch in slices(whole, "text"):
                for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    if not text:
                        continue
                    own: dict[str, int] = {}
                    for w in _RUN.findall(text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")):
                        own[w] = own.get(w, 0) + 1
                    start = zlib.crc32(f"{'' if doc is None else doc}:".encode())
                    for w, n in own.items():
                        h = zlib.crc32(w.encode(), start)
                        if h % 31 == 0:
                            k = h % len(w)
                            w = w[:k] + w[k + 1 :]
                            if len(w) < SHORTEST:
                                continue
                        held[w] = held.get(w, 0) + n
                if len(held) > _FLUSH:
                    yield emit(held)
                    held = {}
        if held:
            yield emit(held)

    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _windows(low: Column, high: Column) -> Column:
    """The two halves of a window of places."""
    middle = F.floor((low + high) / 2).cast("int")
    return F.array(F.struct(low.alias("low"), middle.alias("high")), F.struct(middle.alias("low"), high.alias("high")))


def _keyed(rows: DataFrame) -> DataFrame:
    """Rows ``word, n, length, shift, low, high`` with the key under which they meet.

    It is made of what is left and right of the window ``low .. high`` of an indexed word of ``length``; in a word
    that is one longer (``shift`` 1) the right part starts one place later.
    """
    left = F.substring("word", F.lit(1), F.col("low"))
    right = F.substring("word", F.col("high") + F.col("shift") + 1, F.col("length") - F.col("high"))
    return rows.withColumn("key", F.xxhash64("length", "low", "high", left, right))


def _met(rows: DataFrame) -> DataFrame:
    """Pairs ``a, n_a, b, n_b`` of keyed rows that are one edit apart; ``a`` is indexed, ``b`` probes."""
    a = rows.where("shift = 0").select("key", F.col("word").alias("a"), F.col("n").alias("n_a"))
    b = rows.select("key", F.col("word").alias("b"), F.col("n").alias("n_b"), "shift")
    # words of one length meet once, as a < b
    apart = ((F.col("shift") == 1) | (F.col("a") < F.col("b"))) & (F.levenshtein("a", "b", 1) == 1)
    return a.join(b, (a["key"] == b["key"]) & apart).select("a", "n_a", "b", "n_b")


def near_words(words: DataFrame, crowd: int = CROWD) -> DataFrame:
    """``a, n_a, b, n_b`` of all pairs of ``words(word, n)`` that are one insertion, deletion or replacement apart, each pair once."""
    scratch = Scratch(words.sparkSession, "spelling")
    size = F.length("word")
    shifts = F.array(F.struct(size.alias("length"), F.lit(0).alias("shift")), F.struct((size - 1).alias("length"), F.lit(1).alias("shift")))
    whole = words.select("word", "n", F.inline(shifts)).withColumns({"low": F.lit(0), "high": F.col("length")})
    found = None
    while True:
        split = whole.where("length > 0").select("word", "n", "length", "shift", F.inline(_windows(F.col("low"), F.col("high")))).where("low < high")
        keyed = scratch.save(_keyed(split))
        full = scratch.save(keyed.groupBy("key").agg(F.count("*").alias("size"), F.first("low").alias("from"), F.first("high").alias("to")).where((F.col("size") > crowd) & (F.col("to") - F.col("from") > 1)).select("key"))
        crowded = not full.isEmpty()
        pairs = scratch.save(_met(keyed.join(full, "key", "left_anti") if crowded else keyed))
        found = pairs if found is None else found.unionAll(pairs)
        if not crowded:
            # an inserted letter beside its like is met in both halves
            return found.distinct()
        whole = keyed.join(full, "key", "left_semi")


def roots(forms: DataFrame, scratch: Scratch) -> DataFrame:
    """``word, root`` of ``forms(word, form)``: forms are followed to the last, twice as far each round."""
    table = forms.select("word", F.col("form").alias("root"))
    while True:
        further = table.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = scratch.save(table.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        table = step.select("word", "root")
        if step.where("moved").isEmpty():
            return table


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", crowd: int = CROWD) -> DataFrame:
    """``word, n, n_near, form, form_n, root`` of the words that occur ``LEAST`` times or more.

    A word's form is its near word with the most occurrences (the first in code-point order of equals) if it has
    ``RATIO`` times as many as the word; its root is where its forms lead, itself without a form.

    Null texts have no words; a null id counts as an empty one; rows repeated count each.  Further columns of
    ``docs`` are ignored, and an empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "spelling")
    words = scratch.save(word_counts(docs, id_col, text_col).where(F.col("n") >= LEAST))
    near = near_words(words, crowd)
    both = near.select(F.col("a").alias("word"), F.col("b").alias("other"), F.col("n_b").alias("other_n")).unionAll(near.select(F.col("b").alias("word"), F.col("a").alias("other"), F.col("n_a").alias("other_n")))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("best"))
    form = F.when(-F.col("best.less") >= RATIO * F.col("n"), F.col("best"))
    table = scratch.save(words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), form["other"].alias("form"), (-form["less"]).alias("form_n")))
    ends = roots(table.where("form IS NOT NULL"), scratch)
    return table.join(ends, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
