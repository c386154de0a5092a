"""Language identification by rank-order n-gram profiles.

A profile lists the most frequent letter n-grams of a language by rank.  A document's
own list is compared with each profile by the out-of-place distance: the sum, over its
n-grams, of how far each one stands from its rank in the profile, or the longest
possible distance where the profile lacks it.  The nearest profile wins.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .textkit import map_text, slices

#: Longest n-gram, and n-grams in a profile.
ORDERS = 3
PROFILE = 400
#: Documents per language from which profiles are learned at most.
TRAIN_DOCS = 20_000
UNKNOWN = "und"

_NOT_LETTERS = re.compile(r"[\W\d_]+")
#: Most distinct n-grams kept in a task before their counts are passed on.
_FLUSH = 500_000


def _letters(text: str) -> str:
    """Runs of letters (``str.isalpha``) in lower case, with a space between."""
    words = _NOT_LETTERS.sub(" ", text.lower())
    if not words.isascii():
        others = {c for c in set(words) if c != " " and not c.isalpha()}
        if others:
            words = re.sub(f"[{re.escape(''.join(sorted(others)))} ]+", " ", words)
    return words.strip()


def grams(text: str | None) -> np.ndarray:
    """Keys of all n-grams of the words of a text, one for each place; empty without letters.

    Words are runs of letters, in lower case, with a space before and after.  A key
    packs up to three code points of 21 bits.
    """
    letters = _letters(text) if text else ""
    if not letters:
        return np.empty(0, np.int64)
    codes = np.frombuffer(f" {letters} ".encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
    parts, key = [codes[codes != 32]], codes
    for n in range(2, ORDERS + 1):
        key = (key[:-1] << 21) | codes[n - 1 :]
        # an n-gram may begin or end with a space but doesn't cross from word to word
        inner = np.ones(len(key), bool)
        for k in range(1, n - 1):
            inner &= codes[k : k + len(key)] != 32
        parts.append(key[inner])
    return np.concatenate(parts)


def ranked(keys: np.ndarray, most: int = PROFILE) -> np.ndarray:
    """The most frequent keys, most frequent first; ties by key."""
    values, counts = np.unique(keys, return_counts=True)
    return values[np.lexsort((values, -counts))[:most]]


@dataclass
class Profiles:
    """Sorted keys of each language's profile with their ranks."""

    names: list[str]
    keys: list[np.ndarray]
    ranks: list[np.ndarray]

    @classmethod
    def of(cls, lists: dict[str, np.ndarray]) -> Profiles:
        names = sorted(lists)
        order = [np.argsort(lists[n]) for n in names]
        return cls(names, [lists[n][o] for n, o in zip(names, order, strict=True)], list(order))

    def predict(self, text: str | None) -> tuple[str, float]:
        """The nearest language and one minus its share of the longest distance.

        ``und`` with score 0 if the text has no letters or nothing was learned.
        """
        own = ranked(grams(text))
        if not len(own) or not self.names:
            return UNKNOWN, 0.0
        here = np.arange(len(own))
        far = []
        for keys, ranks in zip(self.keys, self.ranks, strict=True):
            at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
            place = np.where(keys[at] == own, np.abs(ranks[at] - here), PROFILE)
            far.append(int(place.sum()))
        best = int(np.argmin(far))  # the first name in order wins a tie
        return self.names[best], 1 - far[best] / (PROFILE * len(own))


def gram_counts(docs: DataFrame, lang_col: str, text_col: str) -> DataFrame:
    """Counts of each language's n-grams; each task sums its own before the shuffle."""

    def emit(held: dict[str, tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        for lang, (keys, counts) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys)), pa.array(keys), pa.array(counts)], ["lang", "gram", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for whole in batches:
            for batch in slices(whole, "text", 1 << 21):
                by: dict[str, list[np.ndarray]] = {}
                for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    by.setdefault(lang, []).append(grams(text))
                for lang, parts in by.items():
                    keys, counts = np.unique(np.concatenate(parts), return_counts=True)
                    if lang in held:
                        keys, inverse = np.unique(np.concatenate([held[lang][0], keys]), return_inverse=True)
                        counts = np.bincount(inverse, np.concatenate([held[lang][1], counts])).astype(np.int64)
                    held[lang] = keys, counts
                if sum(len(k) for k, _ in held.values()) > _FLUSH:
                    yield from emit(held)
                    held = {}
        yield from emit(held)

    rows = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "lang string, gram long, n long")
    return rows.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def learn_profiles(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", train_docs: int = TRAIN_DOCS) -> Profiles:
    """Profiles of the languages in ``lang_col``.

    A language with more than ``train_docs`` labelled rows is learned from that many at most, others
    from all their rows.  Rows are picked by a hash of what they hold and of their place,
    so rows that are alike are picked apart, and each language is filled up to the bound.
    """
    labelled = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    sizes = {r[0]: r[1] for r in labelled.groupBy(lang_col).count().collect()}
    if not sizes:
        return Profiles.of({})
    share = F.lit(1.0)
    for lang, n in sizes.items():
        if n > train_docs:
            # some more than the bound, of which the least hashes stay: fewer are as good as impossible
            share = F.when(F.col(lang_col) == lang, min(1.0, (train_docs + 10 * math.sqrt(train_docs) + 100) / n)).otherwise(share)
    spot = F.pmod(F.xxhash64(*docs.columns, F.monotonically_increasing_id(), F.lit(7)), F.lit(1 << 53))
    some = labelled.select(F.col(lang_col), F.col(text_col), spot.alias("_spot")).where(F.col("_spot") < share * float(1 << 53))
    least = F.row_number().over(Window.partitionBy(lang_col).orderBy("_spot", F.xxhash64(text_col)))
    picked = some.withColumn("_n", least).where(F.col("_n") <= train_docs).drop("_n", "_spot") if max(sizes.values()) > train_docs else labelled
    counts = gram_counts(picked, lang_col, text_col)
    # Spark drops all but the first PROFILE rows of a language before the shuffle
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    top = counts.withColumn("rank", place).where(F.col("rank") <= PROFILE).collect()
    lists: dict[str, list[tuple[int, int]]] = {}
    for r in top:
        lists.setdefault(r["lang"], []).append((r["rank"], r["gram"]))
    return Profiles.of({lang: np.array([g for _, g in sorted(x)], np.int64) for lang, x in lists.items()})


def identify(docs: DataFrame, profiles: Profiles, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``lang_pred`` and ``score`` of each whole text.

    Each row of ``docs`` gets one row, repeated rows and rows with a null id too.  Null
    and empty texts and texts without letters are ``und`` with score 0.  Further
    columns of ``docs`` are ignored.
    """
    model = docs.sparkSession.sparkContext.broadcast(profiles)
    kind = dict(docs.dtypes)[id_col]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [model.value.predict(t) for t in batch.column(1).to_pylist()]
        lang, score = zip(*found, strict=True)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64())], [id_col, "lang_pred", "score"])

    return map_text(docs.select(id_col, F.col(text_col).cast("string").alias("text")), run, f"{id_col} {kind}, lang_pred string, score double")


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a document is kept out of training: crc32 of its id as text mod 4 is 2."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))
