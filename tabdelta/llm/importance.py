"""Quality classifier by importance resampling over hashed n-grams.

Two generative models, of target text and of raw text, each give every hashed word
and word pair a probability.  A document's importance is the ratio of its likelihoods
under the two, and documents are sampled without replacement in proportion to it by
the Gumbel top-k trick: the k largest of log importance plus Gumbel noise.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch
from .textkit import map_text, mix64, slices, window_hashes, words_of

#: Hash buckets of the models; what is gathered and broadcast is bounded by this.
BUCKETS = 1 << 18
#: Labelled target documents that the target model is fitted on, at most.
TARGET_DOCS = 50_000
#: Pseudo-occurrences of each bucket in both models, on the target's scale.
SMOOTHING = 5.0


def features(text: str | None, buckets: int = BUCKETS) -> np.ndarray:
    """Buckets of all words and word pairs of a whole text, one for each place."""
    words = words_of(text)
    if not words:
        return np.empty(0, np.int64)
    hashes = window_hashes(words, 1)
    if len(words) > 1:
        hashes = np.concatenate([hashes, window_hashes(words, 2)])
    return (hashes % np.uint64(buckets)).astype(np.int64)


def bucket_counts(docs: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Raw and target counts per bucket of ``docs(is_target, text)``, summed within tasks first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for whole in batches:
            for batch in slices(whole, "text"):
                for hit, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    found = features(text, buckets)
                    np.add.at(raw, found, 1)
                    if hit:
                        np.add.at(target, found, 1)
        some = np.flatnonzero(raw)
        if len(some):
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(raw[some]), pa.array(target[some])], ["bucket", "raw", "target"])

    rows = docs.select("is_target", "text").mapInArrow(run, "bucket long, raw long, target long")
    return rows.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def log_ratios(counts: DataFrame, buckets: int = BUCKETS, smoothing: float = SMOOTHING) -> np.ndarray:
    """Log ratio of target to raw probability of each bucket; 0 everywhere without a target.

    Raw counts are brought to the size of the target text, and ``smoothing`` is added to
    both, so that a bucket seen a few times says little.
    """
    raw, target = np.zeros(buckets), np.zeros(buckets)
    for r in counts.toLocalIterator():
        raw[r["bucket"]], target[r["bucket"]] = r["raw"], r["target"]
    if not target.sum():
        return np.zeros(buckets)
    expected = raw * (target.sum() / raw.sum())
    return np.log((target + smoothing) / (expected + smoothing))


def gumbel(ids: np.ndarray, seed: int) -> np.ndarray:
    """Gumbel noise that depends on the id and the seed only."""
    bits = mix64(mix64(ids.astype(np.int64).view(np.uint64)) + np.uint64(seed))
    unit = ((bits >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53
    return -np.log(-np.log(unit))


def kth_largest(table: DataFrame, column: str, k: int, bins: int = 512, few: int = 4096) -> float:
    """The k-th largest value of a double column, exactly, without a global sort.

    Counts of equal slices of the value range narrow the place of the k-th value down
    until ``few`` values are left, or they are all alike.
    """
    low, high = table.agg(F.min(column), F.max(column)).first()
    above = 0
    while True:
        inside = table.where(F.col(column).between(low, high))
        slot = F.least(F.floor((F.col(column) - low) / (high - low) * bins), F.lit(bins - 1)) if high > low else F.lit(0)
        found = inside.groupBy(slot.cast("int").alias("slot")).agg(F.count("*").alias("n"), F.min(column).alias("lo"), F.max(column).alias("hi")).collect()
        for r in sorted(found, key=lambda r: -r["slot"]):
            if above + r["n"] >= k:
                break
            above += r["n"]
        if r["lo"] == r["hi"]:
            return r["lo"]
        if r["n"] <= few:
            rest = table.where(F.col(column).between(r["lo"], r["hi"])).select(column).collect()
            return sorted((x[0] for x in rest), reverse=True)[k - above - 1]
        low, high = r["lo"], r["hi"]


def resample(
    docs: DataFrame,
    target: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    share: float = 0.8,
    seed: int = 20,
    buckets: int = BUCKETS,
    target_docs: int = TARGET_DOCS,
) -> DataFrame:
    """Log importance, sampling key and ``kept`` of each row of ``docs``.

    ``target`` names the target documents in ``id_col``; at most ``target_docs`` of them,
    picked by a hash of the id, fit the target model.  The raw model counts all documents.
    ``kept`` marks the ceil(share * rows) largest keys; rows with the very same key as
    the last of these (the same id and text) are kept with it.

    Null and empty texts have log importance 0.  Each row of ``docs`` gets one row.  Ids that are no
    whole numbers draw noise by their hash; a null id draws the same noise each time.  Without target documents all importances are 0 and the
    sample is uniform.  An empty table gives an empty result.  Further columns are ignored.
    """
    spark = docs.sparkSession
    kind = dict(docs.dtypes)[id_col]
    texts = docs.select(id_col, F.col(text_col).cast("string").alias("text"))
    picked = target.where(F.col(id_col).isNotNull()).select(id_col).distinct().orderBy(F.xxhash64(id_col), id_col).limit(target_docs)
    flagged = texts.join(F.broadcast(picked.withColumn("is_target", F.lit(True))), id_col, "left")
    weights = spark.sparkContext.broadcast(log_ratios(bucket_counts(flagged, buckets), buckets))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        score = np.array([weights.value[features(t, buckets)].sum() for t in batch.column(1).to_pylist()])
        noise = gumbel(batch.column(2).to_numpy(zero_copy_only=False), seed)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array(score + noise)], [id_col, "log_weight", "sample_key"])

    whole = kind in ("tinyint", "smallint", "int", "bigint")
    number = F.coalesce(F.col(id_col).cast("long"), F.lit(0)) if whole else F.xxhash64(id_col)

    scratch = Scratch(spark, "importance")
    scored = scratch.save(map_text(texts.withColumn(f"{id_col}_number", number), run, f"{id_col} {kind}, log_weight double, sample_key double"))
    rows = scored.count()
    if not rows:
        return scored.withColumn("kept", F.lit(True))
    return scored.withColumn("kept", F.col("sample_key") >= kth_largest(scored, "sample_key", int(np.ceil(share * rows))))
