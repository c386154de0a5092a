"""Benchmark decontamination by size-partitioned MinHash containment search.

Short test items are sought inside long documents.  A document as a whole has almost
no Jaccard similarity with an item, so items are partitioned by size and each size
class is sought in overlapping document windows in proportion to it: four times the
least size of the class long, with steps of half that.  Every occurrence of an item
then lies wholly in some window that it fills to a fifth or more, and with ``BANDS``
one-row bands a window with a similarity of 0.19 goes unseen with a chance of about
1e-6.  Items found are verified by exact containment of their shingles in the
document.

An item that a document holds in pieces, scattered over more than a window, is found by its signature as
a whole: the shingles that are its minima are a sample of it, and if a document holds half of
them anywhere, the item is verified too.

A band can only agree if the window holds the very shingle that is the item's minimum,
so signatures are made only of windows that hold such a shingle; the outcome is the
same as with all signatures.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch
from .textkit import map_text, mix64, window_hashes, words_of

#: One-row MinHash bands.
BANDS = 64
_SEEDS = mix64(np.arange(1, BANDS + 1, dtype=np.uint64))


def signature(hashes: np.ndarray) -> np.ndarray:
    """Minimum of each permutation over a set of shingle hashes."""
    return np.array([mix64(hashes ^ s).min() for s in _SEEDS])


class ItemIndex:
    """MinHash bands of test items, by the width of their shingles and their size class."""

    def __init__(self, items: list[tuple[int, str]], width: int):
        self.width = width
        self.sets: list[tuple[int, int, np.ndarray]] = []
        bands: dict[tuple[int, int], dict[tuple[int, int], list[int]]] = defaultdict(lambda: defaultdict(list))
        anchors: dict[tuple[int, int], set[int]] = defaultdict(set)
        minima: list[set[int]] = []
        for item_id, text in items:
            words = words_of(text)
            if not words:
                continue
            shingles = np.unique(window_hashes(words, width))
            part = (min(width, len(words)), int(len(shingles)).bit_length() - 1)
            minima.append(set())
            for i, seed in enumerate(_SEEDS):
                values = mix64(shingles ^ seed)
                k = int(values.argmin())
                bands[part][i, int(values[k])].append(len(self.sets))
                minima[-1].add(int(shingles[k]))
            anchors[part] |= minima[-1]
            self.sets.append((item_id, part[0], shingles))
        self.parts = {
            part: (np.array(sorted(anchors[part]), np.uint64), dict(bands[part])) for part in sorted(bands)
        }
        #: Items of each anchor, and how many anchors each item has.
        self.owners: dict[int, list[int]] = defaultdict(list)
        self.n_anchors = [len(x) for x in minima]
        for k, own in enumerate(minima):
            for x in own:
                self.owners[x].append(k)

    def search(self, text: str | None, least: float) -> list[tuple[int, int, int]]:
        """(item, shared shingles, shingles of the item) of the items contained in a text."""
        words = words_of(text)
        found: set[int] = set()
        hashes: dict[int, np.ndarray] = {}
        for (width, size), (anchors, bands) in self.parts.items():
            if len(words) < width:
                continue
            if width not in hashes:
                hashes[width] = window_hashes(words, width)
            h = hashes[width]
            at = np.searchsorted(anchors, h)
            hits = np.flatnonzero(anchors[np.minimum(at, len(anchors) - 1)] == h)
            held = Counter(k for x in set(h[hits].tolist()) for k in self.owners[x])
            found.update(k for k, n in held.items() if 2 * n >= self.n_anchors[k] and self.sets[k][1] == width)
            length = 1 << (size + 2)
            step = length // 2
            # window k holds the shingles from k * step to k * step + length
            starts = np.unique(np.concatenate([hits // step, np.maximum(hits // step - 1, 0)])) * step
            for start in starts.tolist():
                for i, value in enumerate(signature(h[start : start + length]).tolist()):
                    found.update(bands.get((i, value), ()))
        out = []
        for k in found:
            item_id, width, shingles = self.sets[k]
            shared = int(np.isin(shingles, hashes[width]).sum())
            if shared >= least * len(shingles):
                out.append((item_id, shared, len(shingles)))
        return out


def decontaminate(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    width: int = 5,
    least: float = 0.8,
    block: int = 20_000,
    block_bytes: int = 16 << 20,
) -> DataFrame:
    """Pairs of a document and a test item of whose shingles it holds ``least`` or more.

    Items are the stated query set: they go to the executors in blocks of about
    ``block`` items and ``block_bytes`` of their texts, each sought in all documents.  Documents
    are neither shuffled nor cut.

    Texts are folded to lower case (A-Z) and split at white space.  An item with fewer
    than ``width`` words is one sequence of its own length.  Null, empty and blank
    documents and items match nothing; rows with a null id take no part.  Rows repeated
    in ``docs`` or ``items`` give repeated pairs.  Empty tables give an empty result.
    """
    spark = docs.sparkSession
    kinds = dict(docs.dtypes)[id_col], dict(items.dtypes)[item_col]
    schema = f"{id_col} {kinds[0]}, {item_col} {kinds[1]}, n_shared long, n_item long, containment double"
    texts = docs.where(F.col(id_col).isNotNull()).select(id_col, F.col(text_col).cast("string").alias("text"))
    sought = items.where(F.col(item_col).isNotNull() & F.col(item_text_col).isNotNull()).select(item_col, item_text_col)
    size = sought.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(F.col(item_text_col).cast("string"))), F.lit(0))).first()
    blocks = max(1, math.ceil(size[0] / block), math.ceil(size[1] / block_bytes))
    out: DataFrame | None = None
    for k in range(blocks):
        part = sought.where(F.pmod(F.xxhash64(item_col), F.lit(blocks)) == k)
        index = spark.sparkContext.broadcast(ItemIndex([tuple(r) for r in part.collect()], width))

        def run(batch: pa.RecordBatch, index=index) -> pa.RecordBatch:
            rows = [
                (d, i, shared, size, shared / size)
                for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
                for i, shared, size in index.value.search(t, least)
            ]
            columns = list(zip(*rows, strict=True)) or [()] * 5
            names = [id_col, item_col, "n_shared", "n_item", "containment"]
            kind = [batch.schema.field(0).type, None, pa.int64(), pa.int64(), pa.float64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kind, strict=True)], names)

        found = map_text(texts, run, schema)
        out = found if out is None else out.unionAll(found)
    return out


def remove_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without those that ``decontaminate`` pairs with an item; rows with a null id stay.

    Rows go by id: if an id has several texts, all go with the one that holds an item.
    """
    pairs = decontaminate(docs, items, id_col, text_col, **options)
    return docs.join(Scratch(docs.sparkSession, "decontaminate").save(pairs.select(id_col).distinct()), id_col, "left_anti")
