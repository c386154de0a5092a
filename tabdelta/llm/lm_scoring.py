"""Language-model scoring by cross-entropy difference.

Two word bigram models, of the target documents and of all documents as background,
are matched: they share one vocabulary, the same bigrams and the same smoothing, and
differ only in their counts.  A document's score is its cross-entropy under the target
model less that under the background model, in bits per token; low scores look like
the target.

Counts cover every document, and every word and every bigram is kept, so the models grow
with the corpus.  They are never gathered: texts are dealt into chunks, a chunk asks for its
distinct words and bigrams with its own counts, packed in sorted order, each bucket of
hashes adds up what all chunks ask for and answers in the same order, and a chunk's texts are
scored where its answers meet them.

With ``min_share`` both models are bounded instead: words and bigrams of a smaller share
of the tokens are one unknown word or are scored by their words, and both tables are broadcast.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .scratch import Scratch, broadcast_if_small
from .textkit import BATCH_BYTES, map_text, mix64, slices, window_hashes, words_of

#: Strength of the word model in the bigram model, in tokens.
PRIOR = 50.0
#: Labels up to this number are broadcast; beyond it they are joined by a shuffle.
BROADCAST_LABELS = 2_000_000
#: Most distinct entries summed in a task before they are passed on.
_FLUSH = 400_000
#: Bytes of text of a chunk, bytes of all text for each bucket of hashes, and log of the fewest buckets.
CHUNK_BYTES = 4 << 20
BUCKET_BYTES = 16 << 20
FEWEST_BUCKETS = 8
#: Stands before the first word of a text.
_START = np.uint64(0x2545F4914F6CDD1D)
#: What a chunk asks for: words and bigrams.
_WORD, _PAIR = 0, 1


def word_counts(docs: DataFrame) -> DataFrame:
    """``word, n, n_target`` of ``docs(is_target, text)``; a word is given by its hash."""

    def emit(every: Counter, target: Counter) -> pa.RecordBatch:
        words = list(every)
        columns = [window_hashes(words, 1).view(np.int64), [every[w] for w in words], [target[w] for w in words]]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["word", "n", "n_target"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every: Counter = Counter()
        target: Counter = Counter()
        for whole in batches:
            for batch in slices(whole, "text"):
                for hit, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    words = words_of(text)
                    every.update(words)
                    if hit:
                        target.update(words)
                if len(every) > _FLUSH:
                    yield emit(every, target)
                    every, target = Counter(), Counter()
        if every:
            yield emit(every, target)

    rows = docs.select("is_target", "text").mapInArrow(run, "word long, n long, n_target long")
    return rows.groupBy("word").agg(F.sum("n").alias("n"), F.sum("n_target").alias("n_target"))


@dataclass
class Vocabulary:
    """Word hashes in order with their counts; the last entry of the counts is the unknown word."""

    words: np.ndarray
    counts: np.ndarray  # columns: all, target

    @property
    def size(self) -> int:
        """Ids below this are words, the unknown word and the start of a text."""
        return len(self.words) + 2

    def ids(self, words: list[bytes]) -> np.ndarray:
        """Ids of a text's words, after the id of its start."""
        out = np.empty(len(words) + 1, np.int64)
        out[0] = len(self.words) + 1
        found = window_hashes(words, 1).view(np.int64)
        at = np.minimum(np.searchsorted(self.words, found), max(len(self.words) - 1, 0))
        known = self.words[at] == found if len(self.words) else np.zeros(len(found), bool)
        out[1:] = np.where(known, at, len(self.words))
        return out


def bigram_counts(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """``pair, n, n_target``: a pair is the first id times the vocabulary's size plus the second."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def merged(parts: list[np.ndarray], weights: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        keys, inverse = np.unique(np.concatenate(parts), return_inverse=True)
        weight = np.concatenate(weights)
        return keys, np.stack([np.bincount(inverse, weight[:, k], len(keys)) for k in (0, 1)], axis=1).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = shared.value
        keys, counts = np.empty(0, np.int64), np.empty((0, 2), np.int64)
        for whole in batches:
            for batch in slices(whole, "text", 1 << 22):
                parts, weights = [keys], [counts]
                for hit, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    ids = vocab.ids(words_of(text))
                    pairs = ids[:-1] * vocab.size + ids[1:]
                    parts.append(pairs)
                    weights.append(np.tile(np.array([[1, 1 if hit else 0]], np.int64), (len(pairs), 1)))
                keys, counts = merged(parts, weights)
                if len(keys) > _FLUSH:
                    yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts[:, 0]), pa.array(counts[:, 1])], ["pair", "n", "n_target"])
                    keys, counts = keys[:0], counts[:0]
        if len(keys):
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts[:, 0]), pa.array(counts[:, 1])], ["pair", "n", "n_target"])

    rows = docs.select("is_target", "text").mapInArrow(run, "pair long, n long, n_target long")
    return rows.groupBy("pair").agg(F.sum("n").alias("n"), F.sum("n_target").alias("n_target"))


@dataclass
class Models:
    """Both models as arrays: column 0 background, column 1 target."""

    vocabulary: Vocabulary
    word_p: np.ndarray
    pairs: np.ndarray
    pair_n: np.ndarray
    follow_n: np.ndarray

    @classmethod
    def of(cls, vocabulary: Vocabulary, pairs: np.ndarray, pair_n: np.ndarray) -> Models:
        counts = np.vstack([vocabulary.counts, np.zeros((1, 2))]) + 1.0
        follow = np.stack([np.bincount(pairs // vocabulary.size, pair_n[:, k], vocabulary.size) for k in (0, 1)], axis=1)
        return cls(vocabulary, counts / counts.sum(axis=0), pairs, pair_n, follow)

    def losses(self, text: str | None) -> np.ndarray:
        """Bits of each token of a text under the background and the target model."""
        ids = self.vocabulary.ids(words_of(text))
        pairs = ids[:-1] * self.vocabulary.size + ids[1:]
        seen = np.zeros((len(pairs), 2))
        if len(self.pairs):
            at = np.minimum(np.searchsorted(self.pairs, pairs), len(self.pairs) - 1)
            seen = np.where((self.pairs[at] == pairs)[:, None], self.pair_n[at], 0)
        p = (seen + PRIOR * self.word_p[ids[1:]]) / (self.follow_n[ids[:-1]] + PRIOR)
        return -np.log2(p)


def fit_models(docs: DataFrame, min_share: float) -> Models:
    """Count ``docs(is_target, text)`` and build both models.

    Of the counts of words and of bigrams at most 1 / ``min_share`` rows each reach the
    driver; entries seen once are left out at any size.
    """
    scratch = Scratch(docs.sparkSession, "lm_scoring")
    seen = Observation()
    words = word_counts(docs).observe(seen, F.sum("n").alias("n"), F.sum("n_target").alias("n_target"))
    saved = scratch.save(words.where(F.col("n") >= 2))
    total = np.array([seen.get["n"] or 0, seen.get["n_target"] or 0], float)
    least = max(2.0, min_share * total[0])
    table = saved.where(F.col("n") >= least).orderBy("word").toArrow()
    counts = np.stack([table[c].to_numpy().astype(float) for c in ("n", "n_target")], axis=1)
    vocabulary = Vocabulary(table["word"].to_numpy(), np.vstack([counts, total - counts.sum(axis=0)]))
    scratch.drop(saved)
    pairs = bigram_counts(docs, vocabulary).where(F.col("n") >= least).toArrow()
    order = np.argsort(pairs["pair"].to_numpy())
    pair_n = np.stack([pairs[c].to_numpy().astype(float) for c in ("n", "n_target")], axis=1)
    return Models.of(vocabulary, pairs["pair"].to_numpy()[order], pair_n[order])


@dataclass
class Tokens:
    """All tokens of some texts: hashes of the word, of the one before it and of both."""

    length: np.ndarray
    word: np.ndarray
    before: np.ndarray
    pair: np.ndarray

    @classmethod
    def of(cls, texts: list[str | None]) -> Tokens:
        held = [words_of(t) for t in texts]
        length = np.fromiter(map(len, held), np.int64, len(held))
        word = window_hashes(list(chain.from_iterable(held)), 1)
        before = np.concatenate([word[:0], word[-1:], word[:-1]])
        before[(np.cumsum(length) - length)[length > 0]] = _START
        return cls(length, word, before, mix64(mix64(before) + word))

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct words and starts in order, and the places in them of all words, then of all before."""
        return np.unique(np.concatenate([self.word, self.before]), return_inverse=True)

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        return np.unique(self.pair, return_inverse=True)

    def counts(self, is_target: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Kind, keys and a column of counts each for all and target documents; of words also as the word before."""
        hit = np.repeat(is_target.astype(float), self.length)
        keys, at = self.words()
        n, k = len(self.word), len(keys)
        columns = [np.bincount(x, w, k) for x in (at[:n], at[n:]) for w in (None, hit)]
        yield _WORD, keys, np.stack(columns, axis=1)
        keys, at = self.pairs()
        yield _PAIR, keys, np.stack([np.bincount(at, w, len(keys)) for w in (None, hit)], axis=1)


def _planes(x: np.ndarray) -> bytes:
    """The first bytes of all numbers, then the second ones; those that are all alike pack well."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.itemsize).T.tobytes()


def _of_planes(data: bytes, dtype: str) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(np.dtype(dtype).itemsize, -1).T).view(dtype).ravel()


def _chunks(docs: DataFrame, kind: str) -> DataFrame:
    """``docs(id, is_target, text)`` with the chunk of each row and its place there."""
    limit = CHUNK_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, held, pos = TaskContext.get().partitionId() << 32, 0, 0
        for part in (p for batch in batches for p in slices(batch, "text", min(limit, BATCH_BYTES))):
            size = part.column(2).nbytes
            if pos and held + size > limit:
                chunk, held, pos = chunk + 1, 0, 0
            n = part.num_rows
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.full(n, chunk, np.int64)), pa.array(np.arange(pos, pos + n, dtype=np.int32))], [*part.schema.names, "chunk", "pos"])
            held, pos = held + size, pos + n

    return docs.select("id", "is_target", "text").mapInArrow(run, f"id {kind}, is_target boolean, text string, chunk long, pos int")


def _asked(rows: DataFrame, bits: int) -> DataFrame:
    """What chunks ask of each bucket.

    A chunk that is read in pieces asks once for each, named by the first place in it.
    """
    names = ["chunk", "part", "kind", "bucket", "keys", "counts"]
    types = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]

    def asked(chunk: int, part: int, texts: list[str | None], hits: list[bool | None]) -> pa.RecordBatch:
        out = []
        for kind, keys, counts in Tokens.of(texts).counts(np.array([bool(h) for h in hits], bool)):
            bucket = (keys >> np.uint64(64 - bits)).astype(np.int64)
            cuts = np.append(np.flatnonzero(np.diff(bucket, prepend=-1)), len(keys))
            for a, b in zip(cuts.tolist(), cuts[1:].tolist(), strict=False):
                out.append((chunk, part, kind, int(bucket[a]), _planes(np.diff(keys[a:b], prepend=np.uint64(0))), _planes(counts[a:b].T.astype("<u4"))))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out, strict=True)) or [()] * 6, types, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = part = end = -1
        texts: list[str | None] = []
        hits: list[bool | None] = []
        for batch in (p for whole in batches for p in slices(whole, "text")):
            t = {n: batch.column(n).to_numpy(zero_copy_only=False) for n in ("chunk", "pos")}
            new = np.concatenate([[True], (t["chunk"][1:] != t["chunk"][:-1]) | (t["pos"][1:] != t["pos"][:-1] + 1)])
            cuts = [*np.flatnonzero(new).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if (int(t["chunk"][a]), int(t["pos"][a])) != (chunk, end):
                    if texts:
                        yield asked(chunk, part, texts, hits)
                    chunk, part, texts, hits = int(t["chunk"][a]), int(t["pos"][a]), [], []
                texts += batch.column("text").slice(a, b - a).to_pylist()
                hits += batch.column("is_target").slice(a, b - a).to_pylist()
                end = int(t["pos"][b - 1]) + 1
        if texts:
            yield asked(chunk, part, texts, hits)

    return rows.select("chunk", "pos", "is_target", "text").mapInArrow(run, "chunk long, part int, kind int, bucket int, keys binary, counts binary")


def _answers(asked: DataFrame) -> DataFrame:
    """``chunk, part, kind, bucket, counts``: the counts of the whole corpus for the keys asked for, in their order.

    A row without a chunk holds the bucket's number of words and tokens of all and of target documents.
    """

    def answer(table: pa.Table) -> pa.Table:
        kind, bucket = table["kind"][0].as_py(), table["bucket"][0].as_py()
        width = 4 if kind == _WORD else 2
        keys = [np.cumsum(_of_planes(x, "<u8"), dtype=np.uint64) for x in table["keys"].to_pylist()]
        counts = np.concatenate([_of_planes(x, "<u4").reshape(width, -1) for x in table["counts"].to_pylist()], axis=1)
        ends = np.cumsum([len(k) for k in keys]).tolist()
        at = np.unique(np.concatenate(keys), return_inverse=True)[1]
        del keys
        total = np.stack([np.bincount(at, c).astype("<i8") for c in counts])
        del counts
        out = [_planes(total[:, at[a:b]]) for a, b in zip([0, *ends[:-1]], ends, strict=True)]
        rows = [(c, p, kind, bucket, x, None, None, None) for c, p, x in zip(table["chunk"].to_pylist(), table["part"].to_pylist(), out, strict=True)]
        if kind == _WORD:
            rows.append((None, None, kind, bucket, None, int((total[0] > 0).sum()), int(total[0].sum()), int(total[1].sum())))
        types = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), *[pa.int64()] * 3]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["chunk", "part", "kind", "bucket", "counts", "words", "n", "n_target"])

    schema = "chunk long, part int, kind int, bucket int, counts binary, words long, n long, n_target long"
    return asked.groupBy("kind", "bucket").applyInArrow(answer, schema)


def _whole_scores(docs: DataFrame, id_col: str, kind: str) -> DataFrame:
    """Scores of ``docs(id, is_target, text)`` by models of all words and bigrams."""
    scratch = Scratch(docs.sparkSession, "lm_scoring")
    n_bytes = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(FEWEST_BUCKETS, (n_bytes // BUCKET_BYTES).bit_length())
    rows = scratch.save(_chunks(docs, kind), compression="zstd")
    answers = scratch.save(_answers(_asked(rows, bits)), compression="zstd")
    size = answers.where(F.col("chunk").isNull()).agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("words", "n", "n_target")]).first()
    norm = np.array([size[1], size[2]], float) + size[0] + 2

    def whole(found: list[dict], part: int, kind: int, width: int) -> np.ndarray:
        """A part's answers of a kind, by bucket, which is the order of its keys."""
        own = sorted((r["bucket"], r["counts"]) for r in found if r["part"] == part and r["kind"] == kind)
        return np.concatenate([_of_planes(c, "<i8").reshape(width, -1) for _, c in own], axis=1).T

    def score(texts: pa.Table, found: pa.Table) -> pa.Table:
        texts, answered = texts.sort_by("pos"), found.to_pylist()
        length, sums = np.zeros(texts.num_rows, np.int64), np.zeros((3, texts.num_rows))
        parts = sorted({r["part"] for r in answered})
        cuts = [*np.searchsorted(texts["pos"].to_numpy(), parts).tolist(), texts.num_rows]
        for part, a, b in zip(parts, cuts, cuts[1:], strict=False):
            tokens = Tokens.of(texts["text"].slice(a, b - a).to_pylist())
            n, at, pair_at = len(tokens.word), tokens.words()[1], tokens.pairs()[1]
            words, pairs = whole(answered, part, _WORD, 4), whole(answered, part, _PAIR, 2)
            p = (pairs[pair_at] + PRIOR * (words[at[:n], :2] + 1) / norm) / (words[at[n:], 2:] + PRIOR)
            bits = -np.log2(p)
            doc = np.repeat(np.arange(b - a), tokens.length)
            length[a:b] = tokens.length
            sums[:, a:b] = [np.bincount(doc, x, b - a) for x in (bits[:, 1], bits[:, 0], bits[:, 1] - bits[:, 0])]
        columns = [texts["id"], pa.array(length), *[pa.array(x / np.maximum(length, 1), mask=length == 0) for x in sums]]
        return pa.Table.from_arrays(columns, [id_col, "n_tokens", "ce_target", "ce_background", "score"])

    texts = rows.select("chunk", "pos", "id", "text")
    found = answers.where(F.col("chunk").isNotNull()).select("chunk", "part", "kind", "bucket", "counts")
    return texts.groupBy("chunk").cogroup(found.groupBy("chunk")).applyInArrow(score, f"{id_col} {kind}, n_tokens long, ce_target double, ce_background double, score double")


def cross_entropy_difference(
    docs: DataFrame,
    target: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_share: float | None = None,
) -> DataFrame:
    """``n_tokens``, both cross-entropies in bits per token and their difference ``score``.

    The models hold every word and bigram.  With ``min_share`` they hold those of this
    share of the tokens or more that occur twice at least, at most 1 / ``min_share`` of each.

    ``target`` names the documents of the target model in ``id_col``.  Words are folded to
    lower case (A-Z).  Each row of ``docs`` gets one row.  Null, empty and blank texts
    have no tokens: their cross-entropies and score are null.  Rows with a null id are
    background and are scored.  Repeated rows count each time.  Without target documents
    both models smooth to the vocabulary and the target's is uniform.  An empty table gives
    an empty result.  Further columns are ignored.
    """
    spark = docs.sparkSession
    kind = dict(docs.dtypes)[id_col]
    texts = docs.select(id_col, F.col(text_col).cast("string").alias("text"))
    names = target.where(F.col(id_col).isNotNull()).select(id_col).distinct().withColumn("is_target", F.lit(True))
    marked = texts.join(broadcast_if_small(names, BROADCAST_LABELS), id_col, "left")
    if min_share is None:
        return _whole_scores(marked.select(F.col(id_col).alias("id"), "is_target", "text"), id_col, kind)
    models = spark.sparkContext.broadcast(fit_models(marked, min_share))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: list[tuple[int, float | None, float | None, float | None]] = []
        for text in batch.column(1).to_pylist():
            bits = models.value.losses(text)
            if len(bits):
                background, own = bits.mean(axis=0).tolist()
                out.append((len(bits), own, background, float((bits[:, 1] - bits[:, 0]).mean())))
            else:
                out.append((0, None, None, None))
        columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), [pa.int64(), *[pa.float64()] * 3], strict=True)]
        return pa.RecordBatch.from_arrays([batch.column(0), *columns], [id_col, "n_tokens", "ce_target", "ce_background", "score"])

    return map_text(texts, run, f"{id_col} {kind}, n_tokens long, ce_target double, ce_background double, score double")
