"""Best-fit packing of tokenised documents by the sum-of-squares rule.

A document goes where the squared numbers of open sequences per residual gap, summed
over all gaps, become smallest; that keeps many different gaps open for what comes.

Pieces are dealt by a hash into groups of about ``GROUP`` pieces, and each group is
packed on its own, longest piece first.  A group costs a few sequences that aren't
full at most, so the loss against packing everything at once is a fraction of a
percent at any size, and no task holds more than one group.
"""

from __future__ import annotations

import math
import os
import string
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .scratch import Scratch
from .textkit import map_text

#: Tokens in a sequence.
CAPACITY = 4096
#: Pieces packed together, about.
GROUP = 16_384
#: Words whose ids a worker keeps, about; beyond it the half used last stays.
_KNOWN = 500_000
#: Runs of signs whose ids it keeps, about.
_TAILS = 10_000
#: Signs that the tokenizer cuts off from letters before them; an apostrophe may stay with the letters behind it.
_SIGNS = string.punctuation.replace("'", "")

_encoders: dict[str, Encoder] = {}


class Encoder:
    """Token ids of texts under a tokenizer that drops white space and lower-cases.

    Such a tokenizer treats what stands between spaces on its own, so a worker encodes
    each distinct word once and keeps its ids.  New words of letters alone are encoded many
    at a time and told apart by the tokens that end a word; signs behind letters are encoded once.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.words = pa.array([], pa.large_binary())
        self.ids = np.empty(0, "<u4")  # of all words, one after another
        self.bounds = np.zeros(1, np.int64)
        self.used = np.empty(0, np.int64)  # when a word was last asked for
        self.turn = 0
        ends = sorted(i for token, i in self.tokenizer.get_vocab().items() if token.endswith("</w>"))
        self.is_end = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.is_end[ends] = True
        # added tokens are sought in the text as it is, inside of words too; texts that may hold one are encoded whole
        self.added = [t.content.lower().encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.tails: dict[str, bytes] = {}

    @classmethod
    def at(cls, path: str) -> Encoder:
        if path not in _encoders:
            _encoders[path] = cls(path)
        return _encoders[path]

    def _apart(self, words: list[str]) -> list[bytes]:
        return [np.array(f.ids, "<u4").tobytes() for f in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _together(self, words: list[str]) -> list[bytes]:
        """Ids of words of letters."""
        out: list[bytes] = []
        for block in (words[i : i + 256] for i in range(0, len(words), 256)):
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(block)], add_special_tokens=False)[0].ids, "<u4")
            last = (np.flatnonzero(self.is_end[ids]) + 1) * 4
            if len(last) != len(block):  # a letter that falls apart when lower-cased
                out += self._apart(block)
                continue
            data, at = ids.tobytes(), 0
            for end in last.tolist():
                out.append(data[at:end])
                at = end
        return out

    def _learn(self, words: list[str]) -> list[bytes]:
        """Ids of new words; letters and the signs behind them are pieces of their own to the tokenizer."""
        if len(self.tails) > _TAILS:
            self.tails.clear()
        made: dict[str, bytes] = {}
        letters, other, marked = [], [], []
        for w in words:
            if w.isalpha():
                letters.append(w)
                continue
            stem = w.rstrip(_SIGNS)
            # some letters are composed or folded into a letter and a mark, which goes with the signs
            if len(stem) < len(w) <= len(stem) + 8 and stem.isalpha() and (stem.isascii() or unicodedata.normalize("NFC", stem).lower().isalpha()):
                marked.append((w, stem, w[len(stem) :]))
            else:
                other.append(w)
        stems = list({stem for _, stem, _ in marked}.difference(letters))
        known = self._known(pa.array([x.encode("utf-8", "surrogatepass") for x in stems], pa.large_binary())).to_pylist()
        made.update((x, self.ids[self.bounds[k] : self.bounds[k + 1]].tobytes()) for x, k in zip(stems, known, strict=True) if k is not None)
        letters += [x for x, k in zip(stems, known, strict=True) if k is None]
        tails = list({tail for _, _, tail in marked}.difference(self.tails))
        self.tails.update(zip(tails, self._apart(tails), strict=True))
        for some, encode in ((letters, self._together), (other, self._apart)):
            made.update(zip(some, encode(some), strict=True))
        made.update((w, made[stem] + self.tails[tail]) for w, stem, tail in marked)
        return [made[w] for w in words]

    def _known(self, words: pa.Array) -> pa.Array:
        return pc.index_in(words, value_set=self.words)

    def _places(self, words: pa.Array) -> np.ndarray:
        """Places of distinct words among those kept; new ones are learned, and the ones longest unused go if there are too many."""
        self.turn += 1
        if len(self.words) > _KNOWN:
            stay = np.sort(np.argsort(self.used, kind="stable")[-_KNOWN // 2 :])
            size = np.diff(self.bounds)
            self.ids = self.ids[np.repeat(np.isin(np.arange(len(size)), stay), size)]
            self.bounds = np.concatenate([[0], np.cumsum(size[stay])])
            self.words, self.used = self.words.take(pa.array(stay)), self.used[stay]
        found = self._known(words)
        new = found.is_null()
        places = found.fill_null(0).to_numpy().astype(np.int64)
        if pc.any(new).as_py():
            fresh = words.filter(new)
            ids = self._learn([w.decode("utf-8", "surrogatepass") for w in fresh.to_pylist()])
            places[new.to_numpy(zero_copy_only=False)] = np.arange(len(fresh)) + len(self.words)
            self.words = pa.concat_arrays([self.words, fresh])
            self.ids = np.concatenate([self.ids, np.frombuffer(b"".join(ids), "<u4")])
            self.bounds = np.concatenate([self.bounds, self.bounds[-1] + np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)) // 4)])
            self.used = np.concatenate([self.used, np.empty(len(fresh), np.int64)])
        self.used[places] = self.turn
        return places

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers.

        Words are cut and told apart by Arrow, and ids are put in their place by NumPy; Python sees distinct words only.
        """
        # A-Z are folded first, so that a word is kept once; the tokenizer folds the rest
        folded = [(t or "").encode("utf-8", "surrogatepass").lower() for t in texts]
        apart = [i for i, t in enumerate(folded) if any(a in t for a in self.added)]
        whole = dict(zip(apart, self._apart([texts[i] for i in apart]), strict=True))
        parts = pc.split_pattern(pa.array([b"" if i in whole else t.replace(b"\n", b" ") for i, t in enumerate(folded)], pa.large_binary()), b" ")
        coded = parts.flatten().dictionary_encode()
        place = self._places(coded.dictionary)[coded.indices.to_numpy()]
        starts, sizes = self.bounds[place], np.diff(self.bounds)[place]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        made = self.ids[np.arange(ends[-1]) + np.repeat(starts - ends[:-1], sizes)]
        bounds = ends[parts.offsets.to_numpy()].tolist()
        return [whole[i] if i in whole else made[a:b].tobytes() for i, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False))]


def token_pieces(docs: DataFrame, tokenizer: str, end: int, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Pieces of at most ``capacity`` tokens: id, piece, start, length, crc32 of the ids, and the ids if asked for.

    A document is its ids and then the id ``end``; a null text is empty.
    """
    kind = dict(docs.dtypes)[id_col]
    names = [id_col, "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        at, piece, start, length, crc, kept = [], [], [], [], [], []
        closing = np.array([end], "<u4").tobytes()
        for row, ids in enumerate(Encoder.at(tokenizer).encode(batch.column(1).to_pylist())):
            ids += closing
            for k, first in enumerate(range(0, len(ids), 4 * capacity)):
                part = ids[first : first + 4 * capacity]
                at.append(row)
                piece.append(k)
                start.append(first // 4)
                length.append(len(part) // 4)
                crc.append(zlib.crc32(part))
                if with_ids:
                    kept.append(np.frombuffer(part, "<u4").astype(np.int32))
        columns = [batch.column(0).take(pa.array(at, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(c, pa.int64()) for c in (start, length, crc))]
        return pa.RecordBatch.from_arrays([*columns, *[pa.array(kept, pa.list_(pa.int32()))] * with_ids], names)

    schema = f"{id_col} {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return map_text(docs.select(id_col, F.col(text_col).cast("string").alias("text")), run, schema)


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of each length, taken in the given order.

    With N(g) open sequences of residual gap g, a length goes into the gap where the sum of
    N(g) ** 2 over 0 < g < capacity becomes smallest; ties go to the smallest gap.  A new
    sequence is opened only where none that is open has room.
    """
    counts = np.zeros(capacity + 1, np.int64)
    open_at: list[list[int]] = [[] for _ in range(capacity + 1)]
    sequence = np.empty(len(lengths), np.int64)
    offset = np.empty(len(lengths), np.int64)
    made = 0
    for i, size in enumerate(lengths.tolist()):
        gaps = counts[size:capacity]
        used = np.flatnonzero(gaps)
        gap = capacity
        if len(used):
            after = np.where(used > 0, 2 * counts[used] + 1, 0)  # a gap of 0 is closed and not counted
            gap = int(used[(after - 2 * gaps[used] + 1).argmin()]) + size
        if gap == capacity:
            into, made = made, made + 1
        else:
            into = open_at[gap].pop()
            counts[gap] -= 1
        sequence[i], offset[i] = into, capacity - gap
        if gap > size:
            open_at[gap - size].append(into)
            counts[gap - size] += 1
    return sequence, offset


def pack(pieces: DataFrame, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``: no sequence exceeds ``capacity``, none has a hole.

    ``pieces`` has a ``length`` from 1 to ``capacity``; all its columns stay as they are, but
    ``sequence_id`` and ``offset`` replace columns of that name.  Rows repeated
    are packed each on their own.  An empty table gives an empty result.
    """
    names = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    groups = max(1, math.ceil(pieces.count() / group))
    # the place of a row is hashed too, so that rows repeated do not meet in one group
    place_of = F.monotonically_increasing_id()
    dealt = pieces.select(F.pmod(F.xxhash64(*[c for c in names if c != "ids"], place_of), F.lit(groups)).alias("_packed_in"), F.struct(*names).alias("_piece"))
    schema = StructType([*[pieces.schema[c] for c in names], StructField("sequence_id", LongType()), StructField("offset", LongType())])

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        # Arrow keeps long ids beside nulls as they are, which pandas would turn into doubles
        rows = pa.Table.from_struct_array(table["_piece"].combine_chunks())
        order = pc.sort_indices(rows, [("length", "descending"), *[(c, "ascending") for c in names[:2] if c != "length"]])
        rows = rows.take(order)
        sequence, offset = sum_of_squares(rows["length"].to_numpy(), capacity)
        first = key[0].as_py() << 32
        return rows.append_column("sequence_id", pa.array(sequence + first)).append_column("offset", pa.array(offset))

    return dealt.groupBy("_packed_in").applyInArrow(run, schema)


def pack_documents(docs: DataFrame, tokenizer: str, end: int, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """Cut documents of more than ``capacity`` tokens into pieces and pack all pieces.

    Only such documents are cut.  Null and empty texts are the id ``end`` alone.  Repeated
    rows and rows with a null id are documents of their own.  An empty table gives an empty
    result.  Further columns of ``docs`` are ignored.
    """
    scratch = Scratch(docs.sparkSession, "packing")
    return pack(scratch.save(token_pieces(docs, tokenizer, end, id_col, text_col, capacity)), capacity, group)


def sequences(docs: DataFrame, tokenizer: str, end: int, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """The packed sequences themselves: ``sequence_id`` and its ``ids`` in order."""
    scratch = Scratch(docs.sparkSession, "packing")
    packed = pack(scratch.save(token_pieces(docs, tokenizer, end, id_col, text_col, capacity, with_ids=True)), capacity, group)
    parts = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return parts.select("sequence_id", F.flatten(F.transform("parts", lambda p: p["ids"])).alias("ids"))
