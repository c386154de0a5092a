"""Small per-row helpers on words and shingles, shared by the text operators.

Words are maximal runs of bytes other than space and U+0009-U+000D, which is what
``bytes.split()`` yields; ``bytes.lower()`` folds A-Z only.  Shingles are hashed to
64 bits from the bytes of their words joined by single spaces, so equal word
sequences always hash alike, whatever the space between the words was.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Odd base of the polynomial byte hash and its inverse modulo 2**64.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Bytes of text hashed at a time; bounds the power tables and the prefix sums.
_BLOCK = 1 << 18
#: Bytes of text given to one call of a batch function.
BATCH_BYTES = 2 << 20

_tables: list[np.ndarray] = []


def _powers() -> list[np.ndarray]:
    if not _tables:
        for base in (_BASE, _INVERSE):
            table = np.full(_BLOCK * 2, base, np.uint64)
            table[0] = 1
            _tables.append(np.cumprod(table, dtype=np.uint64))
    return _tables


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, a bijection on unsigned 64-bit integers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def words_of(text: str | None, fold: bool = True) -> list[bytes]:
    """Words of a text as UTF-8 bytes; A-Z lower-cased if ``fold``.  Null: no words."""
    if not text:
        return []
    data = text.encode("utf-8", "surrogatepass")
    return (data.lower() if fold else data).split()


def window_hashes(words: list[bytes], width: int) -> np.ndarray:
    """Hashes of all windows of ``width`` words, in order.

    With fewer words the whole sequence is the one window; without words there is none.
    """
    n = len(words)
    if n == 0:
        return np.empty(0, np.uint64)
    width = min(width, n)
    lens = np.fromiter(map(len, words), np.int64, n)
    ends = np.cumsum(lens + 1) - 1
    starts = ends - lens
    first, last = starts[: n - width + 1], ends[width - 1 :]
    data = np.frombuffer(b" ".join(words), np.uint8)
    power, inverse = _powers()
    out = np.empty(len(first), np.uint64)
    at = 0
    while at < len(first):
        base = int(first[at])
        upto = max(at + 1, int(np.searchsorted(last, base + _BLOCK, "right")))
        upto = min(upto, len(first))
        span = int(last[upto - 1]) - base
        if span >= len(power):  # one window longer than the tables: hash it on its own
            out[at] = _long_hash(data[base : base + span])
            at += 1
            continue
        sums = np.zeros(span + 1, np.uint64)
        np.cumsum((data[base : base + span].astype(np.uint64) + np.uint64(1)) * power[:span], out=sums[1:])
        a, b = first[at:upto] - base, last[at:upto] - base
        out[at:upto] = (sums[b] - sums[a]) * inverse[a]
        at = upto
    return mix64(out + (last - first).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def _long_hash(data: np.ndarray) -> np.uint64:
    power, _ = _powers()
    total, scale = 0, 1
    step = len(power)
    for i in range(0, len(data), step):
        part = data[i : i + step].astype(np.uint64) + np.uint64(1)
        total += scale * int((part * power[: len(part)]).sum(dtype=np.uint64))
        scale = scale * pow(_BASE, step, 1 << 64) % (1 << 64)
    return np.uint64(total % (1 << 64))


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct shingle hashes of a whole text."""
    return np.unique(window_hashes(words_of(text), width))


def slices(batch: pa.RecordBatch, column: str, limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that one slice holds about ``limit`` bytes of ``column`` at most."""
    if batch.num_rows == 0:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    group = np.cumsum(sizes.astype(np.int64)) // limit
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:], strict=False):
        yield batch.slice(a, b - a)


def map_text(df: DataFrame, function: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str | StructType, column: str = "text") -> DataFrame:
    """``mapInArrow`` with batches cut by the size of their texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, column):
                out = function(part)
                if out is not None and out.num_rows:
                    yield out

    return df.mapInArrow(run, schema)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once however often the body uses it.

    Inside the function of a ``transform`` an expression would be evaluated for each element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))
