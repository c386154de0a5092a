"""N-gram Jaccard join by a count-vector R-tree.

Tokens (hashes of word shingles) are dealt into groups, about as many as the document has
tokens, and a document is the point of its group counts.  The overlap of two documents is at most the sum of the
coordinate minima of their points, and the overlap of a document with any in a box at
most that with the box's upper corner.  An R-tree over the points prunes by this bound,
and pairs that survive are verified on their exact sets.

One tree over everything can't be built or searched in pieces, so the points are
first dealt into cells without losing a pair.  The shingles of a document are dealt into
parts by hash.  Two documents with Jaccard similarity t or more differ in at most
r = (1 - t) n / t shingles, each of which spoils one part.  Parts go by their number of
shingles, most first, and then by a hash of what they hold: of the first r + 1 in this order
at least one holds the very same shingles in both documents, as at most r that only one of
them has can stand before it.  A document enters the cells named by the contents of these
parts; each cell has an R-tree of its own.  The fullest parts hold three shingles or more, so few
documents meet by chance.  (A document has fewer than r + 1 parts with a shingle with a chance
below 1e-8.)  Tiny sets enter a cell for each two of their first r + 2 shingles.

Documents with the same set are one class, found by its hash of 128 bits, and only
classes are searched and linked, so copies cost nothing further.  Who reaches whom is found
first: classes seek partners in rounds, as in Boruvka's construction of a spanning forest.
Each class tries the few survivors in other components that the bound takes to be most
alike and that weren't tried before, and more of them each round.  Rounds end when no
survivor is left untried between components, so no link between them is missed.  All
links then lie within components; these are searched in blocks of bounded size, by an R-tree
again, and each class's links are counted where its survivors are verified, so pairs never
become rows.  The work for a component grows with the square of its different texts, as its links do.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .scratch import Scratch, broadcast_if_small
from .textkit import map_text, mix64, shingle_set, slices

#: Logs of the least and the greatest number of groups.
FEWEST, MOST = 6, 12
#: Points in a leaf and children of a node.
LEAF = 16
#: Sets smaller than this have twice as many parts as needed, and those below the first bound pairs of shingles instead.
TINY, SMALL = 16, 64
#: Members of a cell indexed in one tree.
CHUNK = 4096
#: Classes and shingles of a component searched in one block.
BLOCK, BLOCK_SHINGLES = 4096, 1 << 21
#: Untried survivors that a class tries in the first round, and how many times as many in each further one.
TRIES, MORE = 3, 4
#: Classes of a cell that ask at a time; bounds the survivors held.
ASKING = 256
#: Ids up to which texts to verify are picked by a broadcast; beyond it by a shuffle.
BROADCAST_IDS = 2_000_000
#: Members up to which cells are compared by their members.
_SHORT = 64


class Similarity:
    """Jaccard similarity of ``num / den`` or more."""

    def __init__(self, num: int, den: int):
        if not 0 < num <= den:
            raise ValueError("the least similarity lies above 0 and up to 1")
        self.num, self.den = num, den

    @property
    def wide(self) -> bool:
        """Whether similar sets may differ in so much that parts would hold less than two shingles."""
        return self.num * 5 < self.den * 3

    def differ(self, n: int) -> int:
        """Most shingles by which a set of ``n`` and a similar one can differ."""
        return (self.den - self.num) * n // self.num

    def overlap(self, total: np.ndarray) -> np.ndarray:
        """Least overlap of two similar sets with ``total`` shingles together."""
        return -(-self.num * total // (self.num + self.den))

    def parts(self, level: int) -> int:
        """The number of parts of sets of 2 ** level to 2 ** (level + 1) shingles; 0: single shingles.

        At most 0.72 of the parts are needed, half of them for small sets, so that enough of them hold a shingle.
        """
        need = self.differ(2 << level) + 1
        if 1 << level < TINY or self.wide:
            return 0
        return 2 * need if 1 << level < SMALL else -(-need * 100 // 72)

    def levels(self, n: int) -> list[int]:
        """The size class of a set, and the next one if sets in it can be similar."""
        own = n.bit_length() - 1
        start = 2 << own
        return [own, own + 1] if n * self.den >= self.num * start else [own]


def cell_keys(shingles: np.ndarray, sim: Similarity) -> np.ndarray:
    """Keys of the cells that a set (sorted distinct hashes) enters."""
    n = len(shingles)
    spoiled = sim.differ(n)
    if not spoiled:  # similar to itself only
        return np.empty(0, np.uint64)
    out = {}
    for level in sim.levels(n):
        parts = sim.parts(level)
        if parts in out:
            continue
        if not parts and sim.wide:
            out[parts] = mix64(shingles[: spoiled + 1] + np.uint64(1))
            continue
        if not parts:  # of the first spoiled + 2 shingles two are the same in both
            held = mix64(shingles[: spoiled + 2])
            i, j = np.triu_indices(len(held), 1)
            out[parts] = mix64(held[i] ^ mix64(held[j] + np.uint64(1)))
            continue
        part = (shingles >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)  # in order, as the hashes are
        first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        keys = mix64(np.add.reduceat(mix64(shingles), first) ^ mix64((part[first] << np.uint64(32)) | np.uint64(parts)))
        size = np.diff(np.append(first, n))
        out[parts] = keys[np.lexsort((keys, -size))[: spoiled + 1]]
    return np.concatenate(list(out.values()))


def point(shingles: np.ndarray) -> bytes:
    """Shingles in each group, as bytes; two a group from 2 ** 19 shingles on."""
    n = len(shingles)
    groups = 1 << min(max((n - 1).bit_length(), FEWEST), MOST)
    counts = np.bincount((shingles & np.uint64(groups - 1)).astype(np.int64), minlength=groups)
    return counts.astype(_width(n)).tobytes()


def _width(n: int) -> str:
    return "<u1" if n < 1 << 19 else "<u2"


def folded(points: list[bytes], sizes: np.ndarray) -> np.ndarray:
    """Points as rows of one matrix, with the fewest groups among them.

    Groups go by the low bits of the hash, so the halves of a point add up to the point of half
    as many groups.
    """
    held = [np.frombuffer(x, _width(n)) for x, n in zip(points, sizes.tolist(), strict=True)]
    groups = min(map(len, held))
    return np.stack([x if len(x) == groups else x.reshape(-1, groups).sum(axis=0, dtype=np.uint16) for x in held]).astype(np.uint16)


class RTree:
    """A packed R-tree over points; a node keeps its upper corner and the least size below it."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        self.points, self.sizes = points, sizes
        self.root = self._node(np.argsort(sizes, kind="stable"), 0)

    def _node(self, rows: np.ndarray, depth: int) -> tuple:
        high, least = self.points[rows].max(axis=0), int(self.sizes[rows].min())
        if len(rows) <= LEAF:
            return high, least, rows, None
        if depth:  # tiles of the widest coordinate
            held = self.points[rows]
            rows = rows[np.argsort(held[:, int((held.max(axis=0) - held.min(axis=0)).argmax())], kind="stable")]
        return high, least, None, [self._node(p, depth + 1) for p in np.array_split(rows, min(LEAF, -(-len(rows) // LEAF)))]

    def search(self, points: np.ndarray, sizes: np.ndarray, sim: Similarity) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Pairs (rows of the queries, rows of the tree) whose bound allows a link, and the bound."""
        todo = [(self.root, np.arange(len(points)))]
        while todo:
            (high, least, rows, below), asking = todo.pop()
            bound = np.minimum(points[asking], high).sum(axis=1, dtype=np.int64)
            asking = asking[bound >= sim.overlap(sizes[asking] + least)]
            if not len(asking):
                continue
            if below is not None:
                todo += [(node, asking) for node in below]
                continue
            bound = np.minimum(points[asking][:, None, :], self.points[rows][None, :, :]).sum(axis=2, dtype=np.int64)
            q, x = np.nonzero(bound >= sim.overlap(sizes[asking][:, None] + self.sizes[rows][None, :]))
            yield asking[q], rows[x], bound[q, x]


def _features(docs: DataFrame, width: int, sim: Similarity) -> DataFrame:
    """``id, n, cls, check, keys``: size and 128-bit hash of each set, and its cells.

    A task gives the cells of a set only once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for part in (p for batch in batches for p in slices(batch, "text")):
            size, cls, check, keys = [], [], [], []
            for text in part.column(1).to_pylist():
                s = shingle_set(text, width)
                a, b = _set_hash(s)
                new = a not in seen
                if new and len(seen) < 1_000_000:
                    seen.add(a)
                size.append(len(s))
                cls.append(a)
                check.append(b)
                keys.append(cell_keys(s, sim).view(np.int64) if new else None)
            columns = [part.column(0), pa.array(size, pa.int64()), pa.array(cls, pa.int64()), pa.array(check, pa.int64()), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["id", "n", "cls", "check", "keys"])

    kind = dict(docs.dtypes)["id"]
    return docs.mapInArrow(run, f"id {kind}, n long, cls long, check long, keys array<long>")


def _set_hash(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits of hash of a set, as two signed integers."""
    n = np.array([len(shingles)], np.uint64)
    a = mix64(np.array([mix64(shingles).sum(dtype=np.uint64)], np.uint64) + n)
    b = mix64(np.array([mix64(shingles ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64)], np.uint64) ^ n)
    return int(a.view(np.int64)[0]), int(b.view(np.int64)[0])


def _shared_cells(cells: DataFrame) -> DataFrame:
    """``cell, chunk, cls`` of the cells with two classes or more, from ranges of ``key, cls`` in order.

    Small cells with the same members are named by these, so that classes that share many
    cells are seen once.  A cell of any size passes through in pieces, which are its chunks; a
    cell cut by the end of a range goes on under the same name in another chunk.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 32
        key, cls = np.empty(0, np.int64), np.empty(0, np.int64)
        first_key: int | None = None
        long_key: int | None = None  # a cell of which rows were passed on already, how many, and the last one
        passed, last = 0, 0
        seen: set[int] = set()
        for batch in _with_end(batches):
            if batch is not None:
                key = np.concatenate([key, batch.column(0).to_numpy(zero_copy_only=False)])
                cls = np.concatenate([cls, batch.column(1).to_numpy(zero_copy_only=False)])
            if not len(key):
                continue
            new = np.concatenate([[not (int(key[0]) == long_key and int(cls[0]) == last)], (key[1:] != key[:-1]) | (cls[1:] != cls[:-1])])
            key, cls = key[new], cls[new]
            if not len(key):
                continue
            first_key = int(key[0]) if first_key is None else first_key
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            size = np.diff(np.append(first, len(key)))
            before = np.zeros(len(first), np.int64)
            before[0] = passed if int(key[0]) == long_key else 0
            hold = batch is not None and before[-1] + size[-1] <= _SHORT
            out = len(first) - hold
            name = key[first]
            edge = name == first_key
            if batch is None:
                edge[-1] = True
            whole = (before + size <= _SHORT) & ~edge
            take = (before + size >= 2) | edge
            members = mix64(np.add.reduceat(mix64(cls.view(np.uint64)), first) + size.astype(np.uint64)).view(np.int64)
            name = np.where(whole, members, name)
            take[out:] = False
            for k in np.flatnonzero(take & whole).tolist():
                if int(name[k]) in seen:
                    take[k] = False
                elif len(seen) < 1_000_000:
                    seen.add(int(name[k]))
            rows = np.repeat(take, size)
            if rows.any():
                place = np.arange(len(key)) - np.repeat(first - before, size)
                chunk = np.where(np.repeat(whole, size), 0, base + place // CHUNK)
                columns = [np.repeat(name, size)[rows], chunk[rows], cls[rows]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["cell", "chunk", "cls"])
            if hold:
                key, cls = key[first[-1] :], cls[first[-1] :]
            else:
                long_key, passed, last = int(key[-1]), int(before[-1] + size[-1]), int(cls[-1])
                key, cls = key[:0], cls[:0]

    return cells.mapInArrow(run, "cell long, chunk long, cls long")


def _with_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def _sets(texts: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """``cls, n, point, shingles`` of the classes in ``wanted(cls, id, rows)``, made anew from the texts of these ids.

    Sets are wide, so only those of ids of which several rows have the text are shuffled, to keep one of each.
    """
    schema = pa.schema([("cls", pa.int64()), ("n", pa.int64()), ("point", pa.binary()), ("shingles", pa.list_(pa.int64()))])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for cls, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            s = shingle_set(text, width)
            if _set_hash(s)[0] == cls:  # else another text with the same id
                rows.append((cls, len(s), point(s), s.view(np.int64)))
        columns = list(zip(*rows, strict=True)) or [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)

    def made(some: DataFrame) -> DataFrame:
        found = texts.join(broadcast_if_small(some.select("cls", "id"), BROADCAST_IDS), "id")
        return map_text(found.select("cls", "text"), run, "cls long, n long, point binary, shingles array<long>")

    once, repeated = wanted.where("rows = 1"), wanted.where("rows > 1")
    return made(once) if repeated.isEmpty() else made(once).unionAll(made(repeated).dropDuplicates(["cls"]))


def _survivors(members: DataFrame, sim: Similarity, tries: int) -> DataFrame:
    """``q, x, alike, cell`` from rows of cells sorted by ``cell, chunk``.

    For each asking class ``q`` the ``tries`` survivors ``x`` in other components, not tried yet,
    with the highest Jaccard similarities that the bound allows; the lowest of equals first.
    """

    def alike(bound: np.ndarray, total: np.ndarray) -> np.ndarray:
        return bound / np.maximum(total - bound, 1)

    def of_pairs(t: dict[str, np.ndarray], points: list[bytes], at: np.ndarray) -> tuple[np.ndarray, ...]:
        """Cells of two members all at once; each asks for the other."""
        size = t["n"]
        length = np.array([len(x) for x in points], np.int64)
        bound = np.zeros(len(at), np.int64)
        kinds = np.stack([length[at], length[at + 1]], axis=1)
        for kind in np.unique(kinds, axis=0) if len(at) else ():
            some = np.flatnonzero((kinds == kind).all(axis=1))
            rows = np.concatenate([at[some], at[some] + 1])
            both = folded([points[i] for i in rows.tolist()], size[rows])
            bound[some] = np.minimum(both[: len(some)], both[len(some) :]).sum(axis=1, dtype=np.int64)
        total = size[at] + size[at + 1]
        fits = (bound >= sim.overlap(total)) & (t["comp"][at] != t["comp"][at + 1])
        at, near = at[fits], alike(bound[fits], total[fits])
        a, b, cell = t["cls"][at], t["cls"][at + 1], t["cell"][at]
        return np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([near, near]), np.concatenate([cell, cell])

    def of_cell(t: dict[str, np.ndarray], held: list[bytes], tried: list[list[int] | None]) -> tuple[np.ndarray, ...] | None:
        comp, cls, size = t["comp"], t["cls"], t["n"]
        query, rows = np.flatnonzero(t["asks"]), np.flatnonzero(t["indexed"])
        if (comp == comp[0]).all() or not len(query) or not len(rows):
            return None
        points = folded(held, size)
        past = {(int(c), x) for c, ts in zip(cls, tried, strict=True) for x in ts or ()}
        tree = RTree(points[rows], size[rows])
        out: list[tuple[np.ndarray, ...]] = []
        for first in range(0, len(query), ASKING):
            asking = query[first : first + ASKING]
            found = list(tree.search(points[asking], size[asking], sim))
            if not found:
                continue
            q, x, bound = (np.concatenate(c) for c in zip(*found, strict=True))
            q, x = asking[q], rows[x]
            new = comp[q] != comp[x]
            q, x, bound = q[new], x[new], bound[new]
            if past:
                new = np.array([(max(i, j), min(i, j)) not in past for i, j in zip(cls[q].tolist(), cls[x].tolist(), strict=True)], bool)
                q, x, bound = q[new], x[new], bound[new]
            near = alike(bound, size[q] + size[x])
            order = np.lexsort((cls[x], -near, q))
            q, x, near = q[order], x[order], near[order]
            keep = np.arange(len(q)) - np.searchsorted(q, q) < tries
            out.append((cls[q[keep]], cls[x[keep]], near[keep], np.full(int(keep.sum()), t["cell"][0])))
        return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in _with_end(batches):
            if batch is not None:
                table = pa.Table.from_batches([batch])
                held = table if held is None else pa.concat_tables([held, table])
            if held is None or not held.num_rows:
                continue
            held = held.combine_chunks()
            t = {n: held[n].to_numpy() for n in ("cell", "chunk", "cls", "comp", "n", "asks", "indexed")}
            points, tried = held["point"].to_pylist(), held["tried"]
            cut = np.flatnonzero((t["cell"][1:] != t["cell"][:-1]) | (t["chunk"][1:] != t["chunk"][:-1])) + 1
            bounds = np.array([0, *cut.tolist()] + ([held.num_rows] if batch is None else []))
            sizes = np.diff(bounds)
            two = bounds[:-1][sizes == 2]
            plain = np.array([not (tried[i].is_valid or tried[i + 1].is_valid) for i in two.tolist()], bool) if len(two) else np.zeros(0, bool)
            both = plain & t["asks"][two] & t["asks"][two + 1] & t["indexed"][two] & t["indexed"][two + 1] if len(two) else plain
            out = [of_pairs(t, points, two[both])]
            done = set(two[both].tolist())
            for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                if j - i > 1 and i not in done:
                    found = of_cell({n: v[i:j] for n, v in t.items()}, points[i:j], tried.slice(i, j - i).to_pylist())
                    if found is not None:
                        out.append(found)
            held = held.slice(int(bounds[-1]))
            columns = [np.concatenate(c) for c in zip(*out, strict=True)]
            if len(columns[0]):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["q", "x", "alike", "cell"])

    return members.mapInArrow(run, "q long, x long, alike double, cell long")


def _first_members(cells: DataFrame, big: DataFrame) -> DataFrame:
    """Rows of cells for the first round: everyone asks in the own chunk, where the cell's lowest class is indexed too."""
    heads = big.select("cell", F.explode("chunks").alias("chunk"), F.col("head.cls").alias("cls"), F.col("head.chunk").alias("home")).where("chunk <> home")
    rows = cells.withColumn("asks", F.lit(True)).unionByName(heads.drop("home").withColumn("asks", F.lit(False)))
    return rows.select("cell", "chunk", "cls", F.col("cls").alias("comp"), F.lit(None).cast("array<long>").alias("tried"), "asks", F.lit(True).alias("indexed"))


def _further_members(cells: DataFrame, labels: DataFrame | None, tried: DataFrame | None) -> DataFrame:
    """Rows of cells for a further round: those outside the component of the cell's lowest class ask in every chunk."""
    rows = cells
    if labels is None:
        rows = rows.withColumn("comp", F.col("cls"))
    else:
        rows = rows.join(labels.withColumnRenamed("node", "cls"), "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
    if tried is None:
        rows = rows.withColumn("tried", F.lit(None).cast("array<long>"))
    else:
        rows = rows.join(tried.groupBy(F.col("b").alias("cls")).agg(F.collect_set("a").alias("tried")), "cls", "left")
    cell = rows.groupBy("cell").agg(F.min(F.struct("cls", "comp")).alias("head"), F.max("comp").alias("last"), F.min("comp").alias("least"), F.collect_set("chunk").alias("chunks"))
    # cells that lie in one component are done; rows meet their cell's facts by the chunk, as a cell may be of any size
    open_ = cell.where(F.col("last") != F.col("least")).select("cell", F.col("head.comp").alias("within"), "chunks", F.explode("chunks").alias("chunk"))
    outside = F.col("comp") != F.col("within")
    rows = rows.join(open_, ["cell", "chunk"]).withColumn("at", F.explode(F.when(outside, F.col("chunks")).otherwise(F.array("chunk"))))
    return rows.select("cell", F.col("at").alias("chunk"), "cls", "comp", "tried", outside.alias("asks"), (F.col("at") == F.col("chunk")).alias("indexed"))


def _links(labels: DataFrame, weights: DataFrame, classes: DataFrame, sim: Similarity) -> DataFrame:
    """``cls, links``: documents of other classes that each class of a component links with.

    A large component is dealt into blocks, and each two blocks are searched in a group of their own.
    """

    def count(t: dict[str, np.ndarray], points: list[bytes], held: np.ndarray, starts: np.ndarray) -> np.ndarray:
        size, weight = t["n"], t["weight"]
        ends = starts + size
        query, rows = np.flatnonzero(t["block"] == t["lo"]), np.flatnonzero(t["block"] == t["hi"])
        both = bool(t["lo"][0] == t["hi"][0])
        links = np.zeros(len(size), np.int64)
        vocabulary, ids = np.unique(held, return_inverse=True)
        mark = np.zeros(len(vocabulary), bool)
        flat = ids if both else np.concatenate([ids[starts[i] : ends[i]] for i in rows.tolist()] or [ids[:0]])
        first = np.cumsum(size[rows]) - size[rows]
        folds = folded(points, size)
        tree = RTree(folds[rows], size[rows])
        for at in range(0, len(query), ASKING):
            asking = query[at : at + ASKING]
            found = list(tree.search(folds[asking], size[asking], sim))
            if not found:
                continue
            q, x = (np.concatenate(c) for c in list(zip(*found, strict=True))[:2])
            order = np.argsort(q, kind="stable")
            q, x = q[order], x[order]
            cuts = [0, *(np.flatnonzero(np.diff(q)) + 1).tolist(), len(q)]
            for i, j in zip(cuts, cuts[1:], strict=False):
                own, near = int(asking[q[i]]), x[i:j]
                mine = ids[starts[own] : ends[own]]
                mark[mine] = True
                if len(near) * 4 > len(rows):
                    overlap = np.add.reduceat(mark[flat], first, dtype=np.int64)[near]
                else:
                    overlap = np.array([np.count_nonzero(mark[flat[first[k] : first[k] + size[rows[k]]]]) for k in near.tolist()])
                mark[mine] = False
                hit = rows[near[sim.den * overlap >= sim.num * (size[own] + size[rows[near]] - overlap)]]
                hit = hit[hit != own]
                links[own] += weight[hit].sum()
                if not both:
                    links[hit] += weight[own]
        return links

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in _with_end(batches):
            if batch is not None:
                table = pa.Table.from_batches([batch])
                held = table if held is None else pa.concat_tables([held, table])
            if held is None or not held.num_rows:
                continue
            t = {n: held[n].to_numpy() for n in ("comp", "lo", "hi", "block", "cls", "n", "weight")}
            cut = np.flatnonzero((t["comp"][1:] != t["comp"][:-1]) | (t["lo"][1:] != t["lo"][:-1]) | (t["hi"][1:] != t["hi"][:-1])) + 1
            bounds = [0, *cut.tolist()] + ([held.num_rows] if batch is None else [])
            for i, j in zip(bounds, bounds[1:], strict=False):
                group = held.slice(i, j - i).combine_chunks()
                sets = group["shingles"].combine_chunks()
                sets = sets.chunk(0) if isinstance(sets, pa.ChunkedArray) else sets
                flat = sets.flatten().to_numpy(zero_copy_only=False)
                size = t["n"][i:j]
                links = count({n: v[i:j] for n, v in t.items()}, group["point"].to_pylist(), flat, np.cumsum(size) - size)
                yield pa.RecordBatch.from_arrays([pa.array(t["cls"][i:j]), pa.array(links)], ["cls", "links"])
            held = held.slice(bounds[-1])

    sized = labels.withColumnRenamed("node", "cls").join(weights, "cls").join(classes.select("cls", "n"), "cls")
    large = sized.groupBy("comp").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks")).where("blocks > 1")
    blocks = F.coalesce("blocks", F.lit(1))
    dealt = sized.join(broadcast_if_small(large, BROADCAST_IDS), "comp", "left").select("comp", "cls", "weight", blocks.alias("blocks"), F.pmod(F.xxhash64("cls"), blocks).cast("int").alias("block"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    met = dealt.withColumn("other", other).withColumn("lo", F.least("block", "other")).withColumn("hi", F.greatest("block", "other"))
    rows = met.join(classes, "cls").select("comp", "lo", "hi", "block", "cls", "n", "weight", "point", "shingles")
    partitions = max(int(labels.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    found = rows.repartition(partitions, "comp", "lo", "hi").sortWithinPartitions("comp", "lo", "hi").mapInArrow(run, "cls long, links long")
    return found.groupBy("cls").agg(F.sum("links").alias("links"))


def _verified(pairs: DataFrame, sets: DataFrame, sim: Similarity) -> DataFrame:
    """``a, b, linked`` by the exact overlap of the sets; only those of some pair are shuffled, while they are few."""
    asked = pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct()
    if asked.count() <= BROADCAST_IDS:
        sets = sets.join(F.broadcast(asked), "cls", "left_semi")
    left = sets.select(F.col("cls").alias("a"), F.col("n").alias("na"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("cls").alias("b"), F.col("n").alias("nb"), F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", (sim.den * both >= sim.num * (F.col("na") + F.col("nb") - both)).alias("linked"))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, num: int = 85, den: int = 100, with_links: bool = True, scratch: Scratch | None = None) -> DataFrame:
    """``n_shingles``, ``component_id`` and ``n_links`` of each row of ``docs``.

    Two documents link if their sets of ``width``-word shingles (words folded A-Z) have a
    Jaccard similarity of ``num / den`` or more; a component is all that links reach,
    and its id is its lowest document id.  ``n_links`` counts the other rows that a row links
    with, copies each on their own; it is left out without ``with_links``.

    With fewer words than ``width`` the whole sequence is the one shingle.  Null, empty
    and blank texts have no shingles and link with nothing.  Rows with a null id take no
    part and are left out.  Rows repeated each give a row; an id with several texts
    belongs with each of these on its own.  An empty table gives an empty result.  Further
    columns of ``docs`` are ignored.  The result reads tables in ``scratch``.
    """
    spark = docs.sparkSession
    sim = Similarity(num, den)
    scratch = scratch or Scratch(spark, "jaccard")
    texts = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    features = scratch.save(_features(texts, width, sim))

    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    keyed = features.where(F.col("keys").isNotNull()).select(F.explode("keys").alias("key"), "cls")
    shared = _shared_cells(keyed.repartitionByRange(partitions, "key", "cls").sortWithinPartitions("key", "cls"))
    cells = scratch.save(shared.distinct())
    # the keys are most of it, and their work is done
    known = scratch.save(features.drop("keys"))
    scratch.drop(features)
    # aggregated before the join, so that the rows of a group of copies don't meet in it
    lowest_row = known.groupBy("cls", "id").agg(F.count("*").alias("rows")).groupBy("cls").agg(F.min(F.struct("id", "rows")).alias("x"))
    met = scratch.save(lowest_row.join(cells.select("cls").distinct(), "cls", "left_semi").select("cls", "x.*"))
    classes = scratch.save(_sets(texts, met, width))
    scratch.drop(met)
    by_cell = cells.groupBy("cell").agg(F.min(F.struct("cls", "chunk")).alias("head"), F.collect_set("chunk").alias("chunks"))
    big = scratch.save(by_cell.where(F.size("chunks") > 1))

    tried: DataFrame | None = None
    labels: DataFrame | None = None
    live, tries, first = cells, TRIES, True
    while True:
        members = _first_members(live, big) if first else _further_members(live, labels, tried)
        rows = members.join(classes.select("cls", "n", "point"), "cls")
        found = scratch.save(_survivors(rows.repartition(partitions, "cell", "chunk").sortWithinPartitions("cell", "chunk"), sim, tries))
        ranked = found.groupBy("q").agg(F.slice(F.sort_array(F.collect_set(F.struct((-F.col("alike")).alias("far"), "x"))), 1, tries).alias("best"))
        chosen = ranked.select("q", F.explode("best.x").alias("x"))
        pairs = scratch.save(chosen.select(F.least("q", "x").alias("a"), F.greatest("q", "x").alias("b")).distinct())
        if pairs.isEmpty() and (not first or big.isEmpty()):
            break
        done = scratch.save(_verified(pairs, classes, sim))
        scratch.drop(pairs)
        before, tried = tried, done if tried is None else scratch.save(tried.unionAll(done))
        if not done.where("linked").isEmpty():
            labels = components(tried.where("linked"), scratch)
        if before is not None:
            scratch.drop(before, done)
        tries, first = tries * MORE, False
        # only cells that had survivors can have more; large ones were searched in parts
        before, live = live, scratch.save(live.join(found.select("cell").unionAll(big.select("cell")).distinct(), "cell", "left_semi"))
        scratch.drop(found, *[before] * (before is not cells))
    scratch.drop(found, pairs)

    # what a class has is found for classes first, so that only one join meets the rows of a group of copies
    copies = scratch.save(known.where(F.col("n") > 0).groupBy("cls", "check").agg(F.count("*").alias("copies"), F.min("id").alias("low")))
    facts = copies.select("cls", "check", "low", (F.col("copies") - 1).alias("links"))
    if labels is not None:
        linked = copies.join(labels.withColumnRenamed("node", "cls"), "cls", "left")
        lowest = scratch.save(linked.where(F.col("comp").isNotNull()).groupBy("comp").agg(F.min("low").alias("comp_low")))
        facts = linked.join(lowest, "comp", "left").select("cls", "check", F.coalesce("comp_low", "low").alias("low"), (F.col("copies") - 1).alias("links"))
        if with_links:
            counted = _links(labels, copies.groupBy("cls").agg(F.sum("copies").alias("weight")), classes, sim)
            facts = facts.join(counted.withColumnRenamed("links", "others"), "cls", "left").select("cls", "check", "low", (F.col("links") + F.coalesce("others", F.lit(0))).alias("links"))
    named = known.select("id", "n", "cls", "check").join(scratch.save(facts), ["cls", "check"], "left")
    result = [F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("low", "id").alias("component_id")]
    return named.select(*result, *[F.coalesce("links", F.lit(0)).cast("long").alias("n_links")] * with_links)


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``docs`` with the row of the lowest id of each component only; rows with a null id stay.

    Rows go by id: rows repeated with the id that stays all stay, and an id with several texts goes if
    any of these is a copy of a text with a lower id.
    """
    work = Scratch(docs.sparkSession, "jaccard")
    found = jaccard_components(docs, id_col, text_col, width, num, den, with_links=False, scratch=work)
    gone = Scratch(docs.sparkSession, "jaccard").save(found.where(F.col(id_col) != F.col("component_id")).select(id_col).distinct())
    work.clear()
    return docs.join(gone, id_col, "left_anti")
