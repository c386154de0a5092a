"""Pairing rows without a key in order: whole parts where they are small, between anchors where they aren't.

A small part is aligned by its longest common subsequence in one task.  In a large one, rows that
are found once on both sides may be anchors; the heaviest increasing sequence of their runs is kept, and the rows
between two anchors are a part of their own, mostly a very small one.  So no task holds a whole
large part, and the work of an alignment grows with its changes.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import cell_of, cell_token
from ..options import CompareOptions
from ..sources.scratch import Scratch
from ..sources.snapshots import running_last
from .rows import number_within

#: Above this product of row counts, rows are aligned between anchors.
WORK = 50_000_000
#: Above this sum of row counts, too.
ROWS = 100_000
#: Above this share of rows outside the common sequence, rows are paired as a multiset.
CHURN = 0.4
#: Rows of a gap compared at a time.
HUNK = 2_000
#: Neighbouring anchors searched for runs in one task, and rows searched for the last anchor before them.
BLOCK = 4_096
#: Stretches of rows sought in gaps that stay wide: how many rows they have, and of how many, by their hash, one is sought.
STRETCHES = ((16, 64), (8, 64), (4, 64))
#: A stretch found more often than this is no anchor.
OFTEN = 1_000
#: Rows of gaps aligned in one call, on average.
BATCH = 20_000
#: Runs of anchors put in increasing order in one task.
RUNS = 2_000_000


def common_sequence(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """A longest common subsequence as index pairs, in linear space by bisection of the edit path."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        if a1 - a0 == 1 or b1 - b0 == 1:
            i, j = np.nonzero(a[a0:a1, None] == b[None, b0:b1])
            if len(i):
                out.append((a0 + int(i[0]), b0 + int(j[0])))
            continue
        mid = (a0 + a1) // 2
        front = _lengths(a[a0:mid], b[b0:b1])
        back = _lengths(a[mid:a1][::-1], b[b0:b1][::-1])[::-1]
        cut = b0 + int((front + back).argmax())
        todo += [(a0, mid, b0, cut), (mid, a1, cut, b1)]
    return sorted(out)


def _lengths(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the longest common subsequence of ``a`` with each prefix of ``b``."""
    row = np.zeros(len(b) + 1, np.int64)
    for x in a:
        step = np.maximum(row[1:], row[:-1] + (b == x))
        row[1:] = np.maximum.accumulate(step)
    return row


def _similar(left: list[int], right: list[int], old_tokens: list, new_tokens: list) -> list[tuple[int, int]]:
    """Pairs of a gap: each old row takes the unused new row that shares most tokens, half or more; the last of equals."""
    pairs = []
    for k in range(0, max(len(left), len(right), 1), HUNK):
        olds, news = left[k : k + HUNK], right[k : k + HUNK]
        if not olds or not news:
            continue
        codes, _ = pd.factorize(np.array([x for i in olds for x in old_tokens[i]] + [x for j in news for x in new_tokens[j]], object))
        width = len(old_tokens[olds[0]])
        a, b = codes[: len(olds) * width].reshape(-1, width), codes[len(olds) * width :].reshape(-1, width)
        free = np.ones(len(news), bool)
        for i in range(len(olds)):
            share = np.where(free, (b == a[i]).mean(axis=1) if width else 1.0, -1.0)
            best = len(news) - 1 - int(share[::-1].argmax())
            if share[best] >= 0.5:
                free[best] = False
                pairs.append((olds[i], news[best]))
    return pairs


def align(old: pd.DataFrame, new: pd.DataFrame, churn: float = 1.0, moves: bool = True) -> pd.DataFrame:
    """``old_r, new_r, state, multiset`` of two row lists (``r, hash, tokens`` in order).

    States are same, similar, moved, removed or added.  If more than ``churn`` of all rows lie
    outside the longest common sequence, order says little, and equal rows pair wherever they stand.
    Without ``moves``, equal rows out of order stay removed and added.
    """
    a, b = old["hash"].to_numpy(), new["hash"].to_numpy()
    anchors = common_sequence(a, b)
    multiset = len(a) + len(b) - 2 * len(anchors) > churn * (len(a) + len(b))
    out: list[tuple[int | None, int | None, str]] = []
    removed, added = list(range(len(a))), list(range(len(b)))
    if not multiset:
        out = [(i, j, "same") for i, j in anchors]
        bounds = [(-1, -1), *anchors, (len(a), len(b))]
        removed, added = [], []
        old_tokens, new_tokens = old["tokens"].tolist(), new["tokens"].tolist()
        for (i0, j0), (i1, j1) in zip(bounds, bounds[1:], strict=False):
            left, right = list(range(i0 + 1, i1)), list(range(j0 + 1, j1))
            near = _similar(left, right, old_tokens, new_tokens) if left and right else []
            out += [(i, j, "similar") for i, j in near]
            olds, news = {i for i, _ in near}, {j for _, j in near}
            removed += [i for i in left if i not in olds]
            added += [j for j in right if j not in news]
    waiting: dict[int, deque[int]] = {}
    for j in added:
        waiting.setdefault(b[j], deque()).append(j)
    for i in removed:
        if moves and waiting.get(a[i]):
            out.append((i, waiting[a[i]].popleft(), "same" if multiset else "moved"))
        else:
            out.append((i, None, "removed"))
    out += [(None, j, "added") for js in waiting.values() for j in js]
    olds, news = old["r"].to_numpy(), new["r"].to_numpy()
    rows = [(None if i is None else int(olds[i]), None if j is None else int(news[j]), s, multiset) for i, j, s in out]
    return pd.DataFrame(rows, columns=["old_r", "new_r", "state", "multiset"]).astype({"old_r": "Int64", "new_r": "Int64", "multiset": bool})


# between anchors ------------------------------------------------------------------


def heaviest_increasing(first: np.ndarray, second: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """A mask of runs that rise in ``second`` as in ``first``, of the most weight in all.

    A run is so many places in a row on both sides.  Of chains that end at a place, only those heavier than all that end before
    it can be part of the heaviest one; they are kept in order, so each run is one search.
    """
    at = np.argsort(first, kind="stable")
    ends: list[int] = []  # where the chains end, rising
    heavy: list[int] = []  # their weights, rising too
    last: list[int] = []  # their last runs
    before = np.full(len(at), -1)
    for k in at.tolist():
        place, x = int(second[k]), bisect_left(ends, int(second[k]))
        total = int(weight[k])
        if x:
            total += heavy[x - 1]
            before[k] = last[x - 1]
        y = x
        while y < len(ends) and heavy[y] <= total:
            y += 1
        ends[x:y], heavy[x:y], last[x:y] = [place], [total], [k]
    kept = np.zeros(len(at), bool)
    k = last[-1] if last else -1
    while k >= 0:
        kept[k] = True
        k = before[k]
    return kept


def _runs(pairs: DataFrame) -> DataFrame:
    """``pairs(g, i, j)`` with ``run``, the first ``i`` of neighbours that stay neighbours; runs end with a block of anchors."""
    block = F.expr(f"i div {BLOCK}")
    by = Window.partitionBy("g", block).orderBy("i")
    starts = F.lag(F.col("j") - F.col("i")).over(by).eqNullSafe(F.col("j") - F.col("i"))
    marked = pairs.withColumn("_start", F.when(~starts, F.col("i")))
    return marked.withColumn("run", F.last("_start", ignorenulls=True).over(by)).drop("_start")


def _kept_runs(runs: DataFrame, most: int, work: Scratch) -> DataFrame:
    """``g, run`` of ``runs(g, run, j, w)`` that rise on both sides.

    Up to ``most`` runs of a ``g`` the heaviest sequence is found in one task.  Of more, the heaviest run of each of ``most``
    stretches is taken first; the others have to lie between two of those kept, on both sides, and are gone through gap by gap.
    """
    found: DataFrame | None = None

    def rising(left: pd.DataFrame) -> pd.DataFrame:
        return left[heaviest_increasing(left["run"].to_numpy(), left["j"].to_numpy(), left["w"].to_numpy())][["top", "run", "j"]].assign(g=left["g"])

    todo = runs.withColumn("top", F.col("g"))
    while True:
        sizes = work.save(todo.groupBy("g").agg(F.count("*").alias("_n"), F.min("run").alias("_low"), F.max("run").alias("_high")).where(F.col("_n") > most))
        wide = not sizes.isEmpty()
        chosen = todo
        if wide:
            many = todo.join(F.broadcast(sizes), "g")
            stretch = F.floor((F.col("run") - F.col("_low")) * F.lit(most) / (F.col("_high") - F.col("_low") + 1))
            best = many.groupBy("g", stretch.alias("_s")).agg(F.max_by(F.struct("top", "run", "j", "w"), F.struct("w", -F.col("run"))).alias("x")).select("g", "x.*")
            chosen = todo.join(F.broadcast(sizes.select("g")), "g", "left_anti").unionByName(best)
        kept = work.save(chosen.select("g", "top", "run", "j", "w").groupBy("g").applyInPandas(rising, "top string, run long, j long, g string"))
        found = kept if found is None else found.unionByName(kept)
        if not wide:
            return found.select(F.col("top").alias("g"), "run")
        # the kept run before each other one, in either order; a run that rises lies behind the same one in both
        rest = todo.join(F.broadcast(sizes.select("g")), "g", "left_semi").join(kept.select("g", "run", F.lit(True).alias("_kept")), ["g", "run"], "left")
        for order, name in (("run", "_before"), ("j", "_below")):
            rest = running_last(rest, [order], F.when(F.col("_kept"), F.col("run")), name, part="g")
        inside = rest.where(F.col("_kept").isNull() & F.col("_before").eqNullSafe(F.col("_below")))
        todo = work.save(inside.select(F.concat_ws("/", "g", F.coalesce("_before", F.lit(-1)).cast("string")).alias("g"), "top", "run", "j", "w"))


def _anchors(rows: DataFrame, keys: list[str], most: int, work: Scratch) -> DataFrame:
    """``g, i, old_r, new_r`` of anchors in ``rows(g, side, r, ...)``, ``i`` rising with both.

    Candidates are rows that ``keys`` tell apart within a ``g`` on both sides.
    """
    place = lambda side: F.max(F.when(F.col("side") == side, F.col("r")))
    count = lambda side: F.count_if(F.col("side") == side) == 1
    single = rows.groupBy("g", *keys).agg(count(0).alias("_a"), count(1).alias("_b"), place(0).alias("old_r"), place(1).alias("new_r")).where("_a AND _b").select("g", "old_r", "new_r")
    ranked = number_within(number_within(work.save(single), ["g"], "old_r", "i"), ["g"], "new_r", "j")
    pairs = work.save(_runs(ranked))
    runs = work.save(pairs.groupBy("g", "run").agg(F.min("j").alias("j"), F.count("*").alias("w")))
    return pairs.join(_kept_runs(runs, most, work), ["g", "run"]).select("g", "i", "old_r", "new_r")


def _stretches(rows: DataFrame, length: int, share: int) -> DataFrame:
    """``g, side, r, seed, k``: starts of stretches of ``length`` rows that ``g`` has as often on both sides, numbered; one of ``share`` by its hash."""
    block = F.expr(f"r div {BLOCK}")
    # the first rows of a block end stretches of the block before, too
    blocks = F.array_compact(F.array(block, F.when(F.col("r") % BLOCK < length - 1, block - 1)))
    by = Window.partitionBy("g", "side", "_b").orderBy("r")
    lanes = rows.select("g", "side", "r", F.col("hash").alias("seed"), F.explode(blocks).alias("_b")).withColumn("_last", F.lead("r", length - 1).over(by))
    step = 1
    while step < length:
        lanes, step = lanes.withColumn("seed", F.xxhash64("seed", F.lead("seed", step).over(by))), 2 * step
    starts = lanes.where((F.col("_b") == block) & F.col("_last").isNotNull() & (F.pmod("seed", F.lit(share)) == 0)).select("g", "side", "r", "seed")
    a, b = (F.count_if(F.col("side") == k) for k in (0, 1))
    often = starts.groupBy("g", "seed").agg(a.alias("_a"), b.alias("_n")).where((F.col("_a") == F.col("_n")) & (F.col("_n") <= OFTEN)).select("g", "seed")
    return starts.join(often, ["g", "seed"]).withColumn("k", F.row_number().over(Window.partitionBy("g", "side", "seed").orderBy("r")))


def _cut(rows: DataFrame, anchors: DataFrame, work: Scratch) -> DataFrame:
    """``rows`` without the anchors, with the last anchor before them put to their ``g``.

    Blocks of rows are gone through on their own; the last anchor before a block is carried on, a row for each block.
    """
    block = F.expr(f"r div {BLOCK}")
    places = anchors.select("g", "i", F.inline(F.array(F.struct(F.lit(0).alias("side"), F.col("old_r").alias("r")), F.struct(F.lit(1).alias("side"), F.col("new_r").alias("r")))))
    at = ["g", "side", "_b"]
    filled = rows.select("g", "side", block.alias("_b")).distinct().join(places.groupBy("g", "side", block.alias("_b")).agg(F.max("i").alias("_i")), at, "left")
    earlier = Window.partitionBy("g", "side").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carried = filled.select(*at, F.max("_i").over(earlier).alias("_carried"))
    own = Window.partitionBy(*at).orderBy("r").rowsBetween(Window.unboundedPreceding, -1)
    # anchors rise with the rows, so the last one is the highest
    lanes = rows.join(places, ["g", "side", "r"], "left").withColumn("_b", block).withColumn("_own", F.max("i").over(own)).where("i IS NULL").join(carried, at)
    after = F.coalesce(F.coalesce("_own", "_carried").cast("string"), F.lit(""))
    return work.save(lanes.select(F.concat_ws(":", "g", after).alias("g"), *[c for c in rows.columns if c != "g"]))


def _wide(rows: DataFrame, work_limit: int, row_limit: int) -> DataFrame:
    """``g, both, wide``: whether a ``g`` has rows of both sides, and more than a task should take."""
    n, m = (F.count_if(F.col("side") == k) for k in (0, 1))
    sizes = rows.groupBy("g").agg(n.alias("n"), m.alias("m"))
    both = (F.col("n") > 0) & (F.col("m") > 0)
    return sizes.select("g", both.alias("both"), (both & ((F.col("n") * F.col("m") > work_limit) | (F.col("n") + F.col("m") > row_limit))).alias("wide"))


def _embedded(part: list[int], whole: list[int]) -> list[int] | None:
    """Where the items of ``part`` stand in ``whole``, in order; none if they don't."""
    at, found = -1, []
    try:
        for x in part:
            at = whole.index(x, at + 1)
            found.append(at)
    except ValueError:
        return None
    return found


def _in_both(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of a longest common subsequence; where rows were only dropped, or only added, one walk finds it."""
    short, whole = (b, a) if len(b) <= len(a) else (a, b)
    at = _embedded(short.tolist(), whole.tolist())
    if at is None:
        pairs = np.array(common_sequence(a, b), np.int64).reshape(-1, 2)
        return pairs[:, 0], pairs[:, 1]
    both = np.array(at, np.int64), np.arange(len(short), dtype=np.int64)
    return both if len(b) <= len(a) else both[::-1]


def _each_gap(rows: pd.DataFrame, *names: str):
    """The gaps of a batch: part and name, and each column of ``names`` of its old and of its new rows, in order."""
    rows = rows.sort_values(["g", "side", "r"])
    part, g, side, *columns = (rows[c].to_numpy() for c in ("part", "g", "side", *names))
    cuts = [0, *(np.flatnonzero(g[1:] != g[:-1]) + 1).tolist(), len(rows)]
    news = np.add.reduceat(side, cuts[:-1]).tolist()
    for first, last, n in zip(cuts, cuts[1:], news, strict=False):
        yield part[first], g[first], *[(c[first : last - n], c[last - n : last]) for c in columns]


_FOUND = "part string, g string, old_r long, new_r long, hash long"
_NONE = np.zeros(0, np.int64)


def _same_in_gaps(rows: pd.DataFrame) -> pd.DataFrame:
    """Rows ``part, g, old_r, new_r, hash`` of gaps ``g, part, side, r, hash``: pairs that are the same in order, and all others alone.

    ``g`` of a row left alone names the place between two pairs, where rows of the other side are left, too.
    """
    out = []
    for part, g, (a, b), (r, s) in _each_gap(rows, "hash", "r"):
        i, j = _in_both(a, b)
        left, right = _others(len(a), i), _others(len(b), j)
        places = [None] * (len(i) + len(left) + len(right))
        if len(left) and len(right):
            hunks = [np.searchsorted(x, y).tolist() for x, y in ((i, left), (j, right))]
            shared = set(hunks[0]) & set(hunks[1])
            places[len(i) :] = [f"{g}.{h}" if h in shared else None for hunk in hunks for h in hunk]
        out.append((part, places, r, s, a, b, i, j, left, right))
    return _found(out)


def _similar_in_gaps(rows: pd.DataFrame) -> pd.DataFrame:
    """As ``_same_in_gaps``, of gaps without equal rows in order: pairs are similar rows; ``tokens`` are compared."""
    out = []
    for part, _, (a, b), (r, s), (old, new) in _each_gap(rows, "hash", "r", "tokens"):
        i, j = np.array(_similar(list(range(len(a))), list(range(len(b))), list(old), list(new)), np.int64).reshape(-1, 2).T
        left, right = _others(len(a), i), _others(len(b), j)
        out.append((part, [None] * (len(i) + len(left) + len(right)), r, s, a, b, i, j, left, right))
    return _found(out)


def _others(n: int, taken: np.ndarray) -> np.ndarray:
    """The numbers below ``n`` that aren't taken."""
    if len(taken) == n:
        return _NONE
    free = np.ones(n, bool)
    free[taken] = False
    return np.flatnonzero(free)


def _found(gaps: list[tuple]) -> pd.DataFrame:
    """Gaps as one table; -1 stands for no row."""
    old, new, hashes, parts, places = [], [], [], [], []
    for part, at, r, s, a, b, i, j, left, right in gaps:
        old += [r[i], r[left], np.full(len(right), -1)]
        new += [s[j], np.full(len(left), -1), s[right]]
        hashes += [a[i], a[left], b[right]]
        parts += [part] * len(at)
        places += at
    old, new = (pd.Series(np.concatenate(x)).astype("Int64") for x in (old, new))
    return pd.DataFrame({"part": parts, "g": pd.Series(places, dtype=object), "old_r": old.where(old >= 0), "new_r": new.where(new >= 0), "hash": np.concatenate(hashes)})


def _batches(gaps: DataFrame, rows: int) -> DataFrame:
    """``gaps`` with whole gaps in batches of ``BATCH`` of all ``rows`` on average."""
    return gaps.groupBy(F.pmod(F.xxhash64("g"), F.lit(1 + rows // BATCH)).alias("_batch"))


def align_large(old: DataFrame, new: DataFrame, work_limit: int = WORK, row_limit: int = ROWS, hunk: int = HUNK, most: int = RUNS) -> DataFrame:
    """``part, old_r, new_r, state`` of parts of any size; ``old`` and ``new`` hold ``part, r, hash, tokens``.

    Anchors are rows found once on both sides.  In gaps that stay wide, starts of stretches of rows that are found as often on both sides are
    anchors too, of shorter ones if need be, and then the k-th of equal rows with the k-th.  A gap that is still wide is aligned
    in windows of ``hunk`` rows of both sides.  Rows left over that are equal have moved, the first with the first, wherever they stand in the part.
    """
    work = Scratch(old.sparkSession, "order")
    sides = [df.select("part", F.lit(k).alias("side"), "r", "hash") for k, df in enumerate((old, new))]
    rows = work.save(sides[0].unionByName(sides[1]).withColumn("g", F.col("part")))
    same = work.save(_anchors(rows, ["hash"], most, work).select(F.col("g").alias("part"), "old_r", "new_r"))
    rest = rows if same.isEmpty() else _cut(rows, _renumbered(same), work)
    for length, share in STRETCHES:
        wide = work.save(_wide(rest, work_limit, row_limit).where("wide").select("g"))
        if wide.isEmpty():
            break
        inside = rest.join(wide, "g", "left_semi")
        more = work.save(_anchors(work.save(_stretches(inside, length, share)), ["seed", "k"], most, work))
        if not more.isEmpty():
            same = same.unionByName(more.join(inside.select("g", "part").distinct(), "g").select("part", "old_r", "new_r"))
            rest = work.save(rest.join(wide, "g", "left_anti").unionByName(_cut(inside, more, work)))
    sizes = work.save(_wide(rest, work_limit, row_limit))
    if not sizes.where("wide").isEmpty():
        wide = rest.join(sizes.where("wide").select("g"), "g", "left_semi")
        narrow = rest.join(sizes.where("wide").select("g"), "g", "left_anti")
        numbered = work.save(number_within(wide, ["g", "side", "hash"], "r", "k"))
        more = work.save(_anchors(numbered, ["hash", "k"], most, work))
        owners = numbered.where("side = 0").select("g", "part", F.col("r").alias("old_r"))
        same = work.save(same.unionByName(more.join(owners, ["g", "old_r"]).select("part", "old_r", "new_r")))
        cut = _cut(numbered.drop("k"), more, work)
        still = work.save(_wide(cut, work_limit, row_limit))
        windows = number_within(cut.join(still.where("wide").select("g"), "g", "left_semi"), ["g", "side"], "r", "k")
        windows = windows.withColumn("g", F.concat_ws("#", "g", F.expr(f"(k - 1) div {hunk}").cast("string"))).drop("k")
        fine = cut.join(still.where("wide").select("g"), "g", "left_anti")
        rest = work.save(narrow.unionByName(fine).unionByName(windows))
        sizes = work.save(_wide(rest, work_limit, row_limit))
    both = rest.join(sizes.where("both").select("g"), "g", "left_semi")
    alone = rest.join(sizes.where("both").select("g"), "g", "left_anti")
    found = work.save(_batches(both, both.count()).applyInPandas(_same_in_gaps, _FOUND))
    # texts of rows go only where rows of both sides are left between equal ones
    left = found.where("g IS NOT NULL").select("part", "g", F.when(F.col("old_r").isNotNull(), 0).otherwise(1).alias("side"), F.coalesce("old_r", "new_r").alias("r"), "hash")
    texts = [df.select("part", F.lit(k).alias("side"), "r", "tokens") for k, df in enumerate((old, new))]
    near = work.save(_batches(left.join(texts[0].unionByName(texts[1]), ["part", "side", "r"]), left.count()).applyInPandas(_similar_in_gaps, _FOUND))
    paired, over = "old_r IS NOT NULL AND new_r IS NOT NULL", found.where("g IS NULL").unionByName(near)
    single = [over.where(f"{other} IS NULL").select("part", "hash", F.col(r).alias("r")).unionByName(alone.where(F.col("side") == k).select("part", "hash", "r")) for k, (r, other) in enumerate((("old_r", "new_r"), ("new_r", "old_r")))]
    olds, news = (number_within(x, ["part", "hash"], "r", "k").withColumnRenamed("r", r) for x, r in zip(single, ("old_r", "new_r"), strict=True))
    state = F.when(F.col("old_r").isNull(), "added").when(F.col("new_r").isNull(), "removed").otherwise("moved")
    moved = olds.join(news, ["part", "hash", "k"], "full_outer").select("part", "old_r", "new_r", state.alias("state"))
    in_order = [x.select("part", "old_r", "new_r").withColumn("state", F.lit(state)) for x, state in ((same, "same"), (found.where(paired), "same"), (near.where(paired), "similar"))]
    return in_order[0].unionByName(in_order[1]).unionByName(in_order[2]).unionByName(moved)


def _renumbered(anchors: DataFrame) -> DataFrame:
    """Anchors of whole parts as ``g, i, old_r, new_r``: the place on the old side rises on both."""
    return anchors.select(F.col("part").alias("g"), F.col("old_r").alias("i"), "old_r", "new_r")


# any size -------------------------------------------------------------------------


def pair_in_order(old: DataFrame, new: DataFrame, columns: list[str], row: str = "r", o: CompareOptions = CompareOptions(), part: str | None = None, new_columns: list[str] | None = None, work_limit: int = WORK, row_limit: int = ROWS) -> DataFrame:
    """``part, old_r, new_r, state, multiset`` of rows without a key, aligned by position within each ``part``.

    Parts whose row counts multiply to ``WORK`` or less, and add up to ``ROWS`` or less, are aligned in one task each; larger
    ones between anchors (``align_large``).  Parts of which too many rows lie outside the common sequence are
    paired as multisets by joins.  ``multiset`` says which way a part went.  A null part counts as the empty one.
    """

    def rows(df: DataFrame, names: list[str]) -> DataFrame:
        tokens = F.array(*[cell_token(cell_of(df, c), o) for c in names])
        return df.select(F.coalesce(F.col(part).cast("string") if part else F.lit(""), F.lit("")).alias("part"), F.col(row).cast("long").alias("r"), F.xxhash64(tokens).alias("hash"), tokens.alias("tokens"))

    a, b = rows(old, columns), rows(new, new_columns or columns)
    n = a.groupBy("part").agg(F.count("*").alias("n")).join(b.groupBy("part").agg(F.count("*").alias("m")), "part", "full_outer")
    overlap = a.groupBy("part", "hash").agg(F.count("*").alias("x")).join(b.groupBy("part", "hash").agg(F.count("*").alias("y")), ["part", "hash"]).groupBy("part").agg(F.sum(F.least("x", "y")).alias("both"))
    # rows in no common sequence are at least those without an equal row
    sizes = n.join(overlap, "part", "left").select("part", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("m", F.lit(0)).alias("m"), F.coalesce("both", F.lit(0)).alias("both"))
    churned = F.col("n") + F.col("m") - 2 * F.col("both") > CHURN * (F.col("n") + F.col("m"))
    large = (F.col("n") * F.col("m") > work_limit) | (F.col("n") + F.col("m") > row_limit)
    work = Scratch(old.sparkSession, "parts")
    plan = work.save(sizes.select("part", "n", "m", F.when(churned, "multiset").when(large, "large").otherwise("small").alias("way")))

    def of(x: DataFrame, parts: DataFrame) -> DataFrame:
        return x.join(parts.select("part"), "part", "left_semi")

    small = plan.where("way = 'small'")
    multiset = plan.where("way = 'multiset'").select("part")
    schema = "part string, old_r long, new_r long, state string, multiset boolean"

    def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        made = align(left.sort_values("r").reset_index(drop=True), right.sort_values("r").reset_index(drop=True), CHURN)
        made.insert(0, "part", key[0])
        return made

    aligned = of(a, small).groupBy("part").cogroup(of(b, small).groupBy("part")).applyInPandas(run, schema)
    many = plan.where("way = 'large'")
    if not many.isEmpty():
        made = work.save(align_large(*(work.save(of(x, many)) for x in (a, b)), work_limit, row_limit))
        in_order = F.count_if((F.col("state") == "same")).alias("both")
        far = made.groupBy("part").agg(in_order).join(many.select("part", "n", "m"), "part").where(churned).select("part")
        far = work.save(far)
        aligned = aligned.unionByName(made.join(far, "part", "left_anti").withColumn("multiset", F.lit(False)))
        multiset = multiset.unionByName(far)

    def numbered(x: DataFrame) -> DataFrame:
        return number_within(of(x, multiset).drop("tokens"), ["part", "hash"], "r", "k")

    joined = numbered(a).withColumnRenamed("r", "old_r").join(numbered(b).withColumnRenamed("r", "new_r"), ["part", "hash", "k"], "full_outer")
    state = F.when(F.col("old_r").isNull(), "added").when(F.col("new_r").isNull(), "removed").otherwise("same")
    return aligned.unionByName(joined.select("part", "old_r", "new_r", state.alias("state"), F.lit(True).alias("multiset")))
