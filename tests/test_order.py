"""Rows without a key in order, in parts too large for one task."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabdelta.operators.order import WORK, _kept_runs, align, align_large, heaviest_increasing, pair_in_order
from tabdelta.sources.scratch import Scratch


def heaviest(first, second, weight):
    """The weight of the heaviest chain, by trying all pairs."""
    best = []
    at = sorted(range(len(first)), key=lambda k: first[k])
    for n, k in enumerate(at):
        best.append(weight[k] + max([best[m] for m in range(n) if second[at[m]] < second[k]], default=0))
    return max(best, default=0)


@pytest.mark.parametrize("seed", range(40))
def test_heaviest_chain(seed):
    rng = random.Random(seed)
    n = rng.choice([0, 1, 2, 7, 40])
    second = rng.sample(range(n), n)
    weight = [rng.choice([1, 1, 2, 9]) for _ in range(n)]
    first = rng.sample(range(n), n)
    kept = heaviest_increasing(np.array(first, int), np.array(second, int), np.array(weight, int))
    chosen = sorted((first[k], second[k]) for k in range(n) if kept[k])
    assert all(a < b for (_, a), (_, b) in zip(chosen, chosen[1:], strict=False))
    assert sum(w for w, x in zip(weight, kept, strict=True) if x) == heaviest(first, second, weight)


def lists(spark, values):
    """Rows of a part: their values as tokens, numbered from 0."""
    made = spark.createDataFrame(pd.DataFrame({"part": "p", "r": range(len(values)), "tokens": [list(v) for v in values]}))
    return made.select("part", "r", F.xxhash64("tokens").alias("hash"), "tokens")


def found(df):
    return sorted([(r.old_r, r.new_r, r.state) for r in df.collect()], key=str)


def test_runs_of_more_than_a_task_takes(spark):
    """Runs in stretches: whatever is kept rises on both sides, and runs that all rise are all kept."""
    rng = random.Random(5)
    order = list(range(400))
    for _ in range(40):
        order.insert(rng.randrange(400), order.pop(rng.randrange(400)))
    rows = [("a", k, j, 1) for k, j in enumerate(order)] + [("b", k, k, 2) for k in range(300)] + [("c", k, 199 - k, 1) for k in range(200)]
    runs = spark.createDataFrame(rows, "g string, run long, j long, w long")
    at = {(g, k): j for g, k, j, _ in rows}
    kept = {}
    for g, k in _kept_runs(runs, 30, Scratch(spark, "test")).collect():
        kept.setdefault(g, []).append((k, at[g, k]))
    for chain in kept.values():
        chain.sort()
        assert all(x < y for (_, x), (_, y) in zip(chain, chain[1:], strict=False))
    assert len(kept["b"]) == 300 and len(kept["c"]) == 1
    assert len(kept["a"]) >= 0.9 * heaviest(*zip(*[(k, j, 1) for g, k, j, _ in rows if g == "a"], strict=True))


@pytest.mark.parametrize("limits", [(WORK, 100_000), (4, 4), (400, 60)])
def test_large_parts_as_small_ones(spark, limits):
    """Insertions, deletions, edits, a move and rows that repeat: the same pairs as of the part as a whole."""
    old = [(f"a{k}", f"b{k}", "c") for k in range(120)]
    old[40:40] = [("blank", "blank", "blank")] * 6
    new = old[:10] + [("n1", "n2", "n3")] + old[12:60] + [(old[60][0], "edited", "c")] + old[61:90] + old[95:] + [old[91]]
    want = align(*[pd.DataFrame({"r": range(len(x)), "hash": [hash(v) for v in x], "tokens": [list(v) for v in x]}) for x in (old, new)])
    want = sorted([(None if pd.isna(i) else int(i), None if pd.isna(j) else int(j), s) for i, j, s in zip(want["old_r"], want["new_r"], want["state"], strict=True)], key=str)
    assert found(align_large(lists(spark, old), lists(spark, new), *limits, hunk=8)) == want


def test_wide_gaps_of_equal_rows(spark):
    """Rows that all repeat have no anchors of their own: the k-th goes with the k-th."""
    old, new = [("x", "y")] * 50 + [("z", "y")] * 3, [("x", "y")] * 47 + [("z", "y")] * 3
    got = found(align_large(lists(spark, old), lists(spark, new), 10, 10, hunk=8))
    assert sorted(i for i, _, _ in got) == list(range(53)) and sum(s == "same" for _, _, s in got) == 50
    assert sum(s == "removed" for _, _, s in got) == 3


def test_one_side_alone(spark):
    some, none = lists(spark, [("a",), ("b",)]), lists(spark, [("a",)]).limit(0)
    assert found(align_large(some, none, 0, 0)) == [(0, None, "removed"), (1, None, "removed")]
    assert found(align_large(none, some, 0, 0)) == [(None, 0, "added"), (None, 1, "added")]
    assert found(align_large(none, none, 0, 0)) == []


def test_large_parts_with_much_churn_are_multisets(spark):
    old = spark.range(60).select(F.lit("p").alias("part"), F.col("id").alias("r"), F.concat(F.lit("v"), "id").alias("x"))
    new = old.select("part", (59 - F.col("r")).alias("r"), "x")
    got = pair_in_order(old, new, ["x"], part="part", work_limit=10, row_limit=10).collect()
    assert len(got) == 60 and all(r.state == "same" and r.multiset and r.old_r == 59 - r.new_r for r in got)


def test_150_000_rows_in_order(spark):
    """Of every 1000 rows one goes, one is edited and a new one is put in; ten rows move to the end."""
    n = 150_000
    old = pd.DataFrame({"r": range(n), "x": [f"v{k}" for k in range(n)], "y": "same", "z": np.arange(n) * 7})
    new = old.rename(columns={"r": "was"}).assign(at=np.where(old["r"].between(70_010, 70_019), old["r"] + n, old["r"]))
    new.loc[new["was"] % 1000 == 5, "x"] += "e"
    fresh = new[new["was"] % 1000 == 7].assign(x="n" + new["x"], y="new", z=-new["z"] - 1, at=new["at"] - 0.5, was=-1)
    new = pd.concat([new[new["was"] % 1000 != 3], fresh]).sort_values("at").drop(columns="at").reset_index(drop=True)
    new.insert(0, "r", range(len(new)))
    a, b = spark.createDataFrame(old), spark.createDataFrame(new)
    got = pair_in_order(a, b.drop("was"), ["x", "y", "z"]).drop("part").persist()
    b = b.withColumn("was", F.nullif("was", F.lit(-1)))
    state = F.when(F.col("o.r").isNull(), "added").when(F.col("b.r").isNull(), "removed").when(F.col("o.r").between(70_010, 70_019), "moved").when(F.col("o.r") % 1000 == 5, "similar").otherwise("same")
    want = a.alias("o").join(b.alias("b"), F.col("o.r") == F.col("b.was"), "full_outer").select(F.col("o.r").alias("old_r"), F.col("b.r").alias("new_r"), state.alias("state"), F.lit(False).alias("multiset"))
    assert got.exceptAll(want).limit(5).collect() == [] and want.exceptAll(got).limit(5).collect() == []
    assert {r.state: r["count"] for r in got.groupBy("state").count().collect()} == {"same": n - 310, "similar": 150, "removed": 150, "added": 150, "moved": 10}


@pytest.mark.parametrize("copies", [1, 3])
def test_wide_parts_of_few_values(spark, copies):
    """rows of 300 values, of which a tenth was dropped; no row tells its place, and in copies no stretch does either."""
    rng = random.Random(copies)
    once = [(str(rng.randrange(50)), rng.choice("ANR"), rng.choice("FO")) for _ in range(12_000 // copies)]
    old = once * copies
    new = [v for v in old if rng.random() >= 0.1]
    states = [r.state for r in align_large(lists(spark, old), lists(spark, new), 400_000, 2_000, hunk=200).collect()]
    assert (states.count("same"), states.count("removed")) == (len(new), len(old) - len(new)) and len(states) == len(old)
