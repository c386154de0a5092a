"""Differences between two snapshots: row states, cell changes and their counts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import EMPTY, NUMBER, as_cell, change_kind, compare_values, display_key, is_empty, large_change, let, number_as_text, scalar_text
from ..options import CompareOptions
from .rows import pair_by_key

UNCHANGED, CHANGED, ADDED, REMOVED, MOVED = "unchanged", "changed", "added", "removed", "moved"


@dataclass
class Diff:
    """Lazy results of a comparison."""

    pairs: DataFrame
    row_states: DataFrame
    cell_changes: DataFrame

    def persist(self) -> Diff:
        """Keep states and changes, for results that read them more than once."""
        self.row_states.persist()
        self.cell_changes.persist()
        return self

    def counts(self) -> DataFrame:
        return change_counts(self.row_states, self.cell_changes)


def _flags(a: Column, b: Column, kind: Column, numeric: Column) -> Column:
    large = F.when(kind.isin("value_changed", "type_changed") & large_change(a, b), "large_change")
    text = F.when(number_as_text(b, numeric), "number_as_text")
    return F.array_compact(F.array(large, text))


def diff_pairs(pairs: DataFrame, columns: list[tuple[str, str]], old_keys: list[str], new_keys: list[str], o: CompareOptions = CompareOptions(), numeric: frozenset[str] = frozenset(), label: str | None = None) -> Diff:
    """Compare paired rows cell by cell.

    ``columns`` pairs old with new column names, typed or cells.  Values that are the same bit by
    bit are passed over as they are; only the others become cells that the rules judge.
    Nothing is shuffled.  ``label`` names a column of row numbers that stands for a missing key.
    """
    old, new = F.col("old"), F.col("new")
    kinds = {side: {f.name: f.dataType for f in pairs.schema[side].dataType.fields} for side in ("old", "new")}

    def at(side: str, name: str) -> Column:
        return as_cell(F.col(side)[name], kinds[side][name])

    shown = [F.nullif(F.when(F.col(s).isNotNull(), display_key([at(s, k) for k in ks])), F.lit("")) for s, ks in (("new", new_keys), ("old", old_keys)) if ks]
    if label:
        shown.append(F.concat(F.lit("row "), (F.coalesce(new[label], old[label]) + 1).cast("string")))
    key = F.coalesce(*shown, F.lit(""))

    def one(x: str, y: str) -> Column:
        same_kind = kinds["old"][x] == kinds["new"][y]
        unlike = ~old[x].eqNullSafe(new[y]) if same_kind else ~at("old", x).eqNullSafe(at("new", y))
        return F.when(unlike, F.struct(F.lit(y).alias("column"), at("old", x).alias("old"), at("new", y).alias("new"), F.lit(y in numeric).alias("numeric")))

    def judged(c: Column) -> Column:
        def made(kind: Column) -> Column:
            return F.struct(c["column"].alias("column"), kind.alias("kind"), c["old"].alias("old"), c["new"].alias("new"), _flags(c["old"], c["new"], kind, c["numeric"]).alias("flags"))

        return let(change_kind(c["old"], c["new"], o), made)

    unlike = F.array_compact(F.array(*[one(x, y) for x, y in columns]))
    both = old.isNotNull() & new.isNotNull()
    first = F.when(old.isNull(), ADDED).when(new.isNull(), REMOVED)
    # rows are left behind before the rules apply, and rows without unlike cells aren't judged
    compared = pairs.select(key.alias("key"), first.alias("first"), F.when(both, unlike).alias("unlike"))
    real = F.exists("unlike", lambda c: F.coalesce(~change_kind(c["old"], c["new"], o).isin("recalculated", "format_changed"), F.lit(False)))
    states = compared.select("key", F.coalesce("first", F.when(F.size("unlike") > 0, F.when(real, CHANGED)), F.lit(UNCHANGED)).alias("state"))
    changes = compared.where(F.size("unlike") > 0).select("key", F.explode("unlike").alias("x")).select("key", judged(F.col("x")).alias("x")).select("key", "x.*").where("kind IS NOT NULL")
    return Diff(pairs, states, changes)


def snapshot_diff(old: DataFrame, new: DataFrame, keys: list[str], columns: list[str] | None = None, o: CompareOptions = CompareOptions(), numeric: frozenset[str] = frozenset(), each: bool = False) -> Diff:
    """Compare two typed tables with the same column names by their ``keys``; with ``each``, rows of a key meet as in a join."""
    names = columns or [c for c in old.columns if c in set(new.columns)]
    pairs = pair_by_key(old.select(*names), new.select(*names), keys, keys, o, each=each)
    return diff_pairs(pairs, [(c, c) for c in names], keys, keys, o, numeric)


def render(changes: DataFrame) -> DataFrame:
    """Cell changes with old and new as text and flags joined by commas."""
    return changes.select("key", "column", "kind", scalar_text(F.col("old")).alias("old"), scalar_text(F.col("new")).alias("new"), F.array_join("flags", ",").alias("flags"))


def change_counts(states: DataFrame, changes: DataFrame) -> DataFrame:
    """One row: rows added and removed, edits by hand, formulas overwritten, real changes, recalculated."""
    rows = states.agg(F.count_if(F.col("state") == ADDED).alias("rows_added"), F.count_if(F.col("state") == REMOVED).alias("rows_removed"))
    kind = F.col("kind")
    cells = changes.agg(
        F.count_if(kind.isin("value_changed", "type_changed")).alias("cells_edited_by_hand"),
        F.count_if(kind == "formula_overwritten").alias("formulas_overwritten"),
        F.count_if(kind.isin("formula_changed", "formula_added")).alias("formulas_changed"),
        F.count_if(kind == "recalculated").alias("recalculated"),
    )
    real = F.col("rows_added") + F.col("rows_removed") + F.col("cells_edited_by_hand") + F.col("formulas_overwritten") + F.col("formulas_changed")
    return rows.join(F.broadcast(cells), F.lit(True)).withColumn("real_changes", real)


def positional_baseline(old: DataFrame, new: DataFrame, o: CompareOptions = CompareOptions(), first: int = 0, last: int | None = None) -> DataFrame:
    """``differing``: cells that differ at the same address; both sides are long cells ``r, c, cell``."""

    def window(df: DataFrame, name: str) -> DataFrame:
        rows = df.where(F.col("r") >= first)
        rows = rows if last is None else rows.where(F.col("r") <= last)
        return rows.select("r", "c", F.col("cell").alias(name))

    none = F.struct(F.lit(EMPTY).cast("tinyint").alias("kind"), F.lit(None).cast("double").alias("num"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("string").alias("formula"))
    both = window(old, "a").join(window(new, "b"), ["r", "c"], "full_outer").select(F.coalesce("a", none).alias("a"), F.coalesce("b", none).alias("b"))
    return both.where(~F.col("a").eqNullSafe(F.col("b"))).agg(F.count_if(compare_values(F.col("a"), F.col("b"), o) != "equal").alias("differing"))


def numeric_columns(cells: DataFrame, columns: list[str], least: float = 0.9) -> list[str]:
    """Columns of cell structs of which ``least`` or more of the filled cells are numbers."""
    row = cells.agg(*[(F.count_if(F.col(c)["kind"] == NUMBER) / F.nullif(F.count_if(~is_empty(F.col(c))), F.lit(0))).alias(c) for c in columns]).first()
    return [c for c in columns if row[c] is not None and row[c] >= least]
