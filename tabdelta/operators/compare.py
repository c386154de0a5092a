"""Comparison of two tables, two sheets or two workbooks as one call.

Columns are matched, a key is found (or rows are aligned in order where there is none), rows
are paired, cells compared and all checks run.  What reaches the driver is a row for each
column; rows and cells stay in DataFrames.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.coords import col_to_letter, rc_to_a1
from ..functions.values import DATE, EMPTY, ID_LIKE, NUMBER, STRING, cell, cell_of, display_key, is_empty, named, parse_text_date, scalar_text, trim
from ..options import CheckOptions, CompareOptions
from ..sources.scratch import Scratch
from ..sources.snapshots import number_as_read
from . import checks as K
from .columns import Match, match_columns, pair_sheets, sheet_scores, signature
from .diff import REMOVED, Diff, change_counts, diff_pairs
from .formulas import followed, short_totals
from .keys import Key, detect_key
from .order import pair_in_order
from .rows import pair_by_key
from .tables import data_range, header_row, table_columns, totals_rows

_ROW = "_r"
_STRONG_ID = re.compile(r"gstin|pan", re.IGNORECASE)
_ID = re.compile(r"id|code|no\.?|number", re.IGNORECASE)


@dataclass(frozen=True)
class Table:
    """Where the table of a sheet lies: rows and columns count from 0; ``columns`` gives the header of each column."""

    header_row: int
    start: int
    end: int
    columns: dict[int, str]


@dataclass
class Comparison:
    """A compared pair of tables; the DataFrames are lazy."""

    name: str
    columns: list[Match]
    key: Key
    diff: Diff
    matched_by: DataFrame
    findings: DataFrame
    old_table: Table | None = None
    new_table: Table | None = None
    row_pairs: DataFrame | None = None
    kept: list[DataFrame] = field(default_factory=list)
    #: The comparison once more, with formulas followed along ``row_map(sheet, old_row, new_row)``.
    again: Callable[[DataFrame], Comparison] | None = None

    def close(self) -> None:
        """Let go of what was kept for results that read it more than once."""
        for df in self.kept:
            df.unpersist()

    def counts(self) -> DataFrame:
        """One row: the counts of changes and of findings by severity."""
        return change_counts(self.diff.row_states, self.diff.cell_changes).join(F.broadcast(K.severity_counts(self.findings)), F.lit(True))


# tables in sheets ---------------------------------------------------------------


def detect_table(cells: DataFrame, header: int | None = None) -> Table:
    """The table of a sheet of long cells ``r, c, cell``.

    Without a header row (given or found) the table starts with the first filled row, and
    its columns go by their letters.
    """
    if header is None:
        found = header_row(cells).first()
        if found is not None:
            header = int(found["header_row"])
    if header is None:
        first = cells.where(~is_empty(F.col("cell"))).agg(F.min("r")).first()[0]
        header = (0 if first is None else int(first)) - 1
    start, end = (int(x) for x in data_range(cells, header + 1).first())
    names: dict[int, str] = {}
    for r in sorted(table_columns(cells, header, start, end).collect(), key=lambda r: r["c"]):
        name, k = r["header"], 2
        while name in names.values():
            name, k = f"{r['header']} ({k})", k + 1
        names[int(r["c"])] = name
    return Table(header, start, end, names)


def sheet_rows(cells: DataFrame, table: Table) -> DataFrame:
    """The data rows of a table as one cell struct a column, with the row number in ``_r``; totals are left out."""
    inside = cells.where(F.col("r").between(table.start, table.end) & F.col("c").isin(list(table.columns)))
    rows = inside.join(totals_rows(inside).select("r"), "r", "left_anti")
    wide = rows.groupBy("r").agg(*[F.first(F.when(F.col("c") == c, F.col("cell")), ignorenulls=True).alias(f"c{c}") for c in table.columns])
    return wide.select(F.col("r").alias(_ROW), *[F.coalesce(f"c{c}", cell(EMPTY)).alias(name) for c, name in table.columns.items()])


def row_map(c: Comparison, old_rows: int) -> DataFrame:
    """``old_row, new_row`` of all rows of the old sheet: paired rows, null for rows removed or left out of the table.

    Rows above and below the table move with its start and its end.
    """
    old, new = c.old_table, c.new_table
    rows = c.row_pairs.sparkSession.range(old_rows).withColumnRenamed("id", "old_row")
    inside = F.col("old_row").between(old.start, old.end)
    paired = c.row_pairs.where("old_r IS NOT NULL AND new_r IS NOT NULL").select(F.col("old_r").alias("old_row"), F.col("new_r").alias("paired"))
    above = F.greatest(F.lit(0), F.col("old_row") + (new.start - old.start))
    moved = F.when(F.col("old_row") < old.start, above).when(F.col("old_row") > old.end, F.col("old_row") + (new.end - old.end))
    return rows.join(paired, "old_row", "left").select("old_row", F.when(inside, F.col("paired")).otherwise(moved).cast("long").alias("new_row"))


def column_map(c: Comparison, old_columns: int) -> dict[int, int]:
    """The new column of each old one; columns outside of matches stay where they are."""
    at = {name: k for k, name in c.new_table.columns.items()}
    new = {m.old: at[m.new] for m in c.columns if m.old is not None and m.new is not None}
    return {k: new.get(c.old_table.columns.get(k, ""), k) for k in range(old_columns)}


# facts about columns ------------------------------------------------------------


def column_facts(df: DataFrame, names: list[str], o: CompareOptions = CompareOptions()) -> dict[str, dict[str, int]]:
    """Counts of filled cells, kinds, dates and identifiers of all columns, in one pass.

    Cells are spread out first, so that the rules on texts are planned once and not for each column; each task counts
    its equal texts, and only distinct ones are looked at.
    """
    cells = F.array(*[F.struct(F.lit(k).alias("k"), cell_of(df, name).alias("cell")) for k, name in enumerate(names)])
    long = df.select(F.inline(cells)) if names else df.limit(0).select(F.lit(0).alias("k"), cell(EMPTY).alias("cell"))
    c = F.col("cell")
    each = long.where(~is_empty(c)).groupBy("k", c["kind"].alias("kind"), F.when(c["kind"] == STRING, c["text"]).alias("text")).agg(F.count("*").alias("n"))
    date = (F.col("kind") == DATE) | parse_text_date(F.col("text"), o.date_order).isNotNull()
    counts = {"filled": F.lit(True), "dates": date, "id_like": trim(F.col("text")).rlike(ID_LIKE), **{f"kind{x}": F.col("kind") == x for x in range(6)}}
    sums = [F.coalesce(F.sum(F.when(met, F.col("n"))), F.lit(0)).alias(name) for name, met in counts.items()]
    found = {r["k"]: r.asDict() for r in each.groupBy("k").agg(*sums).collect()}
    return {name: {n: found.get(k, {}).get(n, 0) for n in ("filled", "dates", "id_like", *(f"kind{x}" for x in range(6)))} for k, name in enumerate(names)}


def _dominant(facts: dict[str, int]) -> int:
    return max(range(1, 6), key=lambda k: facts[f"kind{k}"])


def date_column(names: list[str], facts: dict[str, dict[str, int]], least: float = 0.9) -> str | None:
    """The first column of dates."""
    return next((n for n in names if facts[n]["filled"] and facts[n]["dates"] >= least * facts[n]["filled"]), None)


def id_and_name_columns(names: list[str], facts: dict[str, dict[str, int]], keys: list[str], least: float = 0.8) -> tuple[str | None, str | None]:
    """The column of identifiers (by its header, else by its values) and the first column of other texts; keys are neither."""
    free = [n for n in names if n not in keys]
    by_value = (n for n in free if facts[n]["kind2"] and facts[n]["id_like"] >= least * facts[n]["kind2"])
    ident = next((n for p in (_STRONG_ID, _ID) for n in free if p.search(n)), None) or next(by_value, None)
    name = next((n for n in free if n != ident and facts[n]["filled"] and facts[n]["kind2"] - facts[n]["id_like"] >= least * facts[n]["filled"]), None)
    return ident, name


# comparison ---------------------------------------------------------------------


def _display(df: DataFrame, keys: list[str]) -> Column:
    """What stands for a row in findings: its key, else its row number."""
    shown = display_key([cell_of(df, k) for k in keys]) if keys else F.lit("")
    if _ROW not in df.columns:
        return shown
    return F.coalesce(F.nullif(shown, F.lit("")), F.concat(F.lit("row "), (F.col(_ROW) + 1).cast("string")))


def _in_order(old: DataFrame, new: DataFrame, names: list[str], o: CompareOptions) -> tuple[DataFrame, DataFrame]:
    """Rows paired by position: the pairs as structs, and their row numbers with states."""
    places = pair_in_order(old, new, names, row=_ROW, o=o).persist()
    a = old.select(F.col(_ROW).alias("old_r"), F.struct(*map(named, old.columns)).alias("old"))
    b = new.select(F.col(_ROW).alias("new_r"), F.struct(*map(named, new.columns)).alias("new"))
    return places.join(a, "old_r", "left").join(b, "new_r", "left").select("old", "new"), places


def compare_tables(
    old: DataFrame, new: DataFrame, o: CompareOptions = CompareOptions(), options: CheckOptions = CheckOptions(), name: str = "Sheet1",
    given: list[str] | None = None, sheets: list[Match] = (), with_kinds: bool = True, formulas: DataFrame | None = None, table: Table | None = None, old_name: str | None = None, save: bool = False,
) -> Comparison:
    """Compare two tables of typed columns or cells.

    ``given`` names key columns of the new table.  A column ``_r`` holds row numbers; without it rows
    are numbered as they are read if there is no key.  ``formulas(id, sheet, formula, r, c)`` of
    the new workbook and the ``table`` they point to add the check of totals.  With ``save``, pairs of rows are
    written once; formulas that are followed read them several times, each with other columns.
    """
    old_names, new_names = ([c for c in df.columns if c != _ROW] for df in (old, new))
    facts = [column_facts(df, names, o) for df, names in ((old, old_names), (new, new_names))]
    kinds = [{n: _dominant(f[n]) for n in f} for f in facts] if with_kinds else [None, None]
    matches = match_columns(old_names, new_names, *kinds)
    common = [(m.old, m.new) for m in matches if m.old is not None and m.new is not None]
    names = [y for _, y in common]
    new_facts = facts[1]
    # the old table under the new names
    a = old.select(*[F.col(_ROW)] * (_ROW in old.columns), *[named(x).alias(y) for x, y in common])
    b = new
    key = detect_key(*[df.select(*[cell_of(df, c).alias(c) for c in names]) for df in (a, b)], names, o, given)
    numeric = frozenset(n for n in names if new_facts[n]["filled"] and new_facts[n]["kind1"] >= 0.9 * new_facts[n]["filled"])
    kept: list[DataFrame] = []
    if key.mode == "order":
        a, b = (df if _ROW in df.columns else number_as_read(df, _ROW) for df in (a, b))
        pairs, places = _in_order(a, b, names, o)
        kept.append(places)
        matched_by = places.groupBy("multiset").count().select(F.when(F.col("multiset"), "multiset").otherwise("order").alias("matched_by")).distinct()
        moved = places.where("state = 'moved'").count()
        row_pairs = places.select("old_r", "new_r")
    else:
        order = F.col(_ROW) if _ROW in a.columns else None
        pairs = pair_by_key(a, b, key.columns, key.columns, o, order)
        matched_by, moved = pairs.sparkSession.createDataFrame([("key",)], "matched_by string"), 0
        row_pairs = pairs.select(F.col(f"old.{_ROW}").alias("old_r"), F.col(f"new.{_ROW}").alias("new_r")) if order is not None else None
    label = _ROW if _ROW in a.columns else None
    if save:
        pairs = Scratch(pairs.sparkSession, "pairs").save(pairs)
        row_pairs = pairs.select(F.col(f"old.{_ROW}").alias("old_r"), F.col(f"new.{_ROW}").alias("new_r")) if label else row_pairs

    def finish(moves: DataFrame | None) -> Comparison:
        judged = pairs if moves is None else follow_formulas(pairs, names, moves, old_name or name)
        diff = diff_pairs(judged, [(n, n) for n in names], key.columns, key.columns, o, numeric, label=label)
        # findings read states and changes many times
        diff.persist()
        findings = _findings(diff, a, b, key, names, new_facts, o, options, name, list(matches), list(sheets), moved, formulas, table)
        return Comparison(name, matches, key, diff, matched_by, findings, row_pairs=row_pairs, kept=[*kept, diff.row_states, diff.cell_changes], again=finish)

    return finish(None)


def follow_formulas(pairs: DataFrame, names: list[str], row_map: DataFrame, sheet: str) -> DataFrame:
    """``pairs`` in which an old formula that is the new one once its rows are moved has the new one's text.

    Such a formula isn't changed; what it gives may be, which then counts as recalculated.  One that
    kept its text although the rows it names have moved is changed: its moved form, with a leading ``=``, stands for it.
    """
    width = len(names)
    both = F.array(*[F.struct(F.lit(k).alias("k"), F.col("old")[n]["formula"].alias("old"), F.col("new")[n]["formula"].alias("new")) for k, n in enumerate(names)])
    asked = pairs.select(F.col(f"old.{_ROW}").alias("_at"), F.inline(both)).where("_at IS NOT NULL AND old IS NOT NULL AND new IS NOT NULL")
    asked = asked.select((F.col("_at") * width + F.col("k")).alias("id"), F.lit(sheet).alias("sheet"), "old", "new")
    other = followed(asked, row_map).where("CASE WHEN same THEN old <> new ELSE upper(old) = upper(new) END")
    text = F.when(F.col("same"), F.col("new")).otherwise(F.concat(F.lit("="), "moved"))
    entry = F.struct((F.col("id") % width).cast("int").alias("k"), text.alias("text"))
    texts = other.groupBy(F.expr(f"id div {width}").alias("_at")).agg(F.map_from_entries(F.collect_list(entry)).alias("_texts"))
    met = pairs.withColumn("_row", F.col(f"old.{_ROW}")).join(texts, F.col("_row") == F.col("_at"), "left")
    old = F.col("old")
    for k, n in enumerate(names):
        cell_now = F.col("old")[n].withField("formula", F.coalesce(F.try_element_at("_texts", F.lit(k)), F.col("old")[n]["formula"]))
        old = old.withField(f"`{n}`", cell_now)
    return met.select(old.alias("old"), "new")


def _findings(
    diff: Diff, old: DataFrame, new: DataFrame, key: Key, names: list[str], facts: dict, o: CompareOptions, options: CheckOptions, name: str,
    columns: list[Match], sheets: list[Match], moved: int, formulas: DataFrame | None, table: Table | None,
) -> DataFrame:
    """The findings of every check."""
    keyed = new.withColumn("_key", _display(new, key.columns))
    touched = K.touched_rows(diff.row_states, diff.cell_changes)
    extra = []
    texts = [n for n in facts if n not in key.columns and facts[n]["kind2"]]
    if key.columns and texts:
        at = {n: col_to_letter(F.lit(c)) for c, n in table.columns.items()} if table else {}
        places = [
            F.struct(F.concat(F.lit(f"{name}!"), *([at[n], (F.col(_ROW) + 1).cast("string")] if table else [F.lit(f"{n} of "), F.col("_key")])).alias("place"), F.when(cell_of(new, n)["kind"] == STRING, cell_of(new, n)["text"]).alias("text"))
            for n in texts
        ]
        spread = keyed.select(F.explode(F.array(*places)).alias("x")).select("x.*").where("text IS NOT NULL")
        extra.append(K.referenced_deletions(diff.row_states.where(F.col("state") == REMOVED).select("key"), spread, name))
    day = date_column(names, facts)
    if day:
        extra.append(K.out_of_period(keyed.select(F.col("_key").alias("key"), K.row_dates_of(cell_of(new, day), o).alias("day")), touched))
    ident, label = id_and_name_columns(names, facts, key.columns)
    if ident and label:
        sides = [df.select(_display(df, key.columns).alias("key"), F.when(cell_of(df, label)["kind"] == STRING, trim(cell_of(df, label)["text"])).alias("name"), trim(scalar_text(cell_of(df, ident))).alias("id")) for df in (old, new)]
        extra.append(K.broken_dependency(*sides, ident))
    if options.india_pack:
        headers = [n for n in names if n not in key.columns and (_STRONG_ID.search(n))]
        if headers:
            extra.append(K.invalid_ids(keyed.select(F.col("_key").alias("key"), *[F.when(cell_of(new, h)["kind"] == STRING, cell_of(new, h)["text"]).alias(h) for h in headers]), touched, headers))
    if formulas is not None and table is not None:
        extra.append(total_findings(formulas, keyed, table, name, key))
    shown = [df.select(display_key([cell_of(df, k) for k in key.columns]).alias("key")) if key.columns else df.limit(0).select(F.lit("").alias("key")) for df in (old, new)]
    found = K.run_checks(diff, *shown, extra=extra)
    if any(m.status in ("added", "removed", "renamed") for m in [*columns, *sheets]) or moved:
        found = found.unionByName(K.structure(new, columns, sheets, moved, name))
    return found


def total_findings(formulas: DataFrame, rows: DataFrame, table: Table, name: str, key: Key) -> DataFrame:
    """CHK-02: totals that stop before the end of the table, grouped by the rows they leave out.

    ``formulas`` holds ``id, sheet, formula, r, c``; ``rows`` the new rows with ``_r`` and ``_key``.  The
    impact is the sum of the rows left out in the first column of the range, where all are numbers.
    """
    spark = rows.sparkSession
    spot = spark.createDataFrame([(name, table.start, table.end, min(table.columns), max(table.columns))], "sheet string, data_start int, data_end int, c_first int, c_last int")
    hits = short_totals(formulas, spot).join(formulas.select("id", F.col("sheet").alias("host"), F.col("r").alias("_fr"), F.col("c").alias("_fc")), "id")
    values = F.create_map(*[x for c, n in table.columns.items() for x in (F.lit(c), F.when(cell_of(rows, n)["kind"] == NUMBER, cell_of(rows, n)["num"]))])
    cells = rows.select(F.col(_ROW).alias("row"), F.col("_key").alias("key"), values.alias("values"))
    left = hits.select("id", "host", "_fr", "_fc", "c1", F.explode(F.sequence("first_missing", "last_missing")).alias("row")).join(cells, "row")
    amount = F.col("values")[F.col("c1")]
    each = left.groupBy("id", "host", "_fr", "_fc").agg(F.sort_array(F.collect_list(F.struct("row", "key"))).alias("out"), F.when(F.count(amount) == F.count("*"), F.sum(amount)).alias("impact"))
    place = rc_to_a1(F.col("_fr"), F.col("_fc"))
    groups = each.groupBy("host", F.transform("out", lambda x: x["key"]).alias("keys")).agg(F.array_sort(F.collect_set(place)).alias("cells"), F.min_by("impact", F.struct("_fr", "_fc")).alias("impact"))
    return groups.select(*K.short_total(F.col("keys"), F.col("cells"), F.col("host"), F.col("impact")))


def formula_cells(cells: DataFrame, sheet: str) -> DataFrame:
    """``id, sheet, formula, r, c`` of the formulas of a sheet."""
    return cells.where("cell.formula IS NOT NULL").select(F.xxhash64(F.lit(sheet), "r", "c").alias("id"), F.lit(sheet).alias("sheet"), F.col("cell.formula").alias("formula"), "r", "c")


def compare_sheets(
    old: DataFrame, new: DataFrame, o: CompareOptions = CompareOptions(), options: CheckOptions = CheckOptions(), name: str = "Sheet1",
    old_name: str | None = None, sheets: list[Match] = (), formulas: DataFrame | None = None, follow: bool = True,
) -> Comparison:
    """Compare two sheets of long cells ``r, c, cell``: their tables are detected first.

    Formulas are followed along the rows of this sheet, unless ``follow`` is off; totals are looked for in ``formulas``,
    those of the new sheet if none are given.
    """
    tables = [detect_table(x, o.header_row.get(n)) for x, n in ((old, old_name or name), (new, name))]
    rows = [sheet_rows(x, t).persist() for x, t in zip((old, new), tables, strict=True)]
    totals = formula_cells(new, name) if formulas is None else formulas
    with_formulas = has_formulas(old)
    found = compare_tables(*rows, o, options, name, o.keys.get(name), sheets, formulas=totals, table=tables[1], old_name=old_name, save=with_formulas)
    found.old_table, found.new_table = tables
    found.kept += rows
    if follow and with_formulas:
        return _followed(found, Scratch(old.sparkSession, "moves").save(sheet_map(found, old, old_name or name)))
    return found


def has_formulas(cells: DataFrame) -> bool:
    return not cells.where("cell.formula IS NOT NULL").isEmpty()


def sheet_map(c: Comparison, old: DataFrame, sheet: str) -> DataFrame:
    """``sheet, old_row, new_row`` of all rows of an old sheet of long cells."""
    last = old.agg(F.max("r")).first()[0] or 0
    return row_map(c, max(int(last), c.old_table.end) + 2).select(F.lit(sheet).alias("sheet"), F.col("old_row").cast("int").alias("old_row"), F.col("new_row").cast("int").alias("new_row"))


def _followed(c: Comparison, moves: DataFrame) -> Comparison:
    """``c`` with formulas followed along ``moves``."""
    again = c.again(moves)
    again.old_table, again.new_table = c.old_table, c.new_table
    again.kept = [*c.kept, *again.kept]
    return again


def pair_workbooks(old: dict[str, DataFrame], new: dict[str, DataFrame], o: CompareOptions = CompareOptions()) -> list[Match]:
    """Sheets paired by the options, by name, and by the likeness of headers and first rows."""
    fixed = [Match(x, y, "matched" if x == y else "renamed") for x, y in o.sheet_pairs if x in old and y in new]
    left, right = ({n: x for n, x in s.items() if n not in {m[k] for m in map(lambda m: (m.old, m.new), fixed)}} for k, s in enumerate((old, new)))
    plain = pair_sheets(list(left), list(right), {})
    lone_old, lone_new = [m.old for m in plain if m.status == "removed"], [m.new for m in plain if m.status == "added"]
    if not lone_old or not lone_new:
        return fixed + plain

    def signatures(sheets: dict[str, DataFrame], names: list[str]) -> DataFrame:
        out = None
        for n in names:
            table = detect_table(sheets[n], o.header_row.get(n))
            rows = sheet_rows(sheets[n], table)
            part = signature(rows.withColumn("r", F.col(_ROW) - table.start), list(table.columns.values()), o=o).select(F.lit(n).alias("sheet"), "*")
            out = part if out is None else out.unionByName(part)
        return out

    scores = {(r["old"], r["new"]): r["score"] for r in sheet_scores(signatures(old, lone_old), signatures(new, lone_new)).collect()}
    return fixed + pair_sheets(list(left), list(right), scores)


def compare_workbooks(old: dict[str, DataFrame], new: dict[str, DataFrame], o: CompareOptions = CompareOptions(), options: CheckOptions = CheckOptions(), formulas: DataFrame | None = None) -> tuple[list[Match], list[Comparison]]:
    """All pairs of sheets compared; sheets added, removed and renamed are reported with the first pair.

    Rows of all sheets are paired before a formula is judged, so a reference to another sheet follows that one's rows.
    """
    pairs = pair_workbooks(old, new, o)
    matched = [m for m in pairs if m.old is not None and m.new is not None]
    changed = [m for m in pairs if m.status != "matched"]
    if formulas is None:
        for n, cells in new.items():
            part = formula_cells(cells, n)
            formulas = part if formulas is None else formulas.unionByName(part)
    found = [compare_sheets(old[m.old], new[m.new], o, options, m.new, m.old, changed if k == 0 else (), formulas, follow=False) for k, m in enumerate(matched)]
    with_formulas = [has_formulas(old[m.old]) for m in matched]
    if any(with_formulas):
        moves = None
        for m, c in zip(matched, found, strict=True):
            # every sheet's formulas read the rows of all sheets
            part = Scratch(old[m.old].sparkSession, "moves").save(sheet_map(c, old[m.old], m.old))
            moves = part if moves is None else moves.unionByName(part)
        found = [_followed(c, moves) if x else c for c, x in zip(found, with_formulas, strict=True)]
    return pairs, found
