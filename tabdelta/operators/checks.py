"""Risk checks over a comparison; each gives findings of one schema.

``rule, severity, key, column, title, message``.  Keys are shown keys, rows without one
have none.  All checks are joins and aggregations of the row states and cell changes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import DATE, STRING, finding_id, format_inr, format_value, gstin_valid, named, pan_valid, parse_text_date, scalar_text, serial_to_date, trim
from ..options import CheckOptions, CompareOptions
from ..sources.snapshots import number_rows
from .columns import Match
from .diff import ADDED, REMOVED

#: Order of rules within a severity; others come after.
WEIGHTS = ["CHK-01", "CHK-02", "CHK-03", "CHK-04", "CHK-05", "CHK-06", "CHK-07", "CHK-10", "CHK-09"]
SEVERITIES = ["high", "medium", "info"]


def finding(rule: str, severity: str, key: Column | None = None, column: Column | None = None, title: Column | str = "", message: Column | None = None) -> list[Column]:
    none = F.lit(None).cast("string")
    title = F.lit(title) if isinstance(title, str) else title
    return [
        F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), (none if key is None else key).alias("key"), (none if column is None else column).alias("column"),
        title.alias("title"), (title if message is None else message).alias("message"),
    ]


def referenced_deletions(removed: DataFrame, texts: DataFrame, sheet: str = "", most: int = 20) -> DataFrame:
    """CHK-03: removed keys (``key``) that still stand as text elsewhere (``place, text``), with up to ``most`` places.

    Only keys of four characters or more with a letter or four digits count.
    """
    k = trim(F.col("key"))
    sought = removed.select(k.alias("key"), F.lower(k).alias("_k")).where((F.length("key") >= 4) & (F.col("key").rlike("[A-Za-z]") | (F.regexp_count("key", F.lit("[0-9]")) >= 4))).distinct()
    found = texts.select("place", F.lower(trim(F.col("text"))).alias("_k")).join(sought, "_k")
    listed = found.withColumn("n", F.row_number().over(Window.partitionBy("key").orderBy("place"))).where(F.col("n") <= most)
    places = listed.groupBy("key").agg(F.array_join(F.array_sort(F.collect_list("place")), ", ").alias("places"))
    message = F.concat(F.col("key"), F.lit(f" is gone from {sheet} but stands in "), F.col("places"), F.lit("."))
    return places.select(*finding("CHK-03", "high", F.col("key"), None, "Removed key still in use", message))


def row_dates(cells: DataFrame, column: str, o: CompareOptions = CompareOptions()) -> Column:
    """The day of a cell: of its serial, or of a text date."""
    return row_dates_of(F.col(column), o)


def row_dates_of(c: Column, o: CompareOptions = CompareOptions()) -> Column:
    return F.when(c["kind"] == DATE, serial_to_date(c["num"], o.date1904)).when(c["kind"] == STRING, parse_text_date(c["text"], o.date_order))


def dominant_month(days: DataFrame, least: float = 0.8) -> DataFrame:
    """``month``: the month of ``least`` or more of the days in ``day``; no row if there is none."""
    months = days.where("day IS NOT NULL").groupBy(F.trunc("day", "month").alias("month")).agg(F.count("*").alias("n"))
    total = months.agg(F.sum("n").alias("total"))
    return months.join(F.broadcast(total), F.lit(True)).where(F.col("n") / F.col("total") >= least).select("month")


def out_of_period(rows: DataFrame, touched: DataFrame) -> DataFrame:
    """CHK-04: touched rows (``key``) whose ``day`` in ``rows(key, day)`` lies outside the dominant month."""
    month = dominant_month(rows)
    hit = rows.join(touched.select("key").distinct(), "key").join(F.broadcast(month), F.lit(True)).where(F.trunc("day", "month") != F.col("month"))
    name = F.date_format("month", "MMM-yyyy")
    message = F.concat(F.col("key"), F.lit(" has the day "), F.date_format("day", "yyyy-MM-dd"), F.lit(", while most days lie in "), name, F.lit("."))
    return hit.select(*finding("CHK-04", "high", F.col("key"), None, F.concat(F.lit("Day outside "), name), message))


def broken_dependency(old: DataFrame, new: DataFrame, id_header: str = "ID", least: float = 0.95) -> DataFrame:
    """CHK-05: rows ``key, name, id`` whose id is not the one that the name had in the old table.

    The old table must give a single id to ``least`` of the names with two rows or more.
    """

    def ids(df: DataFrame) -> DataFrame:
        rows = df.where((trim(F.col("name")) != "") & (trim(F.col("id")) != ""))
        each = rows.groupBy("name", "id").agg(F.count("*").alias("n"))
        return each.groupBy("name").agg(F.count("*").alias("ids"), F.sum("n").alias("rows"), F.min("id").alias("one"))

    before, after = ids(old), ids(new)
    holds = before.where("rows >= 2").agg((F.coalesce(F.avg((F.col("ids") == 1).cast("int")), F.lit(1.0)) >= least).alias("holds"))
    single = before.where("ids = 1").select("name", F.col("one").alias("old_id"))
    several = after.where("ids > 1").select("name")
    hit = new.join(several, "name").join(single, "name").where(F.col("id") != F.col("old_id")).join(F.broadcast(holds.where("holds")), F.lit(True))
    message = F.concat(F.col("key"), F.lit(" gives "), F.col("id"), F.lit(" for "), F.col("name"), F.lit(", which had "), F.col("old_id"), F.lit(" in all rows before."))
    return hit.select(*finding("CHK-05", "medium", F.col("key"), F.lit(id_header), F.concat(F.col("name"), F.lit(f" has another {id_header}")), message))


def numbers_as_text(changes: DataFrame) -> DataFrame:
    """CHK-06: changed cells that hold a number as text."""
    hit = changes.where(F.array_contains("flags", "number_as_text"))
    message = F.concat(F.lit("'"), scalar_text(F.col("new")), F.lit("' is text, which sums pass over."))
    return hit.select(*finding("CHK-06", "medium", F.col("key"), F.col("column"), "Text in place of a number", message))


def new_duplicates(old_keys: DataFrame, new_keys: DataFrame) -> DataFrame:
    """CHK-07: keys (``key``) that are double in the new table but not in the old one."""
    many = [k.where("key <> ''").groupBy("key").agg(F.count("*").alias("n")).where("n >= 2") for k in (old_keys, new_keys)]
    hit = many[1].join(many[0].select("key"), "key", "left_anti")
    message = F.concat(F.col("key"), F.lit(" stands in "), F.col("n").cast("string"), F.lit(" rows."))
    return hit.select(*finding("CHK-07", "medium", F.col("key"), None, "Key used more than once", message))


def structure(df: DataFrame, columns: list[Match], sheets: list[Match] = (), moved: int = 0, sheet: str = "") -> DataFrame:
    """CHK-09: sheets and columns added, removed or renamed, and rows moved."""
    lines = []
    words = {"added": "{0} added: {2}.", "removed": "{0} removed: {1}.", "renamed": "{0} renamed: {1} → {2}."}
    for what, found in (("sheet", sheets), ("column", columns)):
        lines += [words[m.status].format(what.capitalize(), m.old, m.new) for m in found if m.status in words]
    if moved:
        lines.append(f"{moved} row(s) changed place in {sheet}.")
    rows = df.sparkSession.createDataFrame([(x,) for x in lines], "message string")
    return rows.select(*finding("CHK-09", "info", None, None, F.col("message")))


def invalid_ids(rows: DataFrame, touched: DataFrame, headers: list[str]) -> DataFrame:
    """CHK-10: touched rows whose GSTIN or PAN text, in columns of ``rows`` named for it, has no valid form."""
    out = None
    hit = rows.join(touched.select("key").distinct(), "key")
    for h in headers:
        low = h.lower()
        kind = "GSTIN" if "gstin" in low else "PAN" if "pan" in low.replace("_", " ").split() else None
        if kind is None:
            continue
        valid = gstin_valid(named(h)) if kind == "GSTIN" else pan_valid(named(h))
        part = hit.where(named(h).isNotNull() & (named(h) != "") & ~valid)
        part = part.select(*finding("CHK-10", "medium", F.col("key"), F.lit(h), f"Malformed {kind}", F.concat(named(h), F.lit(f" has not the form of a {kind}."))))
        out = part if out is None else out.unionAll(part)
    return out if out is not None else rows.limit(0).select(*finding("CHK-10", "medium", F.col("key")))


def row_findings(states: DataFrame) -> DataFrame:
    """ROW_ADDED and ROW_REMOVED."""
    out = None
    for state, rule, word in ((ADDED, "ROW_ADDED", "Added"), (REMOVED, "ROW_REMOVED", "Removed")):
        part = states.where(F.col("state") == state).select(*finding(rule, "medium", F.col("key"), None, f"{word} row", F.concat(F.lit(f"{word} row: "), F.col("key"), F.lit("."))))
        out = part if out is None else out.unionAll(part)
    return out


_TITLES = {"value_changed": "Edited value", "type_changed": "Other type", "formula_changed": "Other formula", "formula_added": "New formula"}


def cell_findings(changes: DataFrame) -> DataFrame:
    """CELL_EDIT for every edit."""
    title = F.lit("Changed")
    for kind, text in _TITLES.items():
        title = F.when(F.col("kind") == kind, text).otherwise(title)
    missing = (F.col("kind") == "formula_changed") & ((F.col("old.kind") == 0) | (F.col("new.kind") == 0))

    def side(c: str) -> Column:
        formula = F.col(c)["formula"]
        return F.when((F.col(c)["kind"] == 0) & formula.isNotNull(), F.concat(F.lit("="), formula)).otherwise(format_value(F.col(c), F.col("column")))

    note = F.when(missing, " (One value is not stored and has to be worked out.)").otherwise("")
    message = F.concat(F.col("column"), F.lit(" of "), F.col("key"), F.lit(": "), side("old"), F.lit(" → "), side("new"), F.lit("."), note)
    return changes.where(~F.col("kind").isin("recalculated", "format_changed")).select(*finding("CELL_EDIT", "medium", F.col("key"), F.col("column"), title, message))


def recalculated(changes: DataFrame) -> DataFrame:
    """RECALCULATED: one finding if any cell was."""
    n = changes.where(F.col("kind") == "recalculated").agg(F.count("*").alias("n")).where("n > 0")
    shown = F.col("n").cast("string")
    message = F.concat(shown, F.lit(" formula cell(s) follow changes elsewhere and are not counted as changes."))
    return n.select(*finding("RECALCULATED", "info", None, None, F.concat(shown, F.lit(" recalculated cell(s)")), message))


def overwritten_formulas(changes: DataFrame) -> DataFrame:
    """CHK-01: values typed over formulas."""
    hit = changes.where(F.col("kind") == "formula_overwritten")
    message = F.concat(F.col("column"), F.lit(" of "), F.col("key"), F.lit(" held a formula and now holds "), format_value(F.col("new"), F.col("column")), F.lit("; it no longer follows other cells."))
    return hit.select(*finding("CHK-01", "high", F.col("key"), F.col("column"), "Value typed over a formula", message))


def short_total(keys: Column, cells: Column, host: Column, impact: Column) -> list[Column]:
    """CHK-02: ``keys`` of rows that the totals in ``cells`` of the sheet ``host`` leave out, and the sum they would add."""
    names = F.array_join(keys, ", ")
    sums = F.coalesce(F.concat(F.lit("They would add "), format_inr(F.abs(impact)), F.lit(".")), F.lit("What they would add isn't known."))
    message = F.concat(names, F.lit(" lie past the ranges of "), F.array_join(cells, ", "), F.lit(" on "), host, F.lit(". "), sums)
    return finding("CHK-02", "high", None, None, F.concat(F.lit("Total leaves out "), F.size(keys).cast("string"), F.lit(" row(s)")), message)


def touched_rows(states: DataFrame, changes: DataFrame) -> DataFrame:
    """Keys of rows added or with any changed cell."""
    return states.where(F.col("state") == ADDED).select("key").unionAll(changes.select("key")).distinct()


def ranked(findings: DataFrame, pair: str = "") -> DataFrame:
    """Findings with ``id`` and ``rank`` from 1, by severity, rule, key, column and message.

    Ranges of the order are numbered on their own and shifted by the sizes of those before.
    """
    weight = F.lit(100)
    for k, rule in enumerate(WEIGHTS):
        weight = F.when(F.col("rule") == rule, k).otherwise(weight)
    severity = F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), F.col("severity"))
    marked = findings.select("*", finding_id(F.col("rule"), F.lit(pair), F.col("key"), F.col("column")).alias("id"), severity.alias("_s"), weight.alias("_w"))
    numbered = number_rows(marked, "_s", "_w", "key", "column", "message", name="rank")
    return numbered.withColumn("rank", F.col("rank") + 1).drop("_s", "_w")


def severity_counts(findings: DataFrame) -> DataFrame:
    """``needs_attention, to_review``: findings of high and of medium severity."""
    return findings.agg(F.count_if(F.col("severity") == "high").alias("needs_attention"), F.count_if(F.col("severity") == "medium").alias("to_review"))


def run_checks(diff, old_keys: DataFrame | None = None, new_keys: DataFrame | None = None, columns: list[Match] = (), options: CheckOptions = CheckOptions(), extra: list[DataFrame] = ()) -> DataFrame:
    """The findings of the checks that need no more than the comparison, and ``extra`` ones; double keys only if both lists of keys are given."""
    parts = [overwritten_formulas(diff.cell_changes), numbers_as_text(diff.cell_changes), row_findings(diff.row_states), cell_findings(diff.cell_changes), recalculated(diff.cell_changes), *extra]
    if old_keys is not None and new_keys is not None:
        parts.append(new_duplicates(old_keys, new_keys))
    if columns:
        parts.append(structure(diff.row_states, list(columns)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
