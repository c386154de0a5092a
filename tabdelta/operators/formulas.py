"""Spreadsheet aggregates and formula references, over columns of cells.

A sheet's range is a column of cell structs, so SUM, COUNTIF and the like are Spark
aggregates and criteria are predicates.  Formulas follow moved rows by joins of their
references with the row map; no formula is interpreted row by row.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.coords import col_to_letter, letter_to_col
from ..functions.values import BOOLEAN, DATE, EMPTY, ERROR, NUMBER, STRING, number_text

_OPERATOR = re.compile(r"^(<=|>=|<>|=|<|>)?(.*)$", re.DOTALL)
_NUMBER = re.compile(r"^\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*$")


def _num(c: Column) -> Column:
    return F.when(c["kind"].isin(NUMBER, BOOLEAN, DATE), c["num"])


def _shown(c: Column) -> Column:
    """A cell as text for comparisons: TRUE, FALSE, shortest numbers, '' if empty."""
    return F.when(c["kind"] == BOOLEAN, F.when(c["num"] != 0, "TRUE").otherwise("FALSE")).when(c["kind"].isin(NUMBER, DATE), number_text(c["num"])).otherwise(F.coalesce(c["text"], F.lit("")))


def wildcard(pattern: str) -> str:
    """Regular expression of a criterion: * and ? are wild, ~ takes the next character as it is."""
    out, k = "", 0
    while k < len(pattern):
        ch = pattern[k]
        if ch == "~" and k + 1 < len(pattern):
            k += 1
            out += re.escape(pattern[k])
        else:
            out += {"*": ".*", "?": "."}.get(ch) or re.escape(ch)
        k += 1
    return f"(?is)^{out}$"


def criteria(text: str | float | bool | None):
    """A predicate on cells from a criterion such as ``>=5``, ``<>x`` or ``a*``.

    A number is compared with numbers and booleans only; text without regard to case.
    An empty criterion holds for empty cells.
    """
    if text is None or text == "":
        return lambda c: (c["kind"] == EMPTY) | ((c["kind"] == STRING) & (c["text"] == ""))
    shown = ("TRUE" if text else "FALSE") if isinstance(text, bool) else str(text)
    op, operand = _OPERATOR.match(shown).groups()
    op = op or "="
    if _NUMBER.match(operand):
        x = F.lit(float(operand))
        compare = {"=": lambda n: n == x, "<>": lambda n: n != x, "<": lambda n: n < x, ">": lambda n: n > x, "<=": lambda n: n <= x, ">=": lambda n: n >= x}[op]
        return lambda c: F.coalesce(compare(_num(c)), F.lit(op == "<>"))
    if op in ("=", "<>"):
        pattern = wildcard(operand)
        hit = (lambda c: _shown(c).rlike(pattern)) if operand else (lambda c: _shown(c) == "")
        return hit if op == "=" else lambda c: ~hit(c)
    low = F.lit(operand.lower())
    compare = {"<": lambda s: s < low, ">": lambda s: s > low, "<=": lambda s: s <= low, ">=": lambda s: s >= low}[op]
    return lambda c: F.when(c["kind"] == STRING, compare(F.lower(_shown(c)))).otherwise(False)


# aggregates ---------------------------------------------------------------------


def sum_of(c: Column) -> Column:
    """Numbers and booleans; text and errors are skipped."""
    return F.coalesce(F.sum(_num(c)), F.lit(0.0))


def average_of(c: Column) -> Column:
    """Null, for a division by zero, if there is no number."""
    return F.avg(_num(c))


def min_of(c: Column) -> Column:
    return F.coalesce(F.min(_num(c)), F.lit(0.0))


def max_of(c: Column) -> Column:
    return F.coalesce(F.max(_num(c)), F.lit(0.0))


def count_of(c: Column) -> Column:
    return F.count(_num(c))


def counta_of(c: Column) -> Column:
    """Cells that show something; errors do."""
    return F.count_if(~_blank(c))


def countblank_of(c: Column) -> Column:
    return F.count_if(_blank(c))


def _blank(c: Column) -> Column:
    return (c["kind"] == EMPTY) | ((c["kind"] == STRING) & (F.coalesce(c["text"], F.lit("")) == ""))


def sumif(where: Column, test, c: Column | None = None) -> Column:
    return F.coalesce(F.sum(F.when(criteria(test)(where), _num(where if c is None else c))), F.lit(0.0))


def averageif(where: Column, test, c: Column | None = None) -> Column:
    """Mean of the numbers among the matches."""
    return F.avg(F.when(criteria(test)(where), _num(where if c is None else c)))


def _all(tests: list[tuple[Column, object]]) -> Column:
    out = F.lit(True)
    for where, test in tests:
        out = out & criteria(test)(where)
    return out


def sumifs(c: Column, tests: list[tuple[Column, object]]) -> Column:
    return F.coalesce(F.sum(F.when(_all(tests), _num(c))), F.lit(0.0))


def countif(where: Column, test) -> Column:
    return F.count_if(criteria(test)(where))


def countifs(tests: list[tuple[Column, object]]) -> Column:
    return F.count_if(_all(tests))


def averageifs(c: Column, tests: list[tuple[Column, object]]) -> Column:
    """Sum of the numbers among the matches over all matches, numbers or not."""
    hit = _all(tests)
    return F.try_divide(F.coalesce(F.sum(F.when(hit, _num(c))), F.lit(0.0)), F.count_if(hit))


def subtotal(code: int, c: Column) -> Column:
    """1 AVERAGE, 2 COUNT, 3 COUNTA, 4 MAX, 5 MIN, 9 SUM, the same with 100 added; null for others."""
    makers = {1: average_of, 2: count_of, 3: counta_of, 4: max_of, 5: min_of, 9: sum_of}
    make = makers.get(code % 100)
    return make(c).cast("double") if make else F.max(F.lit(None).cast("double"))


def sumproduct(*cs: Column) -> Column:
    """Sum of the row-wise products; what is no number counts 0."""
    out = F.lit(1.0)
    for c in cs:
        out = out * F.coalesce(F.when(c["kind"].isin(NUMBER, DATE), c["num"]), F.lit(0.0))
    return F.coalesce(F.sum(out), F.lit(0.0))


# scalars ------------------------------------------------------------------------


def _scaled(x: Column, digits: int, to) -> Column:
    scale = F.lit(10.0**digits)
    return F.signum(x) * to(F.abs(x) * scale) / scale


def round_half_away(x: Column, digits: int = 0) -> Column:
    return _scaled(x, digits, lambda v: F.floor(v + 0.5))


def round_up(x: Column, digits: int = 0) -> Column:
    return _scaled(x, digits, F.ceil)


def round_down(x: Column, digits: int = 0) -> Column:
    return _scaled(x, digits, F.floor)


def to_number(c: Column) -> Column:
    """A cell in arithmetic: empty is 0, numeric text a number, other text null for an error."""
    text = F.replace(F.trim(c["text"]), F.lit(","), F.lit("")).try_cast("double")
    return F.when(c["kind"] == EMPTY, 0.0).when(c["kind"] == ERROR, F.lit(None)).when(c["kind"] == STRING, text).otherwise(c["num"])


def truthy(c: Column) -> Column:
    return F.when(c["kind"].isin(NUMBER, BOOLEAN, DATE), c["num"] != 0).when(c["kind"] == EMPTY, False).when(F.upper(c["text"]) == "TRUE", True).when(F.upper(c["text"]) == "FALSE", False)


def if_(test: Column, then: Column, otherwise: Column | None = None) -> Column:
    """Null, for an error, if the test is neither true nor false."""
    return F.when(test, then).when(~test, otherwise if otherwise is not None else F.lit(False))


# references ---------------------------------------------------------------------

_CELL = r"\$?[A-Z]{1,3}\$?[1-9][0-9]*"
#: A text literal, or a cell or range with or without a sheet.
REFERENCE = rf'"(?:[^"]|"")*"|(?<![A-Za-z0-9_.$!])(?:(?:\'(?:[^\']|\'\')+\'|[A-Za-z_][A-Za-z0-9_.]*)!)?{_CELL}(?::{_CELL})?(?![A-Za-z0-9_.(])'


#: Rows of a sheet in a block of a row map.
_BLOCK = 4096


def references(formulas: DataFrame) -> DataFrame:
    """``id, k, text, sheet, c1, r1, c2, r2`` and the ``$`` marks of the references of ``formulas(id, sheet, formula)``.

    Text literals come without a sheet's address: ``r1`` is null.  Rows and columns count from 0.
    """
    parts = formulas.select("id", "sheet", F.posexplode(F.regexp_extract_all("formula", F.lit(REFERENCE), F.lit(0))).alias("k", "text"))
    literal = F.startswith("text", F.lit('"'))
    named = F.regexp_extract("text", r"^(.*)!", 1)
    plain = F.when(named == "", F.col("sheet")).otherwise(F.replace(F.regexp_replace(named, "^'|'$", ""), F.lit("''"), F.lit("'")))
    address = F.regexp_extract("text", r"([^!]*)$", 1)

    def part(k: int) -> Column:
        return F.regexp_extract(address, r"^(\$?)([A-Z]{1,3})(\$?)([0-9]+)(?::(\$?)([A-Z]{1,3})(\$?)([0-9]+))?$", k)

    out = parts.select(
        "id", "k", "text", plain.alias("sheet"), F.regexp_extract("text", r"^(.*!)?", 1).alias("prefix"),
        *[F.when(~literal, part(k)).alias(n) for k, n in ((1, "a1"), (3, "b1"), (5, "a2"), (7, "b2"))],
        F.when(~literal, letter_to_col(part(2))).alias("c1"), F.when(~literal, part(4).cast("int") - 1).alias("r1"),
        F.when(~literal & (part(6) != ""), letter_to_col(part(6))).alias("c2"), F.when(~literal & (part(8) != ""), part(8).cast("int") - 1).alias("r2"),
    )
    return out


def survivors(row_map: DataFrame) -> DataFrame:
    """``sheet, old_row, new_row, following, preceding``: new places of the nearest rows left at or after, and at or before, each row.

    Rows are gone through in blocks; what a block has left first and last is carried to the blocks
    beside it, so that no task gets a whole sheet.
    """
    at = row_map.withColumn("_block", F.expr(f"old_row div {_BLOCK}"))
    # both are running values, one of them backwards: a frame to the end would be gone through anew for each row
    back, on = (Window.partitionBy("sheet", "_block").orderBy(x).rowsBetween(Window.unboundedPreceding, 0) for x in (F.desc("old_row"), "old_row"))
    own = at.select("*", *[F.last("new_row", ignorenulls=True).over(w).alias(n) for w, n in ((back, "_after"), (on, "_before"))])
    left = F.when(F.col("new_row").isNotNull(), F.col("old_row"))
    blocks = at.groupBy("sheet", "_block").agg(F.min_by("new_row", left).alias("_first"), F.max_by("new_row", left).alias("_last"))
    down, up = (Window.partitionBy("sheet").orderBy(x).rowsBetween(Window.unboundedPreceding, -1) for x in (F.desc("_block"), "_block"))
    beside = blocks.select("sheet", "_block", F.last("_first", ignorenulls=True).over(down).alias("_next"), F.last("_last", ignorenulls=True).over(up).alias("_previous"))
    return own.join(beside, ["sheet", "_block"]).select("sheet", "old_row", "new_row", F.coalesce("_after", "_next").alias("following"), F.coalesce("_before", "_previous").alias("preceding"))


def translate(formulas: DataFrame, row_map: DataFrame) -> DataFrame:
    """``id, formula`` with references moved along ``row_map(sheet, old_row, new_row)``; null is a deleted row.

    A deleted cell becomes #REF!; a range shrinks to the rows that are left, or #REF! if none
    are.  Rows that the map doesn't have stay.
    """
    refs = references(formulas)
    places = survivors(row_map)
    start = places.select(F.col("sheet").alias("s1"), F.col("old_row").alias("o1"), F.col("new_row").alias("n1"), F.col("following").alias("f1"), F.lit(True).alias("m1"))
    end = places.select(F.col("sheet").alias("s2"), F.col("old_row").alias("o2"), F.col("preceding").alias("p2"), F.lit(True).alias("m2"))
    joined = refs.join(start, (refs["sheet"] == F.col("s1")) & (refs["r1"] == F.col("o1")), "left").join(end, (refs["sheet"] == F.col("s2")) & (refs["r2"] == F.col("o2")), "left")
    low = F.when(F.col("m1"), F.when(F.col("r2").isNull(), F.col("n1")).otherwise(F.col("f1"))).otherwise(F.col("r1"))
    high = F.when(F.col("m2"), F.col("p2")).otherwise(F.col("r2"))

    def at(a: str, c: str, b: str, r: Column) -> Column:
        return F.concat(F.col(a), col_to_letter(F.col(c)), F.col(b), (r + 1).cast("string"))

    one = F.concat("prefix", at("a1", "c1", "b1", low))
    both = F.concat("prefix", at("a1", "c1", "b1", low), F.lit(":"), at("a2", "c2", "b2", high))
    new = (
        F.when(F.col("r1").isNull(), F.col("text"))
        .when(F.col("r2").isNull(), F.coalesce(one, F.lit("#REF!")))
        .otherwise(F.when(low <= high, both).otherwise("#REF!"))
    )
    moved = joined.select("id", "k", F.coalesce(new, F.lit("#REF!")).alias("new")).groupBy("id").agg(F.sort_array(F.collect_list(F.struct("k", "new"))).alias("refs"))
    gaps = formulas.select("id", F.split("formula", REFERENCE).alias("gaps")).join(moved, "id", "left")
    words = F.transform("refs", lambda x: x["new"])
    whole = F.array_join(F.zip_with("gaps", words, lambda g, x: F.concat(g, F.coalesce(x, F.lit("")))), "")
    return gaps.select("id", F.when(F.col("refs").isNull(), F.get("gaps", F.lit(0))).otherwise(whole).alias("formula"))


def canonical(formula: Column) -> Column:
    """Form in which equivalent formulas agree: no spaces outside texts, upper case, no prefix of newer functions."""
    texts = F.regexp_extract_all(formula, F.lit('"(?:[^"]|"")*"'), F.lit(0))
    gaps = F.transform(F.split(formula, '"(?:[^"]|"")*"'), lambda g: F.regexp_replace(F.upper(F.regexp_replace(g, r"\s+", "")), r"_XLFN\.|_XLWS\.", ""))
    return F.array_join(F.zip_with(gaps, texts, lambda g, t: F.concat(g, F.coalesce(t, F.lit("")))), "")


def followed(pairs: DataFrame, row_map: DataFrame) -> DataFrame:
    """``pairs(id, sheet, old, new)`` with ``moved``, the old formula moved along, and ``same``: whether that is the new one."""
    moved = translate(pairs.select("id", "sheet", F.col("old").alias("formula")), row_map).withColumnRenamed("formula", "moved")
    return pairs.join(moved, "id").withColumn("same", canonical(F.col("moved")) == canonical(F.col("new")))


def equivalent(pairs: DataFrame, row_map: DataFrame) -> DataFrame:
    """``id, same`` of ``pairs(id, sheet, old, new)``: whether the old formula, moved along, is the new one."""
    return followed(pairs, row_map).select("id", "same")


#: Functions whose ranges are totals.
TOTALS = r"(?i)\b(SUM|AVERAGE|MIN|MAX|COUNT|COUNTA|COUNTBLANK|SUMIF|SUMIFS|COUNTIF|COUNTIFS|AVERAGEIF|AVERAGEIFS|SUBTOTAL|SUMPRODUCT)\("


def short_totals(formulas: DataFrame, tables: DataFrame) -> DataFrame:
    """CHK-02 hits: ``id, sheet, c1, last, first_missing, last_missing`` of aggregate ranges that stop before a table's end.

    ``tables`` holds ``sheet, data_start, data_end, c_first, c_last``, a row for each sheet.
    A range counts if it starts at the table's first or second row, covers half of it or more
    and touches its columns.
    """
    totals = formulas.where(F.col("formula").rlike(TOTALS))
    refs = references(totals).where("r2 IS NOT NULL")
    hit = refs.join(F.broadcast(tables), "sheet")
    cover = (F.col("r2") - F.greatest("r1", "data_start") + 1) / (F.col("data_end") - F.col("data_start") + 1)
    near = (F.col("r1") <= F.col("data_start") + 1) & (F.col("data_start") <= F.col("r2")) & (F.col("r2") < F.col("data_end"))
    inside = (F.col("c1") <= F.col("c_last")) & (F.col("c2") >= F.col("c_first"))
    return hit.where(near & inside & (cover >= 0.5)).select("id", "sheet", "c1", F.col("r2").alias("last"), (F.col("r2") + 1).alias("first_missing"), F.col("data_end").alias("last_missing"))
