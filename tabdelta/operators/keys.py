"""Key detection: which columns tell the rows of two snapshots apart."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from itertools import combinations
from math import prod

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import BOOLEAN, DATE, EMPTY, NUMBER, STRING, cell_token, is_empty, matching_key, named, parse_numeric_text, parse_text_date
from ..options import CompareOptions

#: Words of headers that name keys (fixed values).
_WORDS = ("no\\.?", "number", "id", "code", "ref", "invoice", "inv", "bill", "voucher", "vch", "employee", "emp", "gstin", "pan", "sku", "order")
_NAME = re.compile(rf"\b({'|'.join(_WORDS)})\b", re.IGNORECASE)


@dataclass(frozen=True)
class Key:
    columns: list[str]
    mode: str  # key, composite or order
    confidence: str  # high, medium or low
    duplicates: int = 0


def column_stats(cells: DataFrame, columns: list[str], o: CompareOptions = CompareOptions()) -> DataFrame:
    """``column, rows, filled, valued, distinct, fill, uniq, is_date, is_decimal`` of all columns in one pass.

    Each task counts its distinct cells before the shuffle, and only distinct ones become tokens and are looked at for dates.
    """
    parts = F.array(*[F.struct(F.lit(c).alias("column"), named(c).alias("cell")) for c in columns])
    long = cells.select(F.explode(parts).alias("x")).select("x.*").groupBy("column", "cell").agg(F.count("*").alias("_n"))
    c, times = F.col("cell"), F.col("_n")
    shown = F.coalesce(F.when(c["kind"] == NUMBER, c["num"]), F.when(c["kind"] == STRING, parse_numeric_text(c["text"])))
    date = (c["kind"] == DATE) | ((c["kind"] == STRING) & parse_text_date(c["text"], o.date_order).isNotNull())
    tokens = long.groupBy("column", F.when(~is_empty(c), cell_token(c, o)).alias("token")).agg(
        *[F.coalesce(F.sum(F.when(met, times)), F.lit(0)).alias(name) for name, met in (("n", F.lit(True)), ("dates", date), ("numbers", shown.isNotNull()), ("decimals", shown != F.floor(shown)))]
    )
    some = F.col("token").isNotNull()
    n = F.when(some, F.col("n")).otherwise(0)
    stats = tokens.groupBy("column").agg(
        F.sum("n").alias("rows"), F.sum(n).alias("filled"), F.sum(F.when(F.col("token") != "", F.col("n")).otherwise(0)).alias("valued"), F.count_if(some).alias("distinct"), F.sum("dates").alias("dates"), F.sum("numbers").alias("numbers"), F.sum("decimals").alias("decimals")
    )

    def share(a: str, b: str) -> Column:
        return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)

    return stats.select(
        "column", "rows", "filled", "valued", "distinct", share("filled", "rows").alias("fill"), share("distinct", "filled").alias("uniq"), (share("dates", "filled") >= 0.5).alias("is_date"), (share("decimals", "numbers") >= 0.3).alias("is_decimal")
    )


def duplicates(cells: DataFrame, keys: list[str], o: CompareOptions = CompareOptions()) -> DataFrame:
    """``duplicates``: rows beyond the first of each key."""
    groups = cells.select(matching_key([named(k) for k in keys], o).alias("key")).where("key IS NOT NULL").groupBy("key").agg(F.count("*").alias("n"))
    return groups.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("long").alias("duplicates"))


def uniqueness(cells: DataFrame, combos: list[list[str]], o: CompareOptions = CompareOptions()) -> DataFrame:
    """``combo, uniq, duplicates``: distinct keys over rows with a key, and rows beyond the first of each, of every combination of columns in one pass.

    Each cell is made a token once, whatever combinations it is in; keys are equal if 128 bits of hash of their tokens are.
    """
    used = list(dict.fromkeys(c for cs in combos for c in cs))
    tokens = [F.when(named(c)["kind"] != EMPTY, cell_token(named(c), o)) for c in used]
    hashed = cells.select(*[F.when(t.isNotNull(), F.struct(F.xxhash64(t).alias("h"), F.xxhash64(F.lit(1), t).alias("i"))).alias(f"t{k}") for k, t in enumerate(tokens)])

    def part(k: int, cs: list[str]) -> Column:
        at = [F.col(f"t{used.index(c)}") for c in cs]
        whole = reduce(lambda x, y: x & y, [t.isNotNull() for t in at])
        return F.when(whole, F.struct(F.lit(k).alias("combo"), F.xxhash64(*[t["h"] for t in at]).alias("h"), F.xxhash64(*[t["i"] for t in at]).alias("i")))

    rows = hashed.select(F.explode(F.array(*[part(k, cs) for k, cs in enumerate(combos)])).alias("x")).where("x IS NOT NULL").select("x.*")
    keys = rows.groupBy("combo", "h", "i").agg(F.count("*").alias("n"))
    return keys.groupBy("combo").agg((F.count("*") / F.sum("n")).alias("uniq"), (F.sum("n") - F.count("*")).alias("duplicates"))


def _may_be_unique(stats: dict, columns: tuple[str, ...]) -> bool:
    """Whether as many keys as 99 % of the rows can be made of the values of ``columns``."""
    keyed = min(s["rows"] for s in stats.values()) - sum(stats[c]["rows"] - stats[c]["valued"] for c in columns)
    return prod(stats[c]["distinct"] for c in columns) >= 0.99 * keyed


def detect_key(old: DataFrame, new: DataFrame, columns: list[str], o: CompareOptions = CompareOptions(), given: list[str] | None = None) -> Key:
    """The columns given, else the best single column, else two or three together, else none.

    A single key is filled and unique to 98 % on both sides; names that sound like keys
    score higher, dates and decimals lower.  Combinations of the eight most distinct columns
    must be unique to 99 %.  Only statistics, a row for each column, reach the driver.  Three are tried only if no two are
    a key, combinations of too few different values not at all, and a table compared with itself is read for one side.
    """
    if given and all(c in columns for c in given):
        return Key(given, "key" if len(given) == 1 else "composite", "high", duplicates(new, given, o).first()[0])
    tables = [old] if old.sameSemantics(new) else [old, new]
    sides = [{r["column"]: r for r in column_stats(x, columns, o).collect()} for x in tables]
    sides = [sides[0], sides[-1]]
    best: tuple[float, str, bool] | None = None
    for c in columns:
        a, b = (s.get(c) for s in sides)
        if a is None or b is None or min(a["fill"], b["fill"], a["uniq"], b["uniq"]) < 0.98:
            continue
        score = min(a["fill"], b["fill"]) * min(a["uniq"], b["uniq"]) + 0.05 * bool(_NAME.search(c)) - 0.3 * (a["is_date"] or b["is_date"]) - 0.3 * (a["is_decimal"] or b["is_decimal"])
        if best is None or score > best[0]:
            best = score, c, a["uniq"] >= 1 and b["uniq"] >= 1
    if best:
        return Key([best[1]], "key", "high" if best[2] else "medium", duplicates(new, [best[1]], o).first()[0])
    ranked = sorted((c for c in columns if all(c in s and s[c]["fill"] >= 0.98 for s in sides)), key=lambda c: -min(s[c]["uniq"] for s in sides))[:8]
    for n in (2, 3):
        combos = [list(x) for x in combinations(ranked, n) if all(_may_be_unique(s, x) for s in sides)]
        if not combos:
            continue
        combos.sort(key=lambda cs: -sum(bool(_NAME.search(c)) for c in cs))
        found = [{r["combo"]: r for r in uniqueness(x, combos, o).collect()} for x in tables]
        for k, cs in enumerate(combos):
            if all(k in u and u[k]["uniq"] >= 0.99 for u in found):
                return Key(cs, "composite", "medium", found[-1][k]["duplicates"])
    return Key([], "order", "low")
