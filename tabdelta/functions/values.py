"""Cell values: kinds, tokens, equality and flags, as Columns.

A cell is ``struct(kind, num, text, formula)``.  Typed columns and grid cells take the
same form, so one set of rules serves both.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..options import CompareOptions

EMPTY, NUMBER, STRING, BOOLEAN, ERROR, DATE = range(6)
EPOCH = "1899-12-30"
EPOCH_1904 = "1904-01-01"
#: Class of the characters that count as white space.
SPACE = r"[\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
SEP = "\u001f"

_NUMERIC = r"^[+-]?([0-9]{1,3}(,[0-9]{2,3})*(\.[0-9]+)?|[0-9]+(\.[0-9]+)?)$"
_NUMERIC_EXP = r"^[+-]?([0-9]{1,3}(,[0-9]{2,3})*(\.[0-9]+)?|[0-9]+(\.[0-9]+)?)([eE][+-]?[0-9]+)?$"
_MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]


def cell(kind: Column | int, num: Column | None = None, text: Column | None = None, formula: Column | None = None) -> Column:
    kind = F.lit(kind) if isinstance(kind, int) else kind
    none = F.lit(None)
    return F.struct(
        kind.cast("tinyint").alias("kind"),
        (none if num is None else num).cast("double").alias("num"),
        (none if text is None else text).cast("string").alias("text"),
        (none if formula is None else formula).cast("string").alias("formula"),
    )


def typed_cell(column: Column, kind: T.DataType) -> Column:
    """The cell of a typed column.  Null and '' are empty; nested values become JSON text."""
    none = column.isNull()
    if isinstance(kind, T.NumericType):
        return cell(F.when(none, EMPTY).otherwise(NUMBER), column)
    if isinstance(kind, T.BooleanType):
        return cell(F.when(none, EMPTY).otherwise(BOOLEAN), column.cast("int"))
    if isinstance(kind, T.DateType):
        return cell(F.when(none, EMPTY).otherwise(DATE), date_to_serial(column))
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return cell(F.when(none, EMPTY).otherwise(DATE), timestamp_to_serial(column))
    text = F.to_json(column) if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)) else column.cast("string")
    blank = none | (text == "")
    return cell(F.when(blank, EMPTY).otherwise(STRING), None, F.when(~blank, text))


def is_cell(kind: T.DataType) -> bool:
    return isinstance(kind, T.StructType) and kind.fieldNames() == ["kind", "num", "text", "formula"]


def as_cell(column: Column, kind: T.DataType) -> Column:
    """A column of cells as it is, a typed one as cells."""
    return column if is_cell(kind) else typed_cell(column, kind)


def named(name: str) -> Column:
    """The column of exactly this name, whatever signs are in it."""
    return F.col("`" + name.replace("`", "``") + "`")


def cell_of(df: DataFrame, name: str) -> Column:
    return as_cell(named(name), df.schema[name].dataType)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, with the value worked out once and the body kept as one expression."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def is_empty(c: Column) -> Column:
    """Empty kind and no formula."""
    return (c["kind"] == EMPTY) & c["formula"].isNull()


# text ---------------------------------------------------------------------------


def trim(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, f"^{SPACE}+", ""), f"{SPACE}+$", "")


def normalize_string(text: Column, o: CompareOptions = CompareOptions()) -> Column:
    """Trimmed; with ``ignore_spaces`` runs of space collapse, with ``ignore_case`` lower case.

    Text is taken as composed (NFC); ``compose`` makes it so.
    """
    out = trim(F.regexp_replace(text, f"{SPACE}+", " ")) if o.ignore_spaces else trim(text)
    return F.lower(out) if o.ignore_case else out


def compose(df: DataFrame, column: str) -> DataFrame:
    """``df`` with a text column in NFC.  Only distinct texts beyond ASCII pass through Python."""
    odd = df.where(F.col(column).rlike(r"[^\x00-\x7F]")).select(F.col(column).alias("_raw")).distinct()

    def nfc(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(_nfc=[unicodedata.normalize("NFC", x) for x in b["_raw"]])

    known = odd.mapInPandas(nfc, "_raw string, _nfc string").where("_raw <> _nfc")
    names = df.columns
    return df.join(known, F.col(column) == F.col("_raw"), "left").select(*[F.coalesce("_nfc", column).alias(c) if c == column else F.col(c) for c in names])


# numbers ------------------------------------------------------------------------


def parse_numeric_text(text: Column, exponent: bool = False) -> Column:
    """The number a text shows, with or without grouping commas; null if it is none or begins 0 and a digit."""
    s = trim(text)
    shown = s.rlike(_NUMERIC_EXP if exponent else _NUMERIC) & ~F.regexp_replace(s, "^[+-]", "").rlike("^0[0-9]")
    return F.when(shown, F.replace(s, F.lit(","), F.lit("")).try_cast("double"))


def js_round(x: Column) -> Column:
    """Halves go up, below zero too."""
    return F.floor(x + 0.5)


def round_for_key(num: Column, tolerance: float) -> Column:
    """A number's place on the tolerance grid, as text."""
    if tolerance <= 0:
        return F.when(F.isnan(num), "nan").otherwise(number_text(num))
    return F.when(F.isnan(num), "nan").otherwise(js_round(num / tolerance).cast("decimal(38,0)").cast("string"))


def number_text(num: Column) -> Column:
    """Shortest text of a number: 5, 0.25, 1e+21.

    One function of the number, as its branches would swell generated code wherever it is used.
    """
    return let(num, _number_text)


def _number_text(num: Column) -> Column:
    size = F.abs(num)
    plain = F.regexp_replace(F.regexp_replace(num.cast("decimal(38,17)").cast("string"), "0+$", ""), r"\.$", "")
    sci = F.regexp_replace(F.regexp_replace(F.regexp_replace(num.cast("string"), r"\.0E", "E"), "E-", "e-"), "E", "e+")
    return (
        F.when(F.isnan(num), "NaN")
        .when(size == float("inf"), F.when(num > 0, "Infinity").otherwise("-Infinity"))
        .when((num == F.floor(num).cast("double")) & (size < 1e15), num.cast("bigint").cast("string"))
        .when((size >= 1e-6) & (size < 1e15), F.when(size.between(1e-3, 9_999_999), num.cast("string")).otherwise(plain))
        .when((size >= 1e15) & (size < 1e21), num.cast("decimal(38,0)").cast("string"))
        .otherwise(sci)
    )


def numeric_value(c: Column) -> Column:
    return F.when(c["kind"].isin(NUMBER, BOOLEAN, DATE), c["num"])


def numbers_equal(a: Column, b: Column, tolerance: float) -> Column:
    return (F.isnan(a) & F.isnan(b)) | (F.abs(a - b) <= tolerance)


# dates --------------------------------------------------------------------------


def date_to_serial(d: Column, date1904: bool = False) -> Column:
    return F.datediff(d, F.lit(EPOCH_1904 if date1904 else EPOCH).cast("date")).cast("double")


def timestamp_to_serial(ts: Column) -> Column:
    first = F.lit(f"{EPOCH} 00:00:00").cast("timestamp")
    return (F.unix_micros(ts.cast("timestamp")) - F.unix_micros(first)) / 86_400_000_000


def serial_to_date(serial: Column, date1904: bool = False) -> Column:
    """The day nearest to a serial; half a day goes to the next."""
    return F.date_add(F.lit(EPOCH_1904 if date1904 else EPOCH).cast("date"), js_round(serial).cast("int"))


def parse_text_date(text: Column, order: str = "DMY") -> Column:
    """A date written Y-M-D, D-Mon-Y, Mon-D-Y or, by ``order``, D-M-Y or M-D-Y; else null.

    Separators are - and /, with month names also a space.  Years of two digits are
    2000 to 2069 and 1970 to 1999.
    """
    s = trim(text)

    def part(pattern: str, k: int) -> Column:
        return F.regexp_extract(s, pattern, k)

    def made(y: Column, m: Column, d: Column) -> Column:
        year = F.when(F.length(y) >= 3, y.cast("int")).otherwise(y.cast("int") + F.when(y.cast("int") <= 69, 2000).otherwise(1900))
        year = F.when(y.cast("int") < 100, y.cast("int") + F.when(y.cast("int") <= 69, 2000).otherwise(1900)).otherwise(year)
        return F.try_to_date(F.format_string("%04d-%02d-%02d", year, m.cast("int"), d.cast("int")), "yyyy-MM-dd")

    def month(name: Column) -> Column:
        short = F.lower(name)
        at = F.array_position(F.array(*[F.lit(m) for m in _MONTHS]), F.when(short == "sept", "sep").otherwise(short))
        return F.when(at > 0, at)

    iso = r"^([0-9]{4})[-/]([0-9]{1,2})[-/]([0-9]{1,2})$"
    named = r"^([0-9]{1,2})[-/ ]([A-Za-z]{3,4})[-/ ]([0-9]{2,4})$"
    first = r"^([A-Za-z]{3,4})[-/ ]([0-9]{1,2})[-/ ]([0-9]{2,4})$"
    plain = r"^([0-9]{1,2})[-/]([0-9]{1,2})[-/]([0-9]{2,4})$"
    a, b = part(plain, 1), part(plain, 2)
    iso_year = part(iso, 1)
    return (
        F.when(s.rlike(iso), F.try_to_date(F.format_string("%s-%02d-%02d", iso_year, part(iso, 2).cast("int"), part(iso, 3).cast("int")), "yyyy-MM-dd"))
        .when(s.rlike(named), F.when(month(part(named, 2)).isNotNull(), made(part(named, 3), month(part(named, 2)), part(named, 1))))
        .when(s.rlike(first), F.when(month(part(first, 1)).isNotNull(), made(part(first, 3), month(part(first, 1)), part(first, 2))))
        .when(s.rlike(plain), made(part(plain, 3), a, b) if order == "MDY" else made(part(plain, 3), b, a))
    )


# tokens and keys ----------------------------------------------------------------


def cell_token(c: Column, o: CompareOptions = CompareOptions()) -> Column:
    """Text that equal values share; the formula has no part in it."""
    return (
        F.when(c["kind"] == EMPTY, "")
        .when(c["kind"] == NUMBER, F.concat(F.lit("n:"), round_for_key(c["num"], o.numeric_tolerance)))
        .when(c["kind"] == DATE, F.concat(F.lit("d:"), number_text(c["num"])))
        .when(c["kind"] == BOOLEAN, F.when(c["num"] != 0, "b:1").otherwise("b:0"))
        .when(c["kind"] == ERROR, F.concat(F.lit("e:"), c["text"]))
        .otherwise(F.concat(F.lit("s:"), normalize_string(c["text"], o)))
    )


def matching_key(cells: list[Column], o: CompareOptions = CompareOptions()) -> Column:
    """Tokens of the key cells; null if any is empty."""
    parts = [F.when(c["kind"] != EMPTY, cell_token(c, o)) for c in cells]
    joined = parts[0]
    for p in parts[1:]:
        joined = F.concat(joined, F.lit(SEP), p)
    return joined


def scalar_text(c: Column) -> Column:
    """What a cell shows: numbers in shortest form, TRUE or FALSE, text; null if empty."""
    return F.when(c["kind"].isin(STRING, ERROR), c["text"]).when(c["kind"] == BOOLEAN, F.when(c["num"] != 0, "TRUE").otherwise("FALSE")).when(c["kind"].isin(NUMBER, DATE), number_text(c["num"]))


def display_key(cells: list[Column]) -> Column:
    """Key cells as shown, with ' / ' between; an empty cell shows nothing."""
    return F.concat_ws(" / ", *[F.coalesce(F.when(c["kind"] == BOOLEAN, number_text(c["num"])).otherwise(scalar_text(c)), F.lit("")) for c in cells])


def row_hash(cells: list[Column], o: CompareOptions = CompareOptions()) -> Column:
    """Hash of the tokens of a row."""
    return F.xxhash64(F.concat_ws(SEP, *[cell_token(c, o) for c in cells]))


# equality and flags -------------------------------------------------------------


def compare_values(a: Column, b: Column, o: CompareOptions = CompareOptions()) -> Column:
    """equal, type_changed or different, by the first rule that applies to two cells.

    The rules are many, so they are one function of both cells instead of generated code;
    callers leave out cells that are the same bit by bit.
    """
    return let(F.struct(a.alias("a"), b.alias("b")), lambda x: _compare_values(x["a"], x["b"], o))


def _compare_values(a: Column, b: Column, o: CompareOptions) -> Column:
    na, nb = numeric_value(a), numeric_value(b)
    both_num = na.isNotNull() & nb.isNotNull()
    a_text, b_text = a["kind"] == STRING, b["kind"] == STRING
    ta, tb = parse_numeric_text(a["text"]), parse_numeric_text(b["text"])

    def near(x: Column, y: Column, if_equal: Column | str) -> Column:
        return F.when(numbers_equal(x, y, o.numeric_tolerance), if_equal).otherwise("different")

    out = F.when(both_num, near(na, nb, F.when(a["kind"] == b["kind"], "equal").otherwise("type_changed")))
    out = out.when(na.isNotNull() & b_text & tb.isNotNull(), near(na, tb, "type_changed"))
    out = out.when(nb.isNotNull() & a_text & ta.isNotNull(), near(ta, nb, "type_changed"))
    if o.text_dates_equal:
        da, db = parse_text_date(a["text"], o.date_order), parse_text_date(b["text"], o.date_order)
        out = out.when((a["kind"] == DATE) & b_text & (serial_to_date(a["num"], o.date1904) == db), "type_changed")
        out = out.when((b["kind"] == DATE) & a_text & (serial_to_date(b["num"], o.date1904) == da), "type_changed")
        out = out.when(a_text & b_text & da.isNotNull() & db.isNotNull(), F.when(da == db, "equal").otherwise("different"))
    out = out.when((a["kind"] == ERROR) | (b["kind"] == ERROR), F.when((a["kind"] == b["kind"]) & (a["text"] == b["text"]), "equal").otherwise("different"))
    out = out.when(a_text & b_text, F.when(normalize_string(a["text"], o) == normalize_string(b["text"], o), "equal").otherwise("different"))
    return out.when((a["kind"] == EMPTY) & (b["kind"] == EMPTY), "equal").otherwise("different")


def change_kind(a: Column, b: Column, o: CompareOptions = CompareOptions(), equivalent: Column | None = None) -> Column:
    """Kind of change between two cells; null if there is none.

    ``equivalent`` says whether two formulas are the same once references are followed
    through moved rows and columns; without it their texts are compared.
    """
    fa, fb = a["formula"].isNotNull(), b["formula"].isNotNull()
    same = F.upper(a["formula"]) == F.upper(b["formula"]) if equivalent is None else equivalent

    def kind(value: Column) -> Column:
        return (
            F.when(fa & fb & same, F.when(value != "equal", "recalculated"))
            .when(fa & fb, "formula_changed")
            .when(fa, "formula_overwritten")
            .when(fb, "formula_added")
            .when(value == "type_changed", "type_changed")
            .when(value == "different", "value_changed")
        )

    return let(compare_values(a, b, o), kind)


def large_change(a: Column, b: Column) -> Column:
    """A typed number that moved by half of itself or more, or changed sign."""
    x = F.coalesce(numeric_value(a), F.when(a["kind"] == STRING, parse_numeric_text(a["text"])))
    y = F.coalesce(numeric_value(b), F.when(b["kind"] == STRING, parse_numeric_text(b["text"])))
    moved = (F.abs(y - x) >= 0.5 * F.abs(x)) | (x * y < 0)
    return F.coalesce(a["formula"].isNull() & b["formula"].isNull() & (x != 0) & moved, F.lit(False))


def number_as_text(b: Column, numeric_column: Column | bool) -> Column:
    """Text that shows a number in a column of numbers."""
    return F.coalesce(F.lit(numeric_column) if isinstance(numeric_column, bool) else numeric_column, F.lit(False)) & (b["kind"] == STRING) & parse_numeric_text(b["text"]).isNotNull()


# messages -----------------------------------------------------------------------


def is_amount_header(header: Column) -> Column:
    return ~F.contains(header, F.lit("%")) & header.rlike("(?i)₹|rs|amount|value|total|price|rate|tax|gst")


def format_inr(num: Column) -> Column:
    """Rupees with Indian grouping (last three digits, then pairs) and up to two decimals."""
    cents = F.round(F.abs(num).cast("decimal(30,10)"), 2)
    whole = F.floor(cents).cast("decimal(30,0)").cast("string")
    part = F.regexp_replace(F.regexp_replace(cents.cast("decimal(30,2)").cast("string"), r"^[0-9]+", ""), r"\.?0+$", "")
    head = F.regexp_replace(F.substr(whole, F.lit(1), F.greatest(F.length(whole) - 3, F.lit(0))), r"(?<=[0-9])(?=(?:[0-9]{2})+$)", ",")
    grouped = F.when(F.length(whole) > 3, F.concat(head, F.lit(","), F.substr(whole, F.length(whole) - 2))).otherwise(whole)
    return F.concat(F.when((num < 0) & (cents != 0), "-").otherwise(""), F.lit("₹"), grouped, part)


def format_value(c: Column, header: Column) -> Column:
    """A cell for a message: (blank) if empty, rupees in columns of amounts."""
    number = F.when(is_amount_header(header), let(c["num"], format_inr)).otherwise(number_text(c["num"]))
    return F.when(c["kind"].isin(NUMBER, DATE), number).otherwise(F.coalesce(scalar_text(c), F.lit("(blank)")))


def finding_id(rule: Column, *parts: Column) -> Column:
    """The rule and 32 bits of FNV-1a over ``rule|pair|key|column``, in UTF-16 units of the basic plane."""
    text = F.concat_ws("|", rule, *[F.coalesce(p, F.lit("")) for p in parts])
    units = F.transform(F.split(text, ""), lambda x: F.conv(F.hex(F.encode(x, "UTF-16BE")), 16, 10).cast("bigint"))
    start = F.lit(0x811C9DC5).cast("bigint")
    hashed = F.aggregate(units, start, lambda h, u: (h.bitwiseXOR(u) * F.lit(0x01000193).cast("bigint")).bitwiseAND(F.lit(0xFFFFFFFF).cast("bigint")))
    return F.concat(rule, F.lit("-"), F.lpad(F.lower(F.hex(hashed)), 8, "0"))


GSTIN = "^[0-3][0-9][A-Z]{5}[0-9]{4}[A-Z][1-9A-Z]Z[0-9A-Z]$"
PAN = "^[A-Z]{5}[0-9]{4}[A-Z]$"
ID_LIKE = r"^[A-Z0-9\-/]{6,}$"


def gstin_valid(text: Column) -> Column:
    return F.upper(trim(text)).rlike(GSTIN)


def pan_valid(text: Column) -> Column:
    return F.upper(trim(text)).rlike(PAN)
