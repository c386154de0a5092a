"""Format-preserving pseudonyms for personal data, by keyed Feistel permutations.

Validated numbers (card, phone, social security, IPv4 and bank account numbers), dates,
mail addresses and access keys found in a text are replaced by other values of the same
format.  The permutation depends on the key, the kind and the value only, so equal
values stay linked across documents, whatever separators they were written with, and no
two values of a kind share a pseudonym.  All of it is Column expressions: one pass of one
regular expression splits a text into matches and what stands between them, and
higher-order functions put it together again.  Nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textkit import let

#: Half-rounds of a permutation: each adds a keyed function of one half to the other.
ROUNDS = 12

_MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")
_MONTH = "|".join([*_MONTHS, *(m[:3] for m in _MONTHS)])
_DAY = "(?:0?[1-9]|[12][0-9]|3[01])"

#: Patterns by kind, tried in this order at each place.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "access_key": r"(?<![A-Za-z0-9])AKIA[A-Z0-9]{16}(?![A-Za-z0-9])",
    "hex_secret": r"(?<![A-Za-z0-9])(?=[0-9A-Fa-f]{0,127}[0-9])(?=[0-9A-Fa-f]{0,127}[A-Fa-f])[0-9A-Fa-f]{18,128}(?![A-Za-z0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ipv4": r"(?<![\w.])(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?![\w]|\.[0-9])",
    "iso_date": r"(?<![\w-])(?:19|20)[0-9]{2}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12][0-9]|3[01])(?!(?!T[0-9])[\w-])",
    "slash_date": r"(?<![\w/-])(?:19|20)[0-9]{2}/(?:0[1-9]|1[0-2])/(?:0[1-9]|[12][0-9]|3[01])(?![\w/-])",
    "name_date": rf"(?<![\w-])(?:{_DAY} (?:{_MONTH}) (?:19|20)[0-9]{{2}}|(?:{_MONTH}) {_DAY}, (?:19|20)[0-9]{{2}})(?![\w-])",
    "day_date": r"(?<![\w/.])(?:0?[1-9]|[12][0-9]|3[01])[/.](?:0?[1-9]|[12][0-9]|3[01])[/.](?:19|20)[0-9]{2}(?![\w/])",
    "ssn": r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])",
    "phone": r"(?<![\w+])(?:\+?1[ .-]?)?(?:\([0-9]{3}\) ?|[2-9][0-9]{2}[ .-])[0-9]{3}[ .-]?[0-9]{4}(?![\w-])",
    "phone_abroad": r"(?<![\w+])\+(?!1[ .-]?[(2-9])[1-9][0-9](?:[ .-]?[0-9]){6,12}(?![\w-])",
    "card": r"(?<![\w.-])[0-9](?:[ -]?[0-9]){12,18}(?![\w-])",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())


def _hash(key: str, *parts: Column) -> Column:
    """64 hexadecimal digits that depend on the key and the parts."""
    return F.sha2(F.concat_ws("|", F.lit(key), *[p.cast("string") for p in parts]), 256)


def permute(key: str, kind: str, value: Column, a: Column | int, b: Column | int) -> Column:
    """Keyed permutation of the integers from 0 to a * b - 1.

    The value is split as value = left * b + right; half-rounds add a keyed function of
    one part to the other, modulo a or b, so every half-round can be undone.
    """
    a, b = (x if isinstance(x, Column) else F.lit(x).cast("long") for x in (a, b))

    def half(s: Column, i: Column) -> Column:
        left, right = s["l"], s["r"]
        odd = i % 2 == 1
        drawn = F.conv(F.substring(_hash(key, F.lit(kind), i, F.when(odd, right).otherwise(left)), 1, 12), 16, 10).cast("long")
        return F.struct(
            F.when(odd, (left + drawn % a) % a).otherwise(left).alias("l"),
            F.when(odd, right).otherwise((right + drawn % b) % b).alias("r"),
        )

    start = F.struct(F.floor(value / b).cast("long").alias("l"), (value % b).cast("long").alias("r"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, half, lambda s: s["l"] * b + s["r"])


def permute_text(key: str, kind: str, text: Column, hexadecimal: bool = False) -> Column:
    """Keyed permutation of a string: letters stay letters of their case and digits digits.

    ``hexadecimal`` takes 0-9a-f as one alphabet.  Other characters stay.  The two
    halves of the string are shifted character by character in turn, each by a keyed
    function of the other.
    """

    def shift(half: Column, drawn: Column) -> Column:
        def one(c: Column, i: Column) -> Column:
            step = F.conv(F.substr(drawn, (i % 31) * 2 + 1, F.lit(4)), 16, 10).cast("int")

            def turn(base: str, size: int) -> Column:
                return F.char((F.ascii(c) - ord(base) + step) % size + ord(base))

            if hexadecimal:
                return F.lower(F.conv(((F.conv(c, 16, 10).cast("int") + step) % 16).cast("string"), 10, 16))
            return F.when(c.between("0", "9"), turn("0", 10)).when(c.between("a", "z"), turn("a", 26)).when(c.between("A", "Z"), turn("A", 26)).otherwise(c)

        return F.array_join(F.transform(F.split(half, ""), one), "")

    def half(s: Column, i: Column) -> Column:
        left, right = s["l"], s["r"]
        odd = i % 2 == 1
        drawn = _hash(key, F.lit(kind), i, F.when(odd, right).otherwise(left))
        return let(
            drawn,
            lambda d: F.struct(F.when(odd, shift(left, d)).otherwise(left).alias("l"), F.when(odd, right).otherwise(shift(right, d)).alias("r")),
        )

    cut = F.floor(F.length(text) / 2).cast("int")
    start = F.struct(F.substring(text, F.lit(1), cut).alias("l"), F.substr(text, cut + 1).alias("r"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, half, lambda s: F.concat(s["l"], s["r"]))


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _padded(number: Column, width: Column | int) -> Column:
    return F.lpad(number.cast("string"), width, "0")


def _refill(layout: Column, values: Column, kept: str) -> Column:
    """``layout`` with its characters of the class ``kept`` replaced by those of ``values`` in order."""

    def filled(held: Column) -> Column:
        def one(c: Column, i: Column) -> Column:
            place = F.length(F.regexp_replace(F.substr(layout, F.lit(1), i + 1), f"[^{kept}]", ""))
            return F.when(c.rlike(f"[{kept}]"), F.substr(held, place, F.lit(1))).otherwise(c)

        return F.array_join(F.transform(F.split(layout, ""), one), "")

    return let(values, filled)


def luhn_digit(payload: Column) -> Column:
    """The check digit that completes a card number."""
    digits = F.transform(F.split(F.reverse(payload), ""), lambda c: c.cast("int"))
    doubled = F.transform(digits, lambda d, i: F.when(i % 2 == 0, F.floor(d * 2 / 10).cast("int") + d * 2 % 10).otherwise(d))
    return ((10 - F.aggregate(doubled, F.lit(0), lambda s, d: s + d) % 10) % 10).cast("string")


def iban_remainder(account: Column) -> Column:
    """Account number without spaces, first four characters last, modulo 97: 1 if valid."""
    moved = F.concat(F.substr(account, F.lit(5)), F.substring(account, 1, 4))

    def step(s: Column, c: Column) -> Column:
        letter = c.between("A", "Z")
        return F.when(letter, (s * 100 + F.ascii(c) - 55) % 97).otherwise((s * 10 + F.ascii(c) - 48) % 97)

    return F.aggregate(F.split(moved, ""), F.lit(0), step)


def _card(key: str, m: Column) -> Column:
    number = _digits(m)
    n = F.length(number)
    # the first digit, which tells the brand, stays; the last one is made anew
    inner = F.substr(number, F.lit(2), n - 2)
    b = F.pow(F.lit(10), F.ceil((n - 2) / 2)).cast("long")
    a = F.pow(F.lit(10), F.floor((n - 2) / 2)).cast("long")
    payload = F.concat(F.substring(number, 1, 1), _padded(permute(key, "card", inner.cast("long"), a, b), n - 2))
    valid = luhn_digit(F.substr(number, F.lit(1), n - 1)) == F.substr(number, n)
    whole = let(payload, lambda p: F.concat(p, luhn_digit(p)))
    return F.when(valid, _refill(m, whole, "0-9")).otherwise(m)


def _phone(key: str, m: Column) -> Column:
    number = F.substr(_digits(m), F.length(_digits(m)) - 9).cast("long")
    # area codes from 200 on, which need no brackets, stay such; those below stay below
    low = F.lit(2_000_000_000)
    new = F.when(number >= low, permute(key, "phone", number - low, 80_000, 100_000) + low).otherwise(permute(key, "low_phone", number, 20_000, 100_000))
    digits = _padded(new, 10)
    country = F.when(F.length(_digits(m)) == 11, F.lit("1")).otherwise("")
    return _refill(m, F.concat(country, digits), "0-9")


def _phone_abroad(key: str, m: Column) -> Column:
    """The first two digits, which tell the country or at least its region, stay."""
    digits = _digits(m)
    new = F.concat(F.substring(digits, 1, 2), permute_text(key, "phone_abroad", F.substr(digits, F.lit(3))))
    return _refill(m, new, "0-9")


def _ssn(key: str, m: Column) -> Column:
    area, group, serial = (F.substring(m, *x).cast("long") for x in ((1, 3), (5, 2), (8, 4)))
    valid = (area > 0) & (area < 900) & (area != 666) & (group > 0) & (serial > 0)
    new = permute(key, "ssn", ((area - F.when(area > 666, 2).otherwise(1)) * 99 + group - 1) * 9_999 + serial - 1, 898 * 99, 9_999)

    def written(n: Column) -> Column:
        front = F.floor(n / 9_999)
        at = F.floor(front / 99)
        return F.concat_ws("-", _padded(at + F.when(at >= 665, 2).otherwise(1), 3), _padded(front % 99 + 1, 2), _padded(n % 9_999 + 1, 4))

    return F.when(valid, let(new, written)).otherwise(m)


def _ipv4(key: str, m: Column) -> Column:
    parts = F.transform(F.split(m, r"\."), lambda x: x.cast("long"))
    value = F.aggregate(parts, F.lit(0).cast("long"), lambda s, x: s * 256 + x)
    new = permute(key, "ipv4", value, 65_536, 65_536)
    return let(new, lambda n: F.concat_ws(".", *[(F.floor(n / 256**k) % 256).cast("string") for k in (3, 2, 1, 0)]))


#: Days from 1900-01-01 to 2099-12-31.
_DAYS = (17, 4_297)


def _date(key: str, day: Column) -> Column:
    first = F.lit("1900-01-01").cast("date")
    return F.date_add(first, permute(key, "date", F.datediff(day, first).cast("long"), *_DAYS).cast("int"))


def _iso_date(key: str, m: Column) -> Column:
    day = F.try_to_date(m, "yyyy-MM-dd")
    return F.when(day.isNull(), m).otherwise(F.date_format(_date(key, day), "yyyy-MM-dd"))


def _slash_date(key: str, m: Column) -> Column:
    day = F.try_to_date(m, "yyyy/MM/dd")
    return F.when(day.isNull(), m).otherwise(F.date_format(_date(key, day), "yyyy/MM/dd"))


def _name_date(key: str, m: Column) -> Column:
    """The order, the length of the month's name and leading zeros stay."""
    name, month_first = F.regexp_extract(m, "[A-Z][a-z]+", 0), m.rlike("^[A-Z]")
    new = F.lit(None).cast("string")
    for short in (False, True):
        for first in (False, True):
            for zero in (False, True):
                month, day = "MMM" if short else "MMMM", "dd" if zero else "d"
                order = f"{month} {day}, yyyy" if first else f"{day} {month} yyyy"
                own = ((F.length(name) == 3) == short) & (month_first == first) & (m.rlike("(?:^| )0[0-9][ ,]") == zero)
                new = F.when(own, F.date_format(_date(key, F.try_to_date(m, order)), order)).otherwise(new)
    return F.coalesce(new, m)


def _day_date(key: str, m: Column) -> Column:
    """Day first if that is a real day, else month first; a single digit in it means no leading zeros."""
    parts = F.split(m, "[/.]")
    first, second, year = (_padded(F.get(parts, F.lit(k)), 2) if k < 2 else F.get(parts, F.lit(k)) for k in range(3))

    def written(order: str) -> Column:
        short = m.rlike(r"(?:^|[/.])[0-9][/.]")
        own = "d/M/yyyy" if order == "dd/MM/yyyy" else "M/d/yyyy"

        def put(day: Column) -> Column:
            text = F.split(F.when(short, F.date_format(day, own)).otherwise(F.date_format(day, order)), "/")
            marks = F.regexp_replace(m, "[0-9]", "")
            return F.concat(F.get(text, F.lit(0)), F.substring(marks, 1, 1), F.get(text, F.lit(1)), F.substring(marks, 2, 1), F.get(text, F.lit(2)))

        return let(_date(key, F.try_to_date(F.concat_ws("/", first, second, year), order)), put)

    by_day, by_month = (F.try_to_date(F.concat_ws("/", first, second, year), order).isNotNull() for order in ("dd/MM/yyyy", "MM/dd/yyyy"))
    return F.when(by_day, written("dd/MM/yyyy")).when(by_month, written("MM/dd/yyyy")).otherwise(m)


def _iban(key: str, m: Column) -> Column:
    plain = F.replace(m, F.lit(" "), F.lit(""))
    country = F.substring(plain, 1, 2)
    body = permute_text(key, "iban", F.substr(plain, F.lit(5)))
    whole = let(body, lambda b: F.concat(country, _padded(98 - iban_remainder(F.concat(country, F.lit("00"), b)), 2), b))
    return F.when(iban_remainder(plain) == 1, _refill(m, whole, "A-Z0-9")).otherwise(m)


def _email(key: str, m: Column) -> Column:
    local, domain = F.substring_index(m, "@", 1), F.substring_index(m, "@", -1)
    return F.concat_ws("@", permute_text(key, "email", local), domain)


def _access_key(key: str, m: Column) -> Column:
    return F.concat(F.lit("AKIA"), permute_text(key, "access_key", F.substr(m, F.lit(5))))


def _hex_secret(key: str, m: Column) -> Column:
    """Permuted again while there is no letter or no digit left (one in thousands for 18 digits), four times at most."""
    new = permute_text(key, "hex_secret", F.lower(m), hexadecimal=True)
    for _ in range(3):
        new = let(new, lambda x: F.when(x.rlike("[0-9]") & x.rlike("[a-f]"), x).otherwise(permute_text(key, "hex_secret", x, hexadecimal=True)))
    return F.when(m == F.upper(m), F.upper(new)).otherwise(new)


_MAKERS: dict[str, Callable[[str, Column], Column]] = {
    "email": _email, "access_key": _access_key, "hex_secret": _hex_secret, "iban": _iban, "ipv4": _ipv4,
    "iso_date": _iso_date, "slash_date": _slash_date, "name_date": _name_date, "day_date": _day_date,
    "ssn": _ssn, "phone": _phone, "phone_abroad": _phone_abroad, "card": _card,
}


def pseudonymise(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row of ``docs`` with its id, the text with pseudonyms, ``n_replaced`` and the ``kinds`` replaced.

    A match that fails its check (Luhn digit of a card, modulo 97 of an account, a real
    day, an assigned number range) stays as it is.  Card numbers keep their first digit,
    mail addresses their domain, account numbers their country.  ``kinds`` lists the kinds in
    order, with commas between.

    Null and empty texts stay, with nothing replaced.  Repeated rows and rows with a null
    id each give a row.  An empty table gives an empty result.  Further columns are ignored.
    """
    text = F.col("text")
    base = docs.select(id_col, F.col(text_col).cast("string").alias("text"))
    split = base.withColumn("_found", F.when(text.rlike("[0-9@]|AKIA"), F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>")))

    def replaced(m: Column) -> Column:
        kind, value = F.lit(None).cast("string"), m
        for name in reversed(PATTERNS):
            hit = m.rlike(f"^(?:{PATTERNS[name]})$")
            if name == "hex_secret":  # an account number may have these letters only
                hit = hit & ~(m.rlike(f"^(?:{PATTERNS['iban']})$") & (iban_remainder(m) == 1))
            kind, value = F.when(hit, F.lit(name)).otherwise(kind), F.when(hit, _MAKERS[name](key, m)).otherwise(value)
        return F.struct(kind.alias("kind"), value.alias("value"))

    some = F.size("_found") > 0
    new = split.withColumn("_new", F.when(some, F.transform("_found", replaced)))
    done = F.filter(F.arrays_zip(F.col("_found").alias("old"), F.col("_new").alias("new")), lambda x: x["old"] != x["new"]["value"])
    whole = F.concat(
        F.array_join(F.zip_with(F.split(text, ANY), F.transform("_new", lambda x: x["value"]), lambda gap, v: F.concat(gap, F.coalesce(v, F.lit("")))), ""),
    )
    return new.select(
        id_col,
        F.when(some, whole).otherwise(text).alias("text"),
        F.when(some, F.size(done)).otherwise(0).cast("long").alias("n_replaced"),
        F.when(some, F.array_join(F.array_sort(F.array_distinct(F.transform(done, lambda x: x["new"]["kind"]))), ",")).otherwise("").alias("kinds"),
    )
