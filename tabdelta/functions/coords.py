"""Cell addresses: zero-based rows and columns, and A1 text, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col_to_letter(c: Column) -> Column:
    """0 is A, 25 Z, 26 AA; up to three letters (18,277 columns)."""
    one = F.char(65 + c % 26)
    two = F.concat(F.char(65 + (F.floor(c / 26) - 1) % 26), one)
    three = F.concat(F.char(65 + F.floor((c - 702) / 676) % 26), F.char(65 + (F.floor(c / 26) - 1) % 26), one)
    return F.when(c < 26, one).when(c < 702, two).otherwise(three)


def letter_to_col(letters: Column) -> Column:
    """The column of one to three letters, in either case."""
    return F.aggregate(F.split(F.upper(letters), ""), F.lit(0), lambda s, x: s * 26 + F.ascii(x) - 64) - 1


def rc_to_a1(r: Column, c: Column) -> Column:
    return F.concat(col_to_letter(c), (r + 1).cast("string"))


def a1_to_rc(ref: Column) -> Column:
    """``struct(r, c)`` of an address with or without ``$``; null if it is none."""
    bare = F.replace(ref, F.lit("$"), F.lit(""))
    letters, digits = F.regexp_extract(bare, "^([A-Za-z]{1,3})([1-9][0-9]*)$", 1), F.regexp_extract(bare, "^([A-Za-z]{1,3})([1-9][0-9]*)$", 2)
    return F.when(letters != "", F.struct((digits.cast("int") - 1).alias("r"), letter_to_col(letters).alias("c")))
