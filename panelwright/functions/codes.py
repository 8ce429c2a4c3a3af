"""Fixed-width codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean_code(c: Column, width: int) -> Column:
    """Digits of a code, zero-padded to ``width``; '' if it has none, null stays null.

    A decimal tail left by a spreadsheet (``102800000.0``) is dropped first. A
    code longer than ``width`` is kept whole rather than cut.
    """
    digits = F.regexp_replace(F.regexp_replace(F.trim(c.cast("string")), r"\.0+(?=\D*$)", ""), r"\D", "")
    n = F.length(digits)
    return F.when(n == 0, F.lit("")).when(n >= width, digits).otherwise(F.lpad(digits, width, "0"))


def code_to_long(c: Column, max_digits: int = 18) -> Column:
    """The integer a code writes: blanks, quotes, a decimal tail and leading zeros do not count.

    Null for a null code and for one that has no digits, holds letters or is too long.
    """
    s = F.regexp_replace(F.regexp_replace(c.cast("string"), r"(?U)[\s'\"`]", ""), r"\.0+$", "")
    return F.when(s.rlike(rf"^[0-9]{{1,{max_digits}}}$"), s.cast("bigint"))


def parent_code(c: Column, prefix: int, width: int) -> Column:
    """The code of the parent level: the first ``prefix`` characters, filled with zeros."""
    return F.when(F.length(c) == width, F.rpad(F.substring(c, 1, prefix), width, "0"))
