"""Text cleaning and keys of names, as column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Accented letters and what they fold to, footnote marks, affixes and short forms of place names.
ACCENTED = "áàâäãåéèêëíìîïóòôöõúùûüñçýÿÁÀÂÄÃÅÉÈÊËÍÌÎÏÓÒÔÖÕÚÙÛÜÑÇÝ"
FOLDED = "aaaaaaeeeeiiiiooooouuuuncyyAAAAAAEEEEIIIIOOOOOUUUUNCY"
FOOTNOTES = r"[*†‡]+\s*$"
PREFIXES = ("city of", "municipality of", "province of", "bayan ng", "lungsod ng", "dakbayan sa", "munisipalidad ng", "mun of", "cty of", "c of", "pgo")
SUFFIXES = ("city", "municipality", "province", "capital")
SHORT_FORMS = {"sto": "santo", "sta": "santa", "gen": "general", "pres": "president", "gov": "governor", "mt": "mount", "pto": "puerto", "nva": "nueva"}


@F.pandas_udf(T.StringType())
def ascii_fold(s: pd.Series) -> pd.Series:
    """Any script's accents taken off by compatibility decomposition; for alphabets ``fold`` does not list."""
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKD", x).encode("ascii", "ignore").decode())


@F.pandas_udf(T.StringType())
def nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def fold(c: Column) -> Column:
    """Latin accents off, without leaving the JVM."""
    return F.translate(c, ACCENTED, FOLDED)


def squeeze(c: Column) -> Column:
    """Blanks of any kind collapsed and trimmed."""
    return F.trim(F.regexp_replace(c, r"(?U)[\s ]+", " "))


def clean(c: Column) -> Column:
    """Null as '', blanks squeezed, trailing footnote marks off."""
    return squeeze(F.regexp_replace(squeeze(F.coalesce(c, F.lit(""))), FOOTNOTES, ""))


def without_brackets(c: Column) -> Column:
    return squeeze(F.regexp_replace(c, r"\([^)]*\)", " "))


def bracketed(c: Column) -> Column:
    """What stands in the first bracket; '' if there is none."""
    return F.regexp_extract(c, r"\(([^)]*)\)", 1)


def strip_affixes(c: Column) -> Column:
    """One leading and then one trailing affix off, first that fits."""
    s = F.regexp_replace(c, r"^(" + "|".join(PREFIXES) + r") +(?=.)", "")
    return F.regexp_replace(s, r"(?<=.) +(" + "|".join(SUFFIXES) + r")$", "")


def expand_short_forms(c: Column) -> Column:
    """Each word replaced by its long form."""
    out = c
    for k, v in sorted(SHORT_FORMS.items()):
        out = F.regexp_replace(out, rf"\b{k}\b", v)
    return out


def plain_key(c: Column) -> Column:
    """Lower case, accents off, punctuation to blanks; affixes and short forms are kept."""
    return squeeze(F.regexp_replace(F.lower(fold(clean(c))), r"[^a-z0-9]+", " "))


def match_key(c: Column) -> Column:
    """The key that names are compared by: brackets, affixes and accents off, short forms spelt out; '' for null."""
    return expand_short_forms(strip_affixes(plain_key(without_brackets(clean(c)))))


def level_key(c: Column) -> Column:
    """city, municipality or province by the first letter of a typed level, else null."""
    t = F.lower(F.trim(c))
    return F.when(t.startswith("c"), "city").when(t.startswith("m"), "municipality").when(t.startswith("p"), "province")


def split_hint(c: Column) -> tuple[Column, Column]:
    """``Name (Hint)`` as name and hint."""
    return without_brackets(c), squeeze(bracketed(c))


def year_in(c: Column) -> Column:
    """The last four-digit year of 19xx or 20xx in a text, null if none."""
    hits = F.regexp_extract_all(c, F.lit(r"((?:19|20)[0-9]{2})"), 1)
    return F.when(F.size(hits) > 0, F.element_at(hits, -1).cast("int"))


def region_number(c: Column) -> Column:
    """The number that a region's text tells in Arabic or Roman digits, null if none."""
    t = F.upper(F.regexp_extract(c, r"(?i)^\s*(?:region|reg\.?|r)\s*0*([ivx]+|[0-9]+)\b", 1))
    roman = {"I": 1, "II": 2, "III": 3, "IV": 4, "V": 5, "VI": 6, "VII": 7, "VIII": 8, "IX": 9, "X": 10}
    roman |= {"X" + k: 10 + v for k, v in list(roman.items())}  # XI to XX
    m = F.create_map(*[F.lit(x) for kv in roman.items() for x in kv])
    return F.when(t.rlike("^[0-9]+$"), t.try_cast("int")).otherwise(m[t])


def is_note(c: Column) -> Column:
    """Rows of a table that hold no record: blank, totals, titles, notes, sources, footnote lines, long prose."""
    t = F.lower(squeeze(F.coalesce(c, F.lit(""))))
    return (
        (F.length(t) == 0)
        | t.rlike(r"^(sub-?total|grand total|provincial total|total)\b")
        | t.rlike(r"^(table|notes?|source|prepared by|see note|nothing follows|no submission)\b")
        | t.rlike(r"^[0-9]+/")
        | t.rlike(r"^[-`.]+$")
        | t.rlike(r"\(continued\)$|^cont\.|\(cont")
        | (F.length(t) > 90)
    )


def is_metadata(c: Column) -> Column:
    """Rows of a statistical table that are no data.

    Beside blank names: the names a reader gives to missing ones, titles of
    tables, notes and sources, quoted statutes, lines that begin with a
    footnote's small letter (with or without a digit) and a blank, and prose,
    which ends with a point or runs over 90 letters.
    """
    n = F.trim(F.coalesce(c, F.lit("")))
    t = F.lower(n)
    return (
        (n == "")
        | t.isin("nan", "none", "notes:")
        | t.rlike(r"^(table 1\.|note:|sources?:)")
        | t.rlike(r"republic act|in accordance")
        | n.rlike(r"^[a-z][0-9]?\s+\S")
        | n.rlike(r"\.$")
        | (F.length(n) > 90)
    )
