"""Numbers written as text, and arithmetic that is safe under ANSI rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_number(c: Column) -> Column:
    """A double from text in common notations; null where the text writes no number.

    Currency signs and letters before the digits, blanks and thousands commas
    are dropped; brackets or a trailing minus make it negative; a comma
    followed by one or two last digits, with no point after it, is a decimal
    comma. Dashes, 'n/a' and blanks give null.
    """
    trimmed = F.regexp_replace(F.regexp_replace(c, r"(?U)[\s_']", ""), r"(?i)^(\(?)(php|₱|p|\$|usd)", "$1")

    def plain(t: Column) -> Column:
        s = F.regexp_replace(t, r"[()]|-$", "")
        decimal_comma = s.rlike(r"^-?[0-9.]*[0-9],[0-9]{1,2}$")
        return F.struct(
            (t.rlike(r"^\(.*\)$") | t.rlike(r"-$")).alias("neg"),
            F.when(decimal_comma, F.translate(s, ",.", ".")).otherwise(F.regexp_replace(s, ",", "")).alias("s"),
        )

    def number(z: Column) -> Column:
        x = F.when(z["s"].rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]{1,3})?$"), z["s"].try_cast("double"))
        return x * F.when(z["neg"], -1.0).otherwise(1.0)

    return let(let(trimmed, plain), number)


def let(value: Column, body) -> Column:  # noqa: ANN001
    """``body(value)`` with ``value`` computed once, where repeating it would make the generated code explode."""
    return F.get(F.transform(F.array(value), body), 0)


def safe_div(a: Column, b: Column) -> Column:
    """a / b, null where b is zero, null or NaN."""
    return a / F.when((b != 0) & ~F.isnan(b.cast("double")), b)


def clip(c: Column, lo: float | None = None, hi: float | None = None) -> Column:
    """``c`` within its bounds; null stays null, unlike with greatest and least."""
    out = c
    if lo is not None:
        out = F.when(out < lo, F.lit(lo)).otherwise(out)
    if hi is not None:
        out = F.when(out > hi, F.lit(hi)).otherwise(out)
    return out


def nan_to_null(c: Column) -> Column:
    return F.when(F.isnan(c.cast("double")), None).otherwise(c)


def concentration(parts: list[Column]) -> Column:
    """Sum of squared shares of the parts, missing parts counting as zero; 0.0 if they sum to nothing."""
    xs = [F.coalesce(nan_to_null(p), F.lit(0.0)) for p in parts]
    total = sum(xs[1:], xs[0])
    sq = [F.pow(x / F.nullif(total, F.lit(0.0)), 2) for x in xs]
    return F.coalesce(sum(sq[1:], sq[0]), F.lit(0.0))
