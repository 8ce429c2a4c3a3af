"""Targets and features of a panel row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.numbers import clip, concentration, nan_to_null


def spent(parts: list[str], total: str) -> tuple[Column, Column]:
    """What was spent and where the number comes from: the parts' sum where it is positive, else the total; 0 if all are missing."""
    xs = [F.coalesce(nan_to_null(F.col(p)), F.lit(0.0)) for p in parts]
    detail = sum(xs[1:], xs[0])
    top = F.coalesce(nan_to_null(F.col(total)), F.lit(0.0))
    return F.when(detail > 0, detail).otherwise(top), F.when(detail > 0, "detailed").otherwise("total")


def unused_ratio(used: Column, available: Column) -> Column:
    """1 - used / available within [0, 1]; null unless something was available."""
    a = nan_to_null(available)
    return clip(1 - used / F.when(a > 0, a), 0.0, 1.0)


def log_feature(c: str) -> Column:
    return F.log1p(clip(nan_to_null(F.col(c)), 0.0))


def ratio(a: str, b: str) -> Column:
    return nan_to_null(F.col(a)) / F.nullif(nan_to_null(F.col(b)), F.lit(0.0))


def hhi(parts: list[str]) -> Column:
    return concentration([F.col(p) for p in parts])


def ordinal(c: Column) -> Column:
    """The leading digit of a label such as 1st; null for labels without one."""
    return F.regexp_extract(c, r"^\s*([1-6])", 1).try_cast("int")


def member_flag(c: Column, values: tuple[int, ...]) -> Column:
    return F.coalesce(c.isin(*values), F.lit(False)).cast("int")
