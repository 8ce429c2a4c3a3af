"""Joins with the null and name rules a panel needs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Join on ``keys`` where null equals null; the keys are kept once, from the left.

    Spark hashes null-safe equality like plain equality, so this stays a hash
    or merge join. Other columns of the right must not clash with the left.
    """
    r = right.select(*[F.col(k).alias(f"__r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    cond = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys])
    return left.join(r, cond, how).drop(*[f"__r_{k}" for k in keys])


def dimension_wins(fact: DataFrame, dim: DataFrame, key: str, how: str = "left") -> DataFrame:
    """Fact joined to a dimension; where both have a column the dimension's is kept."""
    clash = [c for c in fact.columns if c in dim.columns and c != key]
    return fact.drop(*clash).join(dim, key, how)


def prefixed(df: DataFrame, prefix: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """All columns but ``keep`` renamed with a prefix, so that a join cannot clash."""
    return df.select(*[F.col(c) if c in keep else F.col(c).alias(prefix + c) for c in df.columns])
