"""Repeated rows: kept once by an explicit order, counted, or marked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def keep_one(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key by ``order``, which must end in a unique column.

    Null keys form a group. Only the winner's columns leave a task: the sort is
    within the key's partition, and a filter on rank 1 lets Spark drop rows
    before the shuffle as well (a group limit), which a hot key needs.
    """
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn")


def keep_best(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """As ``keep_one`` by aggregation, with partial results before the shuffle; columns of nested type included."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__b"))
    return best.select(*keys, *[F.col("__b")[c].alias(c) for c in rest]).select(*df.columns)


def duplicate_groups(df: DataFrame, keys: list[str], distinct_of: list[str] | None = None) -> DataFrame:
    """Keys that occur more than once, with their rows and how many values of other columns they mix."""
    extra = [F.count_distinct(c).alias(f"n_{c}") for c in distinct_of or []]
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"), *extra).filter("n_rows > 1")


def mark_duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """All rows with ``is_repeated``: whether their key occurs more than once."""
    return df.withColumn("is_repeated", F.count(F.lit(1)).over(W.partitionBy(*keys)) > 1)
