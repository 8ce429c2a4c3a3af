"""Aggregates that reports are made of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..quality.profiling import exact_quantiles
from .joins import null_safe_join


def medians(df: DataFrame, group: list[str], value: Column, out: str = "median") -> DataFrame:
    """The exact median of each group's values that are neither null nor NaN, from counted values, so no task holds a whole group."""
    v = F.nanvl(value.cast("double"), F.lit(None).cast("double"))
    counts = df.select(*group, v.alias("__v")).filter("__v is not null").groupBy(*group, "__v").agg(F.count(F.lit(1)).alias("__n"))
    return exact_quantiles(counts, group, "__v", "__n").select(*group, F.col("quantile").alias(out))


def summary_by(df: DataFrame, group: str, value: str, digits: int = 3) -> DataFrame:
    """Count, mean and median of the non-null values of a group."""
    v = F.nanvl(F.col(value).cast("double"), F.lit(None).cast("double"))
    a = df.groupBy(group).agg(F.count(v).alias("n"), F.round(F.avg(v), digits).alias("mean"))
    return null_safe_join(a, medians(df, [group], F.col(value)), [group]).withColumn("median", F.round("median", digits))


def by_bucket(df: DataFrame, time: str, value: str, buckets: list[tuple[str, int, int]], digits: int = 4) -> DataFrame:
    """Mean and coverage within named ranges of time, inclusive; a row falls into each range that holds it."""
    labels = F.array_compact(F.array(*[F.when(F.col(time).between(a, b), F.lit(n)) for n, a, b in buckets]))
    v = F.nanvl(F.col(value), F.lit(None).cast("double"))
    return df.select(F.explode(labels).alias("bucket"), v.alias("v")).groupBy("bucket").agg(F.count(F.lit(1)).alias("n_rows"), F.count("v").alias("n_values"), F.round(F.avg("v"), digits).alias("mean"))


def non_null_rates(df: DataFrame, columns: list[str], digits: int = 4) -> DataFrame:
    """Share of non-null (and not NaN) cells per column, in one pass."""
    kinds = dict(df.dtypes)
    there = lambda c: (F.col(c).isNotNull() & ~F.isnan(c)) if kinds[c] in ("double", "float") else F.col(c).isNotNull()
    agg = df.agg(*[F.avg(there(c).cast("double")).alias(c) for c in columns])
    return agg.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.round(F.col(c), digits).alias("rate")) for c in columns])).alias("r")).select("r.*")


def top_k(df: DataFrame, group: list[str], order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each group."""
    return df.withColumn("rank", F.row_number().over(W.partitionBy(*group).orderBy(*order))).filter(F.col("rank") <= k)


def mode_of(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """The most frequent non-null value of each group, ties to the smaller."""
    c = df.filter(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count(F.lit(1)).alias("n"))
    return c.groupBy(*group).agg(F.min_by(value, F.struct(-F.col("n"), F.col(value))).alias("mode"), F.max("n").alias("n"))


def share_and_rank(df: DataFrame, item: str, value: str, digits: int = 6) -> DataFrame:
    """Mean absolute value per item with its share of all and its rank; the windows span one row per item."""
    a = df.groupBy(item).agg(F.avg(F.abs(value)).alias("mean_abs"))
    return a.select(item, F.round("mean_abs", digits).alias("mean_abs"), F.round(F.col("mean_abs") / F.sum("mean_abs").over(W.partitionBy()), digits).alias("share"), F.row_number().over(W.orderBy(F.desc("mean_abs"), item)).alias("rank"))


def overlapping(df: DataFrame, labels: dict[str, Column], value: str, digits: int = 4) -> DataFrame:
    """Count and mean per label; a row counts under every label whose condition it meets."""
    arr = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in labels.items()]))
    v = F.nanvl(F.col(value), F.lit(None).cast("double"))
    return df.select(F.explode(arr).alias("label"), v.alias("v")).groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("v"), digits).alias("mean"))


def joined_distinct(df: DataFrame, group: list[str], value: str, out: str) -> DataFrame:
    """Sorted distinct texts of a group, joined by a bar."""
    return df.groupBy(*group).agg(F.array_join(F.array_sort(F.collect_set(value)), "|").alias(out))


def population_report(pop: DataFrame, code: str, year: str, source: str, value: str) -> DataFrame:
    """``(section, item, n)``: rows, codes, years covered, rows with a count, and codes per source, each from one aggregate."""
    v = F.nanvl(F.col(value), F.lit(None).cast("double"))
    a = pop.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(code).alias("codes"), F.min(year).cast("bigint").alias("first_year"), F.max(year).cast("bigint").alias("last_year"), F.count(v).alias("with_value"))
    head = a.select(F.explode(F.array(*[F.struct(F.lit("table").alias("section"), F.lit(c).alias("item"), F.col(c).cast("bigint").alias("n")) for c in a.columns])).alias("r")).select("r.*")
    return head.unionByName(pop.groupBy(F.col(source).alias("item")).agg(F.count_distinct(code).alias("n")).select(F.lit("source").alias("section"), "item", "n"))
