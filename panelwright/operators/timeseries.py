"""Ordered operators on an entity-by-year panel."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .joins import null_safe_join


def lags_and_leads(df: DataFrame, entity: str, time: str, lags: dict[str, list[int]], leads: dict[str, list[int]] | None = None) -> DataFrame:
    """Row-based lags and leads within an entity; over a missing year they reach the row before it."""
    w = W.partitionBy(entity).orderBy(time)
    out = [F.lag(c, n).over(w).alias(f"{c}_lag{n}") for c, ns in lags.items() for n in ns]
    out += [F.lead(c, n).over(w).alias(f"{c}_lead{n}") for c, ns in (leads or {}).items() for n in ns]
    return df.select("*", *out)


def calendar_lag(df: DataFrame, entity: str, time: str, columns: list[str], n: int = 1) -> DataFrame:
    """The value ``n`` years earlier, null if that year is missing; one range frame instead of a self join."""
    w = W.partitionBy(entity).orderBy(time).rangeBetween(-n, -n)
    return df.select("*", *[F.max(c).over(w).alias(f"{c}_year{n}") for c in columns])


def year_grid(entities: DataFrame, first: int, last: int, time: str = "fiscal_year") -> DataFrame:
    """Every entity in every year, by a generated sequence; no join."""
    return entities.withColumn(time, F.explode(F.sequence(F.lit(first), F.lit(last))))


def fill_gaps(df: DataFrame, entity: str, time: str, columns: list[str]) -> DataFrame:
    """Forward and then backward fill within an entity."""
    back = W.partitionBy(entity).orderBy(time).rowsBetween(W.unboundedPreceding, 0)
    ahead = W.partitionBy(entity).orderBy(time).rowsBetween(0, W.unboundedFollowing)
    return df.withColumns({c: F.coalesce(F.last(c, True).over(back), F.first(c, True).over(ahead)) for c in columns})


def fill_sections(df: DataFrame, group: list[str], order: str, header: str, is_continuation, out: str) -> DataFrame:  # noqa: ANN001
    """The last header that is not a continuation, carried down within each group in row order."""
    w = W.partitionBy(*group).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumn(out, F.last(F.when(~is_continuation, F.col(header)), True).over(w))


def interpolate(observed: DataFrame, entity: str, time: str, value: str, first: int, last: int) -> DataFrame:
    """Yearly values between observations: log-linear, linear where a side is not positive, flat outside.

    Segments come from ``lead``, and each unrolls its own years, so the range
    join of years to segments is a generated sequence: one shuffle by entity.
    """
    w = W.partitionBy(entity).orderBy(time)
    s = observed.filter(F.col(value).isNotNull()).select(entity, F.col(time).alias("t0"), F.col(value).cast("double").alias("v0"), F.lead(time).over(w).alias("t1"), F.lead(value).over(w).cast("double").alias("v1"), F.row_number().over(w).alias("i"))
    lo = F.when(F.col("i") == 1, F.least(F.lit(first), F.col("t0"))).otherwise(F.col("t0"))
    hi = F.when(F.col("t1").isNull(), F.greatest(F.lit(last), F.col("t0"))).otherwise(F.col("t1") - 1)
    s = s.withColumn(time, F.explode(F.sequence(lo, hi))).filter(F.col(time).between(first, last))
    x = (F.col(time) - F.col("t0")) / (F.col("t1") - F.col("t0"))
    logs = F.exp(F.log("v0") * (1 - x) + F.log("v1") * x)
    val = F.when(F.col("t1").isNull() | (F.col(time) <= F.col("t0")), F.col("v0")).when((F.col("v0") > 0) & (F.col("v1") > 0), logs).otherwise(F.col("v0") * (1 - x) + F.col("v1") * x)
    return s.select(entity, time, val.alias(value))


def allocate(members: DataFrame, totals: DataFrame, group: list[str], weight: str, total: str, out: str) -> DataFrame:
    """A group's total split over its members by weight; in equal parts where the weights sum to nothing."""
    w = W.partitionBy(*group)
    m = members.withColumn("__s", F.sum(F.coalesce(F.col(weight), F.lit(0.0))).over(w)).withColumn("__n", F.count(F.lit(1)).over(w))
    share = F.when(F.col("__s") > 0, F.coalesce(F.col(weight), F.lit(0.0)) / F.col("__s")).otherwise(1 / F.col("__n"))
    m = m.withColumn("share", share).drop("__s", "__n")
    return null_safe_join(m, totals.select(*group, total), group).withColumn(out, F.col("share") * F.col(total))


def rebase(df: DataFrame, entity: str, time: str, value: str, base: int, out: str) -> DataFrame:
    """``value`` over its value in the base year; null where the base is missing or zero."""
    b = F.max(F.when(F.col(time) == base, F.col(value))).over(W.partitionBy(entity))
    return df.withColumn(out, F.col(value) / F.nullif(b, F.lit(0.0)))
