"""Rules checked in one pass, as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import nan_to_null


def check_rules(df: DataFrame, rules: dict[str, tuple[str, Column]]) -> DataFrame:
    """``(rule, severity, n_violations, n_rows)``: all counts from one aggregate."""
    agg = df.agg(F.count(F.lit(1)).alias("__n"), *[F.count_if(F.coalesce(c, F.lit(False))).alias(r) for r, (_, c) in rules.items()])
    rows = [F.struct(F.lit(r).alias("rule"), F.lit(s).alias("severity"), F.col(r).alias("n_violations"), F.col("__n").alias("n_rows")) for r, (s, _) in rules.items()]
    return agg.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def check_groups(df: DataFrame, group: str, rules: dict[str, Column]) -> DataFrame:
    """Violations per group and rule, zero counts included."""
    agg = df.groupBy(group).agg(*[F.count_if(F.coalesce(c, F.lit(False))).alias(r) for r, c in rules.items()])
    rows = [F.struct(F.lit(r).alias("rule"), F.col(r).alias("n_violations")) for r in rules]
    return agg.select(group, F.explode(F.array(*rows)).alias("r")).select(group, "r.*")


def repeated_keys(df: DataFrame, key: list[str]) -> DataFrame:
    """How many keys occur more than once."""
    d = df.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    return d.agg(F.count_if(F.col("n") > 1).alias("n_repeated_keys"), F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("n_rows"))


def coverage(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Distinct keys of both, of the left only and of the right only."""
    a = left.select(key).filter(F.col(key).isNotNull()).distinct().withColumn("l", F.lit(1))
    b = right.select(key).filter(F.col(key).isNotNull()).distinct().withColumn("r", F.lit(1))
    return a.join(b, key, "full").agg(
        F.count_if(F.col("l").isNotNull() & F.col("r").isNotNull()).alias("both"), F.count_if(F.col("r").isNull()).alias("only_left"), F.count_if(F.col("l").isNull()).alias("only_right")
    )


def year_checks(df: DataFrame, group: str, name: str, landmark_of: str, landmarks: dict[int, float], parts: tuple[str, ...], total: str, least_units: int = 1000, off: float = 0.30, mismatch: float = 0.01) -> DataFrame:
    """One row per year with what a yearly file is checked for.

    Rows, distinct names and whether they are fewer than ``least_units``;
    negative and zero values of ``landmark_of``; rows whose ``parts`` miss
    ``total`` by more than ``mismatch`` of it, missing parts counting as zero;
    and, where ``landmarks`` has the year, how far the sum of ``landmark_of``
    lies from it and whether that is more than ``off``.
    """
    v, t = nan_to_null(F.col(landmark_of)), F.coalesce(nan_to_null(F.col(total)), F.lit(0.0))
    made = sum((F.coalesce(nan_to_null(F.col(p)), F.lit(0.0)) for p in parts[1:]), F.coalesce(nan_to_null(F.col(parts[0])), F.lit(0.0)))
    agg = df.groupBy(group).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct(name).alias("n_units"), F.count_if(v < 0).alias("n_negative"), F.count_if(v == 0).alias("n_zero"),
        F.count_if(F.abs(made - t) / F.nullif(F.abs(t), F.lit(0.0)) > mismatch).alias("n_mismatch"), F.sum(v).alias("__sum"),
    )
    known = F.create_map(*[F.lit(x) for kv in landmarks.items() for x in kv])
    rel = F.when(F.col("__sum") > 0, F.abs(F.col("__sum") - known[F.col(group)]) / known[F.col(group)])
    return agg.select(group, "n_rows", "n_units", (F.col("n_units") < least_units).alias("few_units"), "n_negative", "n_zero", "n_mismatch", rel.alias("landmark_deviation"), F.coalesce(rel > off, F.lit(False)).alias("landmark_off"))


def level_structure(master: DataFrame) -> DataFrame:
    """Per level of the master: units, repeated codes, units whose province the master lacks, units without a province."""
    provs = master.filter("level = 'province'").select(F.col("psgc10").alias("__p")).distinct()
    dup = master.groupBy("psgc10").agg(F.count(F.lit(1)).alias("__n"))
    m = master.join(dup, "psgc10").join(provs, master["province_code"] == provs["__p"], "left")
    lost = (F.coalesce("province_code", F.lit("")) != "") & F.col("__p").isNull()
    return m.groupBy("level").agg(F.count(F.lit(1)).alias("n_units"), F.count_if(F.col("__n") > 1).alias("n_repeated"), F.count_if(lost).alias("n_orphans"), F.count_if(F.coalesce("province_code", F.lit("")) == "").alias("n_without_province"))
