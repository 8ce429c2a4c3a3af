"""Codes whose prefixes are their parents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.codes import clean_code
from ..functions.numbers import parse_number
from ..functions.text import clean, plain_key, strip_affixes


def parents(codes: DataFrame, code: str, prefix: int, width: int = 10) -> DataFrame:
    """``<code>`` with the code of its parent, made of its first ``prefix`` characters."""
    return codes.withColumn("parent_code", F.rpad(F.substring(F.col(code), 1, prefix), width, "0"))


def with_parent_name(df: DataFrame, code: str, parent: str, name: str, out: str) -> DataFrame:
    """The parent's name looked up in the same table, '' if it has none."""
    up = df.select(F.col(code).alias("__c"), F.col(name).alias("__n")).dropDuplicates(["__c"])
    return df.join(up, df[parent] == up["__c"], "left").withColumn(out, F.coalesce("__n", F.lit(""))).drop("__c", "__n")


def harmonize_codes(raw: DataFrame, code: str, name: str, level: str, population: str) -> DataFrame:
    """A raw code list as a master: clean codes of ten digits, levels, parents and their names, keys, population.

    Rows without a ten-digit code or of an unknown level are dropped; a unit
    whose derived province is not in the list is independent and gets the
    empty province code.
    """
    levels = {"reg": "region", "prov": "province", "city": "city", "mun": "municipality", "submun": "submunicipality", "bgy": "barangay"}
    m = F.create_map(*[F.lit(x) for kv in levels.items() for x in kv])
    d = raw.select(clean_code(F.col(code), 10).alias("psgc10"), clean(F.col(name)).alias("name"), m[F.lower(F.trim(F.col(level)))].alias("level"), parse_number(F.col(population)).cast("bigint").alias("pop_2024"))
    d = d.filter("length(psgc10) = 10 and level is not null")
    d = d.withColumn("region_code", F.rpad(F.substring("psgc10", 1, 2), 10, "0")).withColumn("prov", F.rpad(F.substring("psgc10", 1, 5), 10, "0"))
    provs = d.filter("level = 'province'").select(F.col("psgc10").alias("__p"), F.col("name").alias("province_name")).dropDuplicates(["__p"])
    regs = d.filter("level = 'region'").select(F.col("psgc10").alias("__r"), F.col("name").alias("region_name")).dropDuplicates(["__r"])
    d = d.join(provs, d["prov"] == provs["__p"], "left").join(regs, d["region_code"] == regs["__r"], "left")
    return d.select(
        "psgc10", "level", "name", strip_affixes(F.lower("name")).alias("name_short"), plain_key(F.col("name")).alias("match_key"), "region_code", F.coalesce("region_name", F.lit("")).alias("region_name"),
        F.when(F.col("__p").isNotNull(), F.col("prov")).otherwise(F.lit("")).alias("province_code"), F.coalesce("province_name", F.lit("")).alias("province_name"),
        ((F.col("level") == "city") & F.col("__p").isNull()).alias("is_independent_city"), "pop_2024",
    )


def split_levels(master: DataFrame, path: str) -> None:
    """One directory per level; levels without rows leave none."""
    master.write.mode("overwrite").partitionBy("level").parquet(path)
