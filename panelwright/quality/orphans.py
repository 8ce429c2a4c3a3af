"""References to records that do not exist.

Sorted integer parent keys are compressed into contiguous runs. Each reference
is matched as-of to the run start before it; a key beyond the run's end has no
parent. In the same pass it is matched to the version of its own key that began
last before the reference was made, so that parents which came later or had
gone already are told apart from parents that never were.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.codes import code_to_long

MISSING, LATER, GONE, MALFORMED = "missing", "not_yet", "removed", "malformed"


def versions(parents: DataFrame, key: str, added: str, removed: str) -> DataFrame:
    """Disjoint validity intervals ``(k, t0, t1)`` per integer key, overlapping ones merged.

    A null start means since ever, a null end still valid; rows without a key
    and empty intervals are left out. Repeated rows collapse.
    """
    far, early = F.lit("9999-12-31 00:00:00").cast("timestamp"), F.lit("0001-01-01 00:00:00").cast("timestamp")
    p = parents.select(
        code_to_long(F.col(key)).alias("k"),
        F.coalesce(F.col(added), early).alias("t0"),
        F.coalesce(F.col(removed), far).alias("t1"),
    ).filter("k is not null and t0 < t1")
    p = p.groupBy("k", "t0").agg(F.max("t1").alias("t1"))
    w = W.partitionBy("k").orderBy("t0")
    reach = F.max("t1").over(w.rowsBetween(W.unboundedPreceding, -1))
    p = p.withColumn("isl", F.sum(F.when(F.col("t0") > reach, 1).otherwise(0)).over(w))
    return p.groupBy("k", "isl").agg(F.min("t0").alias("t0"), F.max("t1").alias("t1")).drop("isl")


def key_runs(keys: DataFrame, stride: int = 1, width: int = 4096) -> DataFrame:
    """Runs ``(bucket, k, k_end)`` of keys that follow each other in steps of ``stride``.

    Runs are cut at bucket borders (``width`` steps each), so that no window
    spans more than ``width`` distinct keys and a run never starts in an
    earlier bucket than a key it covers.
    """
    k = keys.select("k").distinct().withColumn("bucket", F.floor(F.col("k") / F.lit(stride * width)))
    w = W.partitionBy("bucket").orderBy("k")
    k = k.withColumn("new", (F.col("k") - F.coalesce(F.lag("k").over(w), F.col("k") - stride - 1) != stride).cast("int"))
    k = k.withColumn("run", F.sum("new").over(w))
    return k.groupBy("bucket", "run").agg(F.min("k").alias("k"), F.max("k").alias("k_end")).drop("run")


def find_orphans(
    refs: DataFrame,
    ref_key: str,
    ref_time: str,
    parents: DataFrame,
    parent_key: str,
    added: str,
    removed: str,
    keep: list[str],
    stride: int = 1,
    limit: int = 1 << 19,
) -> DataFrame:
    """References whose parent was not there when they were made, with a ``reason``.

    ``keep`` names the columns of ``refs`` to return. A key bucket with more than
    ``limit`` references is split: its references are spread over as many parts
    as needed and its few parent rows copied to each, so one key that holds a
    third of all rows is still read by many tasks. References are counted per
    bucket before any of them moves, and are then shuffled once.

    Defined results: a null key is no reference; a key that writes no integer is
    'malformed'; a reference without a time counts if its key exists at all; an
    empty parent table makes every reference 'missing'; repeated rows are all
    returned. Column names of ``refs`` cannot clash, as only ``keep`` is carried
    inside a struct.
    """
    step = 4096 * stride
    v = versions(parents, parent_key, added, removed)
    runs = key_runs(v, stride)
    early = F.lit("0001-01-01 00:00:00").cast("timestamp")
    none_t, none_l = F.lit(None).cast("timestamp"), F.lit(None).cast("bigint")
    row_type = "struct<" + ",".join(f"`{f.name}`:{f.dataType.simpleString()}" for f in refs.select(*keep).schema) + ">"
    none_r = F.lit(None).cast(row_type)
    r = refs.filter(F.col(ref_key).isNotNull()).select(code_to_long(F.col(ref_key)).alias("k"), F.col(ref_time).alias("rt"), F.struct(*keep).alias("r"))
    bad = r.filter("k is null").select("r", F.lit(MALFORMED).alias("reason"))
    r = r.filter("k is not null").withColumn("bucket", F.floor(F.col("k") / step))
    # only split buckets are listed, so this side is empty or tiny unless most of the data is hot
    hot = r.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > limit).select("bucket", F.ceil(F.col("n") / limit).cast("int").alias("parts"))
    parts = F.coalesce("parts", F.lit(1))
    salt = F.explode(F.sequence(F.lit(0), parts - 1)).alias("salt")
    ev_runs = runs.join(hot, "bucket", "left").select("bucket", salt, "k", early.alias("t"), F.lit(0).alias("o"), F.col("k_end").alias("run_end"), none_l.alias("v_key"), none_t.alias("v_end"), none_r.alias("r"))
    vb = v.withColumn("bucket", F.floor(F.col("k") / step)).join(hot, "bucket", "left")
    ev_vers = vb.select("bucket", salt, "k", F.col("t0").alias("t"), F.lit(1).alias("o"), none_l.alias("run_end"), F.col("k").alias("v_key"), F.col("t1").alias("v_end"), none_r.alias("r"))
    far = F.lit("9999-12-30 00:00:00").cast("timestamp")
    ev_refs = r.join(hot, "bucket", "left").select(
        "bucket", F.pmod(F.xxhash64("r"), parts).cast("int").alias("salt"), "k",
        F.coalesce("rt", far).alias("t"), F.lit(2).alias("o"), none_l.alias("run_end"), none_l.alias("v_key"), none_t.alias("v_end"), "r",
    )
    w = W.partitionBy("bucket", "salt").orderBy("k", "t", "o").rowsBetween(W.unboundedPreceding, 0)
    e = ev_runs.unionByName(ev_vers).unionByName(ev_refs)
    e = e.select(
        "k", "t", "r",
        F.last("run_end", True).over(w).alias("run_end"),
        F.last("v_key", True).over(w).alias("v_key"),
        F.last("v_end", True).over(w).alias("v_end"),
    ).filter("r is not null")
    known = F.coalesce(F.col("k") <= F.col("run_end"), F.lit(False)) & (F.pmod(F.col("k"), F.lit(stride)) == 0)
    own = F.coalesce(F.col("v_key") == F.col("k"), F.lit(False))
    reason: Column = (
        F.when(~known, MISSING)
        .when(~own, LATER)
        .when(F.col("t") >= F.col("v_end"), F.when(F.col("t") == far, F.lit(None)).otherwise(GONE))
    )
    found = e.select("r", reason.alias("reason")).filter("reason is not null")
    return found.unionByName(bad).select("r.*", "reason")


def stride_of(parents: DataFrame, key: str) -> int:
    """The largest power of ten (up to 10^9) that divides every parent key; one small aggregate."""
    k = code_to_long(F.col(key))
    row = parents.agg(*[F.count_if(F.pmod(k, F.lit(10**i)) != 0).alias(f"n{i}") for i in range(1, 10)]).first()
    return 10 ** next((i - 1 for i in range(1, 10) if row[f"n{i}"]), 0)


def orphan_report(orphans: DataFrame, by: list[str]) -> DataFrame:
    """Orphan counts per table, period and reason."""
    return orphans.groupBy(*by, "reason").agg(F.count(F.lit(1)).alias("n_orphans"))
