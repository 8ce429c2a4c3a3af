"""Named queries of this package, over whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize, table
from . import encoding, match, mixing, packing, tokens, variants


# --- 2 matching
def p2_matches(spark: SparkSession, d: str) -> DataFrame:
    master = table(spark, d, "psgc_lgu_master")
    recs = materialize(match.panel_records(table(spark, d, "sre_panel"), table(spark, d, "psa_panel")), "match-records")
    units = materialize(match.master_units(master), "match-master")
    return match.match_records(recs, units, master)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return p2_matches(spark, d).select("src", F.col("rec_id").cast("bigint").alias("rec_id"), "psgc10")


# --- 3 variants
def _linked(spark: SparkSession, d: str) -> DataFrame:
    master = table(spark, d, "psgc_lgu_master")
    labels = materialize(match.panel_records(table(spark, d, "sre_panel")), "variants-records")
    units = materialize(match.master_units(master), "variants-master")
    return materialize(variants.link(labels, units, master), "variants-linked")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return variants.variant_pairs(_linked(spark, d))


def p3_classes(spark: SparkSession, d: str) -> DataFrame:
    c = variants.classes(_linked(spark, d))
    return c.select(F.col("rec_id").cast("bigint").alias("label_id"), "entity", "n_links")


# --- 8 packing
def _capacities(spark: SparkSession, d: str) -> dict[int, int]:
    return {r["spec_id"]: r["capacity_tokens"] for r in table(spark, d, "pack_specs").collect()}  # the list of specs


def p8_packed(spark: SparkSession, d: str) -> DataFrame:
    sized = tokens.with_token_counts(table(spark, d, "documents"), ["doc_id"])
    return packing.pack(sized, "doc_id", "n_tokens", _capacities(spark, d))


def p8_usage(spark: SparkSession, d: str) -> DataFrame:
    return packing.usage(p8_packed(spark, d), _capacities(spark, d))


def p8_checked(spark: SparkSession, d: str) -> DataFrame:
    """Per spec: documents placed, containers over capacity, parts placed twice, documents cut that would have fitted whole."""
    caps = _capacities(spark, d)
    p = materialize(p8_packed(spark, d), "packed")
    cap = F.element_at(F.create_map(*[F.lit(v) for s, n in sorted(caps.items()) for v in (s, n)]), F.col("spec_id"))
    full = p.filter("container_id is not null").groupBy("spec_id", "container_id").agg(F.sum("part_tokens").alias("t")).groupBy("spec_id").agg(F.count_if(F.col("t") > cap).alias("n_over"))
    docs = p.groupBy("spec_id", "doc_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("part").alias("parts"), F.sum("part_tokens").alias("t"))
    docs = docs.groupBy("spec_id").agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.col("n") - F.col("parts")).alias("n_twice"), F.count_if((F.col("n") > 1) & (F.col("t") <= cap)).alias("n_cut"))
    return docs.join(full, "spec_id", "left").select("spec_id", "n_docs", F.coalesce("n_over", F.lit(0)).alias("n_over"), "n_twice", "n_cut")


# --- 9 mixing
def p9_mixture(spark: SparkSession, d: str) -> DataFrame:
    sized = materialize(tokens.with_token_counts(table(spark, d, "documents"), ["doc_id", "source"]), "sized")
    return mixing.mix(sized, "doc_id", "source", "n_tokens", table(spark, d, "mix_targets"))


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.shares(p9_mixture(spark, d), table(spark, d, "mix_targets"))


def p9_checked(spark: SparkSession, d: str) -> DataFrame:
    """Per mix: sources listed, sources repeated beyond their cap, records with no whole copy."""
    m = materialize(p9_mixture(spark, d), "mixture")
    s = mixing.shares(m, table(spark, d, "mix_targets"))
    none = m.groupBy("mix_id").agg(F.count_if(F.col("n_copies") < 1).alias("n_empty"))
    over = s.groupBy("mix_id").agg(F.count(F.lit(1)).alias("n_sources"), F.count_if(F.col("most_copies") > F.col("max_repeats")).alias("n_over"))
    return over.join(none, "mix_id", "left").select("mix_id", "n_sources", "n_over", F.coalesce("n_empty", F.lit(0)).alias("n_empty"))


# --- 10 encoding
def p10_restored(spark: SparkSession, d: str) -> DataFrame:
    return encoding.restore(table(spark, d, "documents"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return p10_restored(spark, d).select(F.col("doc_id"))


def queries() -> dict:
    return {f.__name__: f for f in (p2_found, p2_matches, p3_found, p3_classes, p8_packed, p8_usage, p8_checked, p9_mixture, p9_shares, p9_checked, p10_found, p10_restored)}


def oracle_sql() -> dict[str, str]:
    return {
        "p8_checked": "SELECT spec_id, (SELECT count(*) FROM documents) AS n_docs, 0 AS n_over, 0 AS n_twice, 0 AS n_cut FROM pack_specs",
        "p9_checked": "SELECT mix_id, count(*) AS n_sources, 0 AS n_over, 0 AS n_empty FROM (SELECT DISTINCT mix_id, source FROM mix_targets) GROUP BY 1",
    }
