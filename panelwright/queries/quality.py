"""Named queries of the data quality operators, over whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..quality import impute, orphans, profiling, schema_drift, units
from ..session import table

INCOME = "total_current_operating_income"
SPENT = ["total_current_operating_exp", "total_capital_investment_exp", "population"]
CLASS_FORM = "1st|2nd|3rd|4th|5th|6th|Special"


# --- 1 units
def p1_exponents(spark: SparkSession, d: str) -> DataFrame:
    return units.panel_units(table(spark, d, "panel_ml"), table(spark, d, "harmonization_report"), table(spark, d, "header_block"), INCOME, r"income")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return p1_exponents(spark, d).filter("exponent <> 0").select(F.col("id").alias("row_id"))


def p1_harmonized(spark: SparkSession, d: str) -> DataFrame:
    h = units.harmonized(table(spark, d, "panel_ml"), p1_exponents(spark, d), INCOME)
    return h.select("row_id", "psgc10", "fiscal_year", INCOME, f"{INCOME}_common", f"{INCOME}_exponent")


# --- 4 orphans
def _orphans(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "psgc_lgu_master")
    stride = orphans.stride_of(m, "psgc10")
    parts = []
    for name, rec in (("sre_panel_with_psgc", "xwalk_id"), ("population_lgu_annual", "pop_id")):
        t = table(spark, d, name).select(F.lit(name).alias("table_name"), F.col(rec).alias("rec_id"), "psgc10", "fiscal_year", "loaded_at")
        parts.append(t)
    refs = parts[0].unionByName(parts[1])
    return orphans.find_orphans(refs, "psgc10", "loaded_at", m, "psgc10", "added_at", "removed_at", ["table_name", "rec_id", "psgc10", "fiscal_year"], stride)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).select("table_name", "rec_id")


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphan_report(_orphans(spark, d), ["table_name", "fiscal_year"])


# --- 5 fills
def p5_filled(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "panel_ml").withColumn("period", F.floor(F.col("fiscal_year") / 5).cast("int"))
    missing = {f: impute.no_value(F.col(f), zero_is_real=(f == "total_capital_investment_exp")) for f in SPENT}
    levels = [["psgc10", "period"], ["province", "lgu_type", "fiscal_year"], ["lgu_type", "fiscal_year"], []]
    return impute.fill_by_group(p, missing, levels).drop("period")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return impute.filled_cells(p5_filled(spark, d), "row_id", SPENT).select("row_id", "field_name")


# --- 6 profiles
def _profile(spark: SparkSession, d: str, columns: list[str]) -> DataFrame:
    c = profiling.value_counts(table(spark, d, "panel_ml"), ["load_series", "load_id"], columns)
    return profiling.profile(c, ["load_series", "load_id"], {"income_class": CLASS_FORM, "psgc10": r"\d{10}", "load_series": r"ml-\d+"})


def p6_profile(spark: SparkSession, d: str) -> DataFrame:
    cols = [c for c in table(spark, d, "panel_ml").columns if c not in ("load_series", "load_id")]
    return _profile(spark, d, cols)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    p = _profile(spark, d, ["ur_b", "fund_cash_available", "income_class"])
    b = profiling.breaks(p, "load_series", "load_id", ["ur_b", "fund_cash_available", "income_class"], ["ur_b", "fund_cash_available"], ["income_class"])
    return b.select("column_name", "load_id", "issue")


def p6_stability(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "panel_ml")
    c = profiling.value_counts(t, ["load_series", "load_id"], [c for c in t.columns if c not in ("load_series", "load_id")])
    s = profiling.stability(c, "load_series", "load_id")
    return s.withColumns({"psi": F.round("psi", 6), "chi_square": F.round("chi_square", 4)})


# --- 7 schema drift
def _drift(spark: SparkSession, d: str) -> DataFrame:
    return schema_drift.correspondences(table(spark, d, "header_block"), table(spark, d, "harmonization_report"), table(spark, d, "canonical_columns"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return schema_drift.changes(_drift(spark, d)).select("file_id", "column_name", "change_kind")


def p7_table(spark: SparkSession, d: str) -> DataFrame:
    names = [r[0] for r in table(spark, d, "canonical_columns").groupBy("column_name").count().orderBy("column_name").select("column_name").collect()]
    return schema_drift.canonical_rows(table(spark, d, "sheet_rows"), _drift(spark, d), names)


def queries() -> dict:
    return {f.__name__: f for f in (p1_found, p1_harmonized, p4_found, p4_report, p5_found, p5_filled, p6_found, p6_profile, p6_stability, p7_found, p7_table)}
