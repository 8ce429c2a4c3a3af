"""Named queries of sources, sinks, sheets and reports over whole tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import hierarchy, report, reshape, validate
from ..plans import panel as pl
from ..plans import side_tables as st
from ..plans import sources
from ..session import steps_dir, table
from ..sources import tables

# National totals of the transfer by year, in millions.
LANDMARKS = {2010: 265000.0, 2015: 428000.0, 2018: 522000.0, 2020: 575000.0, 2022: 871000.0, 2024: 1006000.0}


def _folder(spark: SparkSession, name: str) -> str:
    return f"{steps_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _n(c: str) -> F.Column:
    return F.nanvl(F.col(c), F.lit(None).cast("double"))


def csv_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Written as CSV and read again with only the wanted columns."""
    path = _folder(spark, "csv")
    tables.write_csv(table(spark, d, "psgc_lgu_master").select("psgc10", "name", "province_name", "level", "pop_2024"), path)
    back = tables.read_csv(spark, path, lambda c: c in ("psgc10", "name", "pop_2024"))
    return back.select("psgc10", "name", F.col("pop_2024").try_cast("bigint").alias("pop_2024"))


def csv_cells(spark: SparkSession, d: str) -> DataFrame:
    """CSV files without a header, read as cells with the first encoding that fits, in row order."""
    path = _folder(spark, "cells")
    t = table(spark, d, "canonical_columns").select("column_name", "known_label").coalesce(1)  # one small file
    t.sortWithinPartitions("column_name", "known_label").write.option("encoding", "iso-8859-1").csv(path)
    rows = tables.read_csv_lines(spark, f"{path}/*.csv")
    return rows.select("row_idx", F.get("cells", 0).alias("column_name"), F.get("cells", 1).alias("known_label"))


def level_split(spark: SparkSession, d: str) -> DataFrame:
    """The master written as one directory per level and read again."""
    path = _folder(spark, "levels")
    hierarchy.split_levels(table(spark, d, "psgc_lgu_master").select("psgc10", "level", "name"), path)
    return tables.read_parquet(spark, path).select("psgc10", F.col("level").cast("string").alias("level"), "name")


def header_fragments(spark: SparkSession, d: str) -> DataFrame:
    """The fragments of header labels laid out as rows of a sheet and flattened again; repeated ones fall together."""
    from ..operators import harmonize

    h = table(spark, d, "header_block").select(F.col("file_id").alias("sheet"), F.posexplode("header_labels").alias("pos", "label"))
    frag = h.select("sheet", "pos", F.posexplode(F.split("label", r" \| ")).alias("row_idx", "cell"))
    wide = h.groupBy("sheet").agg((F.max("pos") + 1).alias("width"))
    cells = frag.groupBy("sheet", "row_idx").agg(F.map_from_entries(F.collect_list(F.struct("pos", "cell"))).alias("at")).join(wide, "sheet")
    rows = cells.select("sheet", "row_idx", F.transform(F.sequence(F.lit(0), F.col("width") - 1), lambda i: F.try_element_at("at", i)).alias("cells"))
    return harmonize.flatten_header(rows).select(F.col("sheet").alias("file_id"), "pos", "label")


def header_inspection(spark: SparkSession, d: str) -> DataFrame:
    """What is looked at before a file is mapped: where its header and data start, how wide it is, its name column."""
    h = table(spark, d, "header_block")
    return h.select("file_id", "header_start", "data_start", F.size("header_labels").alias("n_labels"), F.size(F.filter("column_types", lambda t: t == "string")).alias("n_text"), F.get("header_labels", F.col("lgu_name_col")).alias("name_label"))


def filled_sheet_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows of a sheet that hold anything, counted per file."""
    x = table(spark, d, "sheet_rows").select("file_id", F.array_join(F.filter("cells", lambda c: F.trim(c) != ""), "").alias("held"))
    return reshape.drop_empty_rows(x.withColumn("held", F.nullif("held", F.lit(""))), ["held"]).groupBy("file_id").agg(F.count(F.lit(1)).alias("n"))


def first_rows(spark: SparkSession, d: str) -> DataFrame:
    return reshape.preview(table(spark, d, "sre_panel").select("fiscal_year", "row_id", "lgu_name", "province"), ["fiscal_year", "row_id"])


def coded_tiers(spark: SparkSession, d: str) -> DataFrame:
    return sources.coded_source(table(spark, d, "population_lgu_annual").select("pop_id", F.col("psgc10").alias("code")), table(spark, d, "psgc_lgu_master"), "code").select("pop_id", "psgc10", "tier")


def second_source(spark: SparkSession, d: str) -> DataFrame:
    """The poverty rows through scoped aliases (former names) and the whole cascade."""
    m = table(spark, d, "psgc_lgu_master")
    old = m.filter("old_names is not null").select(F.col("province_name").alias("prov"), F.col("old_names").alias("alias"), "name").dropDuplicates(["prov", "alias"])
    return sources.second_source(table(spark, d, "psa_panel").select("psa_id", "lgu_name", "province", "lgu_type"), m, old).select("psa_id", "psgc10", "tier", "score", "orphan")


def year_checks(spark: SparkSession, d: str) -> DataFrame:
    c = validate.year_checks(table(spark, d, "sre_panel"), "fiscal_year", "lgu_name", "nta_ira", LANDMARKS, ("total_local_sources", "total_external_sources"), "total_current_operating_income")
    return c.select("fiscal_year", "n_rows", "n_units", F.col("few_units").cast("int").alias("few_units"), "n_negative", "n_zero", "n_mismatch", F.round("landmark_deviation", 6).alias("landmark_deviation"), F.col("landmark_off").cast("int").alias("landmark_off"))


def level_structure(spark: SparkSession, d: str) -> DataFrame:
    return validate.level_structure(table(spark, d, "psgc_lgu_master"))


def population_report(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "population_lgu_annual").withColumn("psgc10", pl.code10(F.col("psgc10")))
    return report.population_report(p, "psgc10", "fiscal_year", "pop_source", "population")


def harmonize_summary(spark: SparkSession, d: str) -> DataFrame:
    """What the files' reports add up to per year and era."""
    r = table(spark, d, "harmonization_report")
    return r.groupBy("fiscal_year", "template_era").agg(F.count(F.lit(1)).alias("n_files"), F.sum("n_rows").alias("n_rows"), F.sum("n_unmapped_columns").cast("bigint").alias("n_unmapped"), F.sum(F.size("issues")).cast("bigint").alias("n_issues"), F.sum(F.size("warnings")).cast("bigint").alias("n_warnings"))


def region_names(spark: SparkSession, d: str) -> DataFrame:
    """The canonical region of each typed text: equal wording, then in front, then behind, the longest first; else by its number."""
    m = table(spark, d, "psgc_lgu_master").filter("region_name is not null").select(tx.without_brackets(F.col("region_name")).alias("n")).distinct()
    names = sorted(r["n"] for r in m.collect() if r["n"])  # one row per region
    typed = table(spark, d, "sre_panel").select("region").distinct()
    return typed.select("region", F.coalesce(st.canonical_region(F.col("region"), [(n, n) for n in names]), F.concat(F.lit("Region "), tx.region_number(F.col("region")).cast("string"))).alias("canonical"))


def folded_names(spark: SparkSession, d: str) -> DataFrame:
    """Compatibility forms of typed names, by the Arrow functions and by the letters' table; both must agree in their ASCII letters."""
    m = table(spark, d, "psgc_lgu_master")
    return m.select("psgc10", tx.ascii_fold(F.col("name")).alias("folded"), tx.nfkc(F.col("name")).alias("composed"))


NAMES = [csv_round_trip, csv_cells, level_split, header_fragments, header_inspection, filled_sheet_rows, first_rows, coded_tiers, second_source, year_checks, level_structure, population_report, harmonize_summary, region_names, folded_names]


def queries() -> dict:
    return {f.__name__: f for f in NAMES}


_X = "CASE WHEN isnan({0}) THEN NULL ELSE {0} END"
_NTA, _INC, _LOC, _EXT = (_X.format(c) for c in ("nta_ira", "total_current_operating_income", "total_local_sources", "total_external_sources"))
_DIGITS = "regexp_replace(regexp_replace(trim(psgc10), '\\.0+(\\D*)$', '\\1'), '\\D', '', 'g')"

SQL = {
    "csv_round_trip": "SELECT psgc10, name, pop_2024 FROM psgc_lgu_master",
    "csv_cells": "SELECT CAST(row_number() OVER (ORDER BY column_name, known_label) - 1 AS INTEGER) AS row_idx, column_name, known_label FROM canonical_columns",
    "level_split": "SELECT psgc10, level, name FROM psgc_lgu_master",
    "header_fragments": "WITH h AS (SELECT file_id, unnest(header_labels) AS label, generate_subscripts(header_labels, 1) - 1 AS pos FROM header_block), f AS (SELECT file_id, pos, unnest(string_split(label, ' | ')) AS cell, generate_subscripts(string_split(label, ' | '), 1) AS i FROM h), g AS (SELECT file_id, pos, i, trim(regexp_replace(cell, '[\\s\\x{00A0}]+', ' ', 'g')) AS cell FROM f), k AS (SELECT *, lag(cell) OVER (PARTITION BY file_id, pos ORDER BY i) AS above FROM g WHERE cell <> '') SELECT file_id, CAST(pos AS INTEGER) AS pos, string_agg(cell, ' | ' ORDER BY i) AS label FROM k WHERE above IS NULL OR lower(above) <> lower(cell) GROUP BY file_id, pos",
    "header_inspection": "SELECT file_id, header_start, data_start, CAST(len(header_labels) AS INTEGER) AS n_labels, CAST(len(list_filter(column_types, lambda t: t = 'string')) AS INTEGER) AS n_text, header_labels[lgu_name_col + 1] AS name_label FROM header_block",
    "filled_sheet_rows": "SELECT file_id, count(*) AS n FROM sheet_rows WHERE len(list_filter(cells, lambda c: trim(c) <> '')) > 0 GROUP BY 1",
    "first_rows": "SELECT fiscal_year, row_id, lgu_name, province FROM sre_panel ORDER BY fiscal_year, row_id LIMIT 10",
    "coded_tiers": f"WITH x AS (SELECT pop_id, {_DIGITS} AS dg FROM population_lgu_annual), c AS (SELECT pop_id, CASE WHEN length(dg) = 0 THEN '' WHEN length(dg) >= 10 THEN dg ELSE lpad(dg, 10, '0') END AS psgc10 FROM x) SELECT pop_id, psgc10, CASE WHEN psgc10 IN (SELECT psgc10 FROM psgc_lgu_master) THEN 0 ELSE -1 END AS tier FROM c",
    "year_checks": f"WITH l(y, v) AS (VALUES (2010, 265000), (2015, 428000), (2018, 522000), (2020, 575000), (2022, 871000), (2024, 1006000)), g AS (SELECT fiscal_year, count(*) AS n_rows, count(DISTINCT lgu_name) AS n_units, count(*) FILTER ({_NTA} < 0) AS n_negative, count(*) FILTER ({_NTA} = 0) AS n_zero, count(*) FILTER (abs(coalesce({_LOC}, 0) + coalesce({_EXT}, 0) - coalesce({_INC}, 0)) / nullif(abs(coalesce({_INC}, 0)), 0) > 0.01) AS n_mismatch, sum({_NTA}) AS s FROM sre_panel GROUP BY 1), d AS (SELECT g.*, CASE WHEN s > 0 THEN abs(s - v) / v END AS dev FROM g LEFT JOIN l ON y = fiscal_year) SELECT fiscal_year, n_rows, n_units, CAST(n_units < 1000 AS INTEGER) AS few_units, n_negative, n_zero, n_mismatch, round(dev, 6) AS landmark_deviation, CAST(coalesce(dev > 0.3, false) AS INTEGER) AS landmark_off FROM d",
    "level_structure": "SELECT level, count(*) AS n_units, count(*) FILTER (c > 1) AS n_repeated, count(*) FILTER (coalesce(province_code, '') <> '' AND province_code NOT IN (SELECT psgc10 FROM psgc_lgu_master WHERE level = 'province')) AS n_orphans, count(*) FILTER (coalesce(province_code, '') = '') AS n_without_province FROM (SELECT *, count(*) OVER (PARTITION BY psgc10) AS c FROM psgc_lgu_master) GROUP BY 1",
    "population_report": f"WITH p AS (SELECT *, lpad(CAST(try_cast(regexp_replace(regexp_replace(psgc10, '[\\s\\x{{00A0}}''\"`]', '', 'g'), '\\.0+$', '') AS BIGINT) AS VARCHAR), 10, '0') AS code FROM population_lgu_annual) SELECT 'table' AS section, 'rows' AS item, count(*) AS n FROM p UNION ALL SELECT 'table', 'codes', count(DISTINCT code) FROM p UNION ALL SELECT 'table', 'first_year', min(fiscal_year) FROM p UNION ALL SELECT 'table', 'last_year', max(fiscal_year) FROM p UNION ALL SELECT 'table', 'with_value', count({_X.format('population')}) FROM p UNION ALL SELECT 'source', pop_source, count(DISTINCT code) FROM p GROUP BY pop_source",
    "harmonize_summary": "SELECT fiscal_year, template_era, count(*) AS n_files, CAST(sum(n_rows) AS BIGINT) AS n_rows, CAST(sum(n_unmapped_columns) AS BIGINT) AS n_unmapped, CAST(sum(len(issues)) AS BIGINT) AS n_issues, CAST(sum(len(warnings)) AS BIGINT) AS n_warnings FROM harmonization_report GROUP BY ALL",
    "folded_names": "SELECT psgc10, strip_accents(name) AS folded, nfc_normalize(name) AS composed FROM psgc_lgu_master",
}
