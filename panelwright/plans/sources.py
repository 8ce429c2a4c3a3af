"""Yearly fiscal sheets harmonized, and a second source resolved with the same cascade."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.codes import clean_code
from ..functions.numbers import parse_number
from ..operators import harmonize, report, resolve
from .panel import ORPHAN_NAMES


def harmonize_sheets(rows: DataFrame, rules: DataFrame, identifiers: list[str], measures: list[str], probe: str) -> DataFrame:
    """All sheets ``(sheet, year, row_idx, cells)`` in one canonical table.

    Header blocks are found and flattened per sheet, labels mapped by the
    ordered rules, the leftmost column of a target kept, rows without a record
    dropped, numbers parsed and sheets in single units scaled to millions.
    """
    block = harmonize.header_block(rows, "lgu")
    inside = rows.join(block, "sheet")
    labels = harmonize.flatten_header(inside.filter("row_idx >= header_start and row_idx < data_start").select("sheet", "row_idx", "cells"))
    mapped = labels.join(harmonize.map_labels(labels, rules), "label")
    cols = harmonize.first_per_target(mapped, "sheet", "target", "pos")
    at = cols.groupBy("sheet").agg(F.map_from_entries(F.collect_list(F.struct("target", "pos"))).alias("at"))
    data = inside.filter("row_idx >= data_start").join(at, "sheet")
    cell = lambda c: F.get("cells", F.try_element_at("at", F.lit(c)))
    out = data.select("sheet", "year", "row_idx", *[tx.clean(cell(c)).alias(c) for c in identifiers], *[parse_number(cell(m)).alias(m) for m in measures])
    out = out.filter(~tx.is_note(F.col("lgu_name")))
    return harmonize.rescale(out, ["sheet"], probe, measures)


def harmonize_report(rows: DataFrame, table: DataFrame, probe: str) -> DataFrame:
    """One row per sheet: rows read and kept, units named, median of the probe."""
    a = rows.groupBy("sheet").agg(F.count(F.lit(1)).alias("n_raw"))
    b = table.groupBy("sheet").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("lgu_name").alias("n_lgus"))
    return a.join(b, "sheet", "left").join(report.medians(table, ["sheet"], F.col(probe)), "sheet", "left")


def second_source(records: DataFrame, master: DataFrame, aliases: DataFrame, name: str = "lgu_name", province: str = "province", level: str = "lgu_type") -> DataFrame:
    """Codes for a second source: scoped aliases first, then the cascade; orphans get tier -1.

    ``aliases`` has ``(prov, alias, name)``: in that province the alias stands
    for the name. Parts of a unit ("District IV") count as the unit.
    """
    bare = F.regexp_replace(tx.clean(F.col(name)), r"(?i)[-–,]?\s*\(?\bdist(rict)?\.?\s*[ivx0-9]+\)?\s*$", "")
    r = records.withColumn("__n", bare).withColumn("__p", tx.plain_key(F.col(province))).withColumn("__k", tx.match_key(F.col("__n")))
    al = aliases.select(tx.plain_key(F.col("prov")).alias("__ap"), tx.match_key(F.col("alias")).alias("__ak"), F.col("name").alias("__to"))
    r = r.join(al, (F.col("__p") == F.col("__ap")) & (F.col("__k") == F.col("__ak")), "left").withColumn("__n", F.coalesce("__to", "__n"))
    keyed = r.drop("__p", "__k", "__ap", "__ak", "__to")
    walk = resolve.crosswalk(keyed, master, "__n", province, level)
    out = resolve.join_back(keyed, walk, ["__n", province, level])
    orphan = F.lower(F.trim(F.coalesce(F.col(name), F.lit("")))).isin(*ORPHAN_NAMES) | F.lower(F.col(name)).startswith("special geographic area")
    null = F.lit(None)
    return out.withColumn("orphan", F.coalesce(orphan, F.lit(False))).withColumn("psgc10", F.when(F.col("orphan"), null).otherwise(F.col("psgc10"))).withColumn("tier", F.when(F.col("orphan"), -1).otherwise(F.col("tier"))).drop("__n")


def coded_source(records: DataFrame, master: DataFrame, code: str) -> DataFrame:
    """A source that has codes: ten digits, tier 0 if the master holds them, -1 if not."""
    m = master.select(F.col("psgc10").alias("__m")).distinct()
    r = records.withColumn("psgc10", clean_code(F.col(code), 10))
    return r.join(m, r["psgc10"] == m["__m"], "left").withColumn("tier", F.when(F.col("__m").isNotNull(), 0).otherwise(-1)).drop("__m")
