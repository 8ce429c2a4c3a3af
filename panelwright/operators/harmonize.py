"""Irregular sheets brought to a fixed schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import is_note, squeeze
from .report import medians


def flatten_header(rows: DataFrame, sheet: str = "sheet", row: str = "row_idx", cells: str = "cells") -> DataFrame:
    """Header rows of a sheet as one label per column: ``(sheet, pos, label)``.

    Fragments are joined by " | " from top to bottom; blank ones and one that
    repeats the fragment above it in any case are left out.
    """
    frag = rows.select(sheet, row, F.posexplode(cells).alias("pos", "cell")).withColumn("cell", squeeze(F.coalesce("cell", F.lit("")))).filter("cell <> ''")
    w = W.partitionBy(sheet, "pos").orderBy(row)
    frag = frag.withColumn("above", F.lag("cell").over(w)).filter(F.col("above").isNull() | (F.lower("above") != F.lower("cell")))
    g = frag.groupBy(sheet, "pos").agg(F.array_sort(F.collect_list(F.struct(row, "cell"))).alias("f"))
    return g.select(sheet, "pos", F.array_join(F.col("f.cell"), " | ").alias("label"))


def header_block(rows: DataFrame, sentinel: str, sheet: str = "sheet", row: str = "row_idx", cells: str = "cells", scan: int = 40) -> DataFrame:
    """Where the header of each sheet starts and its data begin: ``(sheet, header_start, data_start)``.

    The header starts at the first of ``scan`` rows with a cell that holds
    ``sentinel``; the data start at the first later row with at least two cells
    that write numbers, or right after the header if no row does.
    """
    low = F.transform(cells, lambda c: F.lower(F.coalesce(c, F.lit(""))))
    has = F.exists(low, lambda c: c.contains(sentinel.lower()))
    numeric = F.size(F.filter(low, lambda c: c.rlike(r"^\(?-?[0-9][0-9,]*\.?[0-9]*\)?$"))) >= 2
    h = rows.filter(has & (F.col(row) < scan)).groupBy(sheet).agg(F.min(row).alias("header_start"))
    d = rows.filter(numeric).select(sheet, F.col(row).alias("r")).join(h, sheet).filter("r > header_start").groupBy(sheet).agg(F.min("r").alias("data_start"))
    return h.join(d, sheet, "left").select(sheet, "header_start", F.coalesce("data_start", F.col("header_start") + 1).alias("data_start"))


def year_header_row(rows: DataFrame, years: tuple[int, ...], sheet: str = "sheet", row: str = "row_idx", cells: str = "cells", least: int = 4, scan: int = 20) -> DataFrame:
    """The first of ``scan`` rows in which at least ``least`` distinct columns hold one of the years."""
    x = rows.filter(F.col(row) < scan).select(sheet, row, F.posexplode(cells).alias("pos", "cell"))
    x = x.withColumn("y", F.regexp_extract(F.coalesce("cell", F.lit("")), r"((?:19|20)[0-9]{2})", 1).try_cast("int")).filter(F.col("y").isin(*years))
    return x.groupBy(sheet, row).agg(F.count_distinct("pos").alias("n")).filter(F.col("n") >= least).groupBy(sheet).agg(F.min(row).alias("header_row"))


def column_groups(header: DataFrame, years: tuple[int, ...], divider: str, sheet: str = "sheet", cells: str = "cells") -> DataFrame:
    """Year columns left and right of a divider column; the larger side holds the population: ``(sheet, year, pos)``."""
    x = header.select(sheet, F.posexplode(cells).alias("pos", "cell")).withColumn("cell", F.lower(F.coalesce("cell", F.lit(""))))
    d = x.filter(F.col("cell").contains(divider.lower())).groupBy(sheet).agg(F.min("pos").alias("at"))
    y = x.withColumn("year", F.regexp_extract("cell", r"((?:19|20)[0-9]{2})", 1).try_cast("int")).filter(F.col("year").isin(*years)).join(d, sheet, "left")
    y = y.withColumn("left", F.coalesce(F.col("pos") < F.col("at"), F.lit(True)))
    w = W.partitionBy(sheet)
    y = y.withColumn("nl", F.count_if("left").over(w)).withColumn("nr", F.count_if(~F.col("left")).over(w))
    side = y.filter(F.col("left") == (F.col("nl") >= F.col("nr")))
    return side.groupBy(sheet, "year").agg(F.min("pos").alias("pos"))


def map_labels(labels: DataFrame, rules: DataFrame, label: str = "label", pattern: str = "pattern", target: str = "target", rank: str = "rank") -> DataFrame:
    """The target of each distinct label: an equal pattern, else the first contained one by rank.

    ``rules`` is a fixed list; labels are made distinct first, so the join by
    containment runs over the vocabulary and not over the rows.
    """
    d = labels.select(label).distinct().withColumn("__l", F.lower(squeeze(F.col(label))))
    j = d.join(F.broadcast(rules), F.col("__l").contains(F.lower(F.col(pattern))))  # the rules are written by hand
    o = F.struct((F.col("__l") != F.lower(F.col(pattern))).cast("int"), F.col(rank), F.col(target))
    return j.groupBy(label).agg(F.min_by(target, o).alias(target))


def first_per_target(mapped: DataFrame, sheet: str, target: str, pos: str) -> DataFrame:
    """Of several columns that map to one target the leftmost is kept."""
    w = W.partitionBy(sheet, target).orderBy(pos)
    return mapped.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r")


def era_of(label: Column, year: Column, rules: list[tuple[str, str]], by_year: list[tuple[int, int, str]]) -> Column:
    """The template an ordered list of phrases tells, else the one of the year."""
    t, out = F.lower(label), None
    for phrase, era in rules:
        c = t.contains(phrase.lower())
        out = F.when(c, era) if out is None else out.when(c, era)
    years = None
    for a, b, era in by_year:
        c = year.between(a, b)
        years = F.when(c, era) if years is None else years.when(c, era)
    return out.otherwise(years) if out is not None else years


def rescale(df: DataFrame, group: list[str], probe: str, measures: list[str], limit: float = 1e6, factor: float = 1e6) -> DataFrame:
    """All measures of a group divided by ``factor`` if the median of ``probe`` exceeds ``limit``."""
    j = df.join(medians(df, group, F.col(probe), "__med"), group, "left")
    return j.select(*[(F.when(F.col("__med") > limit, F.col(c) / factor).otherwise(F.col(c)).alias(c) if c in measures else F.col(c)) for c in df.columns])


def common_scale(df: DataFrame, group: list[str], probe: str, measures: list[str]) -> DataFrame:
    """All measures of a group divided by the power of a thousand by which its median of ``probe`` lies above the usual group's.

    Unlike ``rescale`` it knows thousands as well as millionths: groups are
    compared with the median of all groups' medians. Groups below it stay.
    """
    x = F.nanvl(F.col(probe), F.lit(None).cast("double"))
    med = medians(df.filter(x > 0), group, F.log10(x), "__med")
    up = F.greatest(F.round((F.col("__med") - F.col("__usual")) / 3), F.lit(0.0))
    factor = med.crossJoin(medians(med, [], F.col("__med"), "__usual")).select(*group, F.pow(F.lit(1000.0), up).alias("__factor"))  # one row of the usual
    j = df.join(factor, group, "left")
    return j.select(*[((F.col(c) / F.coalesce("__factor", F.lit(1.0))).alias(c) if c in measures else F.col(c)) for c in df.columns])


def record_rows(df: DataFrame, name: str, province: str) -> DataFrame:
    """Rows that hold a record: a name, and neither a total, a title nor a note."""
    return df.filter(F.col(name).isNotNull() & ~is_note(F.col(name)) & (F.length(squeeze(F.coalesce(F.col(province), F.lit("")))) >= 0))
