"""Side tables from irregular sheets: population, prices, poverty."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.numbers import parse_number
from ..operators import harmonize, timeseries
from ..operators.dedup import keep_one

# Census years, word of the area column, markers of rows that name a unit, wordings of regions in price tables.
CENSUS = (1990, 1995, 2000, 2007, 2010, 2015, 2020, 2024)
AREA = "land area"
UNIT_MARKS = r"^(city of |municipality of )|( city| municipality)$"


# --- sheets of population counts
def is_marked(name: Column) -> Column:
    """Whether a row's name carries the mark of a unit, in front or behind."""
    return F.lower(tx.clean(name)).rlike(UNIT_MARKS)


def population_tables(rows: DataFrame, years: tuple[int, ...] = CENSUS) -> DataFrame:
    """``(sheet, row_idx, name, year, population, area)`` of all sheets: header and column groups found per sheet.

    ``rows`` has ``sheet, row_idx, cells``. The header is the first row with
    census years in four distinct columns; rows up to it and rows that hold
    notes are left out, as are cells without a number.
    """
    h = harmonize.year_header_row(rows, years)
    head = rows.join(h, "sheet").filter("row_idx = header_row").select("sheet", "cells")
    cols = harmonize.column_groups(head, years, AREA)
    area = head.select("sheet", F.posexplode("cells").alias("apos", "c")).filter(F.lower(F.coalesce("c", F.lit(""))).contains(AREA)).groupBy("sheet").agg(F.min("apos").alias("apos"))
    body = rows.join(h, "sheet").filter("row_idx > header_row").withColumn("name", tx.clean(F.get("cells", 0))).filter(~tx.is_note(F.col("name")) & ~tx.is_metadata(F.col("name")))
    x = body.join(cols, "sheet").join(area, "sheet", "left")
    x = x.select("sheet", "row_idx", "name", "year", parse_number(F.get("cells", F.col("pos"))).alias("population"), parse_number(F.get("cells", F.col("apos"))).alias("area"))
    return x.filter("population is not null")


def table_levels(rows: DataFrame, share: float = 0.6) -> DataFrame:
    """What each sheet lists: told by its title, else 'unit' if enough of its names are marked, else 'province'."""
    title = F.lower(F.concat_ws(" ", "cells"))
    t = rows.filter("row_idx < 5").groupBy("sheet").agg(F.max(F.when(title.contains("by city"), 2).when(title.contains("by region and province"), 1).otherwise(0)).alias("told"))
    m = rows.groupBy("sheet").agg(F.avg(is_marked(F.get("cells", 0)).cast("double")).alias("marked"))
    return t.join(m, "sheet").select("sheet", F.when(F.col("told") == 2, "city").when(F.col("told") == 1, "province").when(F.col("marked") >= share, "unit").otherwise("province").alias("level"))


def choose_tables(rows: DataFrame) -> DataFrame:
    """Per level the sheet to use: the first city sheet, the largest of the others, names deciding ties."""
    n = rows.groupBy("sheet").agg(F.count(F.lit(1)).alias("n")).join(table_levels(rows), "sheet")
    o = F.when(F.col("level") == "city", F.lit(0)).otherwise(-F.col("n"))
    return n.withColumn("r", F.row_number().over(W.partitionBy("level").orderBy(o, "sheet"))).filter("r = 1").select("level", "sheet")


def name_variants(name: Column) -> Column:
    """Keys a typed name may stand under, best first."""
    bare = tx.without_brackets(tx.clean(name))
    tail = F.regexp_replace(bare, r"\s+[0-9a-z](,[0-9a-z])*$", "")
    return F.array_distinct(F.array(tx.match_key(bare), tx.match_key(tail), tx.match_key(tx.bracketed(name))))


def with_codes(pop: DataFrame, master: DataFrame) -> DataFrame:
    """Population rows with the code of the one unit that a variant of their name stands for, provinces first; others are dropped.

    A hint in brackets that names a province is tried before the bare name.
    """
    m = master.select("psgc10", "level", tx.match_key(F.col("name")).alias("key"), tx.plain_key(F.col("province_name")).alias("prov"))
    one = m.groupBy("key", "level").agg(F.count_distinct("psgc10").alias("n"), F.min("psgc10").alias("code")).filter("n = 1").drop("n")
    hinted = m.groupBy("key", "prov").agg(F.count_distinct("psgc10").alias("n"), F.min("psgc10").alias("code"), F.min("level").alias("level")).filter("n = 1").drop("n")
    d = pop.select("name").distinct().withColumn("hint", tx.plain_key(tx.bracketed(F.col("name")))).select("name", "hint", F.posexplode(name_variants(F.col("name"))).alias("v", "key")).filter("key <> ''")
    rank = F.when(F.col("level") == "province", 0).when(F.col("level") == "city", 1).otherwise(2)
    a = d.join(hinted, (d["key"] == hinted["key"]) & (d["hint"] == hinted["prov"])).select("name", F.lit(-1).alias("r"), "v", "code", "level")
    b = d.join(one, "key").select("name", rank.alias("r"), "v", "code", "level")
    best = a.unionByName(b).groupBy("name").agg(F.min(F.struct("r", "v", "code", "level")).alias("b")).select("name", F.col("b.code").alias("psgc10"), F.col("b.level").alias("found_level"))
    return pop.join(best, "name").withColumn("pop_source", F.when(F.col("found_level") == "province", "province").when(F.col("found_level") == "city", "city_direct").otherwise("lgu_direct"))


def land_areas(coded: DataFrame, master: DataFrame) -> DataFrame:
    """Area per code: a province's own, and its members inherit it; a later row replaces an earlier one."""
    a = keep_one(coded.filter("area is not null").select("psgc10", "area", "sheet", "row_idx"), ["psgc10"], [F.desc("sheet"), F.desc("row_idx")]).select(F.col("psgc10").alias("p"), "area")
    m = master.select("psgc10", "province_code", "level")
    return m.join(a, F.when(F.col("level") == "province", F.col("psgc10")).otherwise(F.col("province_code")) == F.col("p"), "left").select("psgc10", "area")


def allocated(coded: DataFrame, master: DataFrame, weight: str = "pop_2024") -> DataFrame:
    """Province totals of each census year spread over the member municipalities by weight."""
    tot = coded.filter("found_level = 'province'").select(F.col("psgc10").alias("province_code"), "year", "population").distinct()
    mem = master.filter("level = 'municipality' and province_code <> ''").select("psgc10", "province_code", F.col(weight).cast("double").alias("w"))
    grid = mem.join(tot.select("province_code", "year").distinct(), "province_code")
    a = timeseries.allocate(grid, tot, ["province_code", "year"], "w", "population", "allocated")
    return a.select("psgc10", "year", F.col("allocated").alias("population"), F.lit("province_allocated").alias("pop_source"))


def annual_population(coded: DataFrame, master: DataFrame, first: int, last: int) -> DataFrame:
    """Direct counts before allocated ones, interpolated to every year; units without any get their latest count."""
    direct = coded.filter("found_level <> 'province'").select("psgc10", "year", "population", "pop_source", F.lit(0).alias("priority"))
    both = direct.unionByName(allocated(coded, master).withColumn("priority", F.lit(1)))
    census = keep_one(both, ["psgc10", "year"], [F.col("priority"), F.col("population").desc()])
    annual = timeseries.interpolate(census, "psgc10", "year", "population", first, last)
    source = census.groupBy("psgc10").agg(F.min_by("pop_source", "priority").alias("pop_source"))
    annual = annual.join(source, "psgc10")
    missing = master.filter("pop_2024 is not null").join(annual.select("psgc10"), "psgc10", "left_anti").select("psgc10", F.col("pop_2024").cast("double").alias("population"), F.lit("master_2024").alias("pop_source"))
    return annual.unionByName(timeseries.year_grid(missing, first, last, "year"))


# --- price tables
def is_all_items(c: Column) -> Column:
    """'0 - ALL ITEMS' and its likes: a code in front does not count."""
    return tx.plain_key(F.regexp_replace(tx.clean(c), r"^\s*[0-9.]+\s*-\s*", "")) == "all items"


def canonical_region(c: Column, table: list[tuple[str, str]]) -> Column:
    """A region's canonical name: equal wording first, then the longest wording in front, then the longest behind."""
    t = tx.plain_key(F.regexp_replace(tx.without_brackets(c), r"^\.+", ""))
    by_length = sorted(((tx_key(a), b) for a, b in table), key=lambda x: (-len(x[0]), x[0]))
    out = F.lit(None).cast("string")
    tests = [(lambda a: t == a), (lambda a: t.startswith(a + " ")), (lambda a: t.endswith(" " + a))]
    chain = None
    for test in tests:
        for a, b in by_length:
            chain = F.when(test(a), b) if chain is None else chain.when(test(a), b)
    return chain.otherwise(out) if chain is not None else out


def tx_key(s: str) -> str:
    import re
    import unicodedata

    return " ".join(re.sub(r"[^a-z0-9]+", " ", unicodedata.normalize("NFKD", s.lower()).encode("ascii", "ignore").decode()).split())


def price_index(wide: DataFrame, place: str, item: str, regions: list[tuple[str, str]], first: int, last: int, base: int) -> DataFrame:
    """Regional yearly index from a table with "YYYY Ave" columns: gaps filled, rebased, once per region and year.

    Of rows that repeat a region and year the last by ``file_ord`` wins.
    """
    from ..operators.reshape import unpivot_years

    ids = [place, item, *[c for c in ("file_ord",) if c in wide.columns]]
    num = wide.select(*ids, *[parse_number(F.col(f"`{c}`").cast("string")).alias(c) for c in wide.columns if c not in ids])
    long = unpivot_years(num.filter(is_all_items(F.col(item))), ids, r"(\d{4}) Ave", "fiscal_year", "cpi")
    long = long.withColumn("region", canonical_region(F.col(place), regions)).filter("region is not null")
    o = F.col("file_ord").desc() if "file_ord" in ids else F.col("cpi").desc()
    long = keep_one(long, ["region", "fiscal_year"], [o, F.col("cpi").desc()])
    grid = timeseries.year_grid(long.select("region").distinct(), first, last).join(long.select("region", "fiscal_year", "cpi"), ["region", "fiscal_year"], "left")
    return timeseries.rebase(timeseries.fill_gaps(grid, "region", "fiscal_year", ["cpi"]), "region", "fiscal_year", "cpi", base, "deflator")


# --- poverty report
def is_continuation(c: Column) -> Column:
    return F.coalesce(F.lower(c).rlike(r"continued|\(cont|cont\."), F.lit(False))


def is_capital_region(c: Column) -> Column:
    return F.coalesce(F.lower(c).rlike(r"national capital region|\bncr\b|metro"), F.lit(False))


def unit_type(name: Column, cities: tuple[str, ...] = ()) -> Column:
    """city if the name says so or is known as one, else municipality."""
    low = F.lower(tx.clean(name))
    return F.when(low.rlike(r"\bcity\b") | low.isin(*[c.lower() for c in cities]), "city").otherwise("municipality")


def tidy_report(rows: DataFrame, cities: tuple[str, ...] = ()) -> DataFrame:
    """A report's rows ``(sheet, row_idx, code, heading, name)`` as ``(sheet, row_idx, code, region, province, name, lgu_type)``.

    Headings without a name carry down: a region's resets the province, a
    continued one repeats what stood before, and the capital region has no
    provinces. Only rows with a code of four to ten digits are records. Runs
    are found per sheet, so no window spans the whole table.
    """
    w = W.partitionBy("sheet").orderBy("row_idx").rowsBetween(W.unboundedPreceding, 0)
    head = tx.clean(F.col("heading"))
    is_head = (head != "") & (tx.clean(F.col("name")) == "") & ~is_continuation(head)
    region = is_head & (F.lower(head).rlike(r"^region|autonomous|cordillera") | is_capital_region(head))
    x = rows.withColumn("region", F.last(F.when(region, head), True).over(w)).withColumn("run", F.sum(region.cast("int")).over(w))
    wr = W.partitionBy("sheet", "run").orderBy("row_idx").rowsBetween(W.unboundedPreceding, 0)
    x = x.withColumn("province", F.last(F.when(is_head & ~region, head), True).over(wr))
    x = x.filter(F.col("code").rlike(r"^\d{4,10}$"))
    return x.select("sheet", "row_idx", "code", "region", F.when(is_capital_region(F.col("region")), F.lit(None)).otherwise(F.col("province")).alias("province"), tx.clean(F.col("name")).alias("lgu_name"), unit_type(F.col("name"), cities).alias("lgu_type"))
