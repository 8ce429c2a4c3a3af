"""From coded fiscal rows to the feature matrix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.codes import code_to_long
from ..functions.numbers import nan_to_null
from ..operators import features as ft
from ..operators import reshape
from ..operators.dedup import keep_one
from ..operators.joins import dimension_wins
from ..operators.timeseries import lags_and_leads

# Names that stand for no unit, years of national elections, columns of the matrix, years of poverty estimates.
ORPHAN_NAMES = ("provincial total", "regional total", "national total", "total", "subtotal", "grand total", "", "`", "-", "n/a", "na", "none", "null")
ELECTIONS = (1992, 1995, 1998, 2001, 2004, 2007, 2010, 2013, 2016, 2019, 2022, 2025)
LAGGED = ["ur_a", "ur_b", "nta_ira", "fund_cash_balance_end", "total_current_operating_income"]
LOGGED = ["nta_ira", "total_current_operating_income", "total_local_sources", "total_external_sources", "fund_cash_balance_end", "total_capital_investment_exp", "population", "land_area_sqkm"]
COMPONENTS = ["rpt", "business_tax", "other_taxes", "regulatory_fees", "service_charges", "econ_enterprise"]
POVERTY_YEARS = (2018, 2021, 2023)
POVERTY_FIELDS = ("pi", "cv", "se", "ci_lo", "ci_hi")


def code10(c) -> F.Column:  # noqa: ANN001
    """A code in its ten digits, whatever way it is written; null if it writes none."""
    return F.lpad(code_to_long(c).cast("string"), 10, "0")


def coded_facts(facts: DataFrame) -> DataFrame:
    """Rows with a code and a name that stands for a unit, once per code and year: lowest tier, then first row."""
    f = facts.withColumn("psgc10", code10(F.col("psgc10"))).filter("psgc10 is not null and fiscal_year is not null")
    f = f.filter(~F.lower(F.trim(F.coalesce("matched_name", F.lit("")))).isin(*ORPHAN_NAMES))
    return keep_one(f, ["psgc10", "fiscal_year"], [F.col("tier").asc_nulls_last(), F.col("xwalk_id")])


def latest_population(pop: DataFrame) -> DataFrame:
    """One population row per code and year: the one loaded last."""
    p = pop.withColumn("psgc10", code10(F.col("psgc10"))).filter("psgc10 is not null")
    return keep_one(p, ["psgc10", "fiscal_year"], [F.col("loaded_at").desc(), F.col("pop_id").desc()]).select("psgc10", "fiscal_year", "population", "land_area_sqkm", "pop_source")


def master_ids(master: DataFrame) -> DataFrame:
    """The identifying columns of the master under their names in the panel; a province lies in itself."""
    own = F.when((F.col("level") == "province") & (F.col("province_name") == ""), F.col("name")).otherwise(F.col("province_name"))
    return master.select("psgc10", F.col("name").alias("lgu_name"), F.col("level").alias("lgu_type"), own.alias("province"), F.col("region_name").alias("region"), "income_class", "city_class", "urban_rural", "is_independent_city", "pop_2024")


def collapse_parts(poverty: DataFrame, is_part: Column) -> DataFrame:
    """Rows for parts of one unit as one row of its code: shares averaged unweighted, what cannot be pooled nulled.

    Codes with fewer than two such rows stay as they are; other rows are untouched.
    """
    shares = [f"pi_{y}" for y in POVERTY_YEARS]
    n = F.count_if(is_part).over(W.partitionBy("psgc10"))
    p = poverty.withColumn("__part", is_part & (n > 1) & F.col("psgc10").isNotNull())
    p = p.withColumns({c: nan_to_null(F.col(c)) for c in shares})
    return reshape.collapse(p, F.col("__part"), ["psgc10"], shares, {}).drop("__part")


def poverty_forms(poverty: DataFrame, order: str) -> tuple[DataFrame, DataFrame]:
    """Coded poverty rows as one row per code and year, and as one row per code with a column per field and year.

    Of repeated codes the first by ``order`` is kept, rows without an order last.
    """
    p = keep_one(poverty.filter("psgc10 is not null"), ["psgc10"], [F.col(order).asc_nulls_last()])
    wide = p.select("psgc10", *[nan_to_null(F.col(f"{f}_{y}")).alias(f"{f}_{y}") for y in POVERTY_YEARS for f in POVERTY_FIELDS])
    long = reshape.snapshots_to_long(wide, ["psgc10"], list(POVERTY_FIELDS), list(POVERTY_YEARS))
    return long.select("psgc10", "fiscal_year", *[F.col(f).alias(f"poverty_{f}") for f in POVERTY_FIELDS]), wide


def star(facts: DataFrame, master: DataFrame, pop: DataFrame, poverty: DataFrame | None = None, order: str = "psa_id") -> DataFrame:
    """Facts joined to the master, whose columns win, to the population of the year and to the poverty estimates.

    ``poverty`` is coded; it joins by code and year as ``poverty_*`` and by
    code alone as a block of fields by year. ``in_psa`` tells whether the unit
    has an estimate of any year.
    """
    s = dimension_wins(coded_facts(facts), master_ids(master), "psgc10").join(latest_population(pop), ["psgc10", "fiscal_year"], "left").withColumn("in_sre", F.lit(True))
    if poverty is None:
        return s
    long, wide = poverty_forms(poverty, order)
    s = s.join(long, ["psgc10", "fiscal_year"], "left").join(wide, "psgc10", "left")
    return s.withColumn("in_psa", F.coalesce(*[f"pi_{y}" for y in POVERTY_YEARS]).isNotNull())


def latest_rows(panel: DataFrame) -> DataFrame:
    """One row per entity and year, the one loaded last."""
    return keep_one(panel, ["psgc10", "fiscal_year"], [F.col("loaded_at").desc(), F.col("row_id").desc()])


def with_targets(panel: DataFrame) -> DataFrame:
    """What was spent, its source, and the unused share of the cash available (a) and of income (b)."""
    used, source = ft.spent(["total_current_operating_exp", "total_capital_investment_exp"], "total_expenditures")
    p = panel.withColumn("spent_used", used).withColumn("spent_source", source)
    return p.withColumn("ur_a", ft.unused_ratio(F.col("spent_used"), F.col("fund_cash_available"))).withColumn("ur_b", ft.unused_ratio(F.col("spent_used"), F.col("total_current_operating_income")))


def feature_matrix(panel: DataFrame) -> DataFrame:
    """Targets, lags, logs, ratios and structure of the latest rows; one shuffle by entity after the first.

    The concentration of local revenue is over those of ``COMPONENTS`` that
    the panel has; with none of them there is no such column.
    """
    p = with_targets(latest_rows(panel))
    p = lags_and_leads(p, "psgc10", "fiscal_year", {c: [1, 2] for c in LAGGED}, {"ur_a": [1], "ur_b": [1]})
    p = p.withColumnsRenamed({"ur_a_lead1": "target_ur_a", "ur_b_lead1": "target_ur_b"})
    income = "total_current_operating_income"
    parts = [c for c in COMPONENTS if c in panel.columns]
    return p.withColumns(
        {"ur_a_current": F.col("ur_a"), "ur_b_current": F.col("ur_b")}
        | {f"log_{c}": ft.log_feature(c) for c in LOGGED}
        | {
            "nta_dependency": ft.ratio("nta_ira", income),
            "local_share": ft.ratio("total_local_sources", income),
            "external_share": ft.ratio("total_external_sources", income),
            "fund_balance_share": ft.ratio("fund_cash_balance_end", income),
            "capex_share_avail": ft.ratio("total_capital_investment_exp", "fund_cash_available"),
            "pop_density": ft.ratio("population", "land_area_sqkm"),
            "income_class_num": ft.ordinal(F.col("income_class")),
            "election_year": ft.member_flag(F.col("fiscal_year"), ELECTIONS),
        }
        | ({"revenue_hhi": ft.hhi(parts)} if parts else {})
    )


def model_input(panel: DataFrame) -> DataFrame:
    """Rows with a known target for the models: next year's unused share of income."""
    return feature_matrix(panel).filter("target_ur_b is not null").withColumn("target", F.col("target_ur_b"))
