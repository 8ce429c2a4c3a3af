"""Named queries of the panel operators, each over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.codes import clean_code
from ..functions.numbers import parse_number
from ..ml import folds as fd
from ..operators import dedup, harmonize, hierarchy, report, reshape, resolve, timeseries, validate
from ..operators import features as ft
from ..operators.joins import null_safe_join
from ..plans import panel as pl
from ..session import table

INCOME = "total_current_operating_income"
TYPED = ["region", "province", "lgu_name", "lgu_type"]
CENSUS = (1995, 2000, 2007, 2010, 2015, 2020)
BUCKETS = [("1992-2000", 1992, 2000), ("2001-2008", 2001, 2008), ("2009-2024", 2009, 2024), ("2010s", 2010, 2019), ("all", 1992, 2024)]


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return table(spark, d, name)


def _n(c: str) -> F.Column:
    return F.nanvl(F.col(c), F.lit(None).cast("double"))


# --- joins and duplicates
def coded_poverty(spark: SparkSession, d: str) -> DataFrame:
    """The poverty rows with the code that the exact tiers find; rows for parts of a unit come together in one."""
    psa = _t(spark, d, "psa_panel")
    bare = psa.withColumn("unit", F.regexp_replace("lgu_name", r"(?i)[-–,]?\s*\(?\bdist(rict)?\.?\s*[ivx0-9]+\)?\s*$", ""))
    p = resolve.prepare(bare, "unit", "province", "lgu_type")
    hit = p.join(resolve.exact_tiers(p, resolve.catalog(_t(spark, d, "psgc_lgu_master"))), "rid").select("unit", "province", "lgu_type", "psgc10")
    coded = null_safe_join(bare, hit, ["unit", "province", "lgu_type"])
    return pl.collapse_parts(coded, F.coalesce(F.col("unit") != F.col("lgu_name"), F.lit(False)))


def panel_star_join(spark: SparkSession, d: str) -> DataFrame:
    s = pl.star(_t(spark, d, "sre_panel_with_psgc"), _t(spark, d, "psgc_lgu_master"), _t(spark, d, "population_lgu_annual"), coded_poverty(spark, d))
    return s.select(
        "psgc10", "fiscal_year", "xwalk_id", "tier", "lgu_name", "lgu_type", "province", "region", "income_class", "pop_2024", F.round(_n("total_expenditures"), 4).alias("total_expenditures"), F.round(_n("population"), 4).alias("population"), "pop_source",
        *[F.round(f"poverty_{f}", 6).alias(f"poverty_{f}") for f in pl.POVERTY_FIELDS], *[F.round(f"{f}_{y}", 6).alias(f"{f}_{y}") for f in pl.POVERTY_FIELDS for y in pl.POVERTY_YEARS], F.col("in_sre").cast("int").alias("in_sre"), F.col("in_psa").cast("int").alias("in_psa"),
    )


def tier_dedup(spark: SparkSession, d: str) -> DataFrame:
    return pl.coded_facts(_t(spark, d, "sre_panel_with_psgc")).select("psgc10", "fiscal_year", "xwalk_id", "tier")


def keep_last_dedup(spark: SparkSession, d: str) -> DataFrame:
    return pl.latest_rows(_t(spark, d, "panel_ml")).select("psgc10", "fiscal_year", "row_id")


def keep_best_by_aggregate(spark: SparkSession, d: str) -> DataFrame:
    e = _t(spark, d, "panel_ml").select("psgc10", "fiscal_year", "row_id", "load_id", "loaded_at")
    return dedup.keep_best(e, ["psgc10"], [F.col("loaded_at"), F.col("row_id")]).select("psgc10", "row_id", "load_id")


def distinct_labels(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "sre_panel").select(*TYPED).distinct()


def duplicate_groups(spark: SparkSession, d: str) -> DataFrame:
    return dedup.duplicate_groups(_t(spark, d, "panel_ml"), ["psgc10", "fiscal_year"], ["load_id"])


def repeated_rows_marked(spark: SparkSession, d: str) -> DataFrame:
    m = dedup.mark_duplicates(_t(spark, d, "psa_panel").select("psa_id", "lgu_name", "province"), ["lgu_name", "province"])
    return m.select("psa_id", F.col("is_repeated").cast("int").alias("is_repeated"))


def null_safe_lookup(spark: SparkSession, d: str) -> DataFrame:
    s = _t(spark, d, "sre_panel")
    ids = s.groupBy(*TYPED).agg(F.min("row_id").alias("first_row"))
    return null_safe_join(s.select("row_id", *TYPED), ids, TYPED).groupBy("first_row").agg(F.count(F.lit(1)).alias("n_rows"))


def semi_membership(spark: SparkSession, d: str) -> DataFrame:
    m = _t(spark, d, "psgc_lgu_master").select("psgc10")
    return _t(spark, d, "panel_ml").join(m, "psgc10", "left_semi").select("row_id")


def anti_backfill(spark: SparkSession, d: str) -> DataFrame:
    """Units and years without a population of their own, filled with the master's count."""
    m = _t(spark, d, "psgc_lgu_master").select("psgc10", "pop_2024")
    have = _t(spark, d, "population_lgu_annual").filter(_n("population").isNotNull()).select(pl.code10(F.col("psgc10")).alias("psgc10"), "fiscal_year")
    return timeseries.year_grid(m, 1992, 2024).join(have, ["psgc10", "fiscal_year"], "left_anti")


def coverage_sides(spark: SparkSession, d: str) -> DataFrame:
    return validate.coverage(_t(spark, d, "psgc_lgu_master"), _t(spark, d, "panel_ml"), "psgc10")


def coverage_flags(spark: SparkSession, d: str) -> DataFrame:
    p = _t(spark, d, "psa_panel")
    return p.select("psa_id", F.coalesce(_n("pi_2018"), _n("pi_2021"), _n("pi_2023")).isNotNull().cast("int").alias("has_poverty"))


def member_expansion(spark: SparkSession, d: str) -> DataFrame:
    m = _t(spark, d, "psgc_lgu_master")
    prov = m.filter("level = 'province'").select(F.col("psgc10").alias("province_code"), F.col("name").alias("province_label"))
    return m.filter("level <> 'province'").select("psgc10", "province_code").join(prov, "province_code")


def variant_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Ranked variants of a typed name, the first that names exactly one unit of the master."""
    m = _t(spark, d, "psgc_lgu_master").select("psgc10", tx.match_key(F.col("name")).alias("key"))
    one = m.groupBy("key").agg(F.min("psgc10").alias("psgc10"), F.count(F.lit(1)).alias("n")).filter("n = 1").drop("n")
    p = _t(spark, d, "psa_panel").select("psa_id", F.posexplode(F.array(tx.plain_key(F.col("lgu_name")), tx.match_key(F.col("lgu_name")))).alias("rank", "key"))
    return p.join(one, "key").groupBy("psa_id").agg(F.min_by("psgc10", "rank").alias("psgc10"))


# --- features
def ur_target(spark: SparkSession, d: str) -> DataFrame:
    p = pl.with_targets(_t(spark, d, "panel_ml"))
    return p.select("row_id", F.round("spent_used", 4).alias("spent_used"), "spent_source", F.round("ur_a", 6).alias("ur_a"), F.round("ur_b", 6).alias("ur_b"))


def lag_lead_panel(spark: SparkSession, d: str) -> DataFrame:
    cols = ["ur_a", "ur_b", "nta_ira", "fund_cash_balance_end", INCOME]
    p = timeseries.lags_and_leads(pl.latest_rows(_t(spark, d, "panel_ml")), "psgc10", "fiscal_year", {c: [1, 2] for c in cols}, {"ur_a": [1], "ur_b": [1]})
    return p.select("row_id", *[_n(f"{c}_lag{k}").alias(f"{c}_lag{k}") for c in cols for k in (1, 2)], _n("ur_a_lead1").alias("ur_a_lead1"), _n("ur_b_lead1").alias("ur_b_lead1"))


def calendar_lags(spark: SparkSession, d: str) -> DataFrame:
    p = pl.latest_rows(_t(spark, d, "panel_ml")).select("row_id", "psgc10", "fiscal_year", _n("nta_dependency").alias("x"))
    return timeseries.calendar_lag(p, "psgc10", "fiscal_year", ["x"]).select("row_id", "x_year1")


def log_features(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "panel_ml").select("row_id", *[F.round(ft.log_feature(c), 6).alias(f"log_{c}") for c in pl.LOGGED])


def safe_ratios(spark: SparkSession, d: str) -> DataFrame:
    parts = {"nta_dependency": ("nta_ira", INCOME), "local_share": ("total_local_sources", INCOME), "external_share": ("total_external_sources", INCOME), "fund_balance_share": ("fund_cash_balance_end", INCOME), "capex_share_avail": ("total_capital_investment_exp", "fund_cash_available"), "pop_density": ("population", "land_area_sqkm")}
    return _t(spark, d, "panel_ml").select("row_id", *[F.round(ft.ratio(a, b), 6).alias(c) for c, (a, b) in parts.items()])


def revenue_hhi(spark: SparkSession, d: str) -> DataFrame:
    """The components of local revenue are in the fiscal rows as filed."""
    s = _t(spark, d, "sre_panel")
    return s.select("row_id", F.round(ft.hhi([c for c in pl.COMPONENTS if c in s.columns]), 6).alias("revenue_hhi"))


def structure_features(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "panel_ml").select("row_id", ft.ordinal(F.col("income_class")).alias("income_class_num"), ft.member_flag(F.col("fiscal_year"), pl.ELECTIONS).alias("is_election"))


def unit_rescale(spark: SparkSession, d: str) -> DataFrame:
    p = _t(spark, d, "panel_ml").select("row_id", "file_id", INCOME, "nta_ira")
    r = harmonize.rescale(p, ["file_id"], INCOME, [INCOME, "nta_ira"])
    return r.select("row_id", F.round(_n(INCOME), 6).alias("income"), F.round(_n("nta_ira"), 6).alias("nta_ira"))


def feature_matrix(spark: SparkSession, d: str) -> DataFrame:
    f = pl.feature_matrix(_t(spark, d, "panel_ml"))
    made = ["spent_used", "ur_a", "ur_b", "target_ur_a", "target_ur_b", "ur_a_current", "ur_b_current"]
    made += [f"{c}_lag{k}" for c in pl.LAGGED for k in (1, 2)] + [f"log_{c}" for c in pl.LOGGED] + ["nta_dependency", "local_share", "external_share", "fund_balance_share", "capex_share_avail", "pop_density"]
    return f.select("row_id", "psgc10", "fiscal_year", "spent_source", "income_class_num", "election_year", *[F.round(_n(c), 4).alias(c) for c in made])


# --- time series
def _region_income(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "panel_ml").groupBy("region", "fiscal_year").agg(F.avg(_n("fund_cash_available")).alias("cash"))


def ffill_bfill_grid(spark: SparkSession, d: str) -> DataFrame:
    x = _region_income(spark, d)
    g = timeseries.year_grid(x.select("region").distinct(), 1992, 2024).join(x, ["region", "fiscal_year"], "left")
    return timeseries.fill_gaps(g, "region", "fiscal_year", ["cash"]).select("region", "fiscal_year", F.round("cash", 4).alias("cash"))


def rebase_index(spark: SparkSession, d: str) -> DataFrame:
    x = _t(spark, d, "panel_ml").groupBy("region", "fiscal_year").agg(F.avg(_n("nta_dependency")).alias("x"))
    r = timeseries.rebase(x, "region", "fiscal_year", "x", 2018, "deflator")
    return r.select("region", "fiscal_year", F.round("deflator", 6).alias("deflator"))


def loglinear_interpolate(spark: SparkSession, d: str) -> DataFrame:
    p = pl.latest_population(_t(spark, d, "population_lgu_annual")).select("psgc10", "fiscal_year", _n("population").alias("population"))
    c = p.filter(F.col("fiscal_year").isin(*CENSUS)).filter("population is not null")
    return timeseries.interpolate(c, "psgc10", "fiscal_year", "population", 1992, 2024).select("psgc10", "fiscal_year", F.round("population", 3).alias("population"))


def proportional_allocation(spark: SparkSession, d: str) -> DataFrame:
    m = _t(spark, d, "psgc_lgu_master")
    mem = m.filter("level <> 'province'").select("psgc10", "province_code", F.col("pop_2024").cast("double").alias("w"))
    tot = m.filter("level = 'province'").select(F.col("psgc10").alias("province_code"), F.col("pop_2024").cast("double").alias("total"))
    a = timeseries.allocate(mem, tot, ["province_code"], "w", "total", "allocated")
    return a.select("psgc10", F.round("share", 8).alias("share"), F.round("allocated", 3).alias("allocated"))


def section_header_fill(spark: SparkSession, d: str) -> DataFrame:
    p = _t(spark, d, "psa_panel").select("psa_id", "region", "province")
    cont = F.coalesce(F.lower("province").rlike(r"continued|\(cont"), F.lit(True))
    return timeseries.fill_sections(p, ["region"], "psa_id", "province", cont, "section").select("psa_id", "section")


# --- shapes
def unpivot_snapshots(spark: SparkSession, d: str) -> DataFrame:
    long = reshape.snapshots_to_long(_t(spark, d, "psa_panel"), ["psa_id"], list(pl.POVERTY_FIELDS), [2018, 2019, 2021, 2023])
    return long.select("psa_id", "fiscal_year", *[_n(c).alias(c) for c in pl.POVERTY_FIELDS])


def unpivot_measures(spark: SparkSession, d: str) -> DataFrame:
    return reshape.unpivot_years(_t(spark, d, "psa_panel"), ["psa_id"], r"pi_(\d{4})")


def pivot_contingency(spark: SparkSession, d: str) -> DataFrame:
    return reshape.contingency(_t(spark, d, "panel_ml"), "lgu_type", "spent_source", ["detailed", "total", "none"])


def collapse_mean_union(spark: SparkSession, d: str) -> DataFrame:
    p = _t(spark, d, "psa_panel").select("psa_id", "province", F.col("lgu_name").alias("name"), _n("pi_2018").alias("pi_2018"), _n("pi_2021").alias("pi_2021"))
    part = F.coalesce(F.lower("name").rlike(r"\bdist"), F.lit(False))
    c = reshape.collapse(p, part, ["province"], ["pi_2018", "pi_2021"], {"name": "districts"})
    return c.select("psa_id", "province", "name", F.round("pi_2018", 6).alias("pi_2018"), F.round("pi_2021", 6).alias("pi_2021"))


def union_by_name(spark: SparkSession, d: str) -> DataFrame:
    a = _t(spark, d, "sre_panel_with_psgc").select("psgc10", "fiscal_year", "tier")
    b = _t(spark, d, "population_lgu_annual").select("psgc10", "fiscal_year", "pop_source")
    return reshape.union_all([a, b]).groupBy("fiscal_year").agg(F.count(F.lit(1)).alias("n"), F.count("tier").alias("n_tier"), F.count("pop_source").alias("n_source"))


# --- codes, labels and text
def hierarchy_codes(spark: SparkSession, d: str) -> DataFrame:
    m = hierarchy.parents(_t(spark, d, "psgc_lgu_master").select("psgc10", "name"), "psgc10", 5)
    return hierarchy.with_parent_name(m, "psgc10", "parent_code", "name", "parent_name").select("psgc10", "parent_code", "parent_name")


def code_clean(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "sre_panel_with_psgc").select("xwalk_id", clean_code(F.col("psgc10"), 10).alias("code"))


def text_keys(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "psgc_lgu_master").select("psgc10", tx.plain_key(F.col("name")).alias("plain_key"), tx.match_key(F.col("name")).alias("match_key"), tx.level_key(F.col("level")).alias("level_key"))


def region_canon(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "sre_panel").select("region").distinct().select("region", tx.region_number(F.col("region")).alias("number"))


def year_from_name(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "harmonization_report").select("file_id", tx.year_in(F.col("file_name")).alias("year"))


def metadata_rows(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "sre_panel").groupBy(tx.is_metadata(F.col("lgu_name")).cast("int").alias("is_metadata")).agg(F.count(F.lit(1)).alias("n"))


def number_parse(spark: SparkSession, d: str) -> DataFrame:
    c = _t(spark, d, "sheet_rows").select("file_id", "row_idx", F.posexplode("cells").alias("pos", "cell"))
    return c.select("file_id", "row_idx", "pos", parse_number(F.col("cell")).alias("x"))


def era_rules(spark: SparkSession, d: str) -> DataFrame:
    h = _t(spark, d, "harmonization_report").select("file_id", "fiscal_year", F.lower("file_name").alias("name"))
    e = harmonize.era_of(F.col("name"), F.col("fiscal_year"), [("sie", "SIE"), ("sre", "SRE")], [(1992, 2000, "BOS"), (2001, 2008, "SIE"), (2009, 2024, "SRE")])
    return h.select("file_id", e.alias("era"))


def ordered_pattern_map(spark: SparkSession, d: str) -> DataFrame:
    rules = _t(spark, d, "canonical_columns").select(F.lower("known_label").alias("pattern"), F.col("column_name").alias("target"), (-F.length("known_label")).alias("rank"))
    labels = _t(spark, d, "header_block").select(F.explode("header_labels").alias("label")).select(tx.squeeze(F.lower("label")).alias("label"))
    return harmonize.map_labels(labels, rules)


def alias_closure(spark: SparkSession, d: str) -> DataFrame:
    m = _t(spark, d, "psgc_lgu_master")
    former = m.filter("old_names is not null").select(F.col("match_key_short").alias("key"), F.lower("old_names").alias("alias"))
    return resolve.alias_closure(former.unionByName(m.select(F.lower("province_name").alias("key"), F.col("match_key_short").alias("alias"))), 3)


def exact_tier_match(spark: SparkSession, d: str) -> DataFrame:
    p = resolve.prepare(_t(spark, d, "sre_panel"), "lgu_name", "province", "lgu_type")
    t = resolve.exact_tiers(p, resolve.catalog(_t(spark, d, "psgc_lgu_master")))
    return p.join(t, "rid").select("lgu_name", "province", "lgu_type", "psgc10", "tier")


def fuzzy_tier_match(spark: SparkSession, d: str) -> DataFrame:
    m = _t(spark, d, "psgc_lgu_master")
    return resolve.crosswalk(_t(spark, d, "sre_panel"), m, name_aliases=resolve.former_names(m))


def tier_histogram(spark: SparkSession, d: str) -> DataFrame:
    """How many typed tuples, and how many rows of them, each exact tier of the resolver finds; 0 for the rest."""
    s = _t(spark, d, "sre_panel")
    p = resolve.prepare(s, "lgu_name", "province", "lgu_type")
    t = resolve.exact_tiers(p, resolve.catalog(_t(spark, d, "psgc_lgu_master")))
    walk = p.join(t, "rid", "left").select("lgu_name", "province", "lgu_type", F.coalesce("tier", F.lit(0)).alias("tier"))
    rows = null_safe_join(s.groupBy("lgu_name", "province", "lgu_type").agg(F.count(F.lit(1)).alias("n")), walk, ["lgu_name", "province", "lgu_type"])
    return rows.groupBy("tier").agg(F.count(F.lit(1)).alias("n_tuples"), F.sum("n").alias("n_rows"))


def unmatched_ranking(spark: SparkSession, d: str) -> DataFrame:
    s = _t(spark, d, "sre_panel")
    p = resolve.prepare(s, "lgu_name", "province", "lgu_type")
    t = resolve.exact_tiers(p, resolve.catalog(_t(spark, d, "psgc_lgu_master")))
    walk = p.join(t, "rid", "left").select("lgu_name", "province", "lgu_type", F.coalesce("tier", F.lit(0)).alias("tier"))
    return resolve.unmatched_ranking(s, walk, ["lgu_name", "province", "lgu_type"])


def unmatched_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    p = resolve.prepare(_t(spark, d, "psa_panel"), "lgu_name", "province", "lgu_type")
    cat = resolve.catalog(_t(spark, d, "psgc_lgu_master"))
    return resolve.diagnose(p.join(resolve.exact_tiers(p, cat).select("rid"), "rid", "left_anti"), cat)


# --- reports and rules
def qa_by_year(spark: SparkSession, d: str) -> DataFrame:
    return report.summary_by(_t(spark, d, "panel_ml"), "fiscal_year", "nta_dependency")


def qa_by_bucket(spark: SparkSession, d: str) -> DataFrame:
    return report.by_bucket(_t(spark, d, "panel_ml"), "fiscal_year", "nta_dependency", BUCKETS)


def nonnull_rates(spark: SparkSession, d: str) -> DataFrame:
    p = _t(spark, d, "panel_ml")
    return report.non_null_rates(p, [c for c, t in p.dtypes if t in ("double", "string", "bigint", "int")])


def distinct_counts(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "panel_ml").groupBy("fiscal_year").agg(F.count_distinct("psgc10").alias("n_units"), F.count_distinct("file_id").alias("n_files"))


def entity_summary(spark: SparkSession, d: str) -> DataFrame:
    t = _t(spark, d, "panel_ml")
    p = t.groupBy("psgc10").agg(F.min_by("lgu_name", F.struct("fiscal_year", "row_id")).alias("first_name"), F.round(F.avg(_n("population")), 3).alias("mean_population"))
    m = report.medians(t, ["psgc10"], F.col("nta_dependency"), "median_nta")
    return null_safe_join(p, m, ["psgc10"]).select("psgc10", "first_name", F.round("median_nta", 6).alias("median_nta"), "mean_population")


def topk_per_group(spark: SparkSession, d: str) -> DataFrame:
    m = _t(spark, d, "psgc_lgu_master").filter("level <> 'province' and pop_2024 is not null")
    return report.top_k(m, ["province_name"], [F.desc("pop_2024"), F.col("psgc10")], 5).select("province_name", "psgc10", "rank")


def mode_per_group(spark: SparkSession, d: str) -> DataFrame:
    return report.mode_of(_t(spark, d, "panel_ml"), ["province"], "income_class")


SHARED = ["rpt", "business_tax", "nta_ira", "gps", "economic_services"]


def _amounts(s: DataFrame) -> DataFrame:
    cells = F.array(*[F.struct(F.lit(c).alias("item"), _n(c).alias("v")) for c in SHARED])
    return s.select(F.explode(cells).alias("c")).select("c.*").filter("v is not null")


def share_rank(spark: SparkSession, d: str) -> DataFrame:
    """Amounts of all files, brought to one unit before they are ranked."""
    return report.share_and_rank(_amounts(harmonize.common_scale(_t(spark, d, "sre_panel"), ["file_id"], INCOME, SHARED)), "item", "v", 3)


def overlapping_groups(spark: SparkSession, d: str) -> DataFrame:
    labels = {"cities": F.col("lgu_type") == "city", "municipalities": F.col("lgu_type") == "municipality", "before_2009": F.col("fiscal_year") < 2009, "elections": F.col("fiscal_year").isin(*pl.ELECTIONS), "metro": F.col("province") == "Metro Kalayan"}
    return report.overlapping(_t(spark, d, "panel_ml"), labels, "nta_dependency")


def joined_names(spark: SparkSession, d: str) -> DataFrame:
    return report.joined_distinct(_t(spark, d, "harmonization_report"), ["stream_id"], "template_era", "eras")


def validation_rules(spark: SparkSession, d: str) -> DataFrame:
    p = _t(spark, d, "panel_ml")
    total = _n("total_current_operating_income")
    parts = _n("total_local_sources") + _n("total_external_sources")
    rules = {
        "missing_code": ("error", F.col("psgc10").isNull()),
        "negative_spending": ("error", _n("total_current_operating_exp") < 0),
        "zero_income": ("warning", total == 0),
        "income_identity": ("warning", (total > 0) & (F.abs(total - parts) / total > 0.01)),
        "no_population": ("warning", _n("population").isNull() | (_n("population") <= 0)),
    }
    return validate.check_rules(p, rules)


def validation_by_year(spark: SparkSession, d: str) -> DataFrame:
    rules = {"negative_spending": _n("total_current_operating_exp") < 0, "zero_income": _n(INCOME) == 0}
    return validate.check_groups(_t(spark, d, "panel_ml"), "fiscal_year", rules)


def master_validation(spark: SparkSession, d: str) -> DataFrame:
    m = _t(spark, d, "psgc_lgu_master")
    rules = {"bad_code": ("error", F.length("psgc10") != 10), "no_name": ("error", F.coalesce(F.trim("name"), F.lit("")) == ""), "city_without_province": ("info", (F.col("level") == "city") & (F.col("province_code") == "")), "removed": ("info", F.col("removed_at").isNotNull())}
    return validate.check_rules(m, rules)


# --- folds
def _folded(spark: SparkSession, d: str) -> DataFrame:
    x = pl.with_targets(pl.latest_rows(_t(spark, d, "panel_ml")))
    x = timeseries.lags_and_leads(x, "psgc10", "fiscal_year", {}, {"ur_b": [1]}).filter("ur_b_lead1 is not null")
    return fd.assign_folds(x.select("row_id", "psgc10", "fiscal_year", "ur_b", F.col("ur_b_lead1").alias("target")), fd.fold_table(spark), "fiscal_year")


def fold_sizes(spark: SparkSession, d: str) -> DataFrame:
    return _folded(spark, d).groupBy("fold", "part").agg(F.count(F.lit(1)).alias("n"))


def _scores(spark: SparkSession, d: str) -> DataFrame:
    return fd.scores(fd.baseline_predictions(_folded(spark, d), "target", "ur_b"))


def fold_metrics_naive(spark: SparkSession, d: str) -> DataFrame:
    s = fd.against_naive(_scores(spark, d))
    return s.select("fold", "model", "n_test", *[F.round(c, 5).alias(c) for c in ("rmse", "mae", "r2", "rmse_ratio_vs_naive")])


def verdict(spark: SparkSession, d: str) -> DataFrame:
    v = fd.verdict(_scores(spark, d))
    return v.select("model", F.round("rmse", 5).alias("rmse"), F.round("ratio", 4).alias("ratio"), "verdict")


def stratified_holdout(spark: SparkSession, d: str) -> DataFrame:
    e = _t(spark, d, "psgc_lgu_master").select("psgc10", "region_code")
    return fd.stratified_holdout(e, "psgc10", "region_code").select("psgc10", F.col("held_out").cast("int").alias("held_out"))


def sample_names(spark: SparkSession, d: str) -> DataFrame:
    return fd.sample_per_group(_t(spark, d, "psgc_lgu_master").select("level", "psgc10"), "level", "psgc10", 5)


# --- events
def events_json_daily(spark: SparkSession, d: str) -> DataFrame:
    e = _t(spark, d, "events").select(F.to_date("ts").cast("string").alias("day"), "event_type", F.get_json_object("props", "$.k").try_cast("bigint").alias("k"), "value")
    return e.groupBy("day", "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("k").alias("sum_k"), F.round(F.sum("value"), 3).alias("sum_value"))


def running_share(spark: SparkSession, d: str) -> DataFrame:
    e = _t(spark, d, "events").groupBy("event_type", F.to_date("ts").cast("string").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    w = W.partitionBy("event_type").orderBy("day")
    return e.select("event_type", "day", F.sum("n").over(w.rowsBetween(W.unboundedPreceding, 0)).alias("running"))


NAMES = [
    panel_star_join, tier_dedup, keep_last_dedup, keep_best_by_aggregate, distinct_labels, duplicate_groups, repeated_rows_marked, null_safe_lookup, semi_membership, anti_backfill, coverage_sides, coverage_flags,
    member_expansion, variant_lookup, ur_target, lag_lead_panel, calendar_lags, log_features, safe_ratios, revenue_hhi, structure_features, unit_rescale, feature_matrix, ffill_bfill_grid, rebase_index,
    loglinear_interpolate, proportional_allocation, section_header_fill, unpivot_snapshots, unpivot_measures, pivot_contingency, collapse_mean_union, union_by_name, hierarchy_codes, code_clean, text_keys,
    region_canon, year_from_name, metadata_rows, number_parse, era_rules, ordered_pattern_map, alias_closure, exact_tier_match, fuzzy_tier_match, tier_histogram, unmatched_ranking, unmatched_diagnostics,
    qa_by_year, qa_by_bucket, nonnull_rates, distinct_counts, entity_summary, topk_per_group, mode_per_group, share_rank, overlapping_groups, joined_names, validation_rules, validation_by_year, master_validation,
    fold_sizes, fold_metrics_naive, verdict, stratified_holdout, sample_names, events_json_daily, running_share,
]


def queries() -> dict:
    return {f.__name__: f for f in NAMES}
