import os

import pytest

import __spark_entry__ as e
from panelwright.queries import models, panel, registry
from tests.compare import compare, connect

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@needs_data
@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, name):
    assert compare(spark, connect(DATA), name, e.queries()[name], registry.oracle_sql()[name], DATA) == ""


@needs_data
@pytest.mark.parametrize("name", ["p1_found", "p1_harmonized", "p5_filled", "p6_profile", "p6_stability", "p7_found", "p7_table", "fuzzy_tier_match", "unmatched_diagnostics"])
def test_query_without_sql_runs(spark, name):
    assert e.queries()[name](spark, DATA).count() >= 0


@needs_data
def test_all_rows_are_explained_with_default_parameters(spark, monkeypatch):
    seen = {}

    def spy(owner, name, note):
        f = getattr(owner, name)
        monkeypatch.setattr(owner, name, lambda *a, **k: (note(a, k), f(*a, **k))[1])

    spy(models.models, "boosted", lambda a, k: seen.update(boosted=k))
    spy(models.explain, "clusters", lambda a, k: seen.update(clusters=k))
    spy(models.explain, "contributions", lambda a, k: seen.update(rows=a[0].count()))
    clustered = models.entity_clusters(spark, DATA)
    x = models._input(spark, DATA)
    assert seen == {"boosted": {"validation": "stop"}, "clusters": {}, "rows": x.count()}
    assert {r[0] for r in clustered.select("psgc10").collect()} == {r[0] for r in x.select("psgc10").distinct().collect()}


@needs_data
def test_stability_covers_every_column(spark):
    got = {r[0] for r in e.queries()["p6_stability"](spark, DATA).select("column_name").distinct().collect()}
    assert got == set(spark.read.parquet(f"{DATA}/panel_ml.parquet").columns) - {"load_series", "load_id"}


@needs_data
def test_whole_alias_closure_reaches_the_units_of_every_province(spark):
    got = {(r["key"], r["alias"]) for r in e.queries()["alias_closure"](spark, DATA).filter("depth <= 1").collect()}
    m = spark.read.parquet(f"{DATA}/psgc_lgu_master.parquet").filter("province_name is not null and match_key_short is not null")
    assert {(r["province_name"].lower(), r["match_key_short"]) for r in m.collect()} <= got


@needs_data
def test_whole_grid_keeps_every_real_average(spark):
    got = {(r["region"], r["fiscal_year"]): r["cash"] for r in e.queries()["ffill_bfill_grid"](spark, DATA).collect()}
    p = spark.read.parquet(f"{DATA}/panel_ml.parquet").filter("not isnan(fund_cash_available) and region is not null")
    real = p.groupBy("region", "fiscal_year").avg("fund_cash_available").filter("fiscal_year between 1992 and 2024").collect()
    assert all(got[r[0], r[1]] == pytest.approx(r[2], abs=1e-3) for r in real if r[2] is not None)


@needs_data
def test_whole_pattern_map_knows_short_headers(spark):
    got = {r["label"] for r in e.queries()["ordered_pattern_map"](spark, DATA).collect()}
    known = {r[0].lower() for r in spark.read.parquet(f"{DATA}/canonical_columns.parquet").select("known_label").collect()}
    seen = {" ".join(x.lower().split()) for r in spark.read.parquet(f"{DATA}/header_block.parquet").select("header_labels").collect() for x in r[0] or [] if x}
    assert {x for x in known & seen if len(x) <= 5} and known & seen <= got


def test_amounts_of_all_files_are_ranked_in_one_unit(spark, tmp_path):
    rows = [(f, 20.0 * u * k, *[v * u * k for v in (1.0, 2.0, 9.0, 4.0, 3.0)]) for f, u in enumerate((1.0, 1.0, 1.0, 1e3, 1e6)) for k in (1, 2, 3)]
    spark.createDataFrame(rows, ["file_id", panel.INCOME, *panel.SHARED]).write.parquet(str(tmp_path / "sre_panel.parquet"))
    got = {r["item"]: (r["mean_abs"], r["rank"]) for r in panel.share_rank(spark, str(tmp_path)).collect()}
    assert got == {"nta_ira": (18.0, 1), "gps": (8.0, 2), "economic_services": (6.0, 3), "business_tax": (4.0, 4), "rpt": (2.0, 5)}


@needs_data
def test_entry(spark):
    assert e.entry(spark).limit(5).count() == 5


def test_every_sql_has_a_query():
    assert set(registry.oracle_sql()) <= set(registry.queries())
