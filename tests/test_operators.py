import difflib
import math

import pytest
from pyspark.sql import functions as F

from panelwright.functions import codes, numbers, text
from panelwright.ml import folds
from panelwright.operators import dedup, features, harmonize, hierarchy, joins, report, reshape, resolve, timeseries, validate


def one(spark, col, *values, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(col).collect()]


def test_codes(spark):
    assert one(spark, codes.clean_code(F.col("v"), 10), "102800000.0", "'0100000000", "abc", None, "", "12345678901") == ["0102800000", "0100000000", "", None, "", "12345678901"]
    assert one(spark, codes.code_to_long(F.col("v")), " 0012\xa0", "12.0", "x1", None, "") == [12, 12, None, None, None]


def test_numbers(spark):
    assert one(spark, numbers.parse_number(F.col("v")), "1,234.5", "(9.45)", "P 147.06", "₱1,000", "12,5", "-", "n/a", "", None, "5-", "1.234,5", "1e3") == [1234.5, -9.45, 147.06, 1000.0, 12.5, None, None, None, None, -5.0, 1234.5, 1000.0]
    assert one(spark, numbers.clip(F.col("v"), 0.0, 1.0), -1.0, 0.5, 2.0, None, kind="double") == [0.0, 0.5, 1.0, None]
    assert one(spark, numbers.safe_div(F.lit(1.0), F.col("v")), 0.0, 2.0, None, kind="double") == [None, 0.5, None]


def test_concentration_of_missing_parts(spark):
    df = spark.createDataFrame([(1.0, 1.0), (None, None), (3.0, None), (float("nan"), 2.0)], "a double, b double")
    assert [r[0] for r in df.select(features.hhi(["a", "b"])).collect()] == [0.5, 0.0, 1.0, 1.0]


def test_text(spark):
    assert one(spark, text.match_key(F.col("v")), "City of San\xa0Peñasco *", "Sta. Cruz (Capital)", "Mun. of Gen. Luna", None, "", "City") == ["san penasco", "santa cruz", "general luna", "", "", "city"]
    assert one(spark, text.region_number(F.col("v")), "Region IV (X)", "R07", "Reg. XII - Y", "Metro", None) == [4, 7, 12, None, None]
    assert one(spark, text.year_in(F.col("v")), "a_1999_to_2004.csv", "none", None) == [2004, None, None]
    assert one(spark, text.ascii_fold(F.col("v")), "Ñandú", None) == ["Nandu", None]


def test_null_safe_join(spark):
    a = spark.createDataFrame([(None, 1), ("x", 2)], "k string, a int")
    b = spark.createDataFrame([(None, 10), ("y", 20)], "k string, b int")
    assert sorted(((r["a"], r["b"]) for r in joins.null_safe_join(a, b, ["k"]).collect())) == [(1, 10), (2, None)]


def test_dedup_and_duplicates(spark):
    df = spark.createDataFrame([(1, "a", 3), (2, "a", 1), (3, None, 5), (4, None, 5)], "id int, k string, t int")
    keep = {r["id"] for r in dedup.keep_one(df, ["k"], [F.col("t"), F.col("id")]).collect()}
    assert keep == {2, 3} == {r["id"] for r in dedup.keep_best(df, ["k"], [F.col("t"), F.col("id")]).collect()}
    assert {r["k"]: r["n_rows"] for r in dedup.duplicate_groups(df, ["k"]).collect()} == {"a": 2, None: 2}
    assert dedup.keep_one(df.limit(0), ["k"], [F.col("id")]).count() == 0


def test_interpolation_cases(spark):
    df = spark.createDataFrame([("a", 2000, 100.0), ("a", 2004, 400.0), ("b", 2001, 0.0), ("b", 2003, 10.0), ("c", 2002, 7.0), ("d", 1990, 5.0)], "e string, y int, v double")
    got = {(r["e"], r["y"]): r["v"] for r in timeseries.interpolate(df, "e", "y", "v", 1999, 2005).collect()}
    assert len(got) == 28
    assert got["a", 1999] == 100 and got["a", 2002] == pytest.approx(200) and got["a", 2004] == pytest.approx(400) and got["a", 2005] == 400
    assert got["b", 2002] == 5.0 and got["c", 1999] == 7.0 == got["c", 2005] and got["d", 2000] == 5.0


def test_lags_fill_and_shares(spark):
    df = spark.createDataFrame([("a", 2000, 1.0), ("a", 2002, None), ("a", 2003, 4.0), ("b", 2001, 9.0)], "e string, y int, v double")
    l = {(r["e"], r["y"]): (r["v_lag1"], r["v_lead1"]) for r in timeseries.lags_and_leads(df, "e", "y", {"v": [1]}, {"v": [1]}).collect()}
    assert l["a", 2002] == (1.0, 4.0) and l["b", 2001] == (None, None)
    c = {(r["e"], r["y"]): r["v_year1"] for r in timeseries.calendar_lag(df, "e", "y", ["v"]).collect()}
    assert c["a", 2002] is None and c["a", 2003] is None
    f = {(r["e"], r["y"]): r["v"] for r in timeseries.fill_gaps(df, "e", "y", ["v"]).collect()}
    assert f["a", 2002] == 1.0
    tot = spark.createDataFrame([("a", 10.0), ("b", 3.0)], "e string, total double")
    s = timeseries.allocate(df.withColumn("v", F.coalesce("v", F.lit(0.0)) * (F.col("e") == "a").cast("double")), tot, ["e"], "v", "total", "part").collect()
    assert sum(r["part"] for r in s if r["e"] == "a") == pytest.approx(10) and [r["part"] for r in s if r["e"] == "b"] == [3.0]


def test_reshape(spark):
    df = spark.createDataFrame([(1, 2.0, None, 5.0)], "id int, pi_2018 double, pi_2021 double, cv_2021 double")
    assert sorted((r["year"], r["value"]) for r in reshape.unpivot_years(df, ["id"], r"pi_(\d{4})").collect()) == [(2018, 2.0)]
    long = {r["fiscal_year"]: (r["pi"], r["cv"]) for r in reshape.snapshots_to_long(df, ["id"], ["pi", "cv"], [2018, 2020, 2021]).collect()}
    assert long == {2018: (2.0, None), 2021: (None, 5.0)}
    assert reshape.find_column(df, ["x", "PI_2018"]) == "pi_2018" and reshape.find_column(df, ["id"], "nope") is None
    assert reshape.drop_suffixed(df, "_2021").columns == ["id", "pi_2018"]
    assert reshape.ordered(df, ["cv_2021", "zz"]).columns[0] == "cv_2021"


def test_hierarchy(spark):
    raw = [("102800000.0", "Region\xa0X *", "Reg", None), ("0102800000", "Ilo*", "Prov", "1,234"), ("0102805000", "City of A", "City", "5"), ("0199905000", "B City", "City", None), ("12", "short", "Mun", ""), ("0102806000", "C", "??", "")]
    m = {r["psgc10"] + r["level"]: r for r in hierarchy.harmonize_codes(spark.createDataFrame(raw, "c string, n string, l string, p string"), "c", "n", "l", "p").collect()}
    assert m["0102805000city"]["province_code"] == "0102800000" and m["0102805000city"]["province_name"] == "Ilo" and m["0102800000province"]["pop_2024"] == 1234
    assert m["0199905000city"]["is_independent_city"] and m["0199905000city"]["province_code"] == ""


def test_alias_closure_keeps_least_depth(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("d", "e"), ("a", "c"), ("b", "a"), (None, "x")], "key string, alias string")
    got = {(r["key"], r["alias"]): r["depth"] for r in resolve.alias_closure(e, 3).collect()}
    assert got["a", "c"] == 1 and got["a", "d"] == 2 and got["a", "e"] == 3 and got["a", "a"] == 0 and ("b", "a") in got


def master(spark):
    rows = [
        ("01", "San Jose", "Alpha", "municipality"), ("02", "City of San Jose", "Beta", "city"), ("03", "Kalbario", "Alpha", "municipality"), ("04", "Alpha", "Alpha", "province"), ("05", "Alpha City", "Beta", "city"),
        ("06", "Montemayor", "Beta", "municipality"), ("07", "Montemayer", "Gamma", "municipality"), ("08", "Verdeluna del Norte", "Gamma", "municipality"),
    ]
    return spark.createDataFrame(rows, "psgc10 string, name string, province_name string, level string")


def test_resolver_tiers(spark):
    rec = [("San Jose", "Alpha", "Mun."), ("SAN JOSE", "Beta", "Municipality"), ("Kalbario", "Nowhere", "M"), ("Kalbarlo", "Alpha", "M"), ("Montemayor (Beta)", None, "M"), ("Zzz", "Alpha", "M"), (None, "Alpha", "M"), ("Verdeluna del Norta", "", "M")]
    w = {r["lgu_name"]: (r["psgc10"], r["tier"]) for r in resolve.crosswalk(spark.createDataFrame(rec, "lgu_name string, province string, lgu_type string"), master(spark)).collect()}
    assert w["San Jose"] == ("01", 1) and w["SAN JOSE"] == ("02", 1) and w["Kalbario"] == ("03", 2)
    assert w["Kalbarlo"] == ("03", 3) and w["Montemayor (Beta)"] == ("06", 1) and w["Zzz"] == (None, 0) and w[None] == (None, 0)
    assert w["Verdeluna del Norta"] == ("08", 4)
    empty = resolve.crosswalk(spark.createDataFrame(rec[:1], "lgu_name string, province string, lgu_type string"), master(spark).limit(0)).first()
    assert empty["tier"] == 0


def test_aliases_inside_the_cascade(spark):
    rec = [("Kalbario", "Old Alpha", "M"), ("Oldmayor", "Beta", "M"), ("Oldmayor", "Gamma", "M"), ("First Alpha", "First Alpha", "Province"), ("San Jose", "Older Alpha", "M")]
    provinces = spark.createDataFrame([("old alpha", "alpha"), ("older alpha", "old alpha"), ("first alpha", "alpha")], "key string, alias string")
    names = spark.createDataFrame([("beta", "oldmayor", "montemayor"), (None, "unused", "kalbario")], "prov string, alias string, key string")
    df = spark.createDataFrame(rec, "lgu_name string, province string, lgu_type string")
    w = {(r["lgu_name"], r["province"]): (r["psgc10"], r["tier"]) for r in resolve.crosswalk(df, master(spark), province_aliases=provinces, name_aliases=names).collect()}
    assert w["Kalbario", "Old Alpha"] == ("03", 1) and w["San Jose", "Older Alpha"] == ("01", 1)  # by one step and by two
    assert w["Oldmayor", "Beta"] == ("06", 1) and w["Oldmayor", "Gamma"][1] != 1  # in its province only
    assert w["First Alpha", "First Alpha"] == ("04", 1)  # a province's own name follows the aliases too
    bare = {(r["lgu_name"], r["province"]): r["tier"] for r in resolve.crosswalk(df, master(spark)).collect()}
    assert bare["Kalbario", "Old Alpha"] != 1 and bare["San Jose", "Older Alpha"] != 1


def test_first_candidate_with_a_fit_decides_its_tier(spark):
    # both bracket forms fit someone; the earlier one is taken although the later one is nearer
    m = spark.createDataFrame([("01", "Kalbaroso", "Alpha", "municipality"), ("02", "Vinemaro", "Alpha", "municipality")], "psgc10 string, name string, province_name string, level string")
    rec = spark.createDataFrame([("Kalbaruso (Vinemara)", "Alpha", "M")], "lgu_name string, province string, lgu_type string")
    r = resolve.crosswalk(rec, m).first()
    assert (r["psgc10"], r["tier"]) == ("01", 3)


def test_block_ratio_is_the_stdlib_one(spark):
    pairs = [("abcd", "bcda"), ("san jose", "san juan"), ("", "x"), ("a", "a")]
    df = spark.createDataFrame(pairs, "a string, b string")
    got = [r[0] for r in df.select(resolve.block_ratio("a", "b")).collect()]
    assert got == [difflib.SequenceMatcher(None, a, b).ratio() for a, b in pairs]


def test_headers(spark):
    rows = [("s", 0, ["Title", None, None]), ("s", 1, ["LGU", "Income", "Income"]), ("s", 2, ["lgu", "Local", "Total"]), ("s", 3, ["A", "1.5", "2"])]
    df = spark.createDataFrame(rows, "sheet string, row_idx int, cells array<string>")
    h = harmonize.header_block(df, "lgu").first()
    assert (h["header_start"], h["data_start"]) == (1, 3)
    lab = {r["pos"]: r["label"] for r in harmonize.flatten_header(df.filter("row_idx in (1, 2)")).collect()}
    assert lab == {0: "LGU", 1: "Income | Local", 2: "Income | Total"}
    y = spark.createDataFrame([("s", 0, ["n", "1995"]), ("s", 1, ["n", "1990", "1995", "2000", "2007", "Land Area", "1995"])], "sheet string, row_idx int, cells array<string>")
    assert harmonize.year_header_row(y, (1990, 1995, 2000, 2007)).first()["header_row"] == 1
    g = {r["year"]: r["pos"] for r in harmonize.column_groups(y.filter("row_idx = 1"), (1990, 1995, 2000, 2007), "land area").collect()}
    assert g == {1990: 1, 1995: 2, 2000: 3, 2007: 4}


def test_rules_and_reports(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (1, "b", -1.0), (None, "b", None)], "k int, g string, v double")
    r = {x["rule"]: x["n_violations"] for x in validate.check_rules(df, {"neg": ("error", F.col("v") < 0), "nul": ("info", F.col("k").isNull())}).collect()}
    assert r == {"neg": 1, "nul": 1}
    assert validate.repeated_keys(df, ["k"]).first()["n_repeated_keys"] == 1
    assert {x["g"]: x["mode"] for x in report.mode_of(df, ["g"], "k").collect()} == {"a": 1, "b": 1}
    assert validate.check_rules(df.limit(0), {"neg": ("error", F.col("v") < 0)}).first()["n_violations"] == 0


def test_holdout_and_scores(spark):
    e = spark.createDataFrame([(f"e{i}", "r" if i < 9 else "q") for i in range(10)], "id string, reg string")
    h = folds.stratified_holdout(e, "id", "reg").filter("held_out").groupBy("reg").count().collect()
    assert {r["reg"]: r["count"] for r in h} == {"r": 2, "q": 1}
    p = spark.createDataFrame([("F1", "m", 1.0, 0.5), ("F1", "m", 0.0, 0.5)], "fold string, model string, y_true double, y_pred double")
    s = folds.scores(p).first()
    assert s["rmse"] == 0.5 and s["mae"] == 0.5 and math.isclose(s["r2"], 0.0)


def test_written_steps_leave_no_shuffles(spark):
    from panelwright.session import _CLEANUP, materialize

    kept = lambda: spark._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker().shuffleStatuses().keySet().mkString(" ").split()
    df = spark.range(1000).selectExpr("id % 7 AS k", "id").groupBy("k").agg(F.sum("id").alias("s"))
    before, setting = set(kept()), spark.conf.get(_CLEANUP)
    out = materialize(df.join(df.hint("merge").withColumnRenamed("s", "t"), "k"), "kept")
    assert not set(kept()) - before and spark.conf.get(_CLEANUP) == setting
    assert out.count() == 7 and df.count() == 7
