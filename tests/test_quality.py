import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from panelwright.quality import impute, orphans, profiling, schema_drift, units


def ts(y, m=1, d=1):
    return dt.datetime(y, m, d)


# --- orphans
def brute_orphans(refs, parents):
    out = set()
    for rid, key, at in refs:
        if key is None:
            continue
        k = key.strip(" '\xa0").removesuffix(".0")
        live = any(k.isdigit() and p is not None and int(p) == int(k) and a <= at and (r is None or r > at) for p, a, r in parents)
        if not live:
            out.add(rid)
    return out


def test_orphans_match_brute_force_with_skew(spark):
    rnd = random.Random(1)
    parents = [(f"{k:010d}", ts(2018 + k % 5), None if k % 3 else ts(2024, 1 + k % 12)) for k in range(100000, 100900, 1) if k % 7]
    parents += [("0000100001", ts(2025), None)]  # the key came back later
    refs = []
    for i in range(3000):
        k = 100000 + rnd.randrange(950) if i % 3 else 100123  # one key holds a third
        s = rnd.choice([f"{k:010d}", str(k), f"{k}.0", f"'{k:010d}", f" {k:010d}\xa0"])
        refs.append((i, s, ts(2017 + rnd.randrange(9), 1 + rnd.randrange(12))))
    refs += [(5000, None, ts(2020)), (5001, "abc", ts(2020)), (5002, "", ts(2020)), (5003, "9" * 17, ts(2020))]
    p = spark.createDataFrame(parents, "code string, added_at timestamp, removed_at timestamp")
    r = spark.createDataFrame(refs, "id long, code string, at timestamp").withColumn("k", F.lit("clash")).withColumn("t", F.lit(1))
    got = orphans.find_orphans(r, "code", "at", p, "code", "added_at", "removed_at", ["id", "k", "t"])
    rows = got.collect()
    split = orphans.find_orphans(r, "code", "at", p, "code", "added_at", "removed_at", ["id", "k", "t"], limit=100).collect()
    assert sorted(map(tuple, split)) == sorted(map(tuple, rows))
    assert {x["id"] for x in rows} == brute_orphans(refs, parents)
    assert len(rows) == len({x["id"] for x in rows})
    reasons = {x["id"]: x["reason"] for x in rows}
    assert reasons[5001] == "malformed" and reasons[5003] == "missing"


def test_orphans_of_empty_tables(spark):
    p = spark.createDataFrame([], "code string, added_at timestamp, removed_at timestamp")
    r = spark.createDataFrame([(1, "5", ts(2020))], "id long, code string, at timestamp")
    assert [x["reason"] for x in orphans.find_orphans(r, "code", "at", p, "code", "added_at", "removed_at", ["id"]).collect()] == ["missing"]
    assert orphans.find_orphans(r.limit(0), "code", "at", p, "code", "added_at", "removed_at", ["id"]).count() == 0
    assert orphans.stride_of(p, "code") == 1


def test_runs_are_contiguous_and_cut_at_buckets(spark):
    k = spark.createDataFrame([(i,) for i in [1, 2, 3, 7, 8, 4095, 4096, 4097]], "k long")
    got = sorted((r["k"], r["k_end"]) for r in orphans.key_runs(k).collect())
    assert got == [(1, 3), (7, 8), (4095, 4095), (4096, 4097)]


# --- profiles
@pytest.mark.parametrize("q", [0.0, 0.25, 0.5, 0.9, 1.0])
def test_exact_quantiles(spark, q):
    import numpy as np

    rnd = random.Random(2)
    data = [("a", rnd.gauss(0, 100)) for _ in range(501)] + [("b", float(x)) for x in [0, 0, 0, -5, 1e9, 1e-9, 7]] + [("c", 3.5)] * 40 + [(None, 2.0), (None, 8.0)]
    df = spark.createDataFrame(data, "g string, v double").groupBy("g", "v").count()
    got = {r["g"]: r["quantile"] for r in profiling.exact_quantiles(df, ["g"], "v", "count", q).collect()}
    for g in ("a", "b", "c", None):
        assert got[g] == pytest.approx(float(np.quantile([v for k, v in data if k == g], q)), rel=1e-9, abs=1e-9)


def test_midpoints_are_those_of_sql(spark):
    import duckdb

    pairs = {"a": (4.954, 144.949), "b": (6.516, 178.872), "c": (0.939, 102.835), "d": (7.623, 100.211), "e": (5e-324, 5e-324)}
    df = spark.createDataFrame([(g, x) for g, xy in pairs.items() for x in xy], "g string, v double")
    got = {r["g"]: r["quantile"] for r in profiling.exact_quantiles(df.groupBy("g", "v").count(), ["g"], "v", "count").collect()}
    assert got.pop("e") == 5e-324
    assert got == {g: duckdb.execute("SELECT median(x) FROM (VALUES (?::DOUBLE), (?::DOUBLE)) t(x)", pairs[g]).fetchone()[0] for g in got}
    holes = df.filter("g <> 'e'").unionByName(spark.createDataFrame([(g, None) for g in got], "g string, v double"))
    filled = impute.fill_by_group(holes, {"v": F.col("v").isNull()}, [["g"], []], min_support=2).filter("v_filled")
    assert {r["g"]: r["v"] for r in filled.collect()} == got


def test_profile_breaks(spark):
    rows = [("s", 1, 1.0, "1st")] * 10 + [("s", 2, None, "First")] * 3 + [("s", 2, 1.0, "1st")] * 7 + [("s", 4, 4.0, "1st")] * 8 + [("s", 4, float("nan"), None)] * 2
    df = spark.createDataFrame(rows, "ser string, load long, x double, c string").withColumn("column_name", F.lit("clash"))
    c = profiling.value_counts(df, ["ser", "load"], ["x", "c"])
    p = profiling.profile(c, ["ser", "load"], {"c": "1st|2nd"})
    b = profiling.breaks(p, "ser", "load", ["x", "c"], ["x"], ["c"])
    assert {(r["column_name"], r["load"], r["issue"]) for r in b.collect()} == {("x", 2, "null_rate"), ("c", 2, "form"), ("x", 4, "centre"), ("c", 4, "null_rate"), ("c", 4, "form")}
    one = {r["load"]: r for r in p.filter("column_name = 'x'").collect()}
    assert one[4]["n_missing"] == 2 and one[4]["median_value"] == 4.0 and one[2]["n_distinct"] == 1
    s = profiling.stability(c, "ser", "load").collect()
    assert all(r["psi"] >= 0 and r["chi_square"] >= 0 for r in s) and len(s) == 4
    assert profiling.profile(profiling.value_counts(df.limit(0), ["ser", "load"], ["x"]), ["ser", "load"]).count() == 0


# --- fills
def test_fill_backs_off_and_flags(spark):
    rows = [(i, "a" if i < 6 else "b", "t", float(i % 6)) for i in range(12)] + [(100, "a", "t", None), (101, "zz", "t", -999.0), (102, None, "u", 9999999.0), (103, "b", "t", float("nan"))]
    df = spark.createDataFrame(rows, "id long, g string, k string, v double").withColumn("num", F.lit("clash")).withColumn("c", F.when(F.col("id") < 100, F.col("k")))
    out = impute.fill_by_group(df, {"v": impute.no_value(F.col("v"), True), "c": F.col("c").isNull()}, [["g"], ["k"], []], categorical=("c",), min_support=4)
    got = {r["id"]: r for r in out.collect()}
    assert len(got) == 16 and got[0]["v"] == 0.0 and not got[0]["v_filled"] and got[0]["v_level"] == 0
    assert got[100]["v"] == 2.5 and got[100]["v_level"] == 1 and got[100]["c"] == "t"
    assert got[101]["v"] == 2.5 and got[101]["v_level"] == 2 and got[101]["v_filled"]
    assert got[102]["v_level"] == 3 and got[103]["v_level"] == 1 and got[103]["num"] == "clash"
    cells = impute.filled_cells(out, "id", ["v", "c"])
    assert cells.filter("field_name = 'v'").count() == 4
    empty = impute.fill_by_group(df.limit(0), {"v": F.col("v").isNull()}, [["g"], []])
    assert empty.count() == 0
    none = impute.fill_by_group(df.withColumn("v", F.lit(None).cast("double")), {"v": F.col("v").isNull()}, [["g"], []])
    assert none.filter("v is null and v_filled and v_level is null").count() == 16


def test_no_value(spark):
    xs = [(0, 1.0), (1, 0.0), (2, -1.0), (3, None), (4, float("nan")), (5, 99999999.0), (6, 999.0), (7, 9999999.99)]
    df = spark.createDataFrame(xs, "i int, v double")
    assert {r["i"] for r in df.filter(impute.no_value(F.col("v"), False)).collect()} == {1, 2, 3, 4, 5, 7}
    assert {r["i"] for r in df.filter(impute.no_value(F.col("v"), True)).collect()} == {2, 3, 4, 5, 7}


# --- units
def test_units_of_devices(spark):
    rnd = random.Random(3)
    rows, truth, i = [], {}, 0
    for dev in range(60):
        level = rnd.uniform(20, 400)
        for t in range(1992, 2022):
            e = 0
            if dev == 7:
                e = 6  # always in another unit
            elif dev == 8 and t >= 2010:
                e = 3
            elif rnd.random() < 0.03:
                e = rnd.choice([-3, 3, 6])
            v = level * 1.06 ** (t - 1992) * rnd.uniform(0.9, 1.1)
            rows.append((i, f"d{dev}", t, v * 10.0**e, level * 500, "m", dev % 5 * 100 + t % 100, None))
            truth[i] = e
            i += 1
    rows += [(9001, None, 2000, 50.0e6, 5.0e4, "m", None, 6), (9002, "d1", None, 40.0, 3.0e4, "m", None, None), (9003, "d1", 2001, None, 1.0, "m", 1, None), (9004, "d1", 2001, 0.0, 1.0, "m", 1, None), (9005, "d1", 2001, float("nan"), 1.0, "m", 1, None)]
    df = spark.createDataFrame(rows, "id long, device string, time int, value double, size double, kind string, source long, said int")
    got = {r["id"]: r["exponent"] for r in units.decode_units(df).collect()}
    wrong = [k for k, e in truth.items() if got[k] != e]
    assert len(wrong) <= 3 and got[9001] == 6 and got[9002] == 0 and not {9003, 9004, 9005} & set(got)
    assert units.decode_units(df.limit(0)).count() == 0


def test_viterbi_equals_brute_force():
    import itertools

    import numpy as np

    rnd = random.Random(5)
    s = units.STATES
    for _ in range(20):
        lv = [rnd.uniform(0, 6) for _ in range(4)]
        em = [rnd.uniform(0, 5) for _ in range(4 * len(s))]
        cost = {}
        for p in itertools.product(range(len(s)), repeat=4):
            c = sum(em[t * len(s) + k] for t, k in enumerate(p))
            for t in range(1, 4):
                j = (lv[t] - lv[t - 1]) - (s[p[t]] - s[p[t - 1]])
                c += min((j / units.JUMP_SD) ** 2 / 2, units.JUMP_CAP) + units.SWITCH * (p[t] != p[t - 1])
            cost[p] = c
        got = tuple(units._viterbi([lv], [em], s)[0])
        assert cost[got] == pytest.approx(min(cost.values()))
    assert units._viterbi([], [], s) == [] and np.isfinite(1.0)


def odd_device(spark, states):
    """40 devices alike; 'odd' lies between two units by its level, and once in a file in which all others have the wrong one."""
    rnd, rows = random.Random(3), []
    for t in range(2000, 2010):
        for d in range(40):
            v = 100 * rnd.uniform(0.8, 1.25) * 1.05 ** (t - 2000)
            rows.append((len(rows), f"d{d}", t, v * (10.0 ** states[1] if t == 2005 else 1), 1e4, "m", t, states[1] if t == 2005 else None))
        far = 10.0 ** (0.53 * states[1])
        rows.append((len(rows), "odd", t, 100 * far * 1.05 ** (t - 2000), 1e4, "m", t, states[1] if t == 2005 else None))
    return spark.createDataFrame(rows, "id long, device string, time int, value double, size double, kind string, source long, said int")


@pytest.mark.parametrize("states", [(0, 3), (0, 2), (0, 3, 6)])
def test_paths_decide_where_files_and_remarks_mislead(spark, states):
    df = odd_device(spark, states)
    odd = {r["id"]: r["time"] for r in df.filter("device = 'odd'").collect()}
    true = {r["id"]: states[1] if r["time"] == 2005 and r["device"] != "odd" else 0 for r in df.collect()}
    path = {r["id"]: r["exponent"] for r in units.decode_units(df, states).collect()}
    alone = {r["id"]: r["exponent"] for r in units.decode_units(df.withColumn("device", F.lit(None).cast("string")), states).collect()}
    assert path == true
    assert {odd[i] for i, e in alone.items() if e != true[i]} == {2005}  # by its emission costs alone the odd one is taken for the others' unit


def test_stated_exponent(spark):
    xs = ["already millions", "pesos→millions", "Amounts in 000s", "P'000, not converted", "Php, as filed", "none", None, "in PHP M", "source in pesos; divided by 1,000,000"]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in xs], "s string").select(units.stated_exponent(F.col("s"))).collect()]
    assert got == [0, 0, 3, 3, 6, None, None, 0, 0]


# --- drift
def drift_fixture(spark):
    h = [
        (1, 1, ["Region", "Province", "Real Property Tax | Total", "IRA", "Remarks"], ["string", "string", "double", "double", "string"]),
        (2, 1, ["REGION", "Province", "Property Tax (Real), Total", "IRA", "Junk 3"], ["string", "string", "double", "bigint", "string"]),
        (3, 1, ["Region", "Province", "Allotment of taxes", None], ["string", "string", "double", "string"]),
        (4, 2, [], []),
    ]
    r = [(1, 2000), (2, 2001), (3, 2002), (4, 2000)]
    c = [("region", "Region"), ("province", "Province"), ("rpt", "Real Property Tax | Total"), ("rpt", "Property Tax (Real), Total"), ("nta_ira", "IRA"), ("nta_ira", "National Tax Allotment")]
    return (
        spark.createDataFrame(h, "file_id long, stream_id long, header_labels array<string>, column_types array<string>"),
        spark.createDataFrame(r, "file_id long, fiscal_year int"),
        spark.createDataFrame(c, "column_name string, known_label string"),
    )


def test_schema_changes(spark):
    m = schema_drift.correspondences(*drift_fixture(spark))
    got = {(r["file_id"], r["column_name"], r["change_kind"]) for r in schema_drift.changes(m).collect()}
    assert {(2, "rpt", "renamed"), (2, "nta_ira", "retyped"), (3, "rpt", "removed")} <= got
    assert not any(f == 2 and k in ("added", "removed") for f, _, k in got)
    rows = spark.createDataFrame([(1, 5, ["R1", "P", "1,234.5", "(7)", "x"]), (3, 1, ["R", None, "2"]), (9, 1, ["?"])], "file_id long, row_idx int, cells array<string>")
    t = {r["file_id"]: r for r in schema_drift.canonical_rows(rows, m, ["region", "rpt", "nta_ira"]).collect()}
    assert t[1]["rpt"] == 1234.5 and t[1]["nta_ira"] == -7.0 and t[9]["region"] is None


def test_schema_drift_of_empty_table(spark):
    h, r, c = drift_fixture(spark)
    assert schema_drift.correspondences(h.limit(0), r, c).count() == 0


def test_flooding_settles_or_says_so(spark):
    h, r, c = drift_fixture(spark)
    cols = schema_drift.file_columns(h, r)
    loose = {(x["key"], x["column_name"]): x["s"] for x in schema_drift.flood(cols, c, settled=0.02).collect()}
    tight = {(x["key"], x["column_name"]): x["s"] for x in schema_drift.flood(cols, c, settled=0.0005).collect()}
    # a contraction by 0.9 leaves at most settled * 0.9 / 0.1 to the fixed point
    assert all(abs(loose.get(k, 0.0) - s) <= 0.2 for k, s in tight.items())
    with pytest.raises(ValueError):
        schema_drift.flood(cols, c, flow=0.6, rival=0.7)


def test_columns_are_chosen_until_none_is_left(spark):
    # each label's best column is the next one's, so mutual best pairs appear one after the other
    labels = [f"Total Item {i}" for i in range(9)]
    h = spark.createDataFrame([(1, 1, labels, ["double"] * 9)], "file_id long, stream_id long, header_labels array<string>, column_types array<string>")
    r = spark.createDataFrame([(1, 2000)], "file_id long, fiscal_year int")
    c = spark.createDataFrame([(f"c{i}", f"Total Item {i}") for i in range(9)], "column_name string, known_label string")
    got = {(x["pos"], x["column_name"]) for x in schema_drift.correspondences(h, r, c).collect()}
    assert got == {(i, f"c{i}") for i in range(9)}
