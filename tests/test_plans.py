from pyspark.sql import functions as F

from panelwright.plans import side_tables as st
from panelwright.plans import sources


def master(spark):
    rows = [("0100000000", "Alfara", "Alfara", "0100000000", "province", 900), ("0101000000", "San Roco", "Alfara", "0100000000", "municipality", 100), ("0102000000", "Betel", "Alfara", "0100000000", "municipality", 300), ("0103000000", "City of Gola", "Alfara", "0100000000", "city", 500), ("0201000000", "San Roco", "Zeta", "0200000000", "municipality", 50)]
    return spark.createDataFrame(rows, "psgc10 string, name string, province_name string, province_code string, level string, pop_2024 long")


def sheet(spark):
    rows = [
        ("t1", 0, ["Population by Region and Province", None, None, None, None, None]), ("t1", 1, ["Name", "1990", "2000", "2010", "2020", "Land Area"]), ("t1", 2, ["Alfara 1,i", "400", "800", "1,200", "n/a", "55.5"]),
        ("t1", 3, ["City of Gola", "10", "20", "30", "40", None]), ("t1", 4, ["Note: x", "1", "1", "1", "1", None]), ("t1", 5, ["San Roco (Zeta)", "5", "5", "-", "7", "3"]), ("t1", 6, ["Nowhere", "1", "2", "3", "4", None]),
    ]
    return spark.createDataFrame(rows, "sheet string, row_idx int, cells array<string>")


def test_population_pipeline(spark):
    m, s = master(spark), sheet(spark)
    pop = st.population_tables(s)
    got = {(r["name"], r["year"]): r["population"] for r in pop.collect()}
    assert got["Alfara 1,i", 2010] == 1200.0 and ("Alfara 1,i", 2020) not in got and not any(n.startswith("Note") for n, _ in got)
    assert {r["sheet"]: r["level"] for r in st.table_levels(s).collect()} == {"t1": "province"}
    assert st.choose_tables(s).first()["sheet"] == "t1"
    coded = st.with_codes(pop, m)
    codes = {r["name"]: (r["psgc10"], r["pop_source"]) for r in coded.collect()}
    assert codes["Alfara 1,i"] == ("0100000000", "province") and codes["City of Gola"] == ("0103000000", "city_direct") and codes["San Roco (Zeta)"][0] == "0201000000" and "Nowhere" not in codes
    a = {(r["psgc10"], r["year"]): r["population"] for r in st.allocated(coded, m).collect()}
    assert a["0101000000", 1990] == 100.0 and a["0102000000", 1990] == 300.0
    y = {(r["psgc10"], r["year"]): (r["population"], r["pop_source"]) for r in st.annual_population(coded, m, 1990, 2020).collect()}
    assert len(y) == 5 * 31 and y["0103000000", 1990] == (10.0, "city_direct") and y["0101000000", 2020][0] == 300.0
    assert abs(y["0101000000", 1995][0] - (100 * 200) ** 0.5) < 1e-9 and y["0100000000", 2000] == (900.0, "master_2024")
    land = {r["psgc10"]: r["area"] for r in st.land_areas(coded, m).collect()}
    assert land["0101000000"] == 55.5 == land["0100000000"] and land["0201000000"] is None


def test_price_index(spark):
    wide = spark.createDataFrame([("..Region I (X)", "0 - ALL ITEMS", "50", None, "100", 1), ("Region I", "All Items", "60", None, "120", 2), ("Region I", "Food", "1", "1", "1", 2), ("Lost", "ALL ITEMS", "1", "1", "1", 1)], "Geolocation string, Item string, `2016 Ave` string, `2017 Ave` string, `2018 Ave` string, file_ord int")
    p = {r["fiscal_year"]: (r["region"], r["cpi"], r["deflator"]) for r in st.price_index(wide, "Geolocation", "Item", [("Region I", "Region I"), ("National Capital Region", "NCR")], 2015, 2019, 2018).collect()}
    assert p == {2015: ("Region I", 60.0, 0.5), 2016: ("Region I", 60.0, 0.5), 2017: ("Region I", 60.0, 0.5), 2018: ("Region I", 120.0, 1.0), 2019: ("Region I", 120.0, 1.0)}


def test_report_layout(spark):
    rows = [("s", 1, None, "Region I", None), ("s", 2, None, "Ilo", None), ("s", 3, "0128", "", "Ada"), ("s", 4, None, "Ilo (Continued)", None), ("s", 5, "0129", "", "Bo City"), ("s", 6, None, "Region II", None), ("s", 7, "0130", "", "Cee"), ("s", 8, None, "Metro Manila (NCR)", None), ("s", 9, None, "First District", None), ("s", 10, "0131", "", "Dee")]
    got = {r["code"]: (r["region"], r["province"], r["lgu_type"]) for r in st.tidy_report(spark.createDataFrame(rows, "sheet string, row_idx int, code string, heading string, name string")).collect()}
    assert got["0129"] == ("Region I", "Ilo", "city") and got["0130"] == ("Region II", None, "municipality") and got["0131"] == ("Metro Manila (NCR)", None, "municipality")


def test_harmonize_sheets(spark):
    rows = [("a", 1999, 0, ["Report", None, None]), ("a", 1999, 1, ["LGU", "Income", "Income"]), ("a", 1999, 2, ["Name", "Local", "Total"]), ("a", 1999, 3, ["Alfara", "1,000,000", "5,000,000"]), ("a", 1999, 4, ["Betel", "2,000,000", "4,000,000"]), ("a", 1999, 5, ["TOTAL", "3", "9"]), ("b", 2000, 0, ["LGU Name", "Total Income", "Total Income 2"]), ("b", 2000, 1, ["Alfara", "7.5", "9"])]
    df = spark.createDataFrame(rows, "sheet string, year int, row_idx int, cells array<string>")
    rules = spark.createDataFrame([("lgu", "lgu_name", 3), ("local", "local", 1), ("total", "total", 2)], "pattern string, target string, rank int")
    t = sources.harmonize_sheets(df, rules, ["lgu_name"], ["local", "total"], "total")
    got = {(r["sheet"], r["lgu_name"]): (r["local"], r["total"]) for r in t.collect()}
    assert got == {("a", "Alfara"): (1.0, 5.0), ("a", "Betel"): (2.0, 4.0), ("b", "Alfara"): (None, 7.5)}
    assert {r["sheet"]: r["n_rows"] for r in sources.harmonize_report(df, t, "total").collect()} == {"a": 2, "b": 1}


def test_second_source(spark):
    rec = spark.createDataFrame([(1, "Old Betel", "Alfara", "Mun."), (2, "Gola City - District II", "Alfara", "City"), (3, "GRAND TOTAL", "Alfara", "M"), (4, "San Roco", None, "M")], "id int, lgu_name string, province string, lgu_type string")
    al = spark.createDataFrame([("Alfara", "Old Betel", "Betel")], "prov string, alias string, name string")
    got = {r["id"]: (r["psgc10"], r["tier"]) for r in sources.second_source(rec, master(spark), al).collect()}
    assert got[1] == ("0102000000", 1) and got[2][0] == "0103000000" and got[3] == (None, -1) and got[4] == (None, 0)
    c = {r["code"]: r["tier"] for r in sources.coded_source(spark.createDataFrame([("101000000",), ("5",), (None,)], "code string"), master(spark), "code").collect()}
    assert c == {"101000000": 0, "5": -1, None: -1}
    assert sources.coded_source(rec.withColumn("code", F.lit("1")).limit(0), master(spark), "code").count() == 0
