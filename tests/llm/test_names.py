import difflib
import itertools
import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelwright.llm import match, names, variants

UNITS = [("10", "Deguñoro", "Alfara"), ("11", "City of Haredalbi", "Alfara"), ("12", "Santo Niñoro", "Alfara"), ("13", "Santo Niñoro", "Betuna"), ("14", "Mount Apulan City", "Betuna"), ("15", "Kesolura", "Betuna"), ("16", "Alfara", "Alfara"), ("17", "Banyiyepe", "Betuna"), ("18", "Vokalwegu", "Alfara"), ("19", "Ruzohuñi", "Betuna")]


def master(spark):
    lv = lambda n, p: "province" if n == p else "city" if "City" in n else "municipality"
    rows = [(c, n, p, f"Region {'I' if p == 'Alfara' else 'II'} (X)", lv(n, p), "Zirinsuge" if c == "17" else None) for c, n, p in UNITS]
    return spark.createDataFrame(rows, "psgc10 string, name string, province_name string, region_name string, level string, old_names string")


TYPED = [
    (1, "DEGUÑORO **", "Alfara", "Region I", "M", "10"), (2, "Deguñroo", "ALFARA", "R01", "Mun.", "10"), (3, "Haredalbi City", "Alfara", None, "C", "11"), (4, "Niñoro, Santo (Mun.)", "Betuna", "Region 2", "M", "13"),
    (5, "Sto Ninoro", "Alfara (Continued)", "Region I", "M", "12"), (6, "C. of Mt. Apulan", "Betuna", "Region II", "City", "14"), (7, "Keso- lura", "Betuna", "Region II", "M", "15"), (8, "PGO Alfara", "Alfara", "Region I", "Province", "16"),
    (9, "Bayan ng Zirinsuge", "Betuna", "Region II", "M", "17"), (10, "GRAND TOTAL", "Betuna", "Region II", "M", None), (11, "Wimokata", "Betuna", "Region II", "M", None), (12, "WIMOKATTA", "Betuna", "Region II", "M", None),
    (13, None, None, None, None, None), (14, "", "Alfara", "Region I", "M", None), (15, "V0kalwegu", None, "Region I", None, "18"), (16, "Ruzohunyi", "Betuna", "Region II", "M", "19"), (17, "DEGUÑORO **", "Alfara", "Region I", "M", "10"),
]


def records(spark):
    rows = [("sre", str(i), n, p, r, t) for i, n, p, r, t, _ in TYPED]
    return match.normalized(spark.createDataFrame(rows, "src string, rec_id string, name string, province string, region string, type string"))


@pytest.mark.parametrize(("typed", "compact", "level"), [("MATALIS, GENERAL, MUNICIPALITY OF", "generalmatalis", "municipality"), ("C. of Mount Lindero", "mountlindero", "city"), ("Puke- wova (Mun.)", "pukewova", "municipality"), ("Robisane dl Nte.", "robisanedelnorte", ""), ("(Continued)", "", ""), (None, "", ""), ("PROVINCIAL TOTAL", "", ""), ("Rekalbuta (Dist. II", "rekalbuta", "")])
def test_parse(typed, compact, level):
    got = names.parse(typed)
    assert got[0] == compact and got[3] == level


def test_regions_and_skeletons():
    assert [names.region_key(x) for x in ("Region IV (X)", "R07", "Reg. XIX - Y", "Vunepena Coast", None, "nan")] == ["4", "7", "19", "vunepenacoast", "", ""]
    assert names.skeleton("banyiyepe") == names.skeleton("baniiyepe") and names.consonants("koesluro") == names.consonants("koseluro")


def test_sql_parts_equal_python_parts(spark):
    xs = [n for n in {names.parse(r[1])[0] for r in TYPED} | {names.parse(u[1])[0] for u in UNITS} if n]
    df = names.with_parts(spark.createDataFrame([(x,) for x in xs], "x string"), "x")
    for r in df.collect():
        assert (r["x_ti"], r["x_co"], r["x_sk"], r["x_cc"]) == names.parts(r["x"])


def test_match(spark):
    m = master(spark)
    got = {int(r["rec_id"]): r for r in match.match_records(records(spark), match.master_units(m), m).collect()}
    want = {i: c for i, *_, c in TYPED if c}
    right = sum(got.get(i) is not None and got[i]["psgc10"] == c for i, c in want.items())
    assert right >= len(want) - 1 and not set(got) - set(want) and all(0.5 <= r["confidence"] <= 1 for r in got.values())


def test_variants(spark):
    m = master(spark)
    linked = variants.link(records(spark), match.master_units(m), m)
    ent = {int(r["rec_id"]): r["entity"] for r in linked.collect()}
    assert {i: e for i, e in ent.items() if e.isdigit()} == {i: c for i, *_, c in TYPED if c}
    assert ent[11] == ent[12] and not {10, 13, 14} & set(ent)
    pairs = {(r["label_a"], r["label_b"]) for r in variants.variant_pairs(linked).collect()}
    assert pairs == {(1, 2), (1, 17), (2, 17), (11, 12)}
    c = {int(r["rec_id"]): r["n_links"] for r in variants.classes(linked).collect()}
    assert c[1] == 2 and c[3] == 0


def test_empty_inputs(spark):
    m, r = master(spark), records(spark)
    u = match.master_units(m)
    assert match.match_records(r.limit(0), u, m).count() == 0
    lone = variants.link(r, u.limit(0), m.limit(0))
    ent = {int(x["rec_id"]): x["entity"] for x in lone.collect()}
    assert ent[1] == ent[2] == ent[17] and ent[11] == ent[12]


def test_similarity_join_finds_what_brute_force_finds(spark):
    rnd = random.Random(4)
    base = ["".join(rnd.choice("bdgklmnprstvz") + rnd.choice("aeiou") for _ in range(4)) for _ in range(60)]
    typed = [match.misspell(b, rnd) for b in base for _ in range(2)]
    left = spark.createDataFrame([("x" if i % 3 else "y", t) for i, t in enumerate(typed)], "block string, text string").distinct()
    right = spark.createDataFrame([(b, t) for t in base for b in "xy"], "block string, text string")
    stats = variants.corpus_statistics(left.select("text").unionByName(right.select("text")))
    got = {(r["block"], r["q"], r["m"]) for r in variants.similar_pairs(left, right, stats, 0.3, 0.0).collect()}
    want = set()
    for r in left.collect():
        a = set(names.grams(r["text"], variants.SPACE))
        for t in base:
            b = set(names.grams(t, variants.SPACE))
            if len(a & b) / len(a | b) >= 0.3:
                want.add((r["block"], r["text"], t))
    assert got == want and len(want) >= 100
    assert stats[0].sum() > 0 and stats[2] > 0


def test_blocking_recall_against_brute_force(spark):
    rnd = random.Random(9)
    base = sorted({"".join(rnd.choice("bdgklmnprstvz") + rnd.choice("aeiou") for _ in range(4)) for _ in range(300)})
    units = spark.createDataFrame([("m", str(i), b, "", b, "", "", "municipality", "prov", "", "1") for i, b in enumerate(base)], "src string, rec_id string, nm string, ti string, co string, sk string, lvn string, lvt string, pv string, pnote string, rk string")
    typed = [(match.misspell(b, rnd), b) for b in base]
    recs = spark.createDataFrame([("sre", str(i), t, "", t, "", "", "municipality", "prov", "", "1") for i, (t, _) in enumerate(typed)], units.schema)
    m = spark.createDataFrame([("1", "Region I (X)")], "psgc10 string, region_name string")
    got = {(r["q"], r["m"]) for r in match.value_matches(recs, units, match.region_names(m), match.province_aliases(units)).filter(F.col("kind") == "n").collect()}
    easy = [(t, b) for t, b in typed if difflib.SequenceMatcher(None, t, b).ratio() >= 0.8]
    assert sum(x in got for x in easy) >= 0.9 * len(easy)


def label(i, name, province="Alfara", region="Region I", kind="M"):
    return ("sre", str(i), name, province, region, kind)


def normalized(spark, rows):
    return match.normalized(spark.createDataFrame(rows, "src string, rec_id string, name string, province string, region string, type string"))


def test_rare_words_count_more():
    of = {"occidental": 150, "san": 100}
    weight = lambda w: math.log(1 + 2000 / of.get(w, 1))
    flat = lambda w: 1.0
    apart = ("mula occidental", "pala occidental")
    assert variants.soft_similarity(*apart, weight) < variants.LEAST_ALONE < variants.soft_similarity(*apart, flat)
    assert variants.soft_similarity("gatp uyobi", "gatpuyobi", weight) == variants.soft_similarity("verdeluna", "verdeluna", weight) == 1.0
    assert variants.soft_similarity("mula occidental", "mulaoccidentl", weight) > 0.9
    assert variants.soft_similarity("", "x", weight) == 0.0 and variants.soft_similarity("", "", weight) == 1.0


def test_slips_lie_on_the_letters_they_concern():
    rnd = random.Random(2)
    for _ in range(300):
        a, b = ("".join(rnd.choice("abdehiou") for _ in range(rnd.randrange(7))) for _ in "ab")
        on_a, on_b = variants.slips(a, b)
        assert len(on_a) == len(a) and len(on_b) == len(b)
        if a and b:
            assert sum(on_a) == pytest.approx(sum(on_b)) and (sum(on_a) == 0) == (a == b)


def test_a_chain_of_many_spellings_has_one_root(spark):
    # each spelling is like the next only, and used more often
    word = "badakafalagamanapara"
    rows, used = [], 0
    for i in range(20):
        name = "".join("o" if c == "a" and k < 2 * i else c for k, c in enumerate(word))
        rows += [label(used + k, name) for k in range(i + 1)]
        used += i + 1
    m = master(spark)
    ent = {r["entity"] for r in variants.link(normalized(spark, rows), match.master_units(m), m).collect()}
    assert len(ent) <= 2


def test_a_name_of_many_units_in_a_region_is_still_matched(spark):
    units = [(f"2{i}", "Vilaromo", f"Prov{x}", "Region I (X)", "municipality", None) for i, x in enumerate("abcdef")]
    units += [("30", "Vilaromo", "Zeta", "Region II (Y)", "municipality", None), ("31", "Vilaromo", "Provg", "Region I (X)", "city", None)]
    m = spark.createDataFrame(units, "psgc10 string, name string, province_name string, region_name string, level string, old_names string")
    rows = [label(1, "Vilaromo", None, "Region II"), label(2, "City of Vilaromo", None, "Region I", "City"), label(3, "Vilaromo", None, "Region I"), label(4, "Vilaromo", "Provc", "Region I")]
    got = {int(r["rec_id"]): r["psgc10"] for r in match.match_records(normalized(spark, rows), match.master_units(m), m).collect()}
    assert got == {1: "30", 2: "31", 4: "22"}  # 3 fits six units equally well
    ent = {int(r["rec_id"]): r["entity"] for r in variants.link(normalized(spark, rows), match.master_units(m), m).collect()}
    assert (ent[1], ent[2], ent[4]) == ("30", "31", "22") and not ent[3].isdigit()


def test_labels_without_region_meet_those_of_any(spark):
    rows = [label(1, "Wimokata", "", None), label(2, "Wimokatta", "Betuna", "Region II"), label(3, "Wimokatta", "Betuna", "Region II")]
    m = master(spark)
    ent = {int(r["rec_id"]): r["entity"] for r in variants.link(normalized(spark, rows), match.master_units(m), m).collect()}
    assert len(set(ent.values())) == 1


def test_matches_do_not_depend_on_run_or_partitions(spark):
    m, rows = master(spark), records(spark)
    once = []
    for n in ("4", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        got = match.match_records(rows.repartition(int(n)), match.master_units(m), m)
        once.append(sorted((r["src"], r["rec_id"], r["psgc10"], round(r["confidence"], 4)) for r in got.collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert once[0] == once[1]


def test_trained_vectors_tell_misspelt_names_better_than_random_ones(spark):
    rnd = random.Random(5)
    base = sorted({"".join(rnd.choice("bdgklmnprstvz") + rnd.choice("aeiou") for _ in range(4)) for _ in range(250)})
    typed = [match.misspell(b, rnd) for b in base for _ in range(3)]
    df = spark.createDataFrame([("n", t) for t in {*base, *typed}], "kind string, text string")
    vals = match.token_values(df)
    recs = spark.createDataFrame([(t, "", "") for t in {*base, *typed}], "nm string, pv string, rk string")
    trained = match.train(match.walks(recs, vals))
    met = np.abs(trained).sum(1) > 0
    count = np.zeros(match.TOKENS)
    for t in {*base, *typed}:
        count[names.grams(t, match.TOKENS)] += 1
    idf = np.log(1 + len(base) / np.maximum(count, 1)).astype(np.float32)
    probe = [match.misspell(b, rnd) for b in base]

    def first(model):
        c = match.embed([names.grams(t, match.TOKENS) for t in probe], model, idf) @ match.embed([names.grams(b, match.TOKENS) for b in base], model, idf).T
        return float((c.argmax(1) == np.arange(len(base))).mean())

    random_ones = match.node_vectors(np.zeros_like(trained))
    assert met.mean() > 0.02 and first(match.node_vectors(trained)) > first(random_ones)


def test_skip_grams_are_those_of_a_plain_count(spark):
    rows = [([1, 2, 3, 2],), ([5],), ([],), ([3, 1],)]
    got = {(r["node"], k): n for r in match.skip_grams(spark.createDataFrame(rows * 3, "nodes array<int>").repartition(5)).collect() for k, n in zip(r["near"], r["n"], strict=True)}
    want = {}
    for (x,) in rows:
        for i, j in itertools.permutations(range(len(x)), 2):
            if abs(i - j) <= match.WINDOW and x[i] != x[j]:
                want[x[i], x[j]] = want.get((x[i], x[j]), 0) + 3
    assert got == want


def test_hot_buckets_give_each_pair_once(spark):
    rows = [("n", f"x{i}", int(i % 2 == 0), int(i % 2 == 1)) for i in range(60)]
    bits = {"n": 2}
    v = spark.createDataFrame([(k, t, i, q, m, names.grams("banaka", match.TOKENS)) for i, (k, t, q, m) in enumerate(rows)], "kind string, text string, vid long, is_q int, is_m int, g array<int>")
    shared = spark.sparkContext.broadcast((match.node_vectors(np.zeros((match.TOKENS, match.DIM), np.float32)), np.ones(match.TOKENS, np.float32)))
    got = [(r["qid"], r["mid"]) for r in match.candidates(match.hashed(v, shared, bits), match.signature_type(bits), block=7).collect()]
    assert len(got) == len(set(got)) == 900


def test_bounds_of_pairs_never_fall_short():
    rnd = random.Random(3)
    base = ["".join(rnd.choice("bdghklmnjvfpcqz") + rnd.choice("aeiouyw") for _ in range(rnd.randrange(1, 6))) for _ in range(120)]
    typed = [match.misspell(match.misspell(b, rnd), rnd) for b in base] + ["sanyi", "oriental9", base[0] + "norte"]
    i, j = (x.ravel() for x in np.meshgrid(range(len(typed)), range(len(base)), indexing="ij"))
    most = variants.ceilings(variants.coded(typed), variants.coded(base), i, j)
    assert all(m >= variants.soft_similarity(typed[a], base[b], len) for m, a, b in zip(most, i, j, strict=True)) and (most < 0.5).mean() > 0.5
    column, sets = variants.columns(np.zeros(variants.BUCKETS)), lambda t: set(variants.grams(t))
    may = (variants.counted(typed, column, 0.28, False) @ variants.counted(base, column, 0.28, True).T).ravel() >= -0.01
    share = np.array([len(sets(typed[a]) & sets(base[b])) / len(sets(typed[a]) | sets(base[b])) for a, b in zip(i, j, strict=True)])
    assert may[share >= 0.28].all() and (share >= 0.28).sum() >= 100 and may.mean() < 0.2


def test_a_block_of_one_ending_is_searched_whole_in_little_time(spark, monkeypatch):
    monkeypatch.setattr(variants, "KNOWN", 400)
    monkeypatch.setattr(variants, "TYPED", 150)
    rnd = random.Random(8)
    base = sorted({"".join(rnd.choice("bdgklmnprstvz") + rnd.choice("aeiou") for _ in range(4)) + "oriental" for _ in range(1200)})
    typed = sorted({match.misspell(b, rnd) for b in base[::2]})
    left, right = (spark.createDataFrame([("p", t) for t in x], "block string, text string") for x in (typed, base))
    stats = variants.corpus_statistics(left.select("text").unionByName(right.select("text")))
    began = time.time()
    got = [(r["q"], r["m"], r["sim"]) for r in variants.similar_pairs(left, right, stats, 0.25, 0.5, 0.0).collect()]
    assert time.time() - began < 60 and len(got) == len({x[:2] for x in got})
    weight = lambda w: 1.0
    best = {}
    for q, m, s in got:
        assert s == pytest.approx(variants.soft_similarity(q, m, weight), abs=0.08)
        best[q] = max(best.get(q, 0), s)
    assert set(best) == set(typed)
    for q in typed[::150]:
        assert best[q] >= max(variants.soft_similarity(q, m, weight) for m in base) - 0.03
