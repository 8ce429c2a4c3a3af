"""Free-text names resolved to a master by a ranked cascade of exact and fuzzy tiers.

Every tier is a join of the records that no earlier tier resolved; the order
that a loop over candidates would have is kept in rank columns. Distinct
tuples are resolved once and joined back. Similarity is the ratio of matching
blocks (Ratcliff and Obershelp), computed in Arrow batches on blocked pairs.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import bracketed, level_key, match_key, plain_key, without_brackets
from ..session import materialize
from .joins import null_safe_join

#: Least scores and margins of the fuzzy tiers (fixed values): within province and level, within province, within level, anywhere.
FUZZY = {"3": (0.85, None), "3b": (0.85, 0.05), "4": (0.94, 0.03), "5": (0.92, 0.05)}


@F.pandas_udf(T.DoubleType())
def block_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Share of letters in matching blocks; the order of the arguments matters."""
    m = SequenceMatcher(None, autojunk=True)
    out = []
    last = None
    for x, y in zip(a, b, strict=True):
        if y != last:
            m.set_seq2(y or "")
            last = y
        m.set_seq1(x or "")
        out.append(m.ratio())
    return pd.Series(out)


def ratio_from(least: float):  # noqa: ANN201
    """``block_ratio`` that returns 0 below ``least``; its cheap upper bounds spare most pairs the full comparison."""

    @F.pandas_udf(T.DoubleType())
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        made: dict[str, SequenceMatcher] = {}
        seen: dict[tuple[str, str], float] = {}
        out = []
        for x, y in zip(a, b, strict=True):
            r = seen.get((x, y))
            if r is None:
                m = made.get(y)
                if m is None:
                    m = made[y] = SequenceMatcher(None, "", y)
                m.set_seq1(x)
                r = seen[x, y] = m.ratio() if m.real_quick_ratio() >= least and m.quick_ratio() >= least else 0.0
            out.append(r)
        return pd.Series(out, dtype=float)

    return run


def alias_closure(edges: DataFrame, depth: int = 3) -> DataFrame:
    """All aliases within ``depth`` steps of each key, with the fewest steps: ``(key, alias, depth)``; every key reaches itself.

    Paths are extended by one join a step and kept at their least depth, so the
    plan has a fixed number of joins; no recursion on the driver.
    """
    e = edges.select("key", "alias").filter("key is not null and alias is not null").distinct()
    nodes = e.select("key").unionByName(e.select(F.col("alias").alias("key"))).distinct()
    reach = nodes.select("key", F.col("key").alias("alias"), F.lit(0).alias("depth"))
    front = reach
    for d in range(1, depth + 1):
        step = e.select(F.col("key").alias("alias"), F.col("alias").alias("nxt"))
        front = front.join(step, "alias").select("key", F.col("nxt").alias("alias"), F.lit(d).alias("depth")).distinct()
        reach = reach.unionByName(front)
    return reach.groupBy("key", "alias").agg(F.min("depth").alias("depth"))


def candidate_keys(name: Column) -> Column:
    """Keys of a name in order: brackets inlined, brackets dropped, the bracket alone; without repeats and blanks."""
    keys = F.array(match_key(F.regexp_replace(name, r"[()]", " ")), match_key(without_brackets(name)), match_key(bracketed(name)))
    return F.filter(F.array_distinct(keys), lambda k: k != "")


def candidate_provinces(name: Column, province: Column) -> Column:
    """Keys of the provinces a record may mean, in order: as typed, what the name holds in brackets, what the province does.

    A record that tells none has the blank key alone, which blank provinces of the master match.
    """
    typed = plain_key(without_brackets(province))
    more = F.filter(F.array(plain_key(bracketed(name)), plain_key(bracketed(province))), lambda k: k != "")
    return F.array_distinct(F.concat(F.array(typed), more))


def catalog(master: DataFrame) -> DataFrame:
    """``(psgc10, key, prov, level)`` of each unit; a province without a province's name lies in itself."""
    prov = F.when((F.col("level") == "province") & (F.coalesce(F.trim("province_name"), F.lit("")) == ""), F.col("name")).otherwise(F.col("province_name"))
    return master.select("psgc10", match_key(F.col("name")).alias("key"), plain_key(prov).alias("prov"), "level")


def prepare(records: DataFrame, name: str, province: str, level: str, province_aliases: DataFrame | None = None, name_aliases: DataFrame | None = None) -> DataFrame:
    """Distinct typed tuples with their candidates: ``(rid, name, province, level columns, keys, provs, want)``.

    ``province_aliases`` has ``(key, alias)``: a province's candidates are
    followed by its aliases, nearest first, and so are the keys of records
    that name a province. ``name_aliases`` has ``(prov, alias, key)``: in that
    province, or anywhere if it is null, a name's alias stands for the key and
    is tried right after the name. Both are tables written by hand, so the
    candidates of a record stay few.
    """
    t = records.select(name, province, level).distinct()
    nm, pv = F.coalesce(F.col(name), F.lit("")), F.coalesce(F.col(province), F.lit(""))
    t = t.select(F.xxhash64(name, province, level).alias("rid"), name, province, level, candidate_keys(nm).alias("keys"), candidate_provinces(nm, pv).alias("provs"), level_key(F.col(level)).alias("want"))
    t = materialize(t, "tier-records")
    if province_aliases is not None:
        reach = alias_closure(province_aliases).filter("depth > 0").select(F.col("key").alias("k"), "alias", "depth")
        widened = lambda x, c: _ordered(x.join(reach, x["x"] == reach["k"], "left").select("rid", F.explode(F.array_compact(F.array(F.struct("ord", F.lit(0).alias("step"), "x"), F.when(F.col("alias").isNotNull(), F.struct("ord", F.col("depth").alias("step"), F.col("alias").alias("x")))))).alias("z")), c)
        provs = widened(t.select("rid", F.posexplode("provs").alias("ord", "x")), "provs")
        keys = widened(t.filter("want = 'province'").select("rid", F.posexplode("keys").alias("ord", "x")), "more")
        t = t.drop("provs").join(provs, "rid").join(keys, "rid", "left").withColumn("keys", F.coalesce("more", "keys")).drop("more")
    if name_aliases is not None:
        al = name_aliases.select(F.col("prov").alias("ap"), F.col("alias").alias("x"), F.col("key").alias("to"))
        k = t.select("rid", "provs", F.posexplode("keys").alias("ord", "x"))
        hit = k.join(al, "x").filter(F.col("ap").isNull() | F.array_contains("provs", F.col("ap"))).select("rid", F.struct("ord", F.when(F.col("ap").isNull(), 1).otherwise(F.array_position("provs", F.col("ap")) + 1).cast("int").alias("step"), F.col("to").alias("x")).alias("z"))
        own = k.select("rid", F.struct("ord", F.lit(0).alias("step"), "x").alias("z"))
        t = t.join(_ordered(own.unionByName(hit), "more"), "rid", "left").withColumn("keys", F.coalesce("more", "keys")).drop("more")
    return t


def _ordered(long: DataFrame, out: str) -> DataFrame:
    """``(rid, z)`` with ``z`` of ``ord, step, x`` as one array of the ``x`` per ``rid``, in order and without repeats."""
    return long.groupBy("rid").agg(F.array_distinct(F.transform(F.array_sort(F.collect_set("z")), lambda z: z["x"])).alias(out))


def exact_tiers(prepared: DataFrame, cat: DataFrame) -> DataFrame:
    """Tiers 1 and 2: ``(rid, psgc10, tier, score)``.

    1: key in its province and level, then city and municipality swapped.
    2: key unique at its level, then unique at any level or, for other than
    provinces, unique without the provinces. Within a tier the order of the
    provinces decides, then that of the keys, then the code.

    All steps are rows of one ranking, of which each record keeps the least;
    uniqueness is counted per key before anything is joined.
    """
    k = prepared.select("rid", "provs", "want", F.posexplode("keys").alias("ord", "key"))
    inside = k.select("rid", "want", "ord", "key", F.posexplode("provs").alias("pord", "prov")).join(cat, ["key", "prov"])
    swap = F.when(F.col("want") == "city", "municipality").when(F.col("want") == "municipality", "city")
    step = F.when(F.col("level") == F.col("want"), 0).when(F.col("level") == swap, 1)
    h1 = inside.select("rid", F.struct(F.lit(1).alias("tier"), step.alias("step"), "pord", "ord", F.lit(0).alias("sub"), "psgc10").alias("b")).filter("b.step is not null")
    one = cat.groupBy("key", "level").agg(F.count_distinct("psgc10").alias("n"), F.min("psgc10").alias("code")).groupBy("key")
    only = one.agg(
        F.map_from_entries(F.collect_list(F.when(F.col("n") == 1, F.struct("level", "code")))).alias("at"),
        F.when(F.sum("n") == 1, F.min("code")).alias("any"),
        F.when(F.sum(F.when(F.col("level") != "province", F.col("n"))) == 1, F.min(F.when(F.col("level") != "province", F.col("code")))).alias("below"),
    )  # at most one entry per level
    row = lambda step, sub, code: F.when(code.isNotNull(), F.struct(F.lit(2).alias("tier"), F.lit(step).alias("step"), F.lit(0).alias("pord"), "ord", F.lit(sub).alias("sub"), code.alias("psgc10")))
    below = F.when(F.coalesce("want", F.lit("")) != "province", F.col("below"))
    h2 = k.join(only, "key").select("rid", F.explode(F.array_compact(F.array(row(2, 0, F.try_element_at("at", F.col("want"))), row(3, 0, F.col("any")), row(3, 1, below)))).alias("b"))
    best = h1.unionByName(h2).groupBy("rid").agg(F.min("b").alias("b"))
    return best.select("rid", F.col("b.psgc10").alias("psgc10"), F.col("b.tier").alias("tier"), F.lit(1.0).alias("score"))


def _best_two(pairs: DataFrame) -> DataFrame:
    """Best and second score of each candidate ``(rid, pord, ord)`` of a record; of equal ones the smaller code, and a tie leaves no margin."""
    w = W.partitionBy("rid", "pord", "ord").orderBy(F.desc("s"), "psgc10")
    return pairs.select("rid", "pord", "ord", "psgc10", "s", F.coalesce(F.lead("s").over(w), F.lit(0.0)).alias("second"), F.row_number().over(w).alias("rn")).filter("rn = 1").drop("rn")


def fuzzy_tiers(rest: DataFrame, cat: DataFrame) -> DataFrame:
    """Tiers 3 to 5 on what the exact tiers left: ``(rid, psgc10, tier, score)``.

    Pairs are blocked by province and level, by province, and for the global
    tiers by sharing three letters and a similar length, which any pair with a
    ratio of 0.92 does; a tier only sees what the one before it left. Of a
    record's candidates the first that has a unit fit to its tier decides.
    """
    k = rest.select("rid", "provs", "want", F.posexplode("keys").alias("ord", "key")).filter("length(key) > 2")
    c = cat.select("psgc10", F.col("key").alias("ckey"), F.col("prov").alias("cprov"), F.col("level").alias("clevel"))
    la, lb = F.length("key"), F.length("ckey")
    grams = lambda x: F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(x) - 2, F.lit(1))), lambda i: F.substring(x, i, F.lit(3)))))

    def scored(pairs: DataFrame, low: float) -> DataFrame:
        near = pairs.filter(F.abs(la - lb) <= (1 - low) * (la + lb)).withColumn("s", ratio_from(low)("key", "ckey")).filter("s > 0")
        return near.select("rid", "pord", "ord", "psgc10", (F.col("want") == F.col("clevel")).alias("same"), "s")

    def fitting(pairs: DataFrame, tier: int, least: float, margin: float | None) -> DataFrame:
        b = _best_two(pairs).filter(F.col("s") >= least)
        if margin is not None:
            b = b.filter(F.col("s") - F.col("second") > margin)
        b = b.groupBy("rid").agg(F.min_by(F.struct("psgc10", "s"), F.struct("pord", "ord")).alias("b"))
        return b.select("rid", "b.psgc10", F.lit(tier).alias("tier"), F.round("b.s", 4).alias("score"))

    def both(pairs: DataFrame, name: str, first: tuple, second: tuple) -> DataFrame:
        """A tier within the level and then one at any level, from the same scored pairs; pairs and result are read more than once."""
        pairs = materialize(pairs, f"pairs-{name}")
        one = fitting(pairs.filter("same"), *first)
        two = fitting(pairs.join(one.select("rid"), "rid", "left_anti"), *second)
        return materialize(one.unionByName(two), f"tier-{name}")

    floor = min(least - (margin or 0.0) for least, margin in (FUZZY["3"], FUZZY["3b"]))  # a runner-up below this does not matter
    inside = k.select("rid", "want", "ord", "key", F.posexplode("provs").alias("pord", "prov"))
    local = both(scored(inside.join(c, inside["prov"] == c["cprov"]), floor), "3", (3, *FUZZY["3"]), (3, *FUZZY["3b"]))

    floor = min(least - (margin or 0.0) for least, margin in (FUZZY["4"], FUZZY["5"]))
    cg = c.withColumn("g", grams(F.col("ckey")))
    t = k.join(local.select("rid"), "rid", "left_anti").select("rid", "want", "ord", "key", F.lit(0).alias("pord")).withColumn("g", grams(F.col("key")))
    cond = (t["g"] == cg["g"]) & (F.abs(la - lb) <= (1 - floor) * (la + lb))
    shared = t.join(cg, cond).groupBy("rid", "pord", "ord", "want", "key", "ckey", "clevel", "psgc10").agg(F.count(F.lit(1)).alias("n"))
    # m letters in matching blocks leave at least m - 2 * blocks common trigrams, of which a few may repeat
    m = F.ceil(floor * (la + lb) / 2)
    shared = shared.filter(F.col("n") >= F.greatest(F.lit(1), m - 2 * (la + lb - 2 * m + 1) - 2))
    return local.unionByName(both(scored(shared, floor), "4", (4, *FUZZY["4"]), (5, *FUZZY["5"])))


def crosswalk(records: DataFrame, master: DataFrame, name: str = "lgu_name", province: str = "province", level: str = "lgu_type", province_aliases: DataFrame | None = None, name_aliases: DataFrame | None = None) -> DataFrame:
    """Each distinct typed tuple with its code, tier and score; tier 0 and a null code where nothing matched.

    Null fields are matched as blanks; an empty master leaves all at tier 0.
    """
    p = prepare(records, name, province, level, province_aliases, name_aliases)
    cat = materialize(catalog(master), "tier-catalog")
    ex = materialize(exact_tiers(p, cat), "tier-exact")
    fz = fuzzy_tiers(p.join(ex.select("rid"), "rid", "left_anti"), cat)
    hit = ex.unionByName(fz)
    names = master.select("psgc10", F.col("name").alias("matched_name"))
    return p.join(hit, "rid", "left").join(names, "psgc10", "left").select(name, province, level, "psgc10", F.coalesce("tier", F.lit(0)).alias("tier"), F.coalesce("score", F.lit(0.0)).alias("score"), "matched_name")


def former_names(master: DataFrame) -> DataFrame:
    """``(prov, alias, key)``: the former names of units as aliases within their provinces."""
    old = master.filter("old_names is not null").select(plain_key(F.col("province_name")).alias("prov"), F.explode(F.split("old_names", r"[;|/]|,\s")).alias("old"), match_key(F.col("name")).alias("key"))
    return old.select("prov", match_key(F.col("old")).alias("alias"), "key").filter("alias <> '' and alias <> key").distinct()


def join_back(records: DataFrame, walk: DataFrame, keys: list[str]) -> DataFrame:
    """The crosswalk joined to all rows on typed fields, null matching null."""
    return null_safe_join(records, walk, keys)


def unmatched_ranking(records: DataFrame, walk: DataFrame, keys: list[str], top: int = 30) -> DataFrame:
    """Unmatched tuples by how many rows carry them."""
    miss = walk.filter("tier <= 0").select(*keys)
    return null_safe_join(records.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")), miss.withColumn("miss", F.lit(1)), keys, "inner").drop("miss").orderBy(F.desc("n_rows"), *keys).limit(top)


def diagnose(rest: DataFrame, cat: DataFrame, per_record: int = 8) -> DataFrame:
    """The nearest master names of each unmatched key that share three letters with it."""
    grams = lambda x: F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(x) - 2, F.lit(1))), lambda i: F.substring(x, i, F.lit(3)))))
    k = rest.select("rid", F.explode("keys").alias("key")).withColumn("g", grams(F.col("key")))
    c = cat.select("psgc10", F.col("key").alias("ckey")).withColumn("g", grams(F.col("ckey")))
    pairs = k.join(c, "g").select("rid", "key", "psgc10", "ckey").distinct().withColumn("score", F.round(block_ratio("key", "ckey"), 4))
    w = W.partitionBy("rid").orderBy(F.desc("score"), "psgc10")
    best = pairs.groupBy("rid", "psgc10").agg(F.max("score").alias("score"), F.min("ckey").alias("candidate"))
    return best.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= per_record)
