"""Schemas that drift between files: columns matched by similarity flooding, changes listed, rows united.

Nodes are the distinct column labels in use and the canonical columns. A pair
(label, canonical column) starts with the similarity of its wording and type.
Scores then flow between pairs along three kinds of edges until they settle:
a label that took another's place in the next file of the same stream passes
its scores on; labels of nearly the same letters support each other; and since
no file holds a column twice, labels that stand beside a label compete with it.
Correspondences are then chosen file by file, one to one, best scores first.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.numbers import parse_number
from ..session import materialize

#: A bracket that tells a unit of money says nothing about the column.
UNIT_BRACKET = r"(?i)[|\s]*\((in\s+)?(php?|p|₱|philippine|pesos?|thousands?|millions?|'?000s?|[.,'’\s]|m\b|in|of)+\)"


def letters(label: Column) -> Column:
    """Letters and digits of a label in lower case: blanks, line breaks and punctuation do not count."""
    return F.regexp_replace(F.lower(label), r"(?U)[^\p{L}\p{N}]", "")


def _words(label: Column) -> Column:
    base = F.lower(F.regexp_replace(label, UNIT_BRACKET, ""))
    return F.trim(F.regexp_replace(base, r"(?U)[^\p{L}\p{N}]+", " "))


def _grams(words: Column) -> Column:
    """Distinct letter trigrams of each word with its borders."""
    return F.array_distinct(F.flatten(F.transform(F.split(words, " "), lambda w: F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.substring(F.concat(F.lit("^"), w, F.lit("$")), i, F.lit(3))))))


def file_columns(headers: DataFrame, report: DataFrame) -> DataFrame:
    """One row per file and column: position, label, its letters, its key for matching, stored type and the file before it."""
    years = report.select(F.col("file_id").alias("_f"), "fiscal_year")
    h = headers.join(years, headers["file_id"] == years["_f"]).select("file_id", "stream_id", "fiscal_year", "header_labels", "column_types")
    w = W.partitionBy("stream_id").orderBy("fiscal_year", "file_id")
    h = h.withColumn("prev_file", F.lag("file_id").over(w))
    c = h.select("file_id", "stream_id", "fiscal_year", "prev_file", F.posexplode(F.arrays_zip("header_labels", "column_types")).alias("pos", "z"))
    c = c.select("file_id", "stream_id", "fiscal_year", "prev_file", "pos", F.col("z.header_labels").alias("label"), F.col("z.column_types").alias("type"))
    c = c.filter("label is not null").withColumn("norm", letters(F.col("label"))).withColumn("words", _words(F.col("label")))
    return c.withColumn("key", F.regexp_replace("words", " ", ""))


def _start(cols: DataFrame, canonical: DataFrame) -> DataFrame:
    """``(key, column_name, s0)`` from the wording and the stored types."""
    known = canonical.select("column_name", _words(F.col("known_label")).alias("words")).distinct()
    kg = known.select("column_name", "words", F.explode(_grams(F.col("words"))).alias("g"))
    n_cols = F.lit(30.0)
    df = kg.groupBy("g").agg(F.log(1 + n_cols / F.count_distinct("column_name")).alias("w"))
    kg = kg.join(df, "g")
    kn = kg.groupBy("column_name", "words").agg(F.sum("w").alias("kw"))
    labels = cols.groupBy("key").agg(F.min("words").alias("lw"), F.avg((F.col("type") == "string").cast("double")).alias("text"))
    lg = labels.select("key", F.explode(_grams(F.col("lw"))).alias("g")).join(df, "g", "left")
    lg = lg.withColumn("w", F.coalesce("w", F.log(1 + n_cols) * 0.5))
    ln = lg.groupBy("key").agg(F.sum("w").alias("lw"))
    common = lg.select("key", "g", "w").join(kg.select("g", "column_name", "words"), "g").groupBy("key", "column_name", "words").agg(F.sum("w").alias("both"))
    sim = common.join(ln, "key").join(kn, ["column_name", "words"])
    sim = sim.withColumn("s", 0.6 * F.col("both") / (F.col("lw") + F.col("kw") - F.col("both")) + 0.4 * F.col("both") / F.least("lw", "kw"))
    sim = sim.withColumn("s", F.when(F.col("key") == F.regexp_replace("words", " ", ""), F.lit(1.0)).otherwise(F.least(F.col("s"), F.lit(0.95))))
    best = sim.groupBy("key", "column_name").agg(F.max("s").alias("s"))
    # the type a canonical column is stored as is learned from the labels known to be its
    exact = best.filter("s = 1.0").join(labels.select("key", "text"), "key").groupBy("column_name").agg(F.avg("text").alias("ctext"))
    out = best.join(labels.select("key", "text"), "key").join(exact, "column_name", "left")
    fit = 1 - F.abs(F.col("text") - F.coalesce("ctext", "text"))
    return out.select("key", "column_name", F.when(F.col("s") == 1.0, 1.0).otherwise(F.col("s") * (0.4 + 0.6 * fit)).alias("s0"))


def _successions(cols: DataFrame) -> DataFrame:
    """``(a, b, w)``: how often label b stood where label a stood in the file before, its neighbour being the same."""
    w = W.partitionBy("file_id").orderBy("pos")
    c = cols.select("file_id", "prev_file", "key", F.coalesce(F.lag("key").over(w), F.lit("^")).alias("lt"), F.coalesce(F.lead("key").over(w), F.lit("$")).alias("rt"))
    now = c.filter("prev_file is not null")
    ids = c.select(F.col("file_id").alias("f"), F.col("key").alias("k")).distinct()
    new = now.join(ids, (now["prev_file"] == ids["f"]) & (now["key"] == ids["k"]), "left_anti")
    steps = now.select("file_id", "prev_file").distinct()
    old = c.select(F.col("file_id").alias("pf"), "key", "lt", "rt").join(steps, F.col("pf") == F.col("prev_file")).drop("prev_file", "pf")
    gone = old.join(ids, (old["file_id"] == ids["f"]) & (old["key"] == ids["k"]), "left_anti").select(F.col("file_id").alias("gf"), F.col("key").alias("a"), F.col("lt").alias("glt"), F.col("rt").alias("grt"))
    hits = []
    for mine, theirs in (("lt", "glt"), ("rt", "grt")):
        hits.append(new.join(gone, (new["file_id"] == gone["gf"]) & (new[mine] == gone[theirs])).select("a", F.col("key").alias("b")))
    return hits[0].unionByName(hits[1]).groupBy("a", "b").agg(F.count(F.lit(1)).cast("double").alias("w"))


def _spelling_edges(cols: DataFrame) -> DataFrame:
    """``(a, b, w)`` for labels that share their sorted letters, as swapped letters leave those unchanged."""
    k = cols.select("key").distinct().withColumn("sorted", F.array_join(F.array_sort(F.split("key", "")), ""))
    b = k.select(F.col("key").alias("b"), F.col("sorted").alias("s2"))
    return k.join(b, (k["sorted"] == b["s2"]) & (k["key"] != b["b"])).select(F.col("key").alias("a"), "b", F.lit(4.0).alias("w"))


def flood(cols: DataFrame, canonical: DataFrame, settled: float = 0.02, flow: float = 0.45, rival: float = 0.45) -> DataFrame:
    """Settled scores ``(key, column_name, s)`` of label pairs.

    A round sets each score to its start, plus ``flow`` times the mean of what
    its edges bring, less ``rival`` times the mean over files of the best score
    that another label of the file has for the column, kept within [0, 1].
    Means and maxima move by no more than the scores they are made of, so two
    score tables come nearer to each other by ``flow + rival`` < 1 in a round:
    there is one fixed point, and rounds follow until no score moves by
    ``settled``. Pairs that edges add on the way stay, also at 0, so they meet
    their rivals in every round; what an edge brings counts from a tenth of
    ``settled`` on. How many rounds that may take follows from the numbers;
    more are an error.

    Files that hold the same set of labels count once with their number. Each
    round's scores, one row per plausible pair of label and column, are written
    to the shared folder, so the plan does not grow with the rounds.
    """
    if not 0 < flow + rival < 1:
        raise ValueError("flow + rival must lie between 0 and 1, else scores need not settle")
    start = materialize(_start(cols, canonical), "drift-start")
    e = _successions(cols).unionByName(_spelling_edges(cols))
    e = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"), "w")).groupBy("a", "b").agg(F.sum("w").alias("w"))
    edges = materialize(e.withColumn("p", F.col("w") / (F.sum("w").over(W.partitionBy("b")) + 1.0)).select("a", "b", "p"), "drift-edges")
    sets = cols.groupBy("file_id").agg(F.array_sort(F.collect_set("key")).alias("keys"))
    sets = sets.groupBy("keys").agg(F.count(F.lit(1)).alias("n")).select(F.xxhash64("keys").alias("fs"), "n", F.explode("keys").alias("key"))
    sets = materialize(sets, "drift-sets")
    s = start.select("key", "column_name", F.col("s0").alias("s"))
    most = math.ceil(math.log(settled / 2) / math.log(flow + rival)) + 1
    for _ in range(most):
        push = edges.join(s, edges["a"] == s["key"]).select(F.col("b").alias("key"), "column_name", (flow * F.col("p") * F.col("s")).alias("d")).filter(F.col("d") > settled / 10)
        w = W.partitionBy("fs", "column_name")
        best = sets.join(s, "key").withColumn("t", F.max(F.struct("s", "key")).over(w))
        best = best.withColumn("u", F.max(F.when(F.col("key") != F.col("t.key"), F.col("s"))).over(w))
        other = F.when(F.col("t.key") != F.col("key"), F.col("t.s")).otherwise(F.coalesce("u", F.lit(0.0)))
        press = best.select("key", "column_name", (other * F.col("n")).alias("o"), "n")
        # starts, flows and rivals of a pair meet in one aggregate
        parts = start.unionByName(push, True).unionByName(press, True).unionByName(s.withColumnRenamed("s", "was"), True)
        g = parts.groupBy("key", "column_name").agg(F.coalesce(F.max("s0"), F.lit(0.0)).alias("s0"), F.sum("d").alias("push"), (F.sum("o") / F.sum("n")).alias("press"), F.coalesce(F.max("was"), F.lit(0.0)).alias("was"))
        val = F.col("s0") + F.coalesce("push", F.lit(0.0)) - rival * F.coalesce("press", F.lit(0.0))
        val = F.when(F.col("s0") == 1.0, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(0.99), val)))
        nxt = materialize(g.select("key", "column_name", val.alias("s"), F.abs(val - F.col("was")).alias("moved")), "drift-scores")
        moved = nxt.agg(F.max("moved")).first()[0] or 0.0
        s = nxt.select("key", "column_name", "s")
        if moved < settled:
            return s
    raise RuntimeError(f"scores still move by {moved} after {most} rounds")


def correspondences(headers: DataFrame, report: DataFrame, canonical: DataFrame, least: float = 0.22) -> DataFrame:
    """One row per file and matched canonical column: position, label, its letters, type, score and the file before.

    Defined results: null labels match nothing; a file without labels or an
    empty table gives no rows; of two columns that fit one canonical column the
    better score wins, ties going to the left one; junk columns stay unmatched.
    """
    cols = materialize(file_columns(headers, report), "drift-columns")
    s = flood(cols, canonical)
    cand = cols.join(s.filter(F.col("s") >= least), "key").select("file_id", F.struct(F.negative("s").alias("m"), "pos", "column_name").alias("z"))
    # best scores first, until no candidate of the file is left whose column and position are both free
    none = F.struct(F.lit(None).cast("double").alias("m"), F.lit(-1).alias("pos"), F.lit("").alias("column_name"))
    taken = lambda acc, z: F.exists(acc, lambda y: (y["pos"] == z["pos"]) | (y["column_name"] == z["column_name"]))
    picked = F.aggregate(F.array_sort("zs"), F.array(none), lambda acc, z: F.when(taken(acc, z), acc).otherwise(F.array_append(acc, z)))
    chosen = cand.groupBy("file_id").agg(F.collect_list("z").alias("zs")).select("file_id", F.explode(picked).alias("z")).filter("z.pos >= 0")
    chosen = chosen.select("file_id", "z.pos", "z.column_name", F.negative("z.m").alias("s"))
    out = cols.join(chosen, ["file_id", "pos"]).select("file_id", "stream_id", "fiscal_year", "prev_file", "pos", "label", "norm", "type", "column_name", "s")
    return materialize(out, "drift-match")


def changes(match: DataFrame) -> DataFrame:
    """Changes of each file against the file before it: ``(file_id, column_name, change_kind, before, after)``."""
    files = match.select("file_id", "prev_file").distinct().filter("prev_file is not null")
    now = match.select(F.col("file_id").alias("f"), "column_name", "norm", "type", "label")
    old = match.select(F.col("file_id").alias("of"), "column_name", F.col("norm").alias("onorm"), F.col("type").alias("otype"), F.col("label").alias("olabel"))
    old = old.join(files, old["of"] == files["prev_file"]).select(F.col("file_id").alias("f"), "column_name", "onorm", "otype", "olabel")
    cur = now.join(files, now["f"] == files["file_id"], "left_semi")
    j = cur.join(old, ["f", "column_name"], "full")
    kinds = F.array_compact(
        F.array(
            F.when(F.col("onorm").isNull(), F.lit("added")),
            F.when(F.col("norm").isNull(), F.lit("removed")),
            F.when(F.col("norm") != F.col("onorm"), F.lit("renamed")),
            F.when(~F.col("type").eqNullSafe(F.col("otype")) & F.col("norm").isNotNull() & F.col("onorm").isNotNull(), F.lit("retyped")),
        )
    )
    return j.select(F.col("f").alias("file_id"), "column_name", F.explode(kinds).alias("change_kind"), F.col("olabel").alias("before"), F.col("label").alias("after"), F.col("otype").alias("type_before"), F.col("type").alias("type_after"))


def canonical_rows(sheet_rows: DataFrame, match: DataFrame, columns: list[str], text: tuple[str, ...] = ("region", "province", "lgu_name", "lgu_type", "fund_type")) -> DataFrame:
    """All sheet rows in canonical columns: cells picked by each file's match, numbers parsed, missing columns null."""
    pos = match.groupBy("file_id").agg(F.map_from_entries(F.collect_list(F.struct("column_name", (F.col("pos") + 1).alias("at")))).alias("at"))
    j = sheet_rows.join(pos, "file_id", "left")
    out = []
    for c in columns:
        cell = F.try_element_at("cells", F.try_element_at("at", F.lit(c)))
        out.append((F.trim(cell) if c in text else parse_number(cell)).alias(c))
    return j.select("file_id", "row_idx", *out)
