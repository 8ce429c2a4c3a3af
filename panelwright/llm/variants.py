"""Variant spellings of one name linked, whether or not a master list holds it.

A set-similarity join on q-grams proposes pairs: texts of a block are held
against each other as counts of hashed q-grams, a product of two matrices that
never falls short of the tokens two sets share, and only pairs that may reach
the wanted share go on. Pairs are verified by a soft weighted token
similarity, in which words match by edits and rare words count more. Spellings are joined to the names in the master list first, old names
included; those that fit none are joined to each other and gather around the
spelling that most of them use.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import materialize
from . import names
from .match import EVIDENCE, alike, decide, province_aliases, region_names

#: Token space, buckets that tokens and words are counted in, least share of common tokens, least verified similarity, the same for names that stand alone, how far below the best a province may be.
SPACE, BUCKETS, LEAST_SHARED, LEAST_SIM, LEAST_ALONE, NEAR_PLACE = 1 << 20, 1 << 16, 0.28, 0.58, 0.74, 0.12
#: What a slip costs: a letter for one that is taken for it, for any other, a vowel lost or added, an h or a doubled letter, any other letter, two neighbours swapped.
TAKEN_FOR, CHANGED, VOWEL, SILENT, LETTER, SWAPPED = 0.4, 1.0, 0.7, 0.4, 1.0, 0.9

#: Columns that a set of tokens is counted in, those of them that one bucket of common tokens has for itself; known and typed texts of a block that one task holds, typed ones held against them at once, pairs aligned at once.
COLUMNS, OWN, KNOWN, TYPED, AT_ONCE, ALIGNED = 256, 128, 8192, 4096, 1024, 4096

_FOLDED = str.maketrans("vfcqzeowyj", "bpkksiuuih")
_LETTERS = "abcdefghijklmnopqrstuvwxyz0123456789"


def _bucket(word: str) -> int:
    return xxhash.xxh64_intdigest(word) % BUCKETS


def corpus_statistics(texts: DataFrame) -> tuple[np.ndarray, np.ndarray, int]:
    """In how many of all distinct texts each bucket of tokens and of words occurs, and the number of texts.

    The driver gets one row per bucket (``BUCKETS`` of either kind at most);
    tasks count before anything is shuffled.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = np.zeros(2 * BUCKETS + 1, np.int64)
        for pdf in batches:
            for t in pdf["text"]:
                seen[np.asarray(grams(t)) % BUCKETS] += 1
                seen[BUCKETS + np.array(sorted({_bucket(w) for w in t.split()}), int)] += 1
            seen[-1] += len(pdf)
        some = np.flatnonzero(seen)
        yield pd.DataFrame({"key": some, "n": seen[some]})

    out = np.zeros(2 * BUCKETS + 1, np.int64)
    for r in texts.select("text").distinct().mapInPandas(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).collect():
        out[r["key"]] = r["n"]
    return out[:BUCKETS], out[BUCKETS:-1], int(out[-1])


def grams(text: str) -> list[int]:
    """The q-grams of a name's letters; blanks, which typists add and lose, do not count."""
    return names.grams(text.replace(" ", ""), SPACE)


def columns(df: np.ndarray) -> np.ndarray:
    """The column of each bucket of tokens: the commonest buckets have one each, the others share the rest."""
    out = OWN + np.arange(BUCKETS) % (COLUMNS - OWN)
    out[np.argsort(-df, kind="stable")[:OWN]] = np.arange(OWN)
    return out


def counted(texts: list[str], column: np.ndarray, shared: float, known: bool) -> np.ndarray:
    """A row per text, such that a typed row times a known row is 0 or more for all sets that have ``shared`` of their tokens in common.

    That is (1 + shared) * both >= shared * (n + m). As tokens of one column
    are counted together, the product is never less than the true one.
    """
    sets = [grams(t) for t in texts]
    n = np.array([len(x) for x in sets])
    at = np.repeat(np.arange(len(sets)), n) * COLUMNS + column[np.fromiter((t for x in sets for t in x), np.int64, n.sum()) % BUCKETS]
    x = np.ones((len(sets), COLUMNS + 2), np.float32)
    x[:, :COLUMNS] = np.bincount(at, minlength=len(sets) * COLUMNS).reshape(-1, COLUMNS)
    x[:, COLUMNS + known] = -shared * n
    if not known:
        x[:, :COLUMNS] *= 1 + shared
    return x


def slips(a: str, b: str) -> tuple[list[float], list[float]]:
    """What the cheapest way from ``a`` to ``b`` costs, laid on the letters of ``a`` and on those of ``b``."""
    fa, fb, n, m = a.translate(_FOLDED), b.translate(_FOLDED), len(a), len(b)

    def lone(s: str, i: int) -> float:
        return SILENT if s[i] == "h" or (i and s[i - 1] == s[i]) else VOWEL if s[i] in "aeiou" else LETTER

    drop, add = [lone(a, i) for i in range(n)], [lone(b, j) for j in range(m)]
    rows = [[0.0]]
    for x in add:
        rows[0].append(rows[0][-1] + x)
    for i in range(1, n + 1):
        up, di, ai, fi = rows[-1], drop[i - 1], a[i - 1], fa[i - 1]
        cur = [up[0] + di]
        for j in range(1, m + 1):
            c = up[j - 1] if ai == b[j - 1] else up[j - 1] + (TAKEN_FOR if fi == fb[j - 1] else CHANGED)
            x = up[j] + di
            if x < c:
                c = x
            x = cur[-1] + add[j - 1]
            if x < c:
                c = x
            if i > 1 and j > 1 and ai == b[j - 2] and a[i - 2] == b[j - 1] and ai != b[j - 1]:
                x = rows[i - 2][j - 2] + SWAPPED
                if x < c:
                    c = x
            cur.append(c)
        rows.append(cur)
    on_a, on_b, i, j = [0.0] * n, [0.0] * m, n, m
    while i or j:
        c = rows[i][j]
        if i and j and c == rows[i - 1][j - 1] + (0.0 if a[i - 1] == b[j - 1] else TAKEN_FOR if fa[i - 1] == fb[j - 1] else CHANGED):
            i, j = i - 1, j - 1
            on_a[i] += c - rows[i][j]
            on_b[j] += c - rows[i][j]
        elif i and c == rows[i - 1][j] + drop[i - 1]:
            i -= 1
            on_a[i] += drop[i]
            if m:
                on_b[min(j, m - 1)] += drop[i]
        elif j and c == rows[i][j - 1] + add[j - 1]:
            j -= 1
            on_b[j] += add[j]
            if n:
                on_a[min(i, n - 1)] += add[j]
        else:
            i, j = i - 2, j - 2
            for on, k in ((on_a, i), (on_b, j)):
                on[k] += SWAPPED / 2
                on[k + 1] += SWAPPED / 2
    return on_a, on_b


def soft_similarity(q: str, m: str, weight) -> float:  # noqa: ANN001
    """Similarity in [0, 1] of two names by their words, of which rare ones count more.

    The letters of both names are laid side by side by the cheapest slips, so a
    word that a blank cuts in two, or one glued to the next, still meets its
    partner. Each word of either name then has the share of its letters that
    stand without slips, and the shares are averaged with the weights that
    ``weight`` gives the words. Names with different titles in front are held
    for half as similar, as a title is a whole other word and not a slip; a name
    cut off after five letters or more counts 0.8.
    """
    a, b = q.replace(" ", ""), m.replace(" ", "")
    if a == b:
        return 1.0
    total = of = 0.0
    for text, on in zip((q, m), slips(a, b), strict=True):
        at = 0
        for w in text.split():
            wt = weight(w)
            total += wt * max(0.0, 1 - sum(on[at : at + len(w)]) / len(w))
            of += wt
            at += len(w)
    s = total / of if of else 0.0
    ta, tb = names.parts(a)[0], names.parts(b)[0]
    if ta and tb and ta != tb:
        return 0.5 * s
    return max(s, 0.8) if min(len(a), len(b)) >= 5 and (a.startswith(b) or b.startswith(a)) else s


def coded(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The letters of each text as numbers, one row per text, and its length; 36 stands for any other sign."""
    wide = np.array(texts, f"U{max(map(len, texts))}").view(np.uint32).reshape(len(texts), -1)
    number = np.full(128, 36)
    number[[ord(c) for c in _LETTERS]] = np.arange(36)
    return number[np.minimum(wide, 127)], np.array([len(t) for t in texts])


def _costs() -> tuple[np.ndarray, np.ndarray]:
    """What a letter for another costs, and what a lone letter does, by their numbers; other signs cost the least that is possible."""
    swap, lone = np.zeros((37, 37), np.float32), np.full(37, SILENT, np.float32)
    for i, x in enumerate(_LETTERS):
        lone[i] = SILENT if x == "h" else VOWEL if x in "aeiou" else LETTER
        for j, y in enumerate(_LETTERS):
            swap[i, j] = 0 if x == y else TAKEN_FOR if x.translate(_FOLDED) == y.translate(_FOLDED) else CHANGED
    return swap.reshape(-1), lone


def ceilings(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How similar the coded texts ``a[i]`` and ``b[j]``, of one word each, are at most.

    The cheapest slips of ``slips`` are counted for many pairs at once, without
    laying them on letters: of one word each, texts with slips of cost c keep
    1 - c / n letters at most, n being the longer's; a name cut off counts 0.8.
    """
    swap, lone = _costs()
    out = np.empty(len(i), np.float32)
    long = np.maximum(a[1][i], b[1][j])
    order = np.argsort(long, kind="stable")
    for k in range(0, len(i), ALIGNED):
        at = order[k : k + ALIGNED]
        la, lb = a[1][i[at]], b[1][j[at]]
        n, m, every = la.max(), lb.max(), np.arange(len(at))
        x, y = np.ascontiguousarray(a[0][i[at], :n].T), np.ascontiguousarray(b[0][j[at], :m].T)
        drop, add = lone[x], lone[y]
        for c, z in ((drop, x), (add, y)):
            c[1:][z[1:] == z[:-1]] = SILENT
        up, above, cost = None, np.zeros((m + 1, len(at)), np.float32), np.zeros(len(at), np.float32)
        np.cumsum(add, axis=0, out=above[1:])
        before = None
        for r in range(n):
            cur, same, row = np.empty_like(above), x[r] == y, x[r] * 37
            cur[0] = above[0] + drop[r]
            for c in range(m):
                best = np.minimum(above[c] + swap[row + y[c]], above[c + 1] + drop[r])
                np.minimum(best, cur[c] + add[c], out=best)
                if r and c:
                    both = same[c - 1] & before[c]
                    best[both] = np.minimum(best[both], up[c - 1][both] + np.float32(SWAPPED))
                cur[c + 1] = best
            done = la == r + 1
            cost[done] = cur[lb[done], every[done]]
            up, above, before = above, cur, same
        w = min(n, m)
        cut = ((x[:w] == y[:w]) | (np.arange(w)[:, None] >= np.minimum(la, lb))).all(0)
        out[at] = np.maximum(1 - cost / long[at], np.where(cut, 0.8, 0)) + 1e-4
    return out


def similar_pairs(left: DataFrame, right: DataFrame, stats: tuple, shared: float = LEAST_SHARED, least: float = LEAST_SIM, near: float | None = None) -> DataFrame:
    """``(block, q, m, sim)`` of texts of both sides that lie in one block and are similar; each pair once.

    Both sides have ``(block, text)``, a text being words with blanks between
    them. Blocks only limit the search; a block may hold a third of all texts:
    one with more than ``TYPED`` or ``KNOWN`` of a side is dealt to as many
    tasks as it has pairs of such parts. Within a task, known texts come first
    and typed ones stream past them. Pairs that may have the wanted share of
    common tokens are found by ``counted``, those of one word each bounded by
    ``ceilings``, the rest held against the share and compared by
    ``soft_similarity``, a word weighing log(1 + texts / texts that have it).
    With ``near``, pairs may be left out that are further than that below the
    most similar one of their typed text and block.
    """
    df, wf, n_texts = stats
    spark = left.sparkSession
    counts = spark.sparkContext.broadcast((columns(df), wf))  # of fixed size
    side = lambda x, n: x.select("block", "text").filter("block is not null").distinct().withColumn("side", F.lit(n))
    sides = materialize(side(right, 0).unionByName(side(left, 1)), "variants-sides")
    parts = sides.groupBy("block").agg(F.ceil(F.count_if(F.col("side") == 1) / TYPED).cast("int").alias("pq"), F.ceil(F.count_if(F.col("side") == 0) / KNOWN).cast("int").alias("pm"))
    # hot blocks have thousands of texts each, so they are few
    rows = sides.join(F.broadcast(parts.filter("pq > 0 and pm > 0 and pq * pm > 1")), "block", "left").withColumn("pq", F.coalesce("pq", F.lit(1))).withColumn("pm", F.coalesce("pm", F.lit(1)))
    place = lambda n: F.pmod(F.xxhash64("text"), F.col(n)).cast("int")
    to = lambda n, part: F.transform(F.sequence(F.lit(0), F.col(n) - 1), part)
    rows = rows.withColumn("part", F.explode(F.when(F.col("side") == 0, to("pq", lambda i: i * F.col("pm") + place("pm"))).otherwise(to("pm", lambda i: place("pq") * F.col("pm") + i))))
    # by a stated number, as parts of few bytes are much work and would be put together
    rows = rows.select("block", "part", "side", "text").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "block", "part").sortWithinPartitions("block", "part", "side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        column, often = counts.value
        sets = lru_cache(20_000)(lambda t: frozenset(grams(t)))
        weight = lru_cache(20_000)(lambda w: math.log(1 + n_texts / max(1, int(often[_bucket(w)]))))

        def compared(block: str, typed: list, known: list, x: np.ndarray, codes: tuple, single: np.ndarray) -> Iterator[tuple]:
            i, j = np.nonzero(counted(typed, column, shared, False) @ x.T >= -0.01)
            most = np.ones(len(i), np.float32)
            one = np.flatnonzero(np.array([" " not in t for t in typed])[i] & single[j])
            most[one] = ceilings(coded(typed), codes, i[one], j[one])
            some = np.flatnonzero(most >= least)
            some = some[np.lexsort((-most[some], i[some]))]
            now, top = -1, 0.0
            for k, n, bound in zip(i[some].tolist(), j[some].tolist(), most[some].tolist(), strict=True):
                if k != now:
                    now, top = k, 0.0
                if near is not None and bound < top - near:
                    continue
                a, b = sets(typed[k]), sets(known[n])
                both = len(a & b)
                if both >= shared * (len(a) + len(b) - both) and (s := soft_similarity(typed[k], known[n], weight)) >= least:
                    top = max(top, s)
                    yield block, typed[k], known[n], s

        now, known, held = None, [], None  # the part at hand, its known texts and what is made of them
        for batch in batches:
            block, part, side, text = (batch.column(c).to_pylist() for c in ("block", "part", "side", "text"))
            ends = [k for k in range(1, len(text)) if (block[k], part[k], side[k]) != (block[k - 1], part[k - 1], side[k - 1])]
            kept = []
            for i, j in zip([0, *ends], [*ends, len(text)], strict=True) if text else ():
                if (block[i], part[i]) != now:
                    now, known, held = (block[i], part[i]), [], None
                if side[i] == 0:
                    known += text[i:j]
                elif known:
                    held = held or (counted(known, column, shared, True), coded(known), np.array([" " not in t for t in known]))
                    for k in range(i, j, AT_ONCE):
                        kept += compared(block[i], text[k : min(j, k + AT_ONCE)], known, *held)
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in kept], kind) for i, kind in enumerate((pa.string(), pa.string(), pa.string(), pa.float64()))], names=["block", "q", "m", "sim"])

    return rows.mapInArrow(run, "block string, q string, m string, sim double")


def link(labels: DataFrame, units: DataFrame, master: DataFrame) -> DataFrame:
    """``(rec_id, entity)`` for every label that names something; labels of one entity are variants of one name.

    ``labels`` and ``units`` are normalized records. An entity is a code of the
    master or, for names it lacks, the spelling most labels use in that place.

    Defined results: null and empty names and rows that name totals or notes
    get no entity; labels of the same parts share their entity; a null province
    is looked up by its region, a null region in all of them; an empty master
    leaves all names to each other; a label that several units fit equally well
    is linked to labels of its spelling only.
    """
    labels, units = labels.withColumn("nm", F.col("wd")), units.withColumn("nm", F.col("wd"))
    stats = corpus_statistics(labels.select(F.col("nm").alias("text")).unionByName(units.select(F.col("nm").alias("text"))).filter("text <> ''"))
    prov, rm = places(labels, units, master, stats)
    r = labels.filter("nm <> ''").join(rm, "rk", "left").withColumn("rg", F.when(F.col("rk").rlike(r"^\d+$"), F.col("rk")).otherwise(F.col("rid")))
    r = r.select(F.xxhash64("nm", "pv", "pnote", "rg", "lvn", "lvt").alias("h"), "rec_id", "nm", "pv", "pnote", "rg", "lvn", "lvt")
    d = r.groupBy("h", "nm", "pv", "pnote", "rg", "lvn", "lvt").agg(F.count(F.lit(1)).alias("n_labels"))
    d = materialize(d, "variants-labels")
    u = units.select(F.col("rec_id").alias("psgc10"), F.col("nm").alias("unm"), F.col("pv").alias("upv"), F.col("rk").alias("urg"), F.col("lvt").alias("ulv")).filter("unm <> ''").distinct()
    u = materialize(u, "variants-units")
    hints = d.select("h", F.col("pv").alias("q"), F.lit(1).alias("typed")).unionByName(d.select("h", F.col("pnote").alias("q"), F.lit(2).alias("typed"))).filter("q <> ''")
    hp = hints.join(prov, "q").groupBy("h", "upv").agg(F.max(F.when(F.col("typed") == 1, F.col("psim"))).alias("ps"), F.max(F.when(F.col("typed") == 2, F.col("psim"))).alias("pn"))
    hp = materialize(hp, "variants-places")
    # within the province
    inside = d.join(hp, "h")
    sp = similar_pairs(inside.select(F.col("upv").alias("block"), F.col("nm").alias("text")), u.select(F.col("upv").alias("block"), F.col("unm").alias("text")), stats)
    logit = 12 * F.col("sim") - 7
    c1 = inside.join(sp.select(F.col("block").alias("upv"), F.col("q").alias("nm"), F.col("m").alias("unm"), "sim"), ["upv", "nm"]).join(alike(u, "upv"), ["unm", "upv"])
    c1 = c1.withColumn("nsim", F.col("sim")).withColumn("nlogit", logit)
    first = materialize(decide(c1.select(*EVIDENCE), 0.5), "variants-first")
    # of what is left: within the region, or anywhere if that is unknown too, by names that fit well
    rest = d.join(first.select("h"), "h", "left_anti").withColumn("block", F.coalesce("rg", F.lit("*")))
    wide = alike(u).withColumn("block", F.explode(F.array("urg", F.lit("*"))))
    sr = similar_pairs(rest.select("block", F.col("nm").alias("text")), wide.select("block", F.col("unm").alias("text")), stats, 0.4, 0.75)
    c2 = rest.join(sr.select("block", F.col("q").alias("nm"), F.col("m").alias("unm"), "sim"), ["block", "nm"]).join(wide, ["unm", "block"])
    c2 = c2.withColumn("nsim", F.col("sim")).withColumn("nlogit", logit).withColumn("ps", F.lit(None).cast("double")).withColumn("pn", F.lit(None).cast("double"))
    second = decide(c2.select(*EVIDENCE), 0.5)
    known = materialize(first.unionByName(second).select("h", F.col("psgc10").alias("entity")), "variants-known")
    lone = gather(d.join(known.select("h"), "h", "left_anti"), hp, u.filter("urg <> ''").groupBy("upv").agg(F.min("urg").alias("urg")), stats)
    return r.select("h", "rec_id").join(known.unionByName(lone), "h").select("rec_id", "entity")


def places(labels: DataFrame, units: DataFrame, master: DataFrame, stats: tuple) -> tuple[DataFrame, DataFrame]:
    """``(q, upv, psim)``: the provinces a typed text may mean; ``(rk, rid)``: the region a text without a number means."""
    alias, regions = province_aliases(units), region_names(master)
    block = lambda b, c: (F.lit(b).alias("block"), F.col(c).alias("text"))
    typed = labels.select(*block("p", "pv")).unionByName(labels.select(*block("p", "pnote"))).unionByName(labels.filter("not rk rlike '^[0-9]+$'").select(*block("r", "rk"))).filter("text <> ''")
    known = alias.select(*block("p", "text")).unionByName(regions.select(*block("r", "text")))
    pairs = materialize(similar_pairs(typed, known, stats, 0.25, 0.5, NEAR_PLACE), "variants-places")
    p = pairs.filter("block = 'p' and sim >= 0.6").join(alias.select(F.col("text").alias("m"), F.col("pv").alias("upv")), "m").groupBy("q", "upv").agg(F.max("sim").alias("psim"))
    p = p.withColumn("top", F.max("psim").over(W.partitionBy("q"))).filter(F.col("psim") >= F.col("top") - NEAR_PLACE).drop("top")
    r = pairs.filter("block = 'r'").join(regions.withColumnRenamed("text", "m").withColumnRenamed("rk", "rid"), "m").groupBy(F.col("q").alias("rk")).agg(F.max_by("rid", F.struct("sim", "rid")).alias("rid"))
    return p, r


def gather(d: DataFrame, hp: DataFrame, region_of: DataFrame, stats: tuple) -> DataFrame:
    """``(h, entity)`` of names the master lacks: each spelling points to the most used similar one of its region.

    A spelling without a region points to the most similar one of any region.
    Pointers go from rarer to commoner spellings and from unknown to known
    regions only, so they form trees; their roots are found by doubling the
    pointers until none moves, without collecting a component.
    """
    place = hp.groupBy("h").agg(F.max_by("upv", F.struct(F.coalesce("ps", "pn"), "upv")).alias("upv")).join(region_of, "upv", "left")
    x = d.join(place, "h", "left").withColumn("block", F.coalesce("rg", "urg", F.lit("*")))
    x = materialize(x.select("h", "nm", "block", "n_labels"), "variants-lone")
    use = x.groupBy("block", F.col("nm").alias("q")).agg(F.sum("n_labels").alias("uq"))
    um = use.select("block", F.col("q").alias("m"), F.col("uq").alias("um"))
    text = lambda df: df.select("block", F.col("q").alias("text"))
    s = similar_pairs(text(use), text(use), stats, 0.3, LEAST_ALONE).filter("q <> m")
    s = s.join(use, ["block", "q"]).join(um, ["block", "m"])
    up = s.filter((F.col("um") > F.col("uq")) | ((F.col("um") == F.col("uq")) & (F.col("m") < F.col("q"))))
    ptr = up.groupBy("block", "q").agg(F.max_by(F.struct("block", "m"), F.struct("um", "sim", F.negative(F.xxhash64("m")))).alias("p"))
    lost = text(use.filter("block = '*'"))
    far = similar_pairs(lost, text(use.filter("block <> '*'")).withColumn("block", F.lit("*")), stats, 0.3, LEAST_ALONE).drop("block").join(um.filter("block <> '*'"), "m")
    far = far.groupBy("q").agg(F.max_by(F.struct("block", "m"), F.struct("sim", "um", F.negative(F.xxhash64("m", "block")))).alias("far")).withColumn("block", F.lit("*"))
    ptr = use.join(ptr, ["block", "q"], "left").join(far, ["block", "q"], "left").select("block", "q", F.coalesce("far", "p", F.struct("block", F.col("q").alias("m"))).alias("p"))
    ptr = ptr.select("block", "q", F.col("p.block").alias("tb"), F.col("p.m").alias("to"))
    while True:
        ptr = materialize(ptr, "variants-pointers")
        nxt = ptr.select(F.col("block").alias("tb"), F.col("q").alias("to"), F.col("tb").alias("b2"), F.col("to").alias("t2"))
        ptr = ptr.join(nxt, ["tb", "to"]).select("block", "q", "b2", "t2", ((F.col("tb") != F.col("b2")) | (F.col("to") != F.col("t2"))).alias("moved"))
        ptr = materialize(ptr, "variants-pointers")
        if ptr.filter("moved").isEmpty():
            break
        ptr = ptr.select("block", "q", F.col("b2").alias("tb"), F.col("t2").alias("to"))
    return x.join(ptr.withColumnRenamed("q", "nm"), ["block", "nm"]).select("h", F.concat_ws("|", F.lit("?"), "b2", "t2").alias("entity"))


def variant_pairs(linked: DataFrame) -> DataFrame:
    """All pairs ``(label_a, label_b)`` of labels of one entity, the smaller first. Ids are integers."""
    x = linked.select("entity", F.col("rec_id").cast("bigint").alias("id"))
    y = x.select("entity", F.col("id").alias("other"))
    return x.join(y, "entity").filter("id < other").select(F.col("id").alias("label_a"), F.col("other").alias("label_b"))


def classes(linked: DataFrame) -> DataFrame:
    """One row per label with its entity and its number of links."""
    n = linked.groupBy("entity").agg((F.count(F.lit(1)) - 1).alias("n_links"))
    return linked.join(n, "entity").select("rec_id", "entity", "n_links")
