"""Records matched across sources that share no key, each match with a confidence.

Records, the values of their attributes and the tokens of these values form a
graph. Random walks over it (record, attribute value, token, another value
that has the token, its tokens) train skip-gram vectors of the token nodes; a
value's vector is the weighted mean of its tokens', so values never seen before
have one and the model's size is bounded by its number of token buckets.
Values are blocked by several tables of random hyperplanes, candidates are
scored exactly, by cosine and then by edits, and the scores are calibrated to
probabilities on values with known partners. Matches of values are then put
together to matches of records, level by level of evidence.
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import materialize
from . import names

#: Token and attribute buckets (the vocabulary is their sum), vector length, hash tables, sampled units for calibration.
TOKENS, ATTRIBUTES, DIM, TABLES, CALIBRATED = 8192, 8192, 48, 28, 1500
#: Rounds, shared negative samples, negatives a pair and step of the training; window of the skip-grams.
ROUNDS, NEGATIVES, PER_PAIR, STEP, WINDOW = 6, 256, 5, 0.5, 2
#: Candidates below the least cosine are dropped, as are those that lie too far below a value's best cosine or similarity.
LEAST_COSINE, NEAR, SLACK, LEAST_SIM = 0.5, 0.3, 0.35, 0.5

#: What a candidate of a record brings to the decision.
EVIDENCE = ["h", "psgc10", "n_units", "nsim", "nlogit", "ps", "pn", "pv", "pnote", "rg", "urg", "lvn", "lvt", "ulv"]

_PARTS = "nm string, wd string, ti string, co string, sk string, lvn string, lvt string, pv string, pnote string, rk string"


def normalized(records: DataFrame) -> DataFrame:
    """``src, rec_id, name, province, region, type`` brought to parts: name, its words, title, core, skeleton, levels, province, note, region."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = {c: [] for c in ("nm", "wd", "ti", "co", "sk", "lvn", "lvt", "pv", "pnote", "rk")}
            for n, p, r, t in zip(pdf["name"], pdf["province"], pdf["region"], pdf["type"], strict=True):
                nm, ti, co, lv, note = names.parse(n)
                pv = names.parse(p)[0]
                rk = names.region_key(r)
                former = note.startswith("formerly")
                out["nm"].append(nm)
                out["wd"].append(names.words(n))
                out["ti"].append(ti)
                out["co"].append(co)
                out["sk"].append(names.skeleton(nm))
                out["lvn"].append(lv)
                out["lvt"].append(names.level_of(t))
                out["pv"].append("" if pv and rk.endswith(pv) and len(pv) < 5 else pv)
                out["pnote"].append("" if former else names.parse(note)[0] if note else "")
                out["rk"].append(rk)
            yield pd.DataFrame({"src": pdf["src"], "rec_id": pdf["rec_id"], **out})

    return records.select("src", "rec_id", "name", "province", "region", "type").mapInPandas(run, "src string, rec_id string, " + _PARTS)


def master_units(master: DataFrame) -> DataFrame:
    """One record per name a unit has or had: ``rec_id`` is its code; former names are records of their own."""
    cols = [F.lit("m").alias("src"), F.col("psgc10").alias("rec_id")]
    tail = [F.col("province_name").alias("province"), F.col("region_name").alias("region"), F.col("level").alias("type")]
    now = master.select(*cols, F.col("name").alias("name"), *tail)
    old = master.filter(F.length(F.trim(F.coalesce("old_names", F.lit("")))) > 0).select(*cols, F.explode(F.split("old_names", r"[;|/]|,\s")).alias("name"), *tail)
    return normalized(now.unionByName(old)).withColumn("lvn", F.col("lvt"))


def region_names(master: DataFrame) -> DataFrame:
    """``(text, rk)``: the wordings of each region's name that are not its number."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf["region_name"]:
                k, t = names.region_key(r), names.plain(r)
                inner = "".join(c for p in names._PAREN.findall(t) for c in p if "a" <= c <= "z")
                outer = "".join(c for c in names._PAREN.sub("", t) if "a" <= c <= "z")
                rows += [(x, k) for x in {inner, outer if not k.isdigit() else "", k if not k.isdigit() else ""} if x]
            yield pd.DataFrame(rows, columns=["text", "rk"])

    return master.select("region_name").filter("region_name is not null").distinct().mapInPandas(run, "text string, rk string").distinct()


def province_aliases(units: DataFrame) -> DataFrame:
    """``(text, pv)``: each province's name and the short forms made from its first letters and last word."""
    p = units.select("pv").filter("pv <> ''").distinct()
    tail = F.regexp_extract("pv", r"(oriental|occidental|delnorte|delsur|norte|sur)$", 1)
    head = F.substring(F.col("pv"), 1, 3)
    full = p.select(F.col("pv").alias("text"), "pv")
    short = p.select(F.concat(head, tail).alias("text"), "pv")
    return full.unionByName(short).filter("length(text) > 2").distinct()


def token_values(values: DataFrame) -> DataFrame:
    """``(kind, text)`` with ``vid``, its token buckets ``g`` and the bucket ``a`` of the value's own node."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf = pdf.copy()
            pdf["g"] = [names.grams(t, TOKENS) for t in pdf["text"]]
            split = [names.parts(t) for t in pdf["text"]]
            for i, c in enumerate(("ti", "co", "sk", "cc")):
                pdf[c] = [x[i] for x in split]
            yield pdf[["kind", "text", "g", "ti", "co", "sk", "cc"]]

    v = values.mapInPandas(run, "kind string, text string, g array<int>, ti string, co string, sk string, cc string")
    return v.withColumn("vid", F.xxhash64("kind", "text")).withColumn("a", (F.pmod("vid", F.lit(ATTRIBUTES)) + TOKENS).cast("int"))


def walks(recs: DataFrame, values: DataFrame, per_record: int = 2, seed: int = 11, salts: int = 8) -> DataFrame:
    """Sentences of nodes from random walks: a record's name and province with some tokens, one token, another value that has it.

    A token's values are numbered within ``salts`` parts of it, so the next
    step is a join on (token, part, number): a token that all values share
    costs no more than others and no list of its values is ever built. Every
    choice is a hash of the record, the walk and the seed, so the walks are the
    same in every run and on every cluster.
    """
    v = values.filter("size(g) > 0")
    edges = v.filter("kind <> 'r'").select("vid", F.explode("g").alias("t")).withColumn("s", F.pmod(F.xxhash64("vid", "t"), F.lit(salts)).cast("int"))
    numbered = edges.select("t", "s", F.col("vid").alias("vid2"), F.row_number().over(W.partitionBy("t", "s").orderBy("vid")).alias("i"))
    degree = edges.groupBy("t", "s").agg(F.count(F.lit(1)).alias("deg"))
    nv = v.filter("kind = 'n'").select(F.col("text").alias("nm"), F.col("a").alias("na"), F.col("g").alias("ng"))
    pv = v.filter("kind = 'p'").select(F.col("text").alias("pv"), F.col("a").alias("pa"), F.col("g").alias("pg"))
    r = recs.filter("nm <> ''").select("nm", "pv", "rk").distinct().join(nv, "nm").join(pv, "pv", "left")
    r = r.withColumn("ra", F.when(F.col("rk") != "", (F.pmod(F.xxhash64(F.lit("r"), "rk"), F.lit(ATTRIBUTES)) + TOKENS).cast("int")))
    r = r.withColumn("w", F.explode(F.sequence(F.lit(1), F.lit(per_record)))).withColumn("rh", F.xxhash64("nm", "pv", "rk", "w", F.lit(seed)))
    draw = lambda what, n: F.pmod(F.xxhash64("rh", F.lit(what)), n)
    r = r.withColumn("t", F.get("ng", draw("token", F.size("ng")).cast("int"))).withColumn("s", draw("part", F.lit(salts)).cast("int"))
    r = r.join(degree, ["t", "s"], "left").withColumn("i", draw("value", F.col("deg")).cast("int") + 1)
    r = r.join(numbered, ["t", "s", "i"], "left").join(v.select(F.col("vid").alias("vid2"), F.col("a").alias("a2"), F.col("g").alias("g2")), "vid2", "left")
    # tokens at steps of a drawn width from a drawn place on
    at = lambda g, i, what: F.get(g, F.pmod(draw(f"first {what}", F.size(g)) + i * (draw(f"width {what}", F.size(g) - 1) + 1), F.size(g)).cast("int"))
    some = lambda g, k: F.when(F.size(g) > 1, F.array_compact(F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: at(g, i, g))))).otherwise(F.coalesce(g, F.array().cast("array<int>")))
    one = lambda c: F.array_compact(F.array(c))
    nodes = F.concat(one("ra"), one("pa"), some("pg", 2), one("na"), some("ng", 6), one("t"), one("a2"), some("g2", 5))
    return r.select(nodes.alias("nodes"))


def skip_grams(sentences: DataFrame) -> DataFrame:
    """``(node, near, n, total)``: for each node the nodes within ``WINDOW`` of it in order, how often each is, and the sum.

    A task counts its sentences first and sends one row per node; the rows of a
    node are then added up one by one, so no more than one count per node of
    the vocabulary is held for it, however many tasks there are.
    """
    size = TOKENS + ATTRIBUTES
    counted = pa.schema([("node", pa.int32()), ("near", pa.list_(pa.int32())), ("n", pa.list_(pa.int64()))])

    def packed(nodes: list, near: list, n: list) -> pa.RecordBatch:
        ends = np.cumsum([0, *map(len, near)]).astype(np.int32)
        flat = lambda x, t: np.concatenate([np.zeros(0, t), *x]).astype(t)
        return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int32()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat(near, np.int32))), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat(n, np.int64)))], schema=counted)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, often = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for b in batches:
            c = b.column("nodes")
            flat, ends = c.values.to_numpy(zero_copy_only=False).astype(np.int64), c.offsets.to_numpy()
            sent = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
            flat = flat[ends[0] : ends[-1]]
            found = [keys]
            for d in range(1, WINDOW + 1):
                same = np.flatnonzero(sent[d:] == sent[:-d])
                x, y = flat[same], flat[same + d]
                both = x != y
                found += [x[both] << 32 | y[both], y[both] << 32 | x[both]]
            weight = np.concatenate([often, np.ones(sum(len(f) for f in found[1:]), np.int64)])
            keys, at = np.unique(np.concatenate(found), return_inverse=True)
            often = np.bincount(at, weight, len(keys)).astype(np.int64)
        node, near = keys >> 32, keys & 0xFFFFFFFF
        if len(node):
            cut = np.flatnonzero(np.diff(node)) + 1
            yield packed(node[np.concatenate([[0], cut])].tolist(), np.split(near, cut), np.split(often, cut))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, np.zeros(size, np.int64)
        for b in batches:
            done: tuple[list, list, list] = [], [], []
            near, n = b.column("near"), b.column("n")
            nf, cf, ends = near.values.to_numpy(), n.values.to_numpy(), near.offsets.to_numpy()
            for i, w in enumerate(b.column("node").to_pylist()):
                if w != now:
                    if now is not None:
                        some = np.flatnonzero(total)
                        for x, y in zip(done, (now, some, total[some]), strict=True):
                            x.append(y)
                        total[:] = 0
                    now = w
                total[nf[ends[i] : ends[i + 1]]] += cf[ends[i] : ends[i + 1]]
            yield packed(*done)
        if now is not None:
            some = np.flatnonzero(total)
            yield packed([now], [some], [total[some]])

    ddl = "node int, near array<int>, n array<bigint>"
    rows = sentences.mapInArrow(count, ddl).repartition("node").sortWithinPartitions("node").mapInArrow(add, ddl)
    return rows.withColumn("total", F.aggregate("n", F.lit(0).cast("bigint"), lambda a, x: a + x))


def _stepped(node: np.ndarray, near: np.ndarray, n: np.ndarray, ends: np.ndarray, u: np.ndarray, negatives: np.ndarray) -> np.ndarray:
    """The vectors of some nodes after a step down the skip-gram loss of all their pairs, with shared negative samples."""
    mine, owner = u[node], np.repeat(np.arange(len(node)), np.diff(ends))
    total = np.add.reduceat(n, ends[:-1])
    x = u[near]
    pull = n / (1 + np.exp(np.clip(np.einsum("ed,ed->e", x, mine[owner]), -30, 30)))
    up = np.add.reduceat(x * pull[:, None], ends[:-1], axis=0)
    z = u[negatives]
    down = (1 / (1 + np.exp(np.clip(-(mine @ z.T), -30, 30)))) @ z * (PER_PAIR * total / len(negatives))[:, None]
    return mine + STEP * (up - down) / total[:, None]


def train(sentences: DataFrame, seed: int = 11) -> np.ndarray:
    """Skip-gram vectors of the token buckets, learned with negative sampling; buckets that were not met have zeros.

    The pairs of all walks are counted once, grouped by node and written. A
    round then takes every node a step down the loss of all its pairs, against
    the vectors of the round before, so it needs no order of sentences and no
    merging of diverging copies: the outcome does not depend on how the data
    are spread. As walks are counted both ways, the vectors of centres and of
    contexts would stay equal and are one table. Negative samples are drawn per
    round by the nodes' frequencies to the power 0.75. Vectors start from
    random signs summed over the nodes around each. The driver holds the table,
    whose size is fixed by ``TOKENS + ATTRIBUTES``.
    """
    spark, nodes = sentences.sparkSession, TOKENS + ATTRIBUTES
    rows = materialize(skip_grams(sentences), "match-skip-grams")
    often = np.zeros(nodes)
    for r in rows.select("node", "total").collect():  # at most one row per node of the vocabulary
        often[r["node"]] = r["total"]
    if not often.any():
        return np.zeros((TOKENS, DIM), np.float32)
    rnd = np.random.default_rng(seed)
    rare = np.log(1 + often.sum() / np.maximum(often, 1))
    u = (rnd.choice(np.array([-1.0, 1.0]), (nodes, DIM)) * rare[:, None]).astype(np.float32)

    def round_of(step: int, shared) -> pa.Table:  # noqa: ANN001
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            u, negatives = shared.value
            for whole in batches:
                for k in range(0, whole.num_rows, 512):
                    b = whole.slice(k, 512)
                    near, ends = b.column("near").flatten().to_numpy(), b.column("near").offsets.to_numpy()
                    n, ends, node = b.column("n").flatten().to_numpy().astype(np.float32), ends - ends[0], b.column("node").to_numpy()
                    if step:
                        x = _stepped(node, near, n, ends, u, negatives)
                    else:
                        x = np.add.reduceat(u[near] * n[:, None], ends[:-1], axis=0)
                        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
                    cells = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, DIM, dtype=np.int32)), pa.array(x.astype(np.float32).reshape(-1)))
                    yield pa.RecordBatch.from_arrays([b.column("node"), cells], names=["node", "x"])

        return rows.select("node", "near", "n").mapInArrow(run, "node int, x array<float>").toArrow()

    share = often**0.75 / (often**0.75).sum()
    for step in range(ROUNDS + 1):
        shared = spark.sparkContext.broadcast((u, rnd.choice(nodes, NEGATIVES, p=share)))  # of fixed size
        got = round_of(step, shared)
        u = u.copy()
        u[got.column("node").to_numpy()] = np.asarray(got.column("x").combine_chunks().flatten(), np.float32).reshape(-1, DIM)
        shared.destroy()
    out = np.where(often[:TOKENS, None] > 0, u[:TOKENS], 0)
    seen = often[:TOKENS] > 0
    if seen.any():
        out[seen] -= out[seen].mean(0)
        # the strongest common direction says nothing about a value
        d = np.linalg.svd(out[seen], full_matrices=False)[2][0]
        out[seen] -= (out[seen] @ d)[:, None] * d
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def node_vectors(trained: np.ndarray, seed: int = 11) -> np.ndarray:
    """The trained vectors; buckets that no walk met get random ones of the same length, so they tell apart what has them."""
    noise = np.random.default_rng(seed).standard_normal(trained.shape).astype(np.float32)
    return np.where(np.abs(trained).sum(1, keepdims=True) > 0, trained, noise / np.linalg.norm(noise, axis=1, keepdims=True))


def embed(g: list, model: np.ndarray, idf: np.ndarray) -> np.ndarray:
    out = np.zeros((len(g), model.shape[1]), np.float32)
    for i, b in enumerate(g):
        b = np.asarray(b, int)
        out[i] = (model[b] * idf[b, None]).sum(0)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def hashed(values: DataFrame, shared, bits: dict[str, int], seed: int = 5) -> DataFrame:  # noqa: ANN001
    """``(bk, vid, vec, sig)``: one row per value and table of hyperplanes.

    ``bk`` packs attribute, table and bucket; ``vec`` is the vector in signed
    bytes and ``sig`` the value's buckets in all tables.
    """
    kinds, width = sorted(bits), signature_type(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, idf = shared.value
        planes = np.random.default_rng(seed).standard_normal((DIM, TABLES, max(bits.values()))).astype(np.float32)
        for b in batches:
            kind = np.array([kinds.index(k) for k in b.column("kind").to_pylist()], np.int64)
            n = len(kind)
            x = embed(b.column("g").to_pylist(), model, idf)
            q = np.round(x / np.maximum(np.abs(x).max(1, keepdims=True), 1e-9) * 127).astype(np.int8)
            signs = np.einsum("nd,dtk->ntk", x, planes) > 0
            code = np.zeros((n, TABLES), np.uint32)
            for i, k in enumerate(kinds):
                rows = np.flatnonzero(kind == i)
                code[rows] = signs[rows][:, :, : bits[k]] @ (1 << np.arange(bits[k])).astype(np.uint32)
            bk = (kind[:, None] << 48) | (np.arange(TABLES, dtype=np.int64)[None, :] << 32) | code.astype(np.int64)
            at = np.repeat(np.arange(n), TABLES)
            vec, sig = [r.tobytes() for r in q], [r.tobytes() for r in code.astype(width)]
            cols = [pa.array(bk.reshape(-1)), pa.array(b.column("vid").to_numpy()[at]), pa.array([vec[i] for i in at], pa.binary()), pa.array([sig[i] for i in at], pa.binary())]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(b.column("is_q").to_numpy()[at]), pa.array(b.column("is_m").to_numpy()[at])], names=["bk", "vid", "vec", "sig", "is_q", "is_m"])

    return values.select("kind", "vid", "g", "is_q", "is_m").mapInArrow(run, "bk bigint, vid bigint, vec binary, sig binary, is_q int, is_m int")


def signature_type(bits: dict[str, int]) -> type:
    return np.uint16 if max(bits.values()) <= 16 else np.uint32


def _fixed(column: pa.Array, width: int, dtype: type) -> np.ndarray:
    """Binary cells of one width as a matrix, without copying them one by one."""
    raw = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    first = np.frombuffer(column.buffers()[1], np.int32)[column.offset] if len(column) else 0
    return raw[first : first + len(column) * width].view(dtype).reshape(len(column), -1)


def candidates(hashes: DataFrame, width: type, least: float = LEAST_COSINE, block: int = 2048) -> DataFrame:
    """``(qid, mid, cosine)`` of values that share a bucket in any table, scored exactly, each pair once.

    Buckets are sorted within partitions, known values first, and typed values
    stream past them in blocks; a pair counts in the first table that holds
    it, so nothing has to be made distinct. A bucket with more than ``block``
    known or typed values is dealt to as many tasks as it has pairs of such
    blocks, so a task holds one block of known values however hot the bucket.
    """
    size = hashes.select("bk", "is_q", "is_m").groupBy("bk").agg(F.sum("is_q").alias("nq"), F.sum("is_m").alias("nm")).filter(F.col("nq") * F.col("nm") > block * block)
    size = size.select("bk", F.ceil(F.col("nq") / block).cast("int").alias("pq"), F.ceil(F.col("nm") / block).cast("int").alias("pm"))
    # written, so that its few rows are known to be few and the hashes are not shuffled to meet them
    h = hashes.join(materialize(size, "match-hot"), "bk", "left").withColumn("pq", F.coalesce("pq", F.lit(1))).withColumn("pm", F.coalesce("pm", F.lit(1)))
    place = lambda n: F.pmod(F.xxhash64("vid"), F.col(n)).cast("int")
    parts = lambda there, n, part, side: F.when(F.col(there) == 1, F.transform(F.sequence(F.lit(0), F.col(n) - 1), lambda i: F.struct(part(i).alias("part"), F.lit(side).alias("side")))).otherwise(F.array().cast("array<struct<part:int,side:int>>"))
    both = F.concat(parts("is_m", "pq", lambda i: i * F.col("pm") + place("pm"), 0), parts("is_q", "pm", lambda j: place("pq") * F.col("pm") + j, 1))
    rows = h.select("bk", F.explode(both).alias("to"), "vid", "vec", "sig").select("bk", "to.*", "vid", "vec", "sig")
    rows = rows.repartition(F.col("bk"), F.col("part")).sortWithinPartitions("bk", "part", "side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, known = None, []  # the bucket at hand and its known values
        for b in batches:
            n = b.num_rows
            if n == 0:
                continue
            bk, part, side, vid = (b.column(c).to_numpy() for c in ("bk", "part", "side", "vid"))
            vec = _fixed(b.column("vec"), DIM, np.int8).astype(np.float32)
            vec /= np.maximum(np.linalg.norm(vec, axis=1, keepdims=True), 1e-9)
            sig = _fixed(b.column("sig"), np.dtype(width).itemsize * TABLES, width)
            cut = np.flatnonzero((np.diff(bk) != 0) | (np.diff(part) != 0)) + 1
            out = []
            for i, j in zip([0, *cut], [*cut, n], strict=True):
                key = (bk[i], part[i])
                if key != now:
                    now, known = key, []
                s = i + int(np.searchsorted(side[i:j], 1))
                if s > i:
                    known.append((vid[i:s], vec[i:s], sig[i:s]))
                t = int(bk[i] >> 32) & 0xFFFF
                for u in range(s, j, 2048):
                    v = min(j, u + 2048)
                    for kv, kx, ks in known:
                        cos = vec[u:v] @ kx.T
                        # the best of a block is at most the best of all, so nothing near that is lost here
                        x, y = np.nonzero(cos >= np.maximum(cos.max(1) - NEAR, least)[:, None])
                        if t and len(x):
                            first = ~(sig[u:v][x, :t] == ks[y, :t]).any(1)
                            x, y = x[first], y[first]
                        if len(x):
                            out.append((vid[u:v][x], kv[y], cos[x, y]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[0] for o in out])), pa.array(np.concatenate([o[1] for o in out])), pa.array(np.concatenate([o[2] for o in out]).astype(np.float64))], names=["qid", "mid", "cosine"])

    return rows.mapInArrow(run, "qid bigint, mid bigint, cosine double")


def misspell(text: str, rnd: random.Random) -> str:
    """One or two of the slips that typists and scanners make."""
    swaps = {"e": "i", "i": "e", "o": "u", "u": "o", "v": "b", "k": "c", "p": "f", "a": "e", "l": "i", "n": "m"}
    for _ in range(rnd.choice((1, 1, 2))):
        if len(text) < 4:
            break
        i = rnd.randrange(len(text) - 1)
        kind = rnd.random()
        if kind < 0.25:
            text = text[:i] + text[i + 1 :]
        elif kind < 0.5:
            text = text[:i] + text[i + 1] + text[i] + text[i + 2 :]
        elif kind < 0.75:
            text = text[:i] + swaps.get(text[i], text[i]) + text[i + 1 :]
        else:
            text = text[: i + 1] + text[i] + text[i + 1 :]
    return text


def samples(units: DataFrame, seed: int = 3) -> tuple[DataFrame, DataFrame]:
    """Typed records made of ``CALIBRATED`` units of the master, and ``(h, code, gone)``: the unit each names, and whether it counts as missing.

    Names and provinces get the slips of ``misspell``; fields are left out, and
    some name a neighbouring province (of the same region) or another level, as
    typists do. For a fifth the unit is taken for one that the master lacks, so
    its candidates are all wrong.
    """
    rows = units.filter("nm <> ''").select("rec_id", "nm", "pv", "rk", "lvt").orderBy(F.xxhash64("rec_id", "nm"), "rec_id", "nm").limit(CALIBRATED).collect()  # the stated bound
    rnd, out, beside = random.Random(seed), [], {}
    for r in rows:
        beside.setdefault(r["rk"], []).append(r)
    for i, r in enumerate(rows):
        other = beside[r["rk"]][rnd.randrange(len(beside[r["rk"]]))]
        nm = misspell(r["nm"], rnd) if rnd.random() < 0.6 else r["nm"]
        x = rnd.random()
        pv = r["pv"] if x < 0.65 else misspell(r["pv"], rnd) if x < 0.8 else "" if x < 0.9 else other["pv"]
        rk = r["rk"] if rnd.random() < 0.8 else ""
        x = rnd.random()
        lvt = r["lvt"] if x < 0.85 else "" if x < 0.95 else other["lvt"]
        lvn = r["lvt"] if rnd.random() < 0.3 else ""
        out.append((f"{i}", nm, pv, rk, lvn, lvt, r["rec_id"], i % 5 == 0))
    df = units.sparkSession.createDataFrame(out, "rec_id string, nm string, pv string, rk string, lvn string, lvt string, code string, gone boolean")
    recs = df.select(F.lit("made").alias("src"), "rec_id", "nm", F.lit("").alias("pnote"), "pv", "rk", "lvn", "lvt")
    return recs, df.select("rec_id", "code", "gone")


#: What the evidence of a candidate weighs before anything is learned: name odds, name similarity above 0.7, similarity of the
#: typed province, that it fits, that it does not, that the province in brackets fits, region fits, differs, level of the name
#: fits, differs, level of the type fits, differs, differs by a province; ``HOLD`` is the share by which a weight may move freely.
HOLD = 0.1
PRIOR = np.array([0.0, 1.0, 14.0, 1.5, 0.7, -1.6, 2.0, 0.8, -2.5, 1.2, -1.6, 0.8, -0.6, -3.0])


def features() -> list[Column]:
    """A candidate's evidence as numbers, in the order of ``PRIOR``."""
    f = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    region = F.col("rg").isNotNull() & (F.col("urg") != "")
    typed = (F.col("lvt") != "") & (F.col("lvt") != F.col("ulv"))
    apart = (F.col("lvt") == "province") | ((F.col("ulv") == "province") & (F.col("lvn") != "province"))
    return [
        F.lit(1.0), F.least("nlogit", F.lit(6.0)), F.col("nsim") - 0.70, F.coalesce("ps", F.lit(0.0)), f(F.col("ps").isNotNull()), f(F.col("ps").isNull() & (F.col("pv") != "")), f(F.col("pn").isNotNull()),
        f(region & (F.col("rg") == F.col("urg"))), f(region & (F.col("rg") != F.col("urg"))), f((F.col("lvn") != "") & (F.col("lvn") == F.col("ulv"))), f((F.col("lvn") != "") & (F.col("lvn") != F.col("ulv"))),
        f((F.col("lvt") != "") & (F.col("lvt") == F.col("ulv"))), f(typed & ~apart), f(typed & apart),
    ]


def calibrate(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of a logistic model that a candidate is the right one, drawn towards ``PRIOR`` as far as the labelled rows do not say otherwise."""
    w, hold = PRIOR.copy(), np.diag(1 / (HOLD * np.abs(PRIOR) + np.where(PRIOR == 0, 1.0, 0.05)) ** 2)
    if len(y) < 40 or y.all() or not y.any():
        return w
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + hold
        move = np.linalg.solve(h, x.T @ (y - p) - hold @ (w - PRIOR))
        w = w + move * min(1.0, 2.0 / max(np.abs(move).max(), 1e-9))
        if np.abs(move).max() < 1e-6:
            break
    return w


def value_matches(recs: DataFrame, units: DataFrame, regions: DataFrame, alias: DataFrame) -> DataFrame:
    """``(kind, q, m, sim, logit)``: for names, provinces and regions as typed, the master's values they may mean."""
    typed = reduce(
        DataFrame.unionByName,
        [
            recs.select(F.lit("n").alias("kind"), F.col("nm").alias("text")),
            recs.select(F.lit("p").alias("kind"), F.col("pv").alias("text")),
            recs.select(F.lit("p").alias("kind"), F.col("pnote").alias("text")),
            recs.filter(~F.col("rk").rlike(r"^\d+$")).select(F.lit("r").alias("kind"), F.col("rk").alias("text")),
        ],
    ).filter("text <> ''").distinct()
    known = units.select(F.lit("n").alias("kind"), F.col("nm").alias("text")).unionByName(alias.select(F.lit("p").alias("kind"), "text")).unionByName(regions.select(F.lit("r").alias("kind"), "text")).filter("text <> ''").distinct()
    q, m = typed.withColumn("side", F.lit(0)), known.withColumn("side", F.lit(1))
    sides = q.unionByName(m).groupBy("kind", "text").agg(F.max((F.col("side") == 0).cast("int")).alias("is_q"), F.max((F.col("side") == 1).cast("int")).alias("is_m"))
    vals = materialize(token_values(sides.select("kind", "text")).join(sides, ["kind", "text"]), "match-values")
    counts = {r["kind"]: r["n"] for r in vals.filter("is_m = 1").groupBy("kind").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per attribute
    bits = {k: min(31, max(2, math.ceil(math.log2(max(2, counts.get(k, 1)))) - 5)) for k in ("n", "p", "r")}
    model = node_vectors(train(walks(recs.filter("src <> 'made'").select("nm", "pv", "rk").unionByName(units.select("nm", "pv", "rk")), vals)))
    df = vals.select(F.explode("g").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("c")).collect()  # at most TOKENS rows
    total = sum(r["c"] for r in df) / 12 + 1
    idf = np.zeros(TOKENS, np.float32)
    for r in df:
        idf[r["t"]] = math.log(1 + total / r["c"])
    shared = recs.sparkSession.sparkContext.broadcast((model, idf))  # fixed size
    pairs = candidates(hashed(vals, shared, bits), signature_type(bits))
    # a value's right partner lies near its best cosine, so edits are counted for few pairs
    pairs = pairs.withColumn("top", F.max("cosine").over(W.partitionBy("qid"))).filter(F.col("cosine") >= F.col("top") - NEAR).drop("top")
    # written, so that the shuffle of vectors is gone from the disk before texts are joined
    pairs = materialize(pairs, "match-candidates")
    side = lambda x, *more: vals.select(F.col("vid").alias(f"{x}id"), F.col("text").alias(x), *more, *[F.col(c).alias(f"{x}_{c}") for c in ("ti", "co", "sk", "cc")])
    p = pairs.join(side("q", F.col("kind")), "qid").join(side("m"), "mid")
    p = p.withColumn("sim", names.name_similarity(("q_ti", "q_co", "q", "q_sk", "q_cc"), ("m_ti", "m_co", "m", "m_sk", "m_cc")))
    p = p.filter(F.col("sim") >= LEAST_SIM).withColumn("best", F.max("sim").over(W.partitionBy("kind", "q"))).filter(F.col("sim") >= F.col("best") - SLACK)
    # odds of a name before anything else is known of the record, from the stated weights of cosine and similarity
    logit = -13 + 6 * F.col("cosine") + 13 * F.col("sim")
    return materialize(p.select("kind", "q", "m", "sim", "cosine", logit.alias("logit")), "match-pairs")


def match_records(recs: DataFrame, units: DataFrame, master: DataFrame, least: float = 0.5) -> DataFrame:
    """``(src, rec_id, psgc10, confidence)``: the unit each record names, none if the master seems to lack it.

    ``recs`` and ``units`` are normalized. Names are looked up in the typed
    province, in the province noted in brackets, in the region and in the whole
    master; a candidate's evidence adds up over name, province, region and
    level with weights fitted on records made of known units (``samples``), and
    the best one is taken.

    Defined results: records without a name, and such that name totals or
    notes, give no row; a null province or region is no evidence; repeated
    records each get their match; where several units fit equally well, no row
    is given; an empty master matches nothing.
    """
    made, truth = samples(units)
    recs = recs.select(*made.columns).unionByName(made)
    regions, alias = materialize(region_names(master), "match-regions"), materialize(province_aliases(units), "match-provinces")
    vm = value_matches(recs, units, regions, alias)
    n = vm.filter("kind = 'n'").select(F.col("q").alias("nm"), F.col("m").alias("unm"), F.col("sim").alias("nsim"), F.col("logit").alias("nlogit")).filter("nsim >= 0.56")
    pm = vm.filter("kind = 'p'").join(alias.withColumnRenamed("text", "m"), "m").groupBy("q", F.col("pv").alias("upv")).agg(F.max("sim").alias("psim"))
    pm = pm.withColumn("top", F.max("psim").over(W.partitionBy("q"))).filter("psim >= 0.6 and psim >= top - 0.12").drop("top")
    rm = vm.filter("kind = 'r'").join(regions.withColumnRenamed("text", "m").withColumnRenamed("rk", "rid"), "m").groupBy(F.col("q").alias("rk")).agg(F.max_by("rid", F.struct("sim", "rid")).alias("rid"), F.max("sim").alias("rsim")).filter("rsim >= 0.55").drop("rsim")
    r = recs.filter("nm <> ''").join(rm, "rk", "left")
    r = r.withColumn("rg", F.when(F.col("rk").rlike(r"^\d+$"), F.col("rk")).otherwise(F.col("rid")))
    r = r.select(F.xxhash64("nm", "pv", "pnote", "rg", "lvn", "lvt").alias("h"), "src", "rec_id", "nm", "pv", "pnote", "rg", "lvn", "lvt")
    r = materialize(r, "match-records")
    # records of the same parts are decided once
    d = materialize(r.drop("src", "rec_id").dropDuplicates(["h"]), "match-distinct")
    u = units.select(F.col("rec_id").alias("psgc10"), F.col("nm").alias("unm"), F.col("pv").alias("upv"), F.col("rk").alias("urg"), F.col("lvt").alias("ulv")).filter("unm <> ''").distinct()
    u = materialize(u, "match-units")
    hints = d.select("h", F.col("pv").alias("q"), F.lit(1).alias("typed")).unionByName(d.select("h", F.col("pnote").alias("q"), F.lit(2).alias("typed"))).filter("q <> ''")
    hp = hints.join(pm, "q").groupBy("h", "upv").agg(F.max(F.when(F.col("typed") == 1, F.col("psim"))).alias("ps"), F.max(F.when(F.col("typed") == 2, F.col("psim"))).alias("pn"))
    # each record beside the units whose names it may mean: in its province, and elsewhere where the name fits well
    named = materialize(d.join(n, "nm"), "match-named")
    inside = named.join(hp, "h").join(alike(u, "upv"), ["unm", "upv"])
    null = F.lit(None).cast("double")
    far = named.filter("nsim >= 0.75").withColumn("ps", null).withColumn("pn", null)
    near = far.filter("rg is not null").join(alike(u).withColumn("rg", F.col("urg")), ["unm", "rg"])
    whole = far.filter("nsim >= 0.88 or (pv = '' and pnote = '' and rg is null)").join(alike(u), "unm")
    c = materialize(inside.select(*EVIDENCE).unionByName(near.select(*EVIDENCE)).unionByName(whole.select(*EVIDENCE)).distinct(), "match-evidence")
    best = decide(c, least, learned(c, r.filter("src = 'made'").select("h", "rec_id"), truth))
    return r.filter("src <> 'made'").select("h", "src", "rec_id").join(best, "h").select("src", "rec_id", "psgc10", "confidence", F.col("nsim").alias("name_similarity"))


def alike(u: DataFrame, *place: str) -> DataFrame:
    """Units that the evidence cannot tell apart as one row: ``(unm, place, urg, ulv, psgc10, n_units)``.

    A name that thousands of units bear has as many rows as there are regions
    and levels, so no candidate has to be left out for it.
    """
    return u.groupBy("unm", *place, "urg", "ulv").agg(F.min("psgc10").alias("psgc10"), F.count_distinct("psgc10").cast("int").alias("n_units"))


def learned(c: DataFrame, made: DataFrame, truth: DataFrame) -> np.ndarray:
    """``calibrate`` on the candidate that would be taken for each made record, right or wrong, its unit left out where it counts as missing."""
    x = c.join(made, "h").join(truth, "rec_id").withColumn("right", F.col("psgc10") == F.col("code")).filter("not (right and gone)")
    x = x.select("rec_id", F.col("right").cast("double").alias("right"), F.array(*features()).alias("x"))
    x = x.groupBy("rec_id").agg(F.max(F.struct(F.round(sum((F.get("x", i) * float(w) for i, w in enumerate(PRIOR)), F.lit(0.0)), 9), "right", "x")).alias("b"))
    rows = x.select("b.x", "b.right").toPandas()  # one row for each made record that has a candidate
    if not len(rows):
        return PRIOR.copy()
    m = np.column_stack([np.array(rows["x"].tolist(), float), rows["right"].to_numpy(float)])
    m = m[np.lexsort(m.T)]
    return calibrate(m[:, :-1], m[:, -1])


def decide(c: DataFrame, least: float, weights: np.ndarray = PRIOR) -> DataFrame:
    """The best candidate of each ``h`` by the weighed evidence of name, province, region and level: ``(h, psgc10, confidence, nsim)``.

    Where several units have the same best evidence, none is taken.
    """
    c = c.withColumn("score", F.round(sum((x * float(w) for x, w in zip(features(), weights, strict=True)), F.lit(0.0)), 9))
    each = c.groupBy("h", "psgc10").agg(F.max(F.struct("score", "nsim", "n_units")).alias("b"))
    w = W.partitionBy("h")
    top = each.withColumn("top", F.max("b.score").over(w)).filter(F.col("b.score") == F.col("top"))
    best = top.groupBy("h").agg(F.min("psgc10").alias("psgc10"), F.sum("b.n_units").alias("n"), F.max("b.score").alias("score"), F.max("b.nsim").alias("nsim")).filter("n = 1")
    return best.select("h", "psgc10", (1 / (1 + F.exp(-F.col("score")))).alias("confidence"), "nsim").filter(F.col("confidence") >= least)


def panel_records(sre: DataFrame, psa: DataFrame | None = None) -> DataFrame:
    """The distinct typed labels of the fiscal rows and the rows of the poverty table as records to match."""
    lab = sre.groupBy("label_id").agg(F.min("lgu_name").alias("name"), F.min("province").alias("province"), F.min("region").alias("region"), F.min("lgu_type").alias("type"))
    out = lab.select(F.lit("sre").alias("src"), F.col("label_id").cast("string").alias("rec_id"), "name", "province", "region", "type")
    if psa is not None:
        out = out.unionByName(psa.select(F.lit("psa").alias("src"), F.col("psa_id").cast("string").alias("rec_id"), F.col("lgu_name").alias("name"), "province", "region", F.col("lgu_type").alias("type")))
    return normalized(out)
