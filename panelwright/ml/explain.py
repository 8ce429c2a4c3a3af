"""Contributions of features to tree predictions, their ranking, and clusters of entities by them."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def export_trees(model) -> list[tuple[float, dict]]:  # noqa: ANN001
    """Trees of a fitted forest or boosted model as nested dicts with covers, and each tree's weight."""

    def node(n) -> dict:  # noqa: ANN001
        cover = float(n.impurityStats().count())
        if n.subtreeDepth() == 0:
            return {"v": float(n.prediction()), "c": cover}
        s = n.split()
        kind = s.getClass().getSimpleName()
        test = {"f": int(s.featureIndex())}
        if kind == "ContinuousSplit":
            test["t"] = float(s.threshold())
        else:
            test["left"] = [float(x) for x in s.leftCategories()]
        return {**test, "c": cover, "l": node(n.leftChild()), "r": node(n.rightChild())}

    weights = list(model.treeWeights)
    if "Forest" in type(model).__name__:
        weights = [1.0 / len(weights)] * len(weights)
    return [(float(w), node(t._java_obj.rootNode() if hasattr(t, "_java_obj") else t._call_java("rootNode"))) for w, t in zip(weights, model.trees, strict=True)]


def _goes_left(n: dict, x: np.ndarray) -> bool:
    return x[n["f"]] <= n["t"] if "t" in n else x[n["f"]] in n["left"]


def expected(n: dict) -> float:
    if "v" in n:
        return n["v"]
    return (expected(n["l"]) * n["l"]["c"] + expected(n["r"]) * n["r"]["c"]) / max(n["c"], 1e-12)


def tree_contributions(root: dict, x: np.ndarray, out: np.ndarray, weight: float) -> None:
    """Path-dependent contributions of one tree, added to ``out`` (the published polynomial-time algorithm)."""

    def extend(path: list, zero: float, one: float, f: int) -> list:
        p = [q[:] for q in path] + [[f, zero, one, 1.0 if not path else 0.0]]
        n = len(p) - 1
        for i in range(n - 1, -1, -1):
            p[i + 1][3] += one * p[i][3] * (i + 1) / (n + 1)
            p[i][3] = zero * p[i][3] * (n - i) / (n + 1)
        return p

    def unwind(path: list, k: int) -> list:
        p, n = [q[:] for q in path], len(path) - 1
        one, zero, nxt = p[k][2], p[k][1], p[n][3]
        for i in range(n - 1, -1, -1):
            if one != 0:
                tmp = p[i][3]
                p[i][3] = nxt * (n + 1) / ((i + 1) * one)
                nxt = tmp - p[i][3] * zero * (n - i) / (n + 1)
            else:
                p[i][3] = p[i][3] * (n + 1) / (zero * (n - i))
        for i in range(k, n):
            p[i][:3] = p[i + 1][:3]
        return p[:n]

    def walk(n: dict, path: list, zero: float, one: float, f: int) -> None:
        path = extend(path, zero, one, f)
        if "v" in n:
            for i in range(1, len(path)):
                w = sum(q[3] for q in unwind(path, i))
                out[path[i][0]] += weight * w * (path[i][2] - path[i][1]) * n["v"]
            return
        hot, cold = (n["l"], n["r"]) if _goes_left(n, x) else (n["r"], n["l"])
        z, o = 1.0, 1.0
        k = next((i for i in range(1, len(path)) if path[i][0] == n["f"]), None)
        if k is not None:
            z, o = path[k][1], path[k][2]
            path = unwind(path, k)
        c = max(n["c"], 1e-12)
        walk(hot, path, z * hot["c"] / c, o, n["f"])
        walk(cold, path, z * cold["c"] / c, 0.0, n["f"])

    walk(root, [], 1.0, 1.0, -1)


def _flat(root: dict) -> tuple[list[dict], list[tuple]]:
    """Tests of a tree and, per leaf, the features of its path, the tests and sides each asks for, and the shares for every outcome.

    A feature either keeps to the leaf's path (1) or not (0), so a leaf over d
    features has 2^d outcomes; their Shapley shares are worked out once, with
    the same covers as in ``tree_contributions``, and looked up per row.
    """
    tests: list[dict] = []
    leaves: list[tuple] = []

    def walk(n: dict, path: dict[int, tuple[float, tuple]]) -> None:
        if "v" in n:
            if path:
                leaves.append((list(path), [q for _, q in path.values()], _shares(np.array([z for z, _ in path.values()])) * n["v"]))
            return
        tests.append({k: n[k] for k in ("f", "t", "left") if k in n})
        i = len(tests) - 1
        z, q = path.get(n["f"], (1.0, ()))
        for child, side in ((n["l"], True), (n["r"], False)):
            walk(child, path | {n["f"]: (z * child["c"] / max(n["c"], 1e-12), (*q, (i, side)))})

    walk(root, {})
    return tests, leaves


def _shares(zero: np.ndarray) -> np.ndarray:
    """``(d, 2^d)``: each feature's share of a leaf of value 1 by outcome, bit j of which is feature j."""
    d = len(zero)
    one = (np.arange(2**d)[None, :] >> np.arange(d)[:, None] & 1).astype(float)
    weight = [math.factorial(k) * math.factorial(d - k - 1) / math.factorial(d) for k in range(d)]
    out = np.empty((d, 2**d))
    for i in range(d):
        by_size = np.zeros((d, 2**d))  # subsets of the other features by size
        by_size[0] = 1.0
        for j in range(d):
            if j != i:
                by_size[1:] = by_size[1:] * zero[j] + by_size[:-1] * one[j]
                by_size[0] *= zero[j]
        out[i] = (one[i] - zero[i]) * (np.array(weight) @ by_size)
    return out


def batch_contributions(flat: list[tuple[float, tuple]], x: np.ndarray, n: int) -> np.ndarray:
    """``tree_contributions`` of all trees for all rows of ``x`` at once: ``(rows, n)``."""
    out, cols = np.zeros((n, len(x))), np.ascontiguousarray(x.T)
    for w, (tests, leaves) in flat:
        left = [cols[t["f"]] <= t["t"] if "t" in t else np.isin(cols[t["f"]], t["left"]) for t in tests]
        sides = [(~v, v) for v in left]
        for features, asked, shares in leaves:
            code = np.zeros(len(x), np.int32)
            for j, q in enumerate(asked):
                kept = sides[q[0][0]][q[0][1]]
                for i, side in q[1:]:
                    kept = kept & sides[i][side]
                code |= kept.astype(np.int32) << j
            for f, share in zip(features, shares, strict=True):
                out[f] += w * share[code]
    return out.T


def contributions(df: DataFrame, trees: list[tuple[float, dict]], keys: list[str], features: str, names: list[str]) -> DataFrame:
    """``keys``, one column per feature, ``bias``: they sum to the prediction. Rows are explained in Arrow batches."""
    bias = sum(w * expected(t) for w, t in trees)
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keys).schema)
    ddl += "".join(f", `{n}` double" for n in names) + ", bias double"
    shared = df.sparkSession.sparkContext.broadcast([(w, _flat(t)) for w, t in trees])  # a fitted model, bounded by its parameters

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = np.array(pdf["__x"].tolist(), float).reshape(len(pdf), -1)
            got = pd.DataFrame(batch_contributions(shared.value, x, len(names)) if len(pdf) else np.zeros((0, len(names))), columns=names)
            yield pd.concat([pdf[keys].reset_index(drop=True), got, pd.DataFrame({"bias": np.full(len(pdf), bias)})], axis=1)

    return df.select(*keys, vector_to_array(features).alias("__x")).mapInPandas(run, ddl)


def to_long(contrib: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    cells = F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).alias("value")) for n in names])
    return contrib.select(*keys, F.explode(cells).alias("c")).select(*keys, "c.*")


def clusters(entities: DataFrame, key: str, columns: list[str], k: int = 5, seeds: int = 10) -> DataFrame:
    """``entities`` with ``cluster``: standardized columns, k-means, the cheapest of several seeds."""
    v = VectorAssembler(inputCols=columns, outputCol="__v", handleInvalid="skip").transform(entities.fillna(0.0, subset=columns))
    s = StandardScaler(withMean=True, inputCol="__v", outputCol="__s").fit(v).transform(v)
    best = min((KMeans(k=k, seed=42 + i, featuresCol="__s", predictionCol="cluster", maxIter=30).fit(s) for i in range(seeds)), key=lambda m: m.summary.trainingCost)
    return best.transform(s).drop("__v", "__s")


def signatures(clustered: DataFrame, columns: list[str], top: int = 8) -> DataFrame:
    """The features in which each cluster's mean lies furthest from the mean of all."""
    long = to_long(clustered, ["cluster"], columns)
    m = long.groupBy("cluster", "feature").agg(F.avg("value").alias("mean"))
    g = long.groupBy("feature").agg(F.avg("value").alias("overall"))
    d = m.join(g, "feature").withColumn("delta", F.col("mean") - F.col("overall"))
    return d.withColumn("rank", F.row_number().over(W.partitionBy("cluster").orderBy(F.desc(F.abs("delta")), "feature"))).filter(F.col("rank") <= top)


def exemplars(clustered: DataFrame, key: str, columns: list[str], top: int = 5) -> DataFrame:
    """The entities nearest to their cluster's mean."""
    means = clustered.groupBy("cluster").agg(*[F.avg(c).alias(f"__{c}") for c in columns])
    j = clustered.join(F.broadcast(means), "cluster")  # one row per cluster
    d = sum([F.pow(F.col(c) - F.col(f"__{c}"), 2) for c in columns[1:]], F.pow(F.col(columns[0]) - F.col(f"__{columns[0]}"), 2))
    j = j.withColumn("distance", F.sqrt(d))
    return j.withColumn("rank", F.row_number().over(W.partitionBy("cluster").orderBy("distance", key))).filter(F.col("rank") <= top).select("cluster", key, "distance", "rank")
