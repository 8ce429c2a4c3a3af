import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelwright.ml import explain, models


def data(spark, n=400):
    rnd = random.Random(4)
    rows = []
    for i in range(n):
        a, b, c = rnd.random(), rnd.gauss(0, 1), rnd.choice("xyz")
        rows.append((i, "F1", "train" if i % 4 else "test", a if i % 9 else None, b, c, min(1.0, max(0.0, 0.2 + 0.5 * a + (c == "x") * 0.2 + rnd.gauss(0, 0.02)))))
    return spark.createDataFrame(rows, "id int, fold string, part string, a double, b double, c string, target double")


def test_ridge_equals_the_closed_form(spark):
    rnd = np.random.default_rng(0)
    x = rnd.normal(size=(200, 2))
    y = x @ [1.0, -2.0] + 3 + rnd.normal(size=200) * 0.1
    df = spark.createDataFrame([(float(p), float(q), float(t)) for (p, q), t in zip(x, y, strict=True)], "a double, b double, target double")
    m = models.ridge(["a", "b"], [], "target", 5.0, 200, float(y.std())).fit(df)
    s = (x - x.mean(0)) / x.std(0, ddof=1)
    w = np.linalg.solve(s.T @ s + 5.0 * np.eye(2), s.T @ (y - y.mean()))
    assert np.allclose(m.stages[-1].coefficients.toArray(), w, atol=1e-4)


def test_evaluation_beats_the_mean(spark):
    d = data(spark).withColumn("empty", F.lit(None).cast("double"))
    p = models.evaluate(d, "target", ["a", "b", "empty"], ["c"], {"ridge": models.ridge_for("target"), "boosted": lambda n, c, _t: models.boosted(n, c, "target", rounds=10, depth=3)})
    from panelwright.ml.folds import scores

    s = {r["model"]: r["r2"] for r in scores(p).collect()}
    assert s["ridge"] > 0.5 and s["boosted"] > 0.5


def test_contributions_sum_to_the_prediction(spark, tmp_path):
    d = models.as_features(data(spark, 200), ["a", "b"], ["c"], True)
    m = models.boosted(["a", "b"], ["c"], "target", rounds=4, depth=3, leaf=5).fit(d)
    models.save(m, str(tmp_path / "m"))
    m = models.load(str(tmp_path / "m"))
    names = ["a", "b", "a_missing", "b_missing", "c"]
    out = explain.contributions(m.transform(d), explain.export_trees(m.stages[-1]), ["id", "prediction"], "features", names).toPandas()
    assert np.allclose(out[names].sum(axis=1) + out["bias"], out["prediction"], atol=1e-9)
    # exact Shapley values of a small tree by enumeration of all subsets
    tree = {"f": 0, "t": 0.5, "c": 10, "l": {"v": 1.0, "c": 4}, "r": {"f": 1, "t": 0.0, "c": 6, "l": {"v": 2.0, "c": 2}, "r": {"v": 5.0, "c": 4}}}

    def value(n, x, known):
        if "v" in n:
            return n["v"]
        if n["f"] in known:
            return value(n["l"] if x[n["f"]] <= n["t"] else n["r"], x, known)
        return (n["l"]["c"] * value(n["l"], x, known) + n["r"]["c"] * value(n["r"], x, known)) / n["c"]

    x, got = np.array([0.7, 1.0]), np.zeros(2)
    explain.tree_contributions(tree, x, got, 1.0)
    phi0 = 0.5 * (value(tree, x, {0}) - value(tree, x, set())) + 0.5 * (value(tree, x, {0, 1}) - value(tree, x, {1}))
    phi1 = 0.5 * (value(tree, x, {1}) - value(tree, x, set())) + 0.5 * (value(tree, x, {0, 1}) - value(tree, x, {0}))
    assert got == pytest.approx([phi0, phi1])


def test_batches_equal_the_walk_of_single_rows(spark):
    d = models.as_features(data(spark, 200), ["a", "b"], ["c"], True)
    m = models.boosted(["a", "b"], ["c"], "target", rounds=5, depth=5, leaf=3).fit(d)
    trees = explain.export_trees(m.stages[-1])
    x = np.array([r[0].toArray() for r in m.transform(d).select("features").collect()])
    want = np.zeros((len(x), 5))
    for row, out in zip(x, want, strict=True):
        for w, t in trees:
            explain.tree_contributions(t, row, out, w)
    assert np.allclose(explain.batch_contributions([(w, explain._flat(t)) for w, t in trees], x, 5), want, atol=1e-9)


def test_clusters_and_signatures(spark):
    rows = [(f"e{i}", float(i % 2 * 10 + i * 0.01), float(i % 2)) for i in range(30)]
    c = explain.clusters(spark.createDataFrame(rows, "id string, a double, b double"), "id", ["a", "b"], k=2, seeds=2)
    got = {r["id"]: r["cluster"] for r in c.collect()}
    assert got["e0"] == got["e2"] != got["e1"]
    assert explain.signatures(c, ["a", "b"], 1).count() == 2 and explain.exemplars(c, "id", ["a", "b"], 3).count() == 6


def test_codes_of_unseen_values(spark):
    d = spark.createDataFrame([("a",), ("b",), (None,)], "c string")
    codes = models.category_codes(d.filter("c = 'a'"), "c")
    assert {r["c"]: r["x"] for r in models.with_codes(d, codes, "c", "x").collect()} == {"a": 0, "b": -1, None: -1}


def test_search_is_seeded(spark):
    t = models.search(data(spark, 120), "target", ["a", "b"], ["c"], trials=2)
    assert len(t) == 2 and t[0]["rmse"] <= t[1]["rmse"]
