import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from panelwright.llm import mixing, packing, tokens


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(1, 100), st.integers(1, 30), max_size=30))
def test_plan_packs_every_item_within_capacity(counts):
    groups = packing.plan(dict(counts), 100)
    packed = Counter()
    for n, comp in groups:
        assert n > 0 and sum(s * k for s, k in comp.items()) <= 100
        for s, k in comp.items():
            packed[s] += n * k
    assert packed == Counter(counts)


def test_plan_is_near_the_bound():
    rnd = random.Random(1)
    counts = Counter(min(512, max(3, int(rnd.lognormvariate(4.7, 1)))) for _ in range(20_000))
    groups = packing.plan(dict(counts), 512)
    used, n = sum(s * c for s, c in counts.items()), sum(n for n, _ in groups)
    assert n <= 1.01 * max(-(-used // 512), sum(c for s, c in counts.items() if s > 256))


def test_nnls_meets_its_conditions():
    rng = np.random.default_rng(0)
    a, b = rng.random((20, 40)), rng.random(20)
    x = packing.nnls(a, b)
    g = a.T @ (b - a @ x)
    assert (x >= 0).all() and g.max() < 1e-6 and abs((g * x).sum()) < 1e-6


def test_pack(spark):
    rnd = random.Random(2)
    rows = [(i, rnd.choice([7, 7, 7, 30, 55, 64, 100, 101, 250, 0, None])) for i in range(2000)]
    df = spark.createDataFrame(rows, "id long, size long").withColumn("n", F.lit("clash"))
    got = packing.pack(df, "id", "size", {1: 100, 2: 64}).collect()
    for spec, cap in ((1, 100), (2, 64)):
        fill, per_item = Counter(), Counter()
        for r in got:
            if r["spec_id"] == spec:
                per_item[r["id"]] += r["part_tokens"]
                if r["container_id"] is not None:
                    fill[r["container_id"]] += r["part_tokens"]
                    assert r["part_tokens"] > 0
        assert max(fill.values()) <= cap and set(fill) == set(range(len(fill)))
        assert per_item == Counter({i: s or 0 for i, s in rows})
        whole = [r for r in got if r["spec_id"] == spec and r["part_tokens"] and dict(rows)[r["id"]] <= cap]
        assert len(whole) == len({r["id"] for r in whole})  # no item that fits is split
    u = {r["spec_id"]: r["space_used"] for r in packing.usage(packing.pack(df, "id", "size", {1: 100}), {1: 100}).collect()}
    assert u[1] > 0.9
    assert packing.pack(df.limit(0), "id", "size", {1: 100}).count() == 0


def test_pivot_keeps_the_mass():
    rnd = random.Random(3)
    sizes = [rnd.randrange(1, 500) for _ in range(400)]
    probs = [rnd.random() for _ in sizes]
    out, i, p = mixing.pivot(sizes, probs, 5)
    assert sum(o == -1 for o in out) == (i >= 0)
    total = sum(n * (p if j == i else o) for j, (o, n) in enumerate(zip(out, sizes, strict=True)))
    assert total == pytest.approx(sum(a * b for a, b in zip(sizes, probs, strict=True)))
    means = np.mean([[o if o >= 0 else q for o, q in zip(mixing.pivot([3, 5, 2], [0.2, 0.5, 0.7], s)[0], [0.2, 0.5, 0.7], strict=True)] for s in range(4000)], axis=0)
    assert means[0] == pytest.approx(0.2, abs=0.05)


def test_mix_reaches_the_shares(spark, monkeypatch):
    monkeypatch.setattr(mixing, "GROUP", 64)  # several levels of the tree
    monkeypatch.setattr(mixing, "FAN_IN", 4)
    rnd = random.Random(6)
    rows = [(i, rnd.choice("aaaab") if i > 30 else "c", rnd.randrange(5, 300)) for i in range(3000)] + [(9000, None, 5), (9001, "a", None), (9002, "zz", 5)]
    df = spark.createDataFrame(rows, "id long, src string, n long").withColumn("k", F.lit(1))
    t = spark.createDataFrame([(1, "a", 0.5, 2), (1, "b", 0.3, 2), (1, "c", 0.2, 3), (2, "a", 1.0, 1), (2, "gone", 0.5, 2)], "mix_id int, source string, target_share double, max_repeats int")
    m = mixing.mix(df, "id", "src", "n", t).cache()
    s = {(r["mix_id"], r["source"]): r for r in mixing.shares(m, t).collect()}
    for src, share in (("a", 0.5), ("b", 0.3), ("c", 0.2)):
        assert s[1, src]["actual_share"] == pytest.approx(share, abs=0.01) and s[1, src]["most_copies"] <= s[1, src]["max_repeats"]
    assert s[1, "c"]["most_copies"] == 3 and s[2, "gone"]["tokens"] == 0 and s[2, "a"]["n_docs"] == sum(1 for r in rows if r[1] == "a" and r[2])
    assert m.groupBy("mix_id", "id").count().filter("count > 1").count() == 0
    assert mixing.mix(df.limit(0), "id", "src", "n", t).count() == 0


def test_token_counts(spark):
    import os

    if not os.path.exists(tokens.DEFAULT_VOCABULARY):
        pytest.skip("no vocabulary")
    df = spark.createDataFrame([(1, "hello world"), (2, ""), (3, None), (4, "año " * 5000), (5, "hello world")], "id long, text string")
    n = {r["id"]: r["n_tokens"] for r in tokens.with_token_counts(df, ["id"]).collect()}
    assert n[1] == n[5] == len(tokens._encoding(tokens.DEFAULT_VOCABULARY).encode_ordinary("hello world")) and n[2] == n[3] == 0 and n[4] >= 5000
