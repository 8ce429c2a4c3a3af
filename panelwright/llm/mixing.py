"""Records of several sources mixed to target shares of the total size.

Each record of a source is wanted the same, usually fractional, number of
times. Pivotal dependent rounding makes these numbers whole: two records with
fractional numbers pass mass (in tokens) between them at random until one is
whole, so expectations are kept and a source's total never moves. Groups of a
bounded number of records are rounded side by side; each leaves at most one
fractional record, and these are combined through a reduction tree.
"""

from __future__ import annotations

import random

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import materialize

#: Records rounded in one group, and groups whose rests are combined in one step of the tree.
GROUP, FAN_IN = 8192, 512


def pivot(sizes: list[int], probs: list[float], seed: int) -> tuple[list[int], int, float]:
    """Rounds all but at most one probability: ``(0/1 per record, -1 for the open one; its index or -1; its probability)``."""
    rnd = random.Random(seed)
    out = [-1] * len(sizes)
    i, p = -1, 0.0
    eps = 1e-12
    for j, q in enumerate(probs):
        if q <= eps or q >= 1 - eps:
            out[j] = int(q > 0.5)
            continue
        if i < 0:
            i, p = j, q
            continue
        ni, nj = sizes[i], sizes[j]
        up = min((1 - p) * ni, q * nj)  # mass that may move from j to i
        down = min(p * ni, (1 - q) * nj)
        if rnd.random() * (up + down) < down:
            p, q = p + up / ni, q - up / nj
        else:
            p, q = p - down / ni, q + down / nj
        if q <= eps or q >= 1 - eps:
            out[j] = int(q > 0.5)
            if p <= eps or p >= 1 - eps:
                out[i], i = int(p > 0.5), -1
        else:
            out[i] = int(p > 0.5)
            i, p = j, q
    return out, i, p


def settle(out: list[int], sizes: list[int], probs: list[float]) -> list[int]:
    """Flips records of the last group, largest first, where that brings the total nearer to its expectation.

    Rounding the very last record moves the total by a part of its size, and
    the last one is often large; smaller records make up for it.
    """
    over = sum((o - p) * n for o, n, p in zip(out, sizes, probs, strict=True))
    for j in sorted(range(len(out)), key=lambda j: (-sizes[j], j)):
        if 0 < probs[j] < 1:
            change = sizes[j] * (1 - 2 * out[j])
            if abs(over + change) < abs(over):
                out[j], over = 1 - out[j], over + change
    return out


def wanted_copies(totals: DataFrame, targets: DataFrame) -> DataFrame:
    """``(mix_id, source, share, cap, tokens, n, copies)``: how often each record of a source is wanted.

    The total size of a mix is the largest that no source has to repeat its
    records more than its cap for. Sources without records or tokens cannot
    take part; the others keep their shares of the total to each other.
    """
    t = targets.filter("target_share > 0 and max_repeats > 0").groupBy("mix_id", "source").agg(F.sum("target_share").alias("share"), F.max("max_repeats").alias("cap"))
    j = t.join(totals.filter("tokens > 0"), "source")
    size = j.groupBy("mix_id").agg(F.min(F.col("cap") * F.col("tokens") / F.col("share")).alias("size"))
    j = j.join(size, "mix_id")
    return j.select("mix_id", "source", "share", "cap", "tokens", "n", F.least(F.col("share") * F.col("size") / F.col("tokens"), F.col("cap").cast("double")).alias("copies"))


def mix(sized: DataFrame, key: str, source: str, size: str, targets: DataFrame, seed: int = 17) -> DataFrame:
    """Records with their whole number of copies in each mix: ``(mix_id, source, key, n_tokens, n_copies)``, copies > 0.

    A source's tokens reach its share up to the size of one record. The number
    of groups follows a source's count of records, so a source that holds a
    third of all records is rounded by as many tasks as it needs. The driver
    sees one row per mix and source.

    Defined results: records of size 0 or null, or of a source that no mix
    names (null included), are left out; a mix none of whose sources has
    records gives no rows; repeated rows count as records of their own.
    """
    ktype = dict(sized.dtypes)[key]
    d = sized.select(F.col(key).alias("k"), F.col(source).alias("source"), F.col(size).cast("bigint").alias("n_tokens")).filter("source is not null and n_tokens > 0")
    totals = d.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("n"))
    want = materialize(wanted_copies(totals, targets), "mix-wanted")
    whole = F.floor(F.col("copies") + 1e-9)
    want = want.withColumn("base", whole).withColumn("p", F.when(F.abs(F.col("copies") - F.round("copies")) < 1e-9, 0.0).otherwise(F.col("copies") - whole))
    w = want.select("mix_id", "source", "base", "p", F.ceil(F.col("n") / GROUP).alias("groups"))
    x = d.join(F.broadcast(w), "source")  # one row per mix and source of the target table, which lists them by hand
    fixed = x.filter("p = 0").select("mix_id", "source", "k", "n_tokens", "base", F.lit(0).alias("extra"))
    todo = x.filter("p > 0").select("mix_id", "source", "k", "n_tokens", "base", "p", F.pmod(F.xxhash64("k"), F.col("groups")).alias("g"))
    ddl = f"mix_id int, source string, k {ktype}, n_tokens bigint, base bigint, p double, g bigint, extra int"

    def rounder(level: int, last: bool):  # noqa: ANN202
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(["k", "n_tokens"], kind="stable").reset_index(drop=True)
            s = hash((seed, level, int(pdf["mix_id"].iloc[0]), int(pdf["g"].iloc[0]))) & 0x7FFFFFFF
            out, i, p = pivot(pdf["n_tokens"].tolist(), pdf["p"].tolist(), s)
            if last:
                if i >= 0:
                    out[i] = int(random.Random(s + 1).random() < p)
                out = settle(out, pdf["n_tokens"].tolist(), pdf["p"].tolist())
            pdf["extra"] = out
            if i >= 0 and not last:
                pdf.loc[i, "p"] = p
            return pdf[["mix_id", "source", "k", "n_tokens", "base", "p", "g", "extra"]]

        return run

    most = want.agg(F.max(F.ceil(F.col("n") / GROUP))).first()[0] or 0
    level, groups, done = 0, int(most), []
    while groups:
        last = groups == 1
        r = todo.groupBy("mix_id", "source", "g").applyInPandas(rounder(level, last), ddl)
        r = materialize(r, "mix-rounded") if not last else r
        done.append(r.filter("extra >= 0").select("mix_id", "source", "k", "n_tokens", "base", "extra"))
        if last:
            break
        todo = r.filter("extra < 0").select("mix_id", "source", "k", "n_tokens", "base", "p", F.floor(F.col("g") / FAN_IN).alias("g"))
        groups, level = -(-groups // FAN_IN), level + 1
    out = fixed
    for r in done:
        out = out.unionByName(r)
    return out.select("mix_id", "source", F.col("k").alias(key), "n_tokens", (F.col("base") + F.col("extra")).cast("int").alias("n_copies")).filter("n_copies > 0")


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """Target and reached shares per mix and source, also of sources that could not take part."""
    got = mixed.groupBy("mix_id", "source").agg(F.sum(F.col("n_tokens") * F.col("n_copies")).alias("tokens"), F.count(F.lit(1)).alias("n_docs"), F.max("n_copies").alias("most_copies"))
    t = targets.groupBy("mix_id", "source").agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    j = t.join(got, ["mix_id", "source"], "left").withColumn("tokens", F.coalesce("tokens", F.lit(0)))
    return j.select("mix_id", "source", "target_share", (F.col("tokens") / F.sum("tokens").over(W.partitionBy("mix_id"))).alias("actual_share"), "tokens", F.coalesce("n_docs", F.lit(0)).alias("n_docs"), "max_repeats", F.coalesce("most_copies", F.lit(0)).alias("most_copies"))
