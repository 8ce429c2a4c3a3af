"""Items of varying size packed into containers of fixed capacity.

Pattern packing on the histogram of sizes. Patterns of few large items are
enumerated, their repeat counts are fitted to the histogram by non-negative
least squares and rounded down; what is left, above all the small items, is
packed into the gaps and into new containers, best fit first, again by whole
counts of a size at once. All planning is on the histogram, whose length is
bounded by the capacity, so it costs the same for a thousand items and for a
billion. Items then find their container by their rank within their size.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import materialize

#: Items that one part of the ranks is meant to hold.
PART = 50_000
#: Grid of sizes for the fit, most items of a pattern, smallest item (in capacity / grid) that patterns are made of.
GRID, DEPTH, SMALLEST = 64, 4, 10


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 500) -> np.ndarray:
    """Non-negative least squares by the active-set method of Lawson and Hanson."""
    n = a.shape[1]
    x, used = np.zeros(n), np.zeros(n, bool)
    grad = a.T @ b
    tol = 1e-9 * max(1.0, float(np.abs(grad).max(initial=0.0)))
    for _ in range(rounds):
        free = ~used
        if not free.any() or grad[free].max() <= tol:
            break
        used[np.flatnonzero(free)[grad[free].argmax()]] = True
        while True:
            z = np.zeros(n)
            z[used] = np.linalg.lstsq(a[:, used], b, rcond=None)[0]
            if z[used].min() > 0:
                x = z
                break
            bad = used & (z <= 0)
            step = (x[bad] / np.maximum(x[bad] - z[bad], 1e-300)).min()
            x = x + step * (z - x)
            used &= x > 1e-12
            x[~used] = 0.0
            if not used.any():
                break
        grad = a.T @ (b - a @ x)
    return x


def patterns(grid: int, depth: int, smallest: int, bins: list[int]) -> list[tuple[int, ...]]:
    """Multisets of up to ``depth`` occupied bins that fill at least nine tenths of the grid and fit into it."""
    out: list[tuple[int, ...]] = []

    def grow(prefix: tuple[int, ...], left: int, top: int) -> None:
        if prefix and left <= grid * 0.1:
            out.append(prefix)
        if len(prefix) < depth:
            for b in bins:
                if smallest <= b <= min(left, top):
                    grow((*prefix, b), left - b, b)

    grow((), grid, grid)
    return out


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """Groups ``(number of containers, {size: items in each})`` that hold every item of the histogram once."""
    left = {s: n for s, n in counts.items() if n > 0 and 0 < s <= capacity}
    binned: dict[int, list[int]] = {}
    for s in left:
        binned.setdefault(-(-s * GRID // capacity), []).append(s)
    for sizes in binned.values():
        sizes.sort()
    big = sorted((b for b in binned if b >= SMALLEST), reverse=True)
    pats = patterns(GRID, DEPTH, SMALLEST, big)
    open_: dict[int, list[list]] = {}  # free space -> groups [number, composition]
    spaces: list[int] = []

    def put(free: int, n: int, comp: dict[int, int]) -> None:
        if n > 0:
            if free not in open_:
                spaces.insert(bisect_left(spaces, free), free)
                open_[free] = []
            open_[free].append([n, comp])

    if pats:
        row = {b: i for i, b in enumerate(big)}
        a = np.zeros((len(big), len(pats)))
        for j, p in enumerate(pats):
            for b in p:
                a[row[b], j] += 1
        h = np.array([float(sum(left[s] for s in binned[b])) for b in big])
        # missing a large item costs more than missing a small one, which fits into gaps later
        weight = np.array(big, float)[:, None] / GRID
        x = nnls(a * weight, h * weight[:, 0])
        for j in np.argsort(-x, kind="stable"):
            n = int(x[j] + 1e-6)
            while n > 0:
                comp: dict[int, int] = {}
                ok = True
                for b in pats[j]:
                    s = next((s for s in reversed(binned[b]) if left.get(s, 0) - comp.get(s, 0) > 0), None)
                    if s is None:
                        ok = False
                        break
                    comp[s] = comp.get(s, 0) + 1
                if not ok:
                    break
                m = min(n, *(left[s] // k for s, k in comp.items()))
                for s, k in comp.items():
                    left[s] -= k * m
                put(capacity - sum(s * k for s, k in comp.items()), m, comp)
                n -= m
    # residuals, largest first, each into the tightest gap
    for s in sorted((s for s in left if left[s] > 0), reverse=True):
        c = left[s]
        while c > 0:
            i = bisect_left(spaces, s)
            if i == len(spaces):
                each = capacity // s
                full, rest = divmod(c, each)
                put(capacity - each * s, full, {s: each})
                if rest:
                    put(capacity - rest * s, 1, {s: rest})
                break
            free = spaces[i]
            group = open_[free].pop()
            if not open_[free]:
                del open_[free]
                spaces.pop(i)
            n, comp = group
            each = free // s
            m, k = min(n, c // each), each
            if m == 0:
                m, k = 1, c
            put(free, n - m, comp)
            put(free - k * s, m, {**comp, s: comp.get(s, 0) + k})
            c -= m * k
    return [(n, comp) for groups in open_.values() for n, comp in groups]


def slots(groups: list[tuple[int, dict[int, int]]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per size: first rank, first container and items per container of each stretch of ranks."""
    at: dict[int, list[list[int]]] = {}
    taken: dict[int, int] = {}
    first = 0
    for n, comp in groups:
        for s, k in comp.items():
            r = taken.get(s, 0)
            at.setdefault(s, []).append([r, first, k])
            taken[s] = r + n * k
        first += n
    return {s: tuple(np.array(c, np.int64) for c in zip(*v, strict=True)) for s, v in at.items()}


def pack(items: DataFrame, key: str, size: str, capacities: dict[int, int], salts: int | None = None) -> DataFrame:
    """Every item's container: ``(spec_id, key, part, container_id, part_tokens)``.

    ``capacities`` maps a spec to its capacity. An item larger than the
    capacity is cut into full parts, each a container of its own, and a rest
    that is packed like an item; no other item is split. ``container_id`` counts
    from 0 within the spec, packed containers first.

    Ranks within a size are counted by ``salts`` parts of the keys (64, or one
    for every ``PART`` items if that is more), so a size that a third of all
    items share is still ranked by many tasks; the number follows the items
    alone, so every cluster gives the same containers. What the driver gets is
    one row per size up to the capacity.

    Defined results: items of size 0 or null get one row with part 0 and a null
    container; equal items are told apart by their key; repeated rows are each
    packed; an empty table gives no rows.
    """
    ktype = dict(items.dtypes)[key]
    caps = F.explode(F.array(*[F.struct(F.lit(s).cast("int").alias("spec_id"), F.lit(c).cast("bigint").alias("cap")) for s, c in sorted(capacities.items())])).alias("c")
    x = items.select(F.col(key).alias("k"), F.coalesce(F.col(size).cast("bigint"), F.lit(0)).alias("n"), caps).select("k", "n", "c.*")
    x = x.withColumn("full", F.floor((F.col("n") - 1) / F.col("cap"))).withColumn("full", F.greatest("full", F.lit(0)))
    x = x.withColumn("rest", F.col("n") - F.col("full") * F.col("cap"))
    x = materialize(x, "pack-items")
    salts = salts or max(64, -(-x.count() // PART))
    x = x.withColumn("salt", F.pmod(F.xxhash64("k"), F.lit(salts)).cast("int"))
    counts = x.filter("rest > 0").groupBy("spec_id", "rest", "salt").agg(F.count(F.lit(1)).alias("m"))
    counts = materialize(counts, "pack-counts")
    hist = counts.groupBy("spec_id", "rest").agg(F.sum("m").alias("m")).collect()  # at most one row per size up to the capacity
    table, total = {}, {}
    for s, c in capacities.items():
        groups = plan({r["rest"]: r["m"] for r in hist if r["spec_id"] == s}, c)
        table[s] = slots(groups)
        total[s] = sum(n for n, _ in groups)
    before = counts.withColumn("base", F.sum("m").over(W.partitionBy("spec_id", "rest").orderBy("salt")) - F.col("m")).drop("m")
    small = x.filter("rest > 0").join(before, ["spec_id", "rest", "salt"])
    small = small.withColumn("rank", F.col("base") + F.row_number().over(W.partitionBy("spec_id", "rest", "salt").orderBy("k")) - 1)
    shared = items.sparkSession.sparkContext.broadcast(table)  # bounded by the capacities

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = np.zeros(len(pdf), np.int64)
            spec, rest, rank = pdf["spec_id"].to_numpy(), pdf["rest"].to_numpy(), pdf["rank"].to_numpy()
            order = np.lexsort((rest, spec))
            cut = np.flatnonzero(np.diff(spec[order]) | np.diff(rest[order])) + 1
            for idx in np.split(order, cut):
                if len(idx):
                    start, first, each = shared.value[int(spec[idx[0]])][int(rest[idx[0]])]
                    j = np.searchsorted(start, rank[idx], side="right") - 1
                    out[idx] = first[j] + (rank[idx] - start[j]) // each[j]
            yield pd.DataFrame({"spec_id": spec, "k": pdf["k"], "part": pdf["full"], "container_id": out, "part_tokens": rest})

    ddl = f"spec_id int, k {ktype}, part bigint, container_id bigint, part_tokens bigint"
    packed = small.select("spec_id", "k", "full", "rest", "rank").mapInPandas(place, ddl)
    # full parts of long items: numbered through by salts as well
    long = x.filter("full > 0")
    lc = long.groupBy("spec_id", "salt").agg(F.sum("full").alias("m"))
    lc = lc.withColumn("base", F.sum("m").over(W.partitionBy("spec_id").orderBy("salt")) - F.col("m")).drop("m")
    long = long.join(lc, ["spec_id", "salt"])
    run = F.sum("full").over(W.partitionBy("spec_id", "salt").orderBy("k", "n").rowsBetween(W.unboundedPreceding, 0)) - F.col("full")
    firsts = F.element_at(F.create_map(*[F.lit(v) for s in sorted(total) for v in (s, total[s])]), F.col("spec_id")) if total else F.lit(0)
    long = long.withColumn("first", firsts + F.col("base") + run)
    cut = long.select("spec_id", "k", "cap", "first", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("full") - 1)).alias("part"))
    cut = cut.select("spec_id", "k", "part", (F.col("first") + F.col("part")).alias("container_id"), F.col("cap").alias("part_tokens"))
    none = x.filter("rest <= 0").select("spec_id", "k", F.lit(0).cast("bigint").alias("part"), F.lit(None).cast("bigint").alias("container_id"), F.lit(0).cast("bigint").alias("part_tokens"))
    return packed.unionByName(cut).unionByName(none).withColumnRenamed("k", key)


def usage(packed: DataFrame, capacities: dict[int, int]) -> DataFrame:
    """Per spec: containers, items, tokens, share of the space used, fullest and emptiest container."""
    c = packed.filter("container_id is not null").groupBy("spec_id", "container_id").agg(F.sum("part_tokens").alias("t"), F.count(F.lit(1)).alias("items"))
    cap = F.element_at(F.create_map(*[F.lit(v) for s, n in sorted(capacities.items()) for v in (s, n)]), F.col("spec_id"))
    return c.groupBy("spec_id").agg(
        F.count(F.lit(1)).alias("n_containers"), F.sum("items").alias("n_parts"), F.sum("t").alias("n_tokens"), F.max("t").alias("fullest"), F.min("t").alias("emptiest"),
        (F.sum("t") / F.sum(cap)).alias("space_used"),
    )
