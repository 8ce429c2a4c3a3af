"""Amounts recorded in different units, brought to one.

A hidden Markov model per device (a reporting entity). The hidden state of an
observation is the power of ten its unit lies above the common one. The
underlying level is smooth, so a change of unit shows as a jump of the log
value by about the difference of two states; the Viterbi path explains all
jumps of a device at once. What files say about their unit, how the rest of a
file was recorded and how far a value lies from comparable devices enter as
emission costs, so a device that never changes its unit is placed as well.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.joins import null_safe_join
from ..session import materialize
from .profiling import exact_quantiles

#: Powers of ten of the units, unless a caller names others: thousandths and millionths come from amounts divided twice.
STATES = (-6, -3, 0, 3, 6)
#: Costs (negative log likelihoods): how fast they rise with the deviation, and where they end, as real breaks happen.
#: ``SPAN`` times before and after are compared for the expected level.
SPAN = 3
LEVEL_SD, LEVEL_CAP, JUMP_SD, JUMP_CAP, SWITCH, SAID = 0.45, 14.0, 0.12, 9.0, 1.2, 1.0


def stated_exponent(text: Column) -> Column:
    """The power of ten a remark on units tells, null if it tells none.

    Remarks of a conversion that was done give 0. The words are fixed values:
    million, thousand, pesos, PHP, their short forms and the signs of division.
    """
    t = F.lower(text)
    return (
        F.when(t.rlike(r"(→|->|\bto\b)\s*millions?|already|divided by"), F.lit(0))
        .when(t.rlike(r"thousand|'000|’000|\b000s?\b|kphp"), F.lit(3))
        .when(t.rlike(r"million|php\s*m\b|₱\s*m\b|\bmn\b"), F.lit(0))
        .when(t.rlike(r"peso|php|₱"), F.lit(6))
    )


def header_exponent(labels: Column, about: str) -> Column:
    """The power of ten told by a bracket in the header labels that match ``about``; null if there is none."""
    hits = F.filter(labels, lambda s: F.lower(s).rlike(about) & s.rlike(r"\("))
    inside = F.transform(hits, lambda s: stated_exponent(F.regexp_extract(s, r"\(([^)]*)\)\s*$", 1)))
    return F.try_element_at(F.filter(inside, lambda x: x.isNotNull()), F.lit(1))


def _viterbi(level: list, costs: list, states: tuple[int, ...] = STATES) -> list[list[int]]:
    """Best state index per step of each sequence; sequences are padded and run side by side."""
    d, t_max = len(level), max((len(x) for x in level), default=0)
    if t_max == 0:
        return [[] for _ in range(d)]
    s, n_states = np.asarray(states, float), len(states)
    lv, em, n = np.zeros((d, t_max)), np.zeros((d, t_max, n_states)), np.array([len(x) for x in level])
    for i in range(d):
        lv[i, : n[i]] = level[i]
        em[i, : n[i]] = np.asarray(costs[i], float).reshape(-1, n_states)
    best, back = em[:, 0].copy(), np.zeros((d, t_max, n_states), np.int8)
    change = SWITCH * (s[:, None] != s[None, :])
    for t in range(1, t_max):
        jump = (lv[:, t] - lv[:, t - 1])[:, None, None] - (s[None, None, :] - s[None, :, None])
        step = np.minimum((jump / JUMP_SD) ** 2 / 2, JUMP_CAP) + change
        total = best[:, :, None] + step
        k = total.argmin(1)
        live = (t < n)[:, None]
        back[:, t] = np.where(live, k, np.arange(n_states))
        best = np.where(live, np.take_along_axis(total, k[:, None, :], 1)[:, 0] + em[:, t], best)
    state, out = best.argmin(1), np.zeros((d, t_max), np.int64)
    for t in range(t_max - 1, -1, -1):
        out[:, t] = state
        state = back[np.arange(d), t, state]
    return [out[i, : n[i]].tolist() for i in range(d)]


def _decoder(states: tuple[int, ...]):  # noqa: ANN202
    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i in range(0, len(pdf), 4096):
                part = pdf.iloc[i : i + 4096]
                paths = _viterbi(list(part["levels"]), list(part["costs"]), states)
                yield pd.DataFrame({"device": part["device"].to_numpy(), "times": list(part["times"]), "bins": list(part["bins"]), "path": [[states[k] for k in x] for x in paths]})

    return decode


def decode_units(rows: DataFrame, states: tuple[int, ...] = STATES) -> DataFrame:
    """The unit of every value, one of the powers of ten in ``states``.

    ``rows`` has ``id, device, time, value, size, kind, source, said``: ``size``
    scales with the expected level (a head count), ``kind`` names comparable
    devices, ``source`` the file and ``said`` the stated power of ten.
    Returns ``id, exponent`` for every row whose value is neither null, NaN nor
    zero; the value in the common unit is ``value / 10^exponent``.

    Steps of a device are cells of (time, tenth of a decade), counted before
    the shuffle, so a device's sequence is bounded by the range of times, not
    by its rows; the decoded cells are joined back to the rows.

    Defined results: rows without device or time are decoded by their emission
    costs alone; repeated rows share their cell and its unit; negative values
    are decoded by their size; with no comparable rows the level says nothing
    and 0 is taken; an empty table gives an empty result.
    """
    # one pass over the rows; every later shuffle is of counts, cells or the same few columns
    v = F.abs(F.nanvl("value", F.lit(None).cast("double")))
    r = rows.select("id", "device", "time", "kind", "source", "said", "size", v.alias("a")).filter("a > 0 and a < 1e300")
    lg = F.log10("a")
    r = r.withColumn("l", lg).withColumn("rel", F.when(F.col("size") > 0, F.col("l") - F.log10("size")))
    # medians of comparable rows: by (kind, time), by time, overall; per head where a size is known
    rounded = F.round("rel", 4)
    by = r.filter("rel is not null").groupBy("kind", "time", rounded.alias("x")).agg(F.count(F.lit(1)).alias("n"))
    m_kt = exact_quantiles(by, ["kind", "time"], "x", "n").filter("n_values >= 15").select("kind", "time", F.col("quantile").alias("m0"))
    # most rows of one kind and time may be in another unit, so the level is the middle one of the times around it
    around = F.array_sort(F.collect_list("m0").over(W.partitionBy("kind").orderBy("time").rangeBetween(-SPAN, SPAN)))
    m_kt = m_kt.select("kind", "time", F.element_at(around, F.floor((F.size(around) + 1) / 2).cast("int")).alias("m1"))
    by_t = by.groupBy("time", "x").agg(F.sum("n").alias("n"))
    m_t = exact_quantiles(by_t, ["time"], "x", "n").select("time", F.col("quantile").alias("m2"))
    plain = r.groupBy("kind", F.round("l", 4).alias("x")).agg(F.count(F.lit(1)).alias("n"))
    m_k = exact_quantiles(plain, ["kind"], "x", "n").select("kind", F.col("quantile").alias("m3"))

    r = null_safe_join(null_safe_join(null_safe_join(r, m_kt, ["kind", "time"]), m_t, ["time"]), m_k, ["kind"])
    dev = F.coalesce(F.col("rel") - F.coalesce("m1", "m2"), F.col("l") - F.col("m3"))
    r = r.select("id", "device", "time", "source", "said", "l", dev.alias("dev"))
    cost = lambda s: F.coalesce(F.least(F.pow((F.col("dev") - s) / LEVEL_SD, 2) / 2, F.lit(LEVEL_CAP)), F.lit(0.0))
    near = F.array_min(F.array(*[F.struct(F.abs(F.col("dev") - s).alias("d"), F.lit(s).alias("s")) for s in states]))["s"]
    # read three times below, so written once; the plan before it ends here
    r = materialize(r.withColumn("near", near), "unit-rows")
    # how the rows of the same file were recorded; a file's count is one record per task before the shuffle
    files = r.filter("source is not null").groupBy("source").agg(F.count("near").alias("fn"), *[F.count_if(F.col("near") == s).alias(f"f{i}") for i, s in enumerate(states)])
    bare = r.withColumn("bin", F.floor(F.col("l") * 10).cast("int"))
    r = null_safe_join(r, files, ["source"])
    for i, s in enumerate(states):
        share = F.when(F.col("fn") > 0, -F.log((F.col(f"f{i}") + 0.3) / (F.col("fn") + 0.3 * len(states)))).otherwise(F.lit(0.0))
        said = F.when(F.col("said").isNotNull() & (F.col("said") != s), F.lit(SAID)).otherwise(F.lit(0.0))
        r = r.withColumn(f"c{i}", cost(s) + share + said)
    r = r.withColumn("bin", F.floor(F.col("l") * 10).cast("int"))
    lone = F.col("device").isNull() | F.col("time").isNull()
    alone = F.array_min(F.array(*[F.struct(F.col(f"c{i}").alias("c"), F.abs(F.lit(s)).alias("z"), F.lit(s).alias("s")) for i, s in enumerate(states)]))["s"]
    single = r.filter(lone).select("id", alone.alias("exponent"))
    r = r.filter(~lone)
    cells = r.groupBy("device", "time", "bin").agg(F.avg("l").alias("l"), *[F.avg(f"c{i}").alias(f"c{i}") for i in range(len(states))])
    seq = cells.groupBy("device").agg(F.array_sort(F.collect_list(F.struct("time", "bin", "l", F.array(*[f"c{i}" for i in range(len(states))]).alias("c")))).alias("q"))
    seq = seq.select("device", F.col("q.time").alias("times"), F.col("q.bin").alias("bins"), F.col("q.l").alias("levels"), F.flatten("q.c").alias("costs"))
    kinds = dict(r.dtypes)
    out = seq.mapInPandas(_decoder(states), f"device {kinds['device']}, times array<{kinds['time']}>, bins array<int>, path array<int>")
    out = out.select(F.col("device").alias("_d"), F.explode(F.arrays_zip("times", "bins", "path")).alias("z")).select("_d", F.col("z.times").alias("_t"), F.col("z.bins").alias("_b"), F.col("z.path").alias("exponent"))
    got = bare.filter(~lone).join(out, (F.col("device") == F.col("_d")) & (F.col("time") == F.col("_t")) & (F.col("bin") == F.col("_b"))).select("id", "exponent")
    return got.unionByName(single)


def panel_units(panel: DataFrame, report: DataFrame, headers: DataFrame, field: str, about: str) -> DataFrame:
    """``decode_units`` for a panel keyed by ``row_id`` with a file reference; ``about`` names the field's header."""
    said = report.select("file_id", stated_exponent(F.col("unit_conversion")).alias("a"))
    head = headers.select("file_id", header_exponent(F.col("header_labels"), about).alias("b"))
    told = said.unionByName(head, allowMissingColumns=True).groupBy("file_id").agg(F.min("a").alias("a"), F.min("b").alias("b"))
    told = told.select(F.col("file_id").alias("_f"), F.coalesce("b", "a").alias("said"))
    p = panel.select(F.col("row_id").alias("id"), F.col("psgc10").alias("device"), F.col("fiscal_year").alias("time"), F.col(field).alias("value"), F.col("pop_2024").cast("double").alias("size"), F.col("lgu_type").alias("kind"), F.col("file_id").alias("source"))
    return decode_units(p.join(told, p["source"] == told["_f"], "left").drop("_f"))


def harmonized(panel: DataFrame, exponents: DataFrame, field: str) -> DataFrame:
    """The panel with ``<field>_common`` in the common unit and the exponent taken out; other columns are untouched."""
    e = exponents.select(F.col("id").alias("_id"), F.col("exponent").alias("_e"))
    p = panel.join(e, panel["row_id"] == e["_id"], "left")
    return p.select(panel["*"], (F.col(field) / F.pow(F.lit(10.0), F.coalesce("_e", F.lit(0)))).alias(f"{field}_common"), F.coalesce("_e", F.lit(0)).alias(f"{field}_exponent"))


