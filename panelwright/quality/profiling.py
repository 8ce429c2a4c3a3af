"""Column profiles per load from unpivoted column-value counts, and the breaks between loads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.joins import null_safe_join


def order_bits(x: Column, drop: int) -> Column:
    """A long that sorts as the double ``x`` does, without its ``drop`` lowest bits.

    The sign and exponent are kept, so bins are of equal relative width and
    their number does not grow with the rows.
    """
    # by arithmetic, as Spark has no bit view of a double; only the order counts
    mant = 52 - drop
    a = F.abs(x)
    huge = a > 1e308
    e = F.when(huge, F.lit(1030)).when(a > 0, F.floor(F.log2(a))).otherwise(F.lit(-1080))
    frac = F.when(huge, F.lit(0)).when(a > 0, F.floor((a / F.pow(F.lit(2.0), e) - 1) * F.lit(float(2**mant)))).otherwise(F.lit(0))
    code = (e + 1080) * F.lit(2 ** (mant + 1)) + frac
    return F.when(x < 0, -code - 1).otherwise(code).cast("bigint")


def exact_quantiles(counts: DataFrame, keys: list[str], value: str, n: str, q: float = 0.5) -> DataFrame:
    """The exact ``q`` quantile (midpoint of the two middle values) of each group of value counts.

    ``counts`` has one row per (keys, value) with its frequency. Values are
    counted in bins of equal relative width first; only the one or two bins
    that hold the wanted ranks are sorted, so no task sorts a whole group even
    if one group holds all rows. Null and NaN values must have been removed.
    Groups without values give no row.
    """
    binned = counts.withColumn("_bin", order_bits(F.col(value), 44))
    bins = binned.groupBy(*keys, "_bin").agg(F.sum(n).alias("_bn"))
    g = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(1))
    bins = bins.withColumn("_total", F.sum("_bn").over(g)).withColumn("_before", F.sum("_bn").over(g.orderBy("_bin")) - F.col("_bn"))
    pos = (F.col("_total") - 1) * F.lit(q)
    bins = bins.withColumn("_lo", F.floor(pos)).withColumn("_hi", F.ceil(pos))
    hit = bins.filter(
        ((F.col("_before") <= F.col("_lo")) & (F.col("_lo") < F.col("_before") + F.col("_bn")))
        | ((F.col("_before") <= F.col("_hi")) & (F.col("_hi") < F.col("_before") + F.col("_bn")))
    ).drop("_bn")
    hit = hit.withColumnRenamed("_bin", "_b")
    rows = null_safe_join(binned.withColumn("_b", F.col("_bin")), hit, [*keys, "_b"], "inner")
    rows = rows.select(*keys, "_b", F.col(value).alias("_v"), F.col(n).alias("_n"), "_total", "_before", "_lo", "_hi")
    w = W.partitionBy(*keys, "_b").orderBy("_v")
    rows = rows.withColumn("_end", F.col("_before") + F.sum("_n").over(w)).withColumn("_start", F.col("_end") - F.col("_n"))
    at = lambda r: F.max(F.when((F.col("_start") <= F.col(r)) & (F.col(r) < F.col("_end")), F.col("_v")))
    out = rows.groupBy(*keys, "_total", "_lo", "_hi").agg(at("_lo").alias("_x"), at("_hi").alias("_y"))
    part = (F.col("_total") - 1) * F.lit(q) - F.col("_lo")
    # weighed and added, as SQL does: a difference of unlike values would be rounded before it is halved
    between = F.when(F.col("_x") == F.col("_y"), F.col("_x")).otherwise(F.col("_x") * (1 - part) + F.col("_y") * part)
    return out.select(*keys, between.alias("quantile"), F.col("_total").alias("n_values"))


def value_counts(df: DataFrame, load: list[str], columns: list[str]) -> DataFrame:
    """Long counts ``(load..., column_name, s, x, n)`` of every value of ``columns`` per load.

    ``s`` is the value as text, null if it is missing (null or NaN); ``x`` is it
    as a double for numeric columns. Counting happens before the shuffle, so a
    value that holds a third of all rows is one record per task. Extra columns
    of ``df`` are not read; columns of clashing names are addressed by position.
    """
    kinds = dict(df.dtypes)
    numeric = {c for c in columns if kinds[c] in ("double", "float", "int", "bigint", "smallint", "tinyint") or kinds[c].startswith("decimal")}

    def cell(c: str) -> Column:
        x = F.col(c).cast("double") if c in numeric else F.lit(None).cast("double")
        s = F.when(F.isnan(x), None).otherwise(F.col(c).cast("string")) if c in numeric else F.col(c).cast("string")
        return F.struct(F.lit(c).alias("column_name"), s.alias("s"), F.nanvl(x, F.lit(None).cast("double")).alias("x"))

    long = df.select(*load, F.explode(F.array(*[cell(c) for c in columns])).alias("v")).select(*load, "v.*")
    return long.groupBy(*load, "column_name", "s", "x").agg(F.count(F.lit(1)).alias("n"))


def profile(counts: DataFrame, load: list[str], patterns: dict[str, str] | None = None) -> DataFrame:
    """One row per column and load: rows, missing, distinct, most frequent, range, median, pattern violations.

    ``patterns`` maps a column to the regular expression its values should
    match in full. An empty input gives no rows; a column with only missing
    values has null range, median and mode. Ties of the most frequent value go
    to the smaller one.
    """
    keys = [*load, "column_name"]
    bad = F.lit(False)
    for c, p in (patterns or {}).items():
        bad = bad | ((F.col("column_name") == c) & ~F.col("s").rlike(f"^(?:{p})$"))
    there = F.col("s").isNotNull()
    base = counts.groupBy(*keys).agg(
        F.sum("n").alias("n_rows"),
        F.sum(F.when(there, 0).otherwise(F.col("n"))).alias("n_missing"),
        F.count_if(there).alias("n_distinct"),
        F.max(F.when(there, F.struct("n", F.negative(F.xxhash64("s")).alias("h"), "s"))).alias("top"),
        F.min("x").alias("min_value"),
        F.max("x").alias("max_value"),
        F.min(F.when(there, F.length("s"))).alias("min_length"),
        F.max(F.when(there, F.length("s"))).alias("max_length"),
        F.sum(F.when(there & bad, F.col("n")).otherwise(0)).alias("n_violations"),
    )
    base = base.select(*keys, "n_rows", "n_missing", "n_distinct", F.col("top.s").alias("top_value"), F.col("top.n").alias("top_count"), "min_value", "max_value", "min_length", "max_length", "n_violations")
    med = exact_quantiles(counts.filter("x is not null"), keys, "x", "n").select(*keys, F.col("quantile").alias("median_value"))
    return null_safe_join(base, med, keys)


def with_previous(p: DataFrame, series: str, load: str, values: list[str]) -> DataFrame:
    """Each profile row beside the one of the load before it (next smaller id of the same series)."""
    w = W.partitionBy(series, "column_name").orderBy(load)
    return p.select("*", F.lag(load).over(w).alias("prev_load"), *[F.lag(v).over(w).alias(f"prev_{v}") for v in values])


def breaks(
    p: DataFrame,
    series: str,
    load: str,
    null_rate: list[str],
    centre: list[str],
    form: list[str],
    null_step: float = 0.20,
    centre_factor: float = 4.0,
    form_step: float = 0.15,
) -> DataFrame:
    """Breaks ``(column_name, load, issue, before, after)`` of each load against the load before it.

    'null_rate': share of missing values differs by ``null_step`` or more.
    'centre': the larger absolute median is at least ``centre_factor`` times
    the smaller. 'form': share of pattern violations among non-missing values
    differs by ``form_step`` or more. A load without values has no centre or
    form to compare; the first load of a series has no break.
    """
    eps = 1e-9
    q = with_previous(p, series, load, ["n_rows", "n_missing", "median_value", "n_violations"]).filter("prev_load is not null")
    share = lambda a, b: F.col(a) / F.nullif(F.col(b), F.lit(0))
    q = q.withColumns(
        {
            "nr": share("n_missing", "n_rows"),
            "prev_nr": share("prev_n_missing", "prev_n_rows"),
            "fm": F.col("n_violations") / F.nullif(F.col("n_rows") - F.col("n_missing"), F.lit(0)),
            "prev_fm": F.col("prev_n_violations") / F.nullif(F.col("prev_n_rows") - F.col("prev_n_missing"), F.lit(0)),
            "cn": F.abs("median_value"),
            "prev_cn": F.abs("prev_median_value"),
        }
    )
    hi, lo = F.greatest("cn", "prev_cn"), F.least("cn", "prev_cn")
    both = F.col("cn").isNotNull() & F.col("prev_cn").isNotNull()
    tests = F.array_compact(
        F.array(
            F.when(F.col("column_name").isin(null_rate) & (F.abs(F.col("nr") - F.col("prev_nr")) >= null_step - eps), F.struct(F.lit("null_rate").alias("issue"), F.col("prev_nr").alias("before"), F.col("nr").alias("after"))),
            F.when(F.col("column_name").isin(centre) & both & (hi > 0) & (hi >= lo * centre_factor * (1 - 1e-12)), F.struct(F.lit("centre").alias("issue"), F.col("prev_median_value").alias("before"), F.col("median_value").alias("after"))),
            F.when(F.col("column_name").isin(form) & (F.abs(F.col("fm") - F.col("prev_fm")) >= form_step - eps), F.struct(F.lit("form").alias("issue"), F.col("prev_fm").alias("before"), F.col("fm").alias("after"))),
        )
    )
    return q.select("column_name", load, F.explode(tests).alias("t")).select("column_name", load, "t.*")


def stability(counts: DataFrame, series: str, load: str, floor: float = 1e-4) -> DataFrame:
    """Population stability index and chi-square of each column between a load and the one before it.

    Numbers are compared over bins of an eighth of a power of two, texts over
    their values. Bins seen in one of the two loads only count with ``floor``.
    The comparison works on bin counts, whose number does not grow with rows.
    """
    b = F.when(F.col("x").isNotNull(), order_bits(F.col("x"), 49).cast("string")).when(F.col("s").isNull(), F.lit("∅")).otherwise(F.col("s"))
    c = counts.groupBy(series, load, "column_name", b.alias("bin")).agg(F.sum("n").alias("n"))
    loads = c.select(series, load).distinct()
    loads = loads.withColumn("prev", F.lag(load).over(W.partitionBy(series).orderBy(load)))
    tot = c.groupBy(series, load, "column_name").agg(F.sum("n").alias("total"))
    c = null_safe_join(c, tot, [series, load, "column_name"], "inner")
    steps = loads.filter("prev is not null").select(F.col(series).alias("_s"), F.col(load).alias("cur"), "prev")
    zero, none = F.lit(0).cast("bigint"), F.lit(None).cast("bigint")
    as_cur = c.join(steps, c[series].eqNullSafe(F.col("_s")) & (c[load] == F.col("cur"))).select("_s", "cur", "column_name", "bin", F.col("n").alias("a"), F.col("total").alias("ta"), zero.alias("b"), none.alias("tb"))
    as_prev = c.join(steps, c[series].eqNullSafe(F.col("_s")) & (c[load] == F.col("prev"))).select("_s", "cur", "column_name", "bin", zero.alias("a"), none.alias("ta"), F.col("n").alias("b"), F.col("total").alias("tb"))
    u = as_cur.unionByName(as_prev).groupBy("_s", "cur", "column_name", "bin").agg(F.sum("a").alias("a"), F.max("ta").alias("ta"), F.sum("b").alias("b"), F.max("tb").alias("tb"))
    ww = W.partitionBy("_s", "cur", "column_name")
    u = u.withColumn("ta", F.max("ta").over(ww)).withColumn("tb", F.max("tb").over(ww)).filter("ta > 0 and tb > 0")
    pa, pb = F.greatest(F.col("a") / F.col("ta"), F.lit(floor)), F.greatest(F.col("b") / F.col("tb"), F.lit(floor))
    e = (F.col("a") + F.col("b")) / (F.col("ta") + F.col("tb"))
    chi = F.pow(F.col("a") - e * F.col("ta"), 2) / (e * F.col("ta")) + F.pow(F.col("b") - e * F.col("tb"), 2) / (e * F.col("tb"))
    return u.groupBy(F.col("_s").alias(series), F.col("cur").alias(load), "column_name").agg(
        F.sum((pa - pb) * F.log(pa / pb)).alias("psi"), F.sum(chi).alias("chi_square"), (F.count(F.lit(1)) - 1).alias("degrees")
    )
