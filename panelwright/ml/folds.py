"""Time folds, entity holdouts, baselines and their scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Expanding training windows with their test windows, both ends inclusive.
FOLDS = [("F1", 1992, 2005, 2006, 2008), ("F2", 1992, 2008, 2009, 2011), ("F3", 1992, 2011, 2012, 2014), ("F4", 1992, 2014, 2015, 2017), ("F5", 1992, 2017, 2018, 2019), ("H", 1992, 2019, 2020, 2024)]


def fold_table(spark: SparkSession, folds: list[tuple] = FOLDS) -> DataFrame:
    return spark.createDataFrame(folds, "fold string, train_lo int, train_hi int, test_lo int, test_hi int")


def assign_folds(df: DataFrame, folds: DataFrame, time: str) -> DataFrame:
    """Each row once per fold it trains or tests: ``fold`` and ``part``. The fold table has a handful of rows."""
    f = F.broadcast(folds)
    j = df.join(f, F.col(time).between(F.col("train_lo"), F.col("train_hi")) | F.col(time).between(F.col("test_lo"), F.col("test_hi")))
    part = F.when(F.col(time).between(F.col("train_lo"), F.col("train_hi")), "train").otherwise("test")
    return j.select(*df.columns, "fold", part.alias("part"))


def baseline_predictions(folded: DataFrame, target: str, current: str) -> DataFrame:
    """Naive persistence (missing ones filled by the training mean), the training mean and zero, for the test rows."""
    mean = F.avg(F.when(F.col("part") == "train", F.col(target)))
    m = folded.groupBy("fold").agg(mean.alias("train_mean"))
    t = folded.filter("part = 'test'").join(F.broadcast(m), "fold")  # one row per fold
    preds = F.array(
        F.struct(F.lit("naive").alias("model"), F.coalesce(F.col(current), F.col("train_mean")).alias("y_pred")),
        F.struct(F.lit("fold_mean").alias("model"), F.col("train_mean").alias("y_pred")),
        F.struct(F.lit("zero").alias("model"), F.lit(0.0).alias("y_pred")),
    )
    return t.select("fold", F.col(target).alias("y_true"), F.explode(preds).alias("p")).select("fold", "p.model", "y_true", F.least(F.greatest("p.y_pred", F.lit(0.0)), F.lit(1.0)).alias("y_pred"))


def scores(pred: DataFrame, by: tuple[str, ...] = ("fold", "model")) -> DataFrame:
    """RMSE, MAE and R² per group from one aggregate."""
    e = F.col("y_true") - F.col("y_pred")
    a = pred.groupBy(*by).agg(F.count(F.lit(1)).alias("n_test"), F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"), F.var_pop("y_true").alias("v"))
    return a.select(*by, "n_test", F.sqrt("mse").alias("rmse"), "mae", (1 - F.col("mse") / F.nullif(F.col("v"), F.lit(0.0))).alias("r2"))


def against_naive(s: DataFrame) -> DataFrame:
    """Each model's RMSE over that of naive persistence in the same fold."""
    base = F.max(F.when(F.col("model") == "naive", F.col("rmse"))).over(W.partitionBy("fold"))
    return s.withColumn("rmse_ratio_vs_naive", F.col("rmse") / F.nullif(base, F.lit(0.0)))


def verdict(s: DataFrame, good: float = 0.95, bad: float = 1.0) -> DataFrame:
    """Mean scores over the folds without the holdout, and what they say against naive persistence."""
    m = against_naive(s).filter("fold <> 'H'").groupBy("model").agg(F.avg("rmse").alias("rmse"), F.avg("mae").alias("mae"), F.avg("r2").alias("r2"), F.avg("rmse_ratio_vs_naive").alias("ratio"))
    v = F.when(F.col("ratio") < good, "better").when(F.col("ratio") <= bad, "similar").otherwise("worse")
    return m.withColumn("verdict", v)


def hash_order(c: Column, seed: int) -> Column:
    """An order that other engines can reproduce."""
    return F.md5(F.concat(c.cast("string"), F.lit(f":{seed}")))


def stratified_holdout(entities: DataFrame, entity: str, stratum: str, share: float = 0.2, seed: int = 42) -> DataFrame:
    """``share`` of each stratum's entities, at least one, by hash order; column ``held_out``."""
    w = W.partitionBy(stratum)
    n = F.count(F.lit(1)).over(w)
    r = F.row_number().over(w.orderBy(hash_order(F.col(entity), seed), entity))
    return entities.withColumn("held_out", r <= F.greatest(F.lit(1), F.bround(n * share).cast("int")))


def sample_per_group(df: DataFrame, group: str, key: str, n: int, seed: int = 1) -> DataFrame:
    """``n`` rows of each group in hash order."""
    w = W.partitionBy(group).orderBy(hash_order(F.col(key), seed), key)
    return df.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= n).drop("__r")
