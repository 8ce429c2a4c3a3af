"""Models on Spark ML: ridge, forests, boosted trees, their search and evaluation over time folds."""

from __future__ import annotations

import random

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import Imputer, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import clip, nan_to_null


def usable(df: DataFrame, numeric: list[str]) -> list[str]:
    """Numeric columns with any value; an all-null one cannot be imputed."""
    row = df.agg(*[F.count(nan_to_null(F.col(c))).alias(c) for c in numeric]).first()
    return [c for c in numeric if row[c]]


def as_features(df: DataFrame, numeric: list[str], categorical: list[str], indicators: bool = False) -> DataFrame:
    """NaN as null, null categories as a value of their own, and flags of missing numbers for trees."""
    out = df.withColumns({c: nan_to_null(F.col(c).cast("double")) for c in numeric} | {c: F.coalesce(F.col(c).cast("string"), F.lit("∅")) for c in categorical})
    return out.withColumns({f"{c}_missing": F.col(c).isNull().cast("double") for c in numeric}) if indicators else out


def category_codes(train: DataFrame, column: str) -> DataFrame:
    """``(column, code)`` in the order of the values, from 0."""
    from pyspark.sql import Window as W

    return train.select(column).filter(F.col(column).isNotNull()).distinct().withColumn("code", F.row_number().over(W.orderBy(column)) - 1)


def with_codes(df: DataFrame, codes: DataFrame, column: str, out: str) -> DataFrame:
    """Codes joined by value; unseen and null values get -1."""
    return df.join(codes.withColumnRenamed("code", "__code"), column, "left").withColumn(out, F.coalesce("__code", F.lit(-1))).drop("__code")


def ridge(numeric: list[str], categorical: list[str], target: str, alpha: float, n: int, target_sd: float) -> Pipeline:
    """Medians imputed, standardized, one-hot; the penalty is scaled so that it equals alpha on the plain squared error."""
    med = [f"{c}__m" for c in numeric]
    stages = [Imputer(strategy="median", inputCols=numeric, outputCols=med), VectorAssembler(inputCols=med, outputCol="__num"), StandardScaler(withMean=True, inputCol="__num", outputCol="__std")]
    parts = ["__std"]
    for c in categorical:
        stages += [StringIndexer(inputCol=c, outputCol=f"{c}__i", handleInvalid="keep"), OneHotEncoder(inputCol=f"{c}__i", outputCol=f"{c}__o", handleInvalid="keep", dropLast=False)]
        parts.append(f"{c}__o")
    stages += [VectorAssembler(inputCols=parts, outputCol="features"), LinearRegression(labelCol=target, solver="normal", elasticNetParam=0.0, standardization=False, regParam=alpha / max(1, n) * target_sd)]
    return Pipeline(stages=stages)


def _tree_stages(numeric: list[str], categorical: list[str]) -> list:
    med = [f"{c}__m" for c in numeric]
    stages = [Imputer(strategy="median", inputCols=numeric, outputCols=med)]
    stages += [StringIndexer(inputCol=c, outputCol=f"{c}__i", handleInvalid="keep", stringOrderType="alphabetAsc") for c in categorical]
    return [*stages, VectorAssembler(inputCols=[*med, *[f"{c}_missing" for c in numeric], *[f"{c}__i" for c in categorical]], outputCol="features")]


def forest(numeric: list[str], categorical: list[str], target: str, trees: int = 150, depth: int = 10, leaf: int = 10) -> Pipeline:
    return Pipeline(stages=[*_tree_stages(numeric, categorical), RandomForestRegressor(labelCol=target, numTrees=trees, maxDepth=depth, minInstancesPerNode=leaf, maxBins=64, seed=42)])


def boosted(numeric: list[str], categorical: list[str], target: str, rounds: int = 60, depth: int = 5, step: float = 0.1, leaf: int = 10, subsample: float = 0.8, validation: str | None = None) -> Pipeline:
    """Boosted trees; with ``validation`` (a boolean column) rounds stop early on those rows."""
    g = GBTRegressor(labelCol=target, maxIter=rounds, maxDepth=depth, stepSize=step, minInstancesPerNode=leaf, subsamplingRate=subsample, maxBins=64, seed=42)
    if validation:
        g = g.setValidationIndicatorCol(validation)
    return Pipeline(stages=[*_tree_stages(numeric, categorical), g])


def predict(model: PipelineModel, df: DataFrame, target: str) -> DataFrame:
    return model.transform(df).select("fold", F.col(target).cast("double").alias("y_true"), clip(F.col("prediction"), 0.0, 1.0).alias("y_pred"))


def evaluate(folded: DataFrame, target: str, numeric: list[str], categorical: list[str], make: dict) -> DataFrame:
    """Predictions of each model for the test rows of each fold; folds and models are a short fixed loop."""
    out = None
    for fold in [r["fold"] for r in folded.select("fold").distinct().orderBy("fold").collect()]:
        part = folded.filter((F.col("fold") == fold) & F.col(target).isNotNull())
        train, test = part.filter("part = 'train'"), part.filter("part = 'test'")
        nums = usable(train, numeric)
        if not nums:
            continue
        tr, te = as_features(train, nums, categorical, True), as_features(test, nums, categorical, True)
        for name, build in make.items():
            p = predict(build(nums, categorical, tr).fit(tr), te, target).withColumn("model", F.lit(name))
            out = p if out is None else out.unionByName(p)
    return out


def ridge_for(target: str, alpha: float = 1.0):  # noqa: ANN201
    def build(nums: list[str], cats: list[str], train: DataFrame) -> Pipeline:
        r = train.agg(F.count(F.lit(1)).alias("n"), F.stddev_pop(target).alias("sd")).first()
        return ridge(nums, cats, target, alpha, r["n"], r["sd"] or 1.0)

    return build


def search(folded: DataFrame, target: str, numeric: list[str], categorical: list[str], trials: int = 8, seed: int = 42) -> list[dict]:
    """Seeded search over the boosting parameters by mean RMSE of the folds, later trials drawn near the best so far."""
    from .folds import scores

    rnd, tried = random.Random(seed), []
    space = {"rounds": (20, 80), "depth": (3, 7), "step": (0.03, 0.3), "leaf": (5, 50), "subsample": (0.6, 1.0)}
    for t in range(trials):
        best = min(tried, key=lambda x: x["rmse"]) if tried else None
        p = {}
        for k, (a, b) in space.items():
            v = rnd.uniform(a, b) if best is None or t < trials // 2 else min(b, max(a, rnd.gauss(best[k], (b - a) / 6)))
            p[k] = round(v) if isinstance(a, int) else v
        pred = evaluate(folded.filter("fold <> 'H'"), target, numeric, categorical, {"boosted": lambda n, c, _t, p=p: boosted(n, c, target, **p)})
        rmse = scores(pred, ("fold",)).agg(F.avg("rmse")).first()[0]
        tried.append(p | {"rmse": rmse})
    return sorted(tried, key=lambda x: x["rmse"])


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)
