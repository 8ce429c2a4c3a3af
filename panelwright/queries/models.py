"""Named queries of the model operators; their results are compared with bounds and invariants in tests, not with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import nan_to_null
from ..ml import explain, folds, models
from ..operators import report
from ..plans import panel as pl
from ..session import materialize, table
from . import panel

NUMERIC = ["ur_b_current", "ur_b_lag1", "ur_b_lag2", "log_nta_ira", "log_total_local_sources", "nta_dependency", "income_class_num", "log_population", "log_land_area_sqkm", "pop_density", "fiscal_year", "election_year", "pi_2018"]
CATEGORICAL = ["lgu_type", "region"]
STOP_YEAR = 2019


def _input(spark: SparkSession, d: str) -> DataFrame:
    """Rows with a target, with the first poverty estimate of their unit beside the features of the matrix."""
    _, wide = pl.poverty_forms(panel.coded_poverty(spark, d), "psa_id")
    x = pl.model_input(table(spark, d, "panel_ml")).join(wide.select("psgc10", "pi_2018"), "psgc10", "left")
    return materialize(x.select("row_id", "psgc10", "lgu_name", "target", *[F.col(c).cast("double").alias(c) if c != "fiscal_year" else F.col(c) for c in NUMERIC], *CATEGORICAL), "model-input")


def _folded(x: DataFrame) -> DataFrame:
    return folds.assign_folds(x, folds.fold_table(x.sparkSession), "fiscal_year")


def _models() -> dict:
    return {"ridge": models.ridge_for("target"), "forest": lambda n, c, _t: models.forest(n, c, "target"), "boosted": lambda n, c, _t: models.boosted(n, c, "target")}


def model_scores(spark: SparkSession, d: str) -> DataFrame:
    """Ridge, forest and boosted trees with their default parameters beside the three baselines, over all folds."""
    f = _folded(_input(spark, d))
    pred = models.evaluate(f, "target", NUMERIC, CATEGORICAL, _models())
    base = folds.baseline_predictions(f, "target", "ur_b_current")
    return folds.against_naive(folds.scores(pred.unionByName(base.select("fold", "y_true", "y_pred", "model"))))


def _fitted(x: DataFrame):  # noqa: ANN202
    """The final model: fitted up to the last year before the holdout, whose rows tell when to stop adding trees."""
    train = x.filter(F.col("fiscal_year") <= STOP_YEAR)
    nums = models.usable(train, NUMERIC)
    tr = models.as_features(train, nums, CATEGORICAL, True).withColumn("stop", F.col("fiscal_year") == STOP_YEAR)
    return nums, models.boosted(nums, CATEGORICAL, "target", validation="stop").fit(tr)


def _contributions(spark: SparkSession, d: str) -> tuple[DataFrame, list[str]]:
    x = _input(spark, d)
    nums, model = _fitted(x)
    names = [*nums, *[f"{c}_missing" for c in nums], *CATEGORICAL]
    rows = model.transform(models.as_features(x, nums, CATEGORICAL, True))
    c = explain.contributions(rows, explain.export_trees(model.stages[-1]), ["row_id", "psgc10", "prediction"], "features", names)
    return materialize(c, "contributions"), names


def attribution_rows(spark: SparkSession, d: str) -> DataFrame:
    c, names = _contributions(spark, d)
    total = sum([F.col(n) for n in names[1:]], F.col(names[0])) + F.col("bias")
    return c.select("row_id", "prediction", total.alias("summed"), *names, "bias")


def attribution_ranking(spark: SparkSession, d: str) -> DataFrame:
    c, names = _contributions(spark, d)
    return report.share_and_rank(explain.to_long(c, ["row_id"], names), "feature", "value", 8)


def entity_clusters(spark: SparkSession, d: str) -> DataFrame:
    c, names = _contributions(spark, d)
    e = c.groupBy("psgc10").agg(*[F.avg(n).alias(n) for n in names])
    return explain.clusters(materialize(e, "entities"), "psgc10", names).select("psgc10", "cluster", *names)


def cluster_signatures(spark: SparkSession, d: str) -> DataFrame:
    c = entity_clusters(spark, d)
    return explain.signatures(materialize(c, "clusters"), [n for n in c.columns if n not in ("psgc10", "cluster")])


def category_codes(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "panel_ml")
    codes = models.category_codes(p.filter("fiscal_year < 2010"), "income_class")
    return models.with_codes(p.select("row_id", "income_class"), codes, "income_class", "code").select("row_id", F.col("code").cast("int").alias("code"))


def spatial_scores(spark: SparkSession, d: str) -> DataFrame:
    """The models fitted without a fifth of each region's entities and scored on them."""
    x = _input(spark, d)
    held = folds.stratified_holdout(x.select("psgc10", "region").distinct(), "psgc10", "region").select("psgc10", "held_out")
    f = x.join(held, "psgc10").withColumn("fold", F.lit("S")).withColumn("part", F.when(F.col("held_out"), "test").otherwise("train"))
    pred = models.evaluate(f, "target", NUMERIC, CATEGORICAL, _models())
    return folds.scores(pred)


def missing_as_value(spark: SparkSession, d: str) -> DataFrame:
    """The -999 fill that a linear model gets where nulls are not imputed."""
    p = table(spark, d, "panel_ml")
    return p.select("row_id", *[F.coalesce(nan_to_null(F.col(c)), F.lit(-999.0)).alias(c) for c in ("nta_dependency", "population")])


def queries() -> dict:
    return {f.__name__: f for f in (model_scores, attribution_rows, attribution_ranking, entity_clusters, cluster_signatures, category_codes, spatial_scores, missing_as_value)}


SQL = {
    "category_codes": "WITH c AS (SELECT income_class, row_number() OVER (ORDER BY income_class) - 1 AS code FROM (SELECT DISTINCT income_class FROM panel_ml WHERE fiscal_year < 2010 AND income_class IS NOT NULL)) SELECT row_id, CAST(coalesce(code, -1) AS INTEGER) AS code FROM panel_ml LEFT JOIN c USING (income_class)",
    "missing_as_value": "SELECT row_id, coalesce(CASE WHEN isnan(nta_dependency) THEN NULL ELSE nta_dependency END, -999) AS nta_dependency, coalesce(CASE WHEN isnan(population) THEN NULL ELSE population END, -999) AS population FROM panel_ml",
}
