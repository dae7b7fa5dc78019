"""Churn model: split, fit, score, evaluate, store."""

from __future__ import annotations

from itertools import product

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from retentia.operators.explain import scoring_variant, top_contributions, wide_explanation
from retentia.operators.selection import PARALLEL
from retentia.schemas import MODEL_FEATURES
from retentia.session import materialise

THRESHOLD = 0.5
POSITIVE_WEIGHT = 3.0

# Default settings and the searched grid.
DEFAULTS = {"maxDepth": 5, "stepSize": 0.1, "maxIter": 200, "subsamplingRate": 0.8}
FEATURE_SHARE = "0.8"
GRID = {
    "maxDepth": [3, 5, 7],
    "stepSize": [0.01, 0.1, 0.3],
    "maxIter": [100, 200, 300],
    "subsamplingRate": [0.8, 1.0],
    "featureSubsetStrategy": ["0.8", "1.0"],
}
GRID_WEIGHTS = [1.0, 3.0, 5.0]


def check_classes(rows: DataFrame, label: str) -> None:
    """A training set without one of the classes is an error, not a model."""
    present = {r[0] for r in rows.select(label).distinct().collect()}
    if present != {0, 1}:
        raise ValueError(f"training needs both classes, found {sorted(present)}")


def weighted(rows: DataFrame, label: str, weight: float = POSITIVE_WEIGHT) -> DataFrame:
    return rows.withColumn("_weight", F.when(F.col(label) == 1, weight).otherwise(1.0))


def _classifier(label: str, seed: int, **settings) -> GBTClassifier:
    return GBTClassifier(
        labelCol=label, featuresCol="_features", weightCol="_weight", seed=seed,
        featureSubsetStrategy=FEATURE_SHARE, **settings,
    )


def fit_churn(rows: DataFrame, label: str = "churn", features: list[str] = MODEL_FEATURES, seed: int = 42, **settings) -> PipelineModel:
    """Boosted trees on the feature columns, positives weighted threefold."""
    check_classes(rows, label)
    assembler = VectorAssembler(inputCols=features, outputCol="_features")
    model = _classifier(label, seed, **{**DEFAULTS, **settings})
    return Pipeline(stages=[assembler, model]).fit(weighted(rows, label))


def search_churn(
    rows: DataFrame, label: str = "churn", features: list[str] = MODEL_FEATURES, seed: int = 42,
    grid: dict[str, list] | None = None, weights: list[float] | None = None, folds: int = 3, key: str = "ccod",
    parallel: int = PARALLEL,
) -> tuple[PipelineModel, float]:
    """Best model of a cross-validated grid by area under the ROC curve.

    The rows are assembled and dealt to folds, by a hash of their key, once;
    all settings of all folds are fitted over that table, ``parallel`` at a
    time.  Of equal scores the first setting wins, lighter weights first.
    """
    check_classes(rows, label)
    assembler = VectorAssembler(inputCols=features, outputCol="_features")
    weighed = {f"_weight_{i}": F.when(F.col(label) == 1, float(w)).otherwise(1.0) for i, w in enumerate(weights or GRID_WEIGHTS)}
    fold = F.pmod(F.xxhash64(F.lit(seed), key), F.lit(folds)).cast("int")
    dealt = assembler.transform(rows).select(label, "_features", *[c.alias(n) for n, c in weighed.items()], fold.alias("_fold"))
    model = _classifier(label, seed)
    builder = ParamGridBuilder().addGrid(model.weightCol, list(weighed))
    for name, values in (grid or GRID).items():
        builder = builder.addGrid(model.getParam(name), values)
    search = CrossValidator(
        estimator=model, estimatorParamMaps=builder.build(), numFolds=folds, foldCol="_fold", seed=seed, parallelism=parallel,
        evaluator=BinaryClassificationEvaluator(labelCol=label, rawPredictionCol="rawPrediction"),
    ).fit(materialise(dealt, "folds"))
    return PipelineModel([assembler, search.bestModel]), max(search.avgMetrics)


def grid_size(grid: dict[str, list] | None = None, weights: list[float] | None = None) -> int:
    return len(list(product(*(grid or GRID).values()))) * len(weights or GRID_WEIGHTS)


def importances(model: PipelineModel, features: list[str] = MODEL_FEATURES) -> list[float]:
    vector = model.stages[-1].featureImportances
    return [float(vector[i]) for i in range(len(features))]


def importance_rank(spark, names: list[str], values: list[float], k: int = 10) -> DataFrame:
    rows = spark.createDataFrame(list(zip(names, values, strict=True)), "feature string, importance double")
    return rows.orderBy(F.desc("importance"), "feature").limit(k)


def score(model: PipelineModel, rows: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Probability of churn and the decision at a threshold."""
    scored = model.transform(rows).withColumn("churn_prob", vector_to_array("probability")[1])
    helpers = ["_features", "rawPrediction", "probability", "prediction"]
    return scored.withColumn("churn_label", F.when(F.col("churn_prob") > threshold, 1).otherwise(0)).drop(*helpers)


def predict_churn(
    model: PipelineModel,
    features: DataFrame,
    snapshot_month: Column,
    normal_means: dict[str, float],
    churn_means: dict[str, float],
    variant: str = "diverse",
    threshold: float = THRESHOLD,
) -> DataFrame:
    """The stored prediction of every customer: score, decision, ten reasons.

    Score and reasons come from one pass over the rows; none is moved.
    """
    scored = score(model, scoring_variant(features, variant), threshold)
    explained = top_contributions(scored, importances(model), keep=["churn_prob", "churn_label"]).where(F.col("ccod").isNotNull())
    return explained.select(
        snapshot_month.alias("snapshot_month"), "ccod", "churn_prob", "churn_label",
        *wide_explanation(explained, normal_means, churn_means),
    )


def confusion(scored: DataFrame, label: str, prediction: str) -> DataFrame:
    return scored.groupBy(label, prediction).agg(F.count(F.lit(1)).alias("n"))


def class_report(scored: DataFrame, label: str, prediction: str) -> DataFrame:
    """Precision, recall, F1 and support per class, from one pass."""
    sides = scored.select(
        F.explode(
            F.array(
                F.struct(F.col(label).alias("class"), F.lit(1).alias("actual"), F.lit(0).alias("said"),
                         (F.col(label) == F.col(prediction)).cast("int").alias("hit")),
                F.struct(F.col(prediction).alias("class"), F.lit(0).alias("actual"), F.lit(1).alias("said"),
                         F.lit(0).alias("hit")),
            )
        ).alias("s")
    ).select("s.*")
    totals = sides.groupBy("class").agg(
        F.sum("actual").alias("support"), F.sum("said").alias("predicted"), F.sum("hit").alias("hits")
    )
    precision = F.when(F.col("predicted") > 0, F.col("hits") / F.col("predicted")).otherwise(0.0)
    recall = F.when(F.col("support") > 0, F.col("hits") / F.col("support")).otherwise(0.0)
    both = totals.withColumns({"precision": precision, "recall": recall})
    f1 = F.when(F.col("precision") + F.col("recall") > 0,
                2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0)
    return both.withColumn("f1", f1).drop("hits")


def roc_auc(scored: DataFrame, label: str, probability: str) -> DataFrame:
    """Exact area under the ROC curve with its counts: ``positives``, ``negatives``, ``roc_auc``; one row.

    The share of pairs of a positive and a negative in which the positive
    scores higher, half for ties.  Rows are counted per distinct score first;
    scores are ranked inside range partitions and only the partitions' totals
    are put in one order.  Null labels and scores are left out; without both
    classes the area is null.
    """
    is_one = F.col(label) == 1
    counts = scored.where(F.col(label).isNotNull() & F.col(probability).isNotNull()).groupBy(F.col(probability).alias("score")).agg(
        F.count_if(is_one).alias("ones"), F.count_if(~is_one).alias("zeros")
    )
    placed = materialise(counts.repartitionByRange("score").withColumn("part", F.spark_partition_id()), "scores")
    below = F.coalesce(F.sum("zeros").over(Window.partitionBy("part").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = placed.withColumn("won", F.col("ones") * (below + F.col("zeros") / 2))
    parts = inside.groupBy("part").agg(F.sum("won").alias("won"), F.sum("ones").alias("ones"), F.sum("zeros").alias("zeros"))
    # One row per partition.
    before = F.coalesce(F.sum("zeros").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = parts.withColumn("won", F.col("won") + F.col("ones") * before).agg(
        F.sum("won").alias("won"), F.coalesce(F.sum("ones"), F.lit(0)).alias("positives"), F.coalesce(F.sum("zeros"), F.lit(0)).alias("negatives")
    )
    pairs = F.nullif(F.col("positives").cast("double") * F.col("negatives"), F.lit(0.0))
    return total.select("positives", "negatives", (F.col("won") / pairs).alias("roc_auc"))


def save_model(model: PipelineModel, means: DataFrame, path: str) -> None:
    model.write().overwrite().save(f"{path}/model")
    means.write.mode("overwrite").parquet(f"{path}/means")


def load_model(spark, path: str) -> tuple[PipelineModel, DataFrame]:
    return PipelineModel.load(f"{path}/model"), spark.read.parquet(f"{path}/means")
