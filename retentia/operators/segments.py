"""Customer segments: encoding, scaling, clustering and similarity."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA, PCAModel, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retentia.functions.numbers import (
    DEFAULT_AREA,
    DEFAULT_LATITUDE,
    DEFAULT_LONGITUDE,
    area_bucket,
    as_doubles,
    distance,
    lenient_double,
)
from retentia.operators.groups import numbered_within, one_row
from retentia.operators.kmeans import Clusters, fit_all
from retentia.operators.selection import PARALLEL, concurrently, kept

CLASS_COLUMNS = ["class_major", "class_mid", "class_minor", "class_detail"]
LABEL_COLUMNS = [*CLASS_COLUMNS, "sido", "sigungu", "biz_type"]
FEATURES = ["lat", "lon", "sido_code", "sigungu_code", "class_pca1", "class_pca2", "biz_type_code", "area_bucket"]
UNKNOWN = "Unknown"
UNSEEN_CODE = 0


def label_codes(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Code of every distinct label of the columns: column, label, code.

    A code is the label's position in sorted order, from 0.  Labels are ranked
    by range partitions, so no task ranks all labels of a column.
    """
    named = [F.struct(F.lit(c).alias("column"), F.coalesce(c, F.lit(UNKNOWN)).alias("label")) for c in columns]
    labels = rows.select(F.explode(F.array(*named)).alias("x")).select("x.*").distinct()
    return numbered_within(labels, "column", "label", "code").select("column", "label", F.col("code").cast("int"))


def encode_labels(rows: DataFrame, codes: DataFrame, columns: list[str], unseen: int = UNSEEN_CODE) -> DataFrame:
    """``<column>_code`` for every column; a label the codes lack gets ``unseen``."""
    for column in columns:
        own = codes.where(F.col("column") == column)
        lookup = own.select(F.col("label").alias("_label"), F.col("code").alias("_code"))
        rows = (
            rows.withColumn("_label", F.coalesce(column, F.lit(UNKNOWN)))
            .join(lookup, "_label", "left")
            .withColumn(f"{column}_code", F.coalesce("_code", F.lit(unseen)))
            .drop("_label", "_code")
        )
    return rows


def with_defaults(rows: DataFrame) -> DataFrame:
    """Missing coordinates and areas replaced, area bucketed."""
    return rows.withColumns(
        {
            "lat": F.coalesce(lenient_double(F.col("lat")), F.lit(DEFAULT_LATITUDE)),
            "lon": F.coalesce(lenient_double(F.col("lon")), F.lit(DEFAULT_LONGITUDE)),
            "area_bucket": area_bucket(F.coalesce(lenient_double(F.col("area")), F.lit(DEFAULT_AREA))),
        }
    )


def standardise(rows: DataFrame, columns: list[str], training: DataFrame | None = None) -> DataFrame:
    """(x - mean) / population deviation; a constant column keeps scale 1."""
    base = rows if training is None else training
    stats = base.agg(
        *[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"s_{c}") for c in columns]
    )
    fitted = one_row(stats)

    def scaled(c: str) -> Column:
        deviation = fitted[f"s_{c}"]
        return (F.col(c) - fitted[f"m_{c}"]) / F.when(deviation > 0, deviation).otherwise(1.0)

    return rows.withColumns({c: scaled(c) for c in columns})


def fit_class_pca(encoded: DataFrame, components: int = 2) -> tuple[PCAModel, list[float]]:
    """Principal components of the four class codes, and the means to centre by."""
    columns = [f"{c}_code" for c in CLASS_COLUMNS]
    means = encoded.agg(*[F.avg(c).alias(c) for c in columns]).first()
    centre = [float(means[c]) for c in columns]
    centred = encoded.select(array_to_vector(_centred(columns, centre)).alias("codes"))
    return PCA(k=components, inputCol="codes", outputCol="components").fit(centred), centre


def _centred(columns: list[str], centre: list[float]) -> Column:
    return F.array(*[F.col(c).cast("double") - m for c, m in zip(columns, centre, strict=True)])


def apply_class_pca(encoded: DataFrame, model: PCAModel, centre: list[float]) -> DataFrame:
    columns = [f"{c}_code" for c in CLASS_COLUMNS]
    with_codes = encoded.withColumn("codes", array_to_vector(_centred(columns, centre)))
    parts = vector_to_array(F.col("components"))
    projected = model.transform(with_codes)
    return projected.withColumns({"class_pca1": parts[0], "class_pca2": parts[1]}).drop("codes", "components")


def with_vector(rows: DataFrame, columns: list[str], into: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=columns, outputCol=into).transform(rows)


def _cheapest(models: list[Clusters]) -> Clusters:
    """The lowest cost; the first of equal ones."""
    return min(models, key=lambda m: m.cost)


def fit_clusters(
    rows: DataFrame, k: int = 10, restarts: int = 10, iterations: int = 300, seed: int = 42
) -> Clusters:
    """K-means with the lowest cost of several starts, which take their steps together.

    ``rows`` holds the vector column ``features``; give a materialised table.
    """
    return _cheapest(fit_all(rows, [(k, seed + i) for i in range(restarts)], iterations))


@dataclass(frozen=True)
class ClusterQuality:
    k: int
    cost: float
    silhouette: float
    davies_bouldin: float


def davies_bouldin(assigned: DataFrame, model: Clusters) -> float:
    """Mean over clusters of the worst (spread_i + spread_j) / centre distance.

    Spread comes from one grouped pass; the rest is k x k arithmetic.
    """
    centers = np.array([c.tolist() for c in model.clusterCenters()])
    spread_rows = (
        assigned.select("cluster", center_distance(F.col("features"), F.col("cluster"), model).alias("d"))
        .groupBy("cluster").agg(F.avg("d").alias("s")).collect()
    )
    spread = {r["cluster"]: r["s"] for r in spread_rows}
    worst = []
    for i in spread:
        ratios = [
            (spread[i] + spread[j]) / np.linalg.norm(centers[i] - centers[j]) for j in spread if j != i
        ]
        worst.append(max(ratios, default=0.0))
    return float(np.mean(worst))


def cluster_quality(rows: DataFrame, model: Clusters) -> ClusterQuality:
    assigned = model.transform(rows)
    silhouette = ClusteringEvaluator(featuresCol="features", predictionCol="cluster").evaluate(assigned)
    return ClusterQuality(
        len(model.clusterCenters()), model.cost, silhouette, davies_bouldin(assigned, model)
    )


def choose_k(
    rows: DataFrame, ks: range = range(2, 21), restarts: int = 10, iterations: int = 300, seed: int = 42, parallel: int = PARALLEL
) -> tuple[Clusters, list[ClusterQuality]]:
    """The model with the best silhouette, and the scores of all.

    All starts of all numbers of clusters take their steps together over one
    kept table; the winner is that of fitting them one after the other.
    """
    with kept(rows.select("features").repartition(2 * rows.sparkSession.sparkContext.defaultParallelism)) as vectors:
        fitted = fit_all(vectors, [(k, seed + i) for k in ks for i in range(restarts)], iterations)
        models = [_cheapest(fitted[at : at + restarts]) for at in range(0, len(fitted), restarts)]
        scores = concurrently(rows.sparkSession, [lambda m=m: cluster_quality(vectors, m) for m in models], parallel)
    best = max(range(len(scores)), key=lambda i: scores[i].silhouette)
    return models[best], scores


def _centers(model: Clusters) -> Column:
    return F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in model.clusterCenters()])


def center_distance(features: Column, cluster: Column, model: Clusters) -> Column:
    return distance(vector_to_array(features), F.get(_centers(model), cluster))


def longest_center_distance(rows: DataFrame, model: Clusters) -> float:
    """Largest distance between any training row and any centre."""
    vector = vector_to_array(F.col("features"))
    farthest = F.array_max(F.transform(_centers(model), lambda c: distance(vector, c)))
    return rows.agg(F.max(farthest)).first()[0]


def centroids(members: DataFrame) -> DataFrame:
    """Mean vector per cluster, for clusters given as labels.

    ``members``: cluster, vec.  Averages are combined map-side per dimension.
    """
    parts = members.select("cluster", F.posexplode(as_doubles(F.col("vec"))).alias("dim", "x"))
    means = parts.groupBy("cluster", "dim").agg(F.avg("x").alias("x"))
    packed = means.groupBy("cluster").agg(F.sort_array(F.collect_list(F.struct("dim", "x"))).alias("v"))
    return packed.select("cluster", F.col("v.x").alias("center"))


def cluster_similarity(members: DataFrame, centers: DataFrame) -> DataFrame:
    """1 - distance to the own centre / largest distance to any centre.

    Every row meets every centre inside its own row: the centres are one
    array, bounded by the number of clusters.
    """
    table = centers.agg(F.sort_array(F.collect_list(F.struct("cluster", "center"))).alias("t"))
    rows = members.withColumn("_t", one_row(table)["t"]).withColumn("_v", as_doubles(F.col("vec")))
    apart = F.transform("_t", lambda c: F.struct(c["cluster"].alias("cluster"), distance(F.col("_v"), c["center"]).alias("d")))
    rows = rows.withColumn("_d", apart)
    longest = rows.agg(F.max(F.array_max(F.transform("_d", lambda x: x["d"])))).scalar()
    own = F.get(F.filter("_d", lambda x: x["cluster"] == F.col("cluster")), F.lit(0))["d"]
    return rows.select(*members.columns, own.alias("distance"), (1 - own / longest).alias("similarity"))
