"""Segment scoring as pipeline stages that are saved and loaded without fitting.

The stages hold what was fitted: the folder of the label codes, loadings of the
class components, means and deviations, centres and the longest distance.  All
of them are column expressions.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

import numpy as np
from pyspark import keyword_only
from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retentia.operators import segments
from retentia.operators.segments import CLASS_COLUMNS, FEATURES, LABEL_COLUMNS
from retentia.session import materialise
from retentia.sources.artifacts import Version

CODES, PIPELINE = "codes", "pipeline"


class _Stage(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """A stage whose parameters are given by keyword."""

    def _set_from(self, values: dict) -> None:
        self._set(**{k: v for k, v in values.items() if v is not None})

    def _value(self, name: str):
        return self.getOrDefault(name)


class LabelCodes(_Stage):
    """``<column>_code`` of every column by a stored table of column, label and code."""

    columns = Param(Params._dummy(), "columns", "label columns", TypeConverters.toListString)
    path = Param(Params._dummy(), "path", "folder of the code table", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, columns=None, path=None):
        super().__init__()
        self._set_from(self._input_kwargs)

    def _transform(self, rows: DataFrame) -> DataFrame:
        codes = rows.sparkSession.read.parquet(self._value("path"))
        return segments.encode_labels(rows, codes, self._value("columns"))


class Defaults(_Stage):
    """Missing coordinates and areas replaced, the area in its bucket."""

    @keyword_only
    def __init__(self):
        super().__init__()

    def _transform(self, rows: DataFrame) -> DataFrame:
        return segments.with_defaults(rows)


class ClassComponents(_Stage):
    """``class_pca1``, ``class_pca2``, ...: the centred class codes times the loadings, one row of them per component."""

    centre = Param(Params._dummy(), "centre", "mean of each class code", TypeConverters.toListFloat)
    loadings = Param(Params._dummy(), "loadings", "loadings, component by component", TypeConverters.toListFloat)

    @keyword_only
    def __init__(self, *, centre=None, loadings=None):
        super().__init__()
        self._set_from(self._input_kwargs)

    def _transform(self, rows: DataFrame) -> DataFrame:
        centre = self._value("centre")
        loadings = np.reshape(self._value("loadings"), (-1, len(centre))).tolist()
        codes = [F.col(f"{c}_code").cast("double") - m for c, m in zip(CLASS_COLUMNS, centre, strict=True)]
        sums = [reduce(add, [c * x for c, x in zip(codes, row, strict=True)]) for row in loadings]
        return rows.withColumns({f"class_pca{i}": s for i, s in enumerate(sums, 1)})


class Scaled(_Stage):
    """(x - mean) / deviation of every column, in an array ``vec``; the columns stay as they are."""

    columns = Param(Params._dummy(), "columns", "feature columns", TypeConverters.toListString)
    means = Param(Params._dummy(), "means", "mean of each column", TypeConverters.toListFloat)
    deviations = Param(Params._dummy(), "deviations", "deviation of each column", TypeConverters.toListFloat)

    @keyword_only
    def __init__(self, *, columns=None, means=None, deviations=None):
        super().__init__()
        self._set_from(self._input_kwargs)

    def _transform(self, rows: DataFrame) -> DataFrame:
        fitted = zip(self._value("columns"), self._value("means"), self._value("deviations"), strict=True)
        return rows.withColumn("vec", F.array(*[(F.col(c).cast("double") - m) / d for c, m, d in fitted]))


class NearestCentre(_Stage):
    """``cluster``, the first of the nearest centres, and ``similarity``: 1 - distance / longest distance."""

    centres = Param(Params._dummy(), "centres", "centres, one after the other", TypeConverters.toListFloat)
    size = Param(Params._dummy(), "size", "components of a centre", TypeConverters.toInt)
    longest = Param(Params._dummy(), "longest", "largest distance of a training row to any centre", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, centres=None, size=None, longest=None):
        super().__init__()
        self._set_from(self._input_kwargs)

    def distances(self) -> Column:
        """Squared distance of ``vec`` to every centre."""
        centres = np.reshape(self._value("centres"), (-1, self._value("size"))).tolist()
        parts = [F.get("vec", F.lit(i)) for i in range(self._value("size"))]
        return F.array(*[reduce(add, [(p - x) * (p - x) for p, x in zip(parts, c, strict=True)]) for c in centres])

    def _transform(self, rows: DataFrame) -> DataFrame:
        apart = rows.withColumn("_apart", self.distances()).withColumn("_least", F.array_min("_apart"))
        cluster = (F.array_position("_apart", F.col("_least")) - 1).cast("int")
        similarity = 1 - F.sqrt("_least") / self._value("longest")
        return apart.withColumns({"cluster": cluster, "similarity": similarity}).drop("_apart", "_least")


def assemble(
    codes_path: str, centre: Sequence[float], loadings: Sequence[float], means: Sequence[float],
    deviations: Sequence[float], centres: Sequence[float], longest: float,
) -> PipelineModel:
    """The scoring pipeline from fitted values."""
    return PipelineModel(
        [
            LabelCodes(columns=LABEL_COLUMNS, path=codes_path),
            Defaults(),
            ClassComponents(centre=list(centre), loadings=list(loadings)),
            Scaled(columns=FEATURES, means=list(means), deviations=list(deviations)),
            NearestCentre(centres=list(centres), size=len(FEATURES), longest=longest),
        ]
    )


def scale_of(rows: DataFrame, columns: list[str] = FEATURES) -> tuple[list[float], list[float]]:
    """Means and population deviations; a constant column has deviation 1."""
    found = rows.agg(*[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"s_{c}") for c in columns]).first()
    return [float(found[f"m_{c}"]) for c in columns], [float(found[f"s_{c}"] or 1.0) for c in columns]


def longest_distance(vectors: DataFrame, centres: Sequence[float], size: int = len(FEATURES)) -> float:
    """Largest distance between a row's ``vec`` and any centre; 1 if all are zero."""
    stage = NearestCentre(centres=list(centres), size=size, longest=1.0)
    found = vectors.agg(F.max(F.array_max(stage.distances())).alias("d")).first()["d"]
    return float(found) ** 0.5 if found else 1.0


def centre_of(rows: DataFrame) -> list[float]:
    """Means of the class codes."""
    found = rows.agg(*[F.avg(f"{c}_code").alias(c) for c in CLASS_COLUMNS]).first()
    return [float(found[c]) for c in CLASS_COLUMNS]


def loadings_of(rows: DataFrame) -> tuple[list[float], list[float]]:
    """Means of the class codes and loadings of their components; each component's largest loading is positive."""
    model, centre = segments.fit_class_pca(rows)
    parts = model.pc.toArray().T
    signs = [np.sign(p[np.abs(p).argmax()]) or 1.0 for p in parts]
    return centre, [float(x) for p, s in zip(parts, signs, strict=True) for x in p * s]


def fit(
    training: DataFrame, version: Version, k: int | None = 10, ks: range = range(2, 21), restarts: int = 10,
    iterations: int = 300, seed: int = 42, loadings: Sequence[float] | None = None, centres: Sequence[float] | None = None,
) -> PipelineModel:
    """Fits codes, components, scale and centres, and writes all of it into the version.

    ``training`` has the label columns, ``lat``, ``lon`` and ``area``.  Without
    ``k`` the number of clusters of the best silhouette among ``ks`` is taken.
    ``loadings`` and ``centres`` that are given, those of a model fitted
    elsewhere, aren't fitted.
    """
    codes = version.write(segments.label_codes(training, LABEL_COLUMNS), CODES)
    encoded = materialise(Defaults().transform(segments.encode_labels(training, codes, LABEL_COLUMNS)), "encoded")
    centre, fitted = loadings_of(encoded) if loadings is None else (centre_of(encoded), loadings)
    loadings = list(fitted)
    projected = materialise(ClassComponents(centre=centre, loadings=loadings).transform(encoded), "projected")
    means, deviations = scale_of(projected)
    vectors = Scaled(columns=FEATURES, means=means, deviations=deviations).transform(projected)
    vectors = materialise(vectors.select("vec", segments.array_to_vector(F.col("vec")).alias("features")), "vectors")
    if centres is None:
        if k is None:
            model, _ = segments.choose_k(vectors, ks, restarts, iterations, seed)
        else:
            model = segments.fit_clusters(vectors, k, restarts, iterations, seed)
        centres = [float(x) for c in model.clusterCenters() for x in c]
    scorer = assemble(version.path(CODES), centre, loadings, means, deviations, centres, longest_distance(vectors, centres))
    version.save(scorer, PIPELINE)
    return scorer
