"""Many k-means fits over one table, in passes that all of them share."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retentia.operators.selection import kept

# A fit ends when no centre moves farther; rows that meet all models at once; rounds over the candidates of a start.
TOLERANCE, ROWS, REDUCING = 1e-4, 2048, 30


class Clusters:
    """Centres of a k-means fit and the sum of squared distances to them when they were last assigned."""

    def __init__(self, centers: np.ndarray, cost: float) -> None:
        self.centers, self.cost = centers, cost

    def clusterCenters(self) -> list[np.ndarray]:
        return list(self.centers)

    def transform(self, rows: DataFrame, features: str = "features", into: str = "cluster") -> DataFrame:
        """The first of the nearest centres of every row."""
        parts = vector_to_array(F.col(features))
        squares = [
            reduce(add, [(parts[i] - float(x)) * (parts[i] - float(x)) for i, x in enumerate(c)]) for c in self.centers
        ]
        apart = F.array(*squares)
        return rows.withColumn(into, (F.array_position(apart, F.array_min(apart)) - 1).cast("int"))


def _blocks(batch: pa.RecordBatch, dims: int) -> Iterator[np.ndarray]:
    """Rows of a batch, a bounded number at once, one column per row."""
    rows = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
    for at in range(0, len(rows), ROWS):
        yield np.ascontiguousarray(rows[at : at + ROWS].T)


def _least(x: np.ndarray, own: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Squared distance of every row to the nearest centre."""
    return np.maximum(own + 2 * ((centers * centers).sum(1)[:, None] / 2 - centers @ x).min(0), 0.0)


def _first(points: DataFrame, seeds: list[int]) -> list[np.ndarray]:
    """One row per seed, each row equally likely: that of the least random number."""
    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = [np.random.default_rng([seed, TaskContext.get().partitionId(), 0]) for seed in seeds]
        best: dict[int, tuple[float, list[float]]] = {}
        for batch in batches:
            for at, chance in enumerate(rng):
                if len(batch):
                    keys = chance.random(len(batch))
                    k = int(keys.argmin())
                    if at not in best or keys[k] < best[at][0]:
                        best[at] = float(keys[k]), batch.column(0)[k].as_py()
        columns = {"at": pa.array(best, pa.int32()), "key": pa.array([b[0] for b in best.values()], pa.float64())}
        yield pa.RecordBatch.from_pydict({**columns, "v": pa.array([b[1] for b in best.values()], pa.list_(pa.float64()))})

    drawn = points.mapInArrow(draw, "at int, key double, v array<double>")
    one = drawn.groupBy("at").agg(F.min(F.struct("key", "v"))["v"].alias("v"))
    return [np.array([r["v"]]) for r in one.orderBy("at").collect()]


def _spread(points: DataFrame, candidates: list[np.ndarray]) -> np.ndarray:
    """Per model the sum over the rows of squared distances to the nearest candidate."""
    shared = points.sparkSession.sparkContext.broadcast(candidates)

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(len(shared.value))
        for batch in batches:
            for x in _blocks(batch, shared.value[0].shape[1]):
                own = (x * x).sum(0)
                sums += [_least(x, own, c).sum() for c in shared.value]
        yield pa.RecordBatch.from_pydict({"at": np.arange(len(sums), dtype=np.int32), "x": sums})

    total = points.mapInArrow(add_up, "at int, x double").groupBy("at").agg(F.sum("x").alias("x"))
    return total.orderBy("at").toArrow()["x"].to_numpy()


def _sampled(points: DataFrame, candidates: list[np.ndarray], chances: np.ndarray, seeds: list[int], step: int) -> list[np.ndarray]:
    """The candidates of each model and rows drawn by their squared distance times the model's chance."""
    shared = points.sparkSession.sparkContext.broadcast((candidates, chances))

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = [np.random.default_rng([seed, TaskContext.get().partitionId(), step]) for seed in seeds]
        known, chance = shared.value
        for batch in batches:
            at, found = [], []
            for x in _blocks(batch, known[0].shape[1]):
                own = (x * x).sum(0)
                for i, c in enumerate(known):
                    chosen = x.T[rng[i].random(x.shape[1]) < chance[i] * _least(x, own, c)]
                    at += [i] * len(chosen)
                    found += chosen.tolist()
            yield pa.RecordBatch.from_pydict({"at": pa.array(at, pa.int32()), "v": pa.array(found, pa.list_(pa.float64()))})

    out = [list(map(tuple, c)) for c in candidates]
    # About twice the clusters of each model.
    for row in points.mapInArrow(draw, "at int, v array<double>").collect():
        out[row["at"]].append(tuple(row["v"]))
    return [np.array(sorted(set(c))) for c in out]


def _reduced(candidates: np.ndarray, weights: np.ndarray, k: int, seed: int) -> np.ndarray:
    """``k`` of the few weighted candidates by k-means++, then moved as MLlib does."""
    if len(candidates) <= k:
        return candidates
    rng = np.random.default_rng(seed)

    def draw(share: np.ndarray) -> int:
        whole = share.sum()
        return int(rng.choice(len(share), p=share / whole if whole > 0 else None))

    centers = candidates[[draw(weights)]]
    apart = ((candidates - centers[0]) ** 2).sum(1)
    while len(centers) < k:
        centers = np.append(centers, candidates[[draw(weights * apart)]], axis=0)
        apart = np.minimum(apart, ((candidates - centers[-1]) ** 2).sum(1))
    before = None
    for _ in range(REDUCING):
        label = ((candidates[:, None] - centers) ** 2).sum(-1).argmin(1)
        if before is not None and (label == before).all():
            break
        before = label
        for j in range(k):
            mine = weights[label == j]
            centers[j] = mine @ candidates[label == j] / mine.sum() if mine.sum() > 0 else candidates[draw(weights)]
    return centers


def starts(points: DataFrame, settings: list[tuple[int, int]]) -> list[np.ndarray]:
    """Centres that k-means|| begins with, per number of clusters and seed, all of them in six passes.

    As MLlib: one random row, twice about 2 k rows drawn by squared distance,
    then k-means++ over these, weighted by the rows nearest to each.
    """
    seeds = [seed * 1000 + k for k, seed in settings]
    candidates = _first(points, seeds)
    if not candidates:
        raise ValueError("no rows to cluster")
    for step in (1, 2):
        spread = _spread(points, candidates)
        chances = np.array([2 * k / s if s > 0 else 0.0 for (k, _), s in zip(settings, spread, strict=True)])
        candidates = _sampled(points, candidates, chances, seeds, step)
    weighed = moved(points, dict(enumerate(candidates)))
    return [_reduced(c, weighed[i][2], k, seed) for i, ((k, _), c, seed) in enumerate(zip(settings, candidates, seeds, strict=True))]


def moved(points: DataFrame, models: dict[int, np.ndarray]) -> dict[int, tuple[np.ndarray, float, np.ndarray]]:
    """One round of Lloyd for all models in one pass over the points: new centres, cost and rows of each centre.

    ``points`` has one column, an array of doubles.  A task meets every model
    with each block of its rows and adds up rows and sums of every centre;
    tasks are added up by Spark.  A centre without rows stays.
    """
    spark = points.sparkSession
    sizes: dict[int, list[int]] = {}
    for i, c in models.items():
        sizes.setdefault(len(c), []).append(i)
    dims = next(iter(models.values())).shape[1]
    groups = [(k, np.concatenate([models[i] for i in own])) for k, own in sizes.items()]
    shared = spark.sparkContext.broadcast(groups)

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups = shared.value
        halves = [(c * c).sum(1) / 2 for _, c in groups]
        sums = [np.zeros((dims + 1, len(c))) for _, c in groups]
        costs = [np.zeros(len(c) // k) for k, c in groups]
        for batch in batches:
            for x in _blocks(batch, dims):
                own = (x * x).sum()
                for (k, centers), half, into, cost in zip(groups, halves, sums, costs, strict=True):
                    # Half of the squared distance, but for the row's own length.
                    apart = (half[:, None] - centers @ x).reshape(-1, k, x.shape[1])
                    least, number = apart[:, 0].copy(), np.uint8 if k < 256 else np.int32
                    label = np.zeros(least.shape, number)
                    for j in range(1, k):
                        # The last one that was nearer than all before it.
                        np.maximum(label, (apart[:, j] < least).view(np.uint8) * number(j), out=label)
                        np.minimum(least, apart[:, j], out=least)
                    cost += 2 * least.sum(1) + own
                    for one, mine in enumerate(label.astype(np.intp)):
                        low = one * k
                        into[dims, low : low + k] += np.bincount(mine, minlength=k)
                        for d in range(dims):
                            into[d, low : low + k] += np.bincount(mine, x[d], k)
        found = np.concatenate([np.concatenate([s.ravel(), c]) for s, c in zip(sums, costs, strict=True)])
        yield pa.RecordBatch.from_pydict({"place": np.arange(len(found), dtype=np.int32), "x": found})

    parts = points.mapInArrow(add_up, "place int, x double").groupBy("place").agg(F.sum("x").alias("x"))
    total = parts.orderBy("place").toArrow()["x"].to_numpy()  # as long as the centres
    shared.destroy()
    out, at = {}, 0
    for k, own in sizes.items():
        n = len(own) * k
        sums = total[at : at + (dims + 1) * n].reshape(dims + 1, len(own), k)
        at += (dims + 1) * n
        for place, i in enumerate(own):
            count, whole = sums[dims, place], sums[:dims, place].T
            centers = np.where(count[:, None] > 0, whole / np.maximum(count, 1)[:, None], models[i])
            out[i] = centers, float(total[at + place]), count
        at += len(own)
    return out


def fit_all(rows: DataFrame, settings: list[tuple[int, int]], iterations: int) -> list[Clusters]:
    """One model per number of clusters and seed; ``rows`` holds the vector column ``features``.

    Each takes the steps of MLlib's fit until no centre moves by more than
    ``TOLERANCE``, but all models share one pass over the rows per step, so
    the passes are as many as the slowest fit takes.
    """
    vectors = rows.select(vector_to_array("features").alias("v"))
    # A short file would be one task, however many models meet its rows.
    tasks = 2 * rows.sparkSession.sparkContext.defaultParallelism
    with kept(vectors.repartition(max(tasks, vectors.rdd.getNumPartitions()))) as points:
        centers = dict(enumerate(starts(points, settings)))
        costs, still = dict.fromkeys(centers, 0.0), dict(centers)
        for _ in range(iterations):
            if not still:
                break
            for i, (after, cost, _) in moved(points, still).items():
                far = ((after - centers[i]) ** 2).sum(1).max()
                centers[i], costs[i] = after, cost
                if far <= TOLERANCE * TOLERANCE:
                    del still[i]
                else:
                    still[i] = after
    return [Clusters(centers[i], costs[i]) for i in range(len(settings))]
