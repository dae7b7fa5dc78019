"""Nearest member of the same cluster, without comparing all pairs.

The exact form is a pivot join in two phases, after the published k-nearest-neighbour
joins for map-reduce (Lu et al., VLDB 2012):

1. Equal vectors are one point; it keeps its two smallest ids.
2. Every large cluster gets pivots (members with the smallest hash), in all a
   bounded number.  Points and queries belong to the cell of their nearest pivot.
3. A query is answered in its own cell first.
4. The distance found decides which other cells may hold something closer: by
   the nearest and farthest point of a cell from its pivot (triangle inequality)
   and by the plane between both pivots, on whose far side the cell lies.  Only
   those are searched.
5. Cells are cut into blocks of bounded size on both sides; one task compares
   one block of queries with one block of points and returns one row per query.

The approximate form hashes vectors by random projections and compares, exactly,
only those that share a bucket.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import Accumulator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retentia.functions.numbers import as_doubles
from retentia.operators.groups import join_back, top_per_group
from retentia.session import materialise

# Points aimed at per cell, and the bound on pivots.  They are all that reaches
# the driver and the tasks: at most twice MAX_PIVOTS vectors, as a cluster gets
# more than one only for every larger part of all points.
CELL_POINTS = 20_000
MAX_PIVOTS = 10_000
BLOCK = 20_000
# Points that a block compares without groups, and distances held at once.
FINE = 500
MATRIX = 1_000_000
# Share of the groups beyond which a query is compared with the whole block.
WIDE = 0.4
# Margin for the rounding of the fast distance form; a wider one only searches more.
SLACK = 1e-6
# Hash tables, projections per table, width of a bucket in typical nearest distances, queries that measure those.
TABLES, PROJECTIONS, WIDTH, PROBES = 12, 4, 4.0, 200


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of a and b, up to rounding."""
    cross = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * (a @ b.T)
    return np.maximum(cross, 0.0)


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype("float64")


def _placed(vectors: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of every vector and its distance."""
    found, step = [], max(1, MATRIX // len(centres))
    for start in range(0, len(vectors), step):
        d2 = _distances(vectors[start : start + step], centres)
        found.append((d2.argmin(1), np.sqrt(d2.min(1))))
    cells, reach = zip(*found, strict=True)
    return np.concatenate(cells), np.concatenate(reach)


def _open(d2: np.ndarray, home: np.ndarray, centres: np.ndarray, ring: tuple[np.ndarray, np.ndarray], have: np.ndarray) -> np.ndarray:
    """Whether a cell may hold something as close as a query ``have``, by its ring and the plane towards the query's home.

    ``d2``: squared distances of the queries to the centres; ``ring``: nearest and farthest point of every cell.
    """
    d = np.sqrt(d2)
    apart = np.maximum(np.sqrt(_distances(centres[home], centres)), 1e-300)
    plane = (d2 - d2[np.arange(len(home)), home][:, None]) / (2 * apart)
    least = np.maximum(np.maximum(d - ring[1], ring[0] - d), plane)
    return (ring[1] >= 0) & (least <= (have + SLACK * (1.0 + d.max()))[:, None])


def _typed(rows: DataFrame) -> DataFrame:
    return rows.select("id", "cluster", as_doubles(F.col("vec")).alias("vec"))


def _points(members: DataFrame) -> DataFrame:
    """Distinct vectors of a cluster with their two smallest ids.

    The second one answers a query that is itself the first.  The rank filter
    keeps two rows per task and vector, so many copies of one vector never
    meet.  A vector one member has alone repeats its id.
    """
    lowest = top_per_group(members, ["cluster", "vec"], [F.col("id")], 2)
    return lowest.groupBy("cluster", "vec").agg(F.min("id").alias("id"), F.max("id").alias("id2"))


def _pivots(points: DataFrame, cell_points: int, max_pivots: int) -> dict:
    """Pivot vectors of the clusters that need more than one cell."""
    sizes = materialise(points.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")), "sizes")
    total = sizes.agg(F.sum("n")).first()[0] or 0
    cell = max(cell_points, total // max_pivots)
    large = sizes.where(F.col("n") > cell).select("cluster", F.ceil(F.col("n") / cell).alias("wanted"))
    mine = points.select("cluster", "id", "vec").join(large, "cluster")
    # Ranking one cluster is cut to that many rows per task before the shuffle.
    ranked = top_per_group(mine, ["cluster"], [F.xxhash64("id"), F.col("id")], 2 * max_pivots)
    table: dict = {}
    for row in ranked.where("rank <= wanted").orderBy("cluster", "rank").collect():
        table.setdefault(row["cluster"], []).append(row["vec"])
    return {c: np.asarray(v, dtype="float64") for c, v in table.items()}


def _search(exclude_self: bool, counter: Accumulator | None) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """Nearest of a block of points for each of a block of queries, exact and with the smaller id on ties.

    A large block is searched as a large cluster is: its points belong to the
    nearest of some of them, and a query looks into those groups only that may
    hold something as close as what it has.  A query may come with a
    ``distance`` it has found elsewhere; then it gets a row only if this block
    may have something as close.
    """

    def search(asking: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        if asking.empty or known.empty:
            return pd.DataFrame({"id": [], "neighbor_id": [], "distance": []})
        points, queries = _matrix(known["vec"]), _matrix(asking["vec"])
        scale = 1.0 + (points * points).sum(1).max() + (queries * queries).sum(1).max()
        # Points in the order of their groups.
        picked = np.random.default_rng(0).choice(len(points), int(len(points) ** 0.5) if len(points) > FINE else 1, replace=False)
        centres = points[picked]
        group, reach = _placed(points, centres)
        order = np.argsort(group, kind="stable")
        points, group, reach = points[order], group[order], reach[order]
        starts = np.searchsorted(group, np.arange(len(centres) + 1))
        ring = np.full(len(centres), np.inf), np.full(len(centres), -np.inf)
        np.minimum.at(ring[0], group, reach)
        np.maximum.at(ring[1], group, reach)
        ids, seconds, own = known["id"].to_numpy()[order], known["id2"].to_numpy()[order], asking["id"].to_numpy()
        # The point that is only the query itself, which cannot answer it.
        place = {i: k for k, (i, second) in enumerate(zip(ids, seconds, strict=True)) if i == second} if exclude_self else {}
        barred = np.array([place.get(i, -1) for i in own])
        names, distance = np.repeat(ids[:1], len(own)), np.full(len(own), np.inf)
        bound = asking["distance"].fillna(np.inf).to_numpy() if "distance" in asking else distance

        def compare(rows: np.ndarray, lo: int, hi: int) -> None:
            """Lets some queries take the nearest of the points from ``lo`` to ``hi`` if it is better than what they have."""
            if counter is not None:
                counter.add(len(rows) * (hi - lo))
            step = max(1, MATRIX // max(1, hi - lo))
            for start in range(0, len(rows) if hi > lo else 0, step):
                mine = rows[start : start + step]
                q, some, self_at = queries[mine], points[lo:hi], barred[mine] - lo
                d2 = _distances(q, some)
                hit = np.flatnonzero((self_at >= 0) & (self_at < hi - lo))
                d2[hit, self_at[hit]] = np.inf
                best = d2.argmin(1)
                least = d2[np.arange(len(mine)), best]
                answer = ids[lo:hi][best]
                if exclude_self:
                    answer = np.where(answer == own[mine], seconds[lo:hi][best], answer)
                exact = np.sqrt(((some[best] - q) ** 2).sum(1))
                # Rounding of the fast form is far below this margin; what lies within it is compared exactly.
                margin = 1e-9 * scale
                close = d2 <= (least + margin)[:, None]
                matters = np.isfinite(least) & (least <= distance[mine] ** 2 + 2 * margin)
                for row in np.flatnonzero((close.sum(1) > 1) & matters):
                    pick = np.flatnonzero(close[row])
                    apart = np.sqrt(((some[pick] - q[row]) ** 2).sum(1))
                    pairs = zip(ids[lo:hi][pick], seconds[lo:hi][pick], strict=True)
                    answers = [s if exclude_self and n == own[mine[row]] else n for n, s in pairs]
                    exact[row], answer[row] = min(zip(apart, answers, strict=True))
                equal = np.flatnonzero(matters & (exact == distance[mine]))
                better = matters & (exact < distance[mine])
                better[equal] = [answer[r] < names[mine[r]] for r in equal]
                distance[mine[better]], names[mine[better]] = exact[better], answer[better]

        if len(centres) == 1:
            compare(np.arange(len(own)), 0, len(points))
        for start in range(0, len(own) if len(centres) > 1 else 0, max(1, MATRIX // len(centres))):
            rows = np.arange(start, min(len(own), start + max(1, MATRIX // len(centres))))
            d2 = _distances(queries[rows], centres)
            home = d2.argmin(1)
            turn = np.argsort(home, kind="stable")
            cuts = np.searchsorted(home[turn], np.arange(len(centres) + 1))
            # A query with a distance opens its own group by the same rule as the others.
            free = np.isinf(bound[rows])
            for j in range(len(centres)):
                at = turn[cuts[j] : cuts[j + 1]]
                compare(rows[at[free[at]]], starts[j], starts[j + 1])
            wanted = _open(d2, home, centres, ring, np.minimum(distance[rows], bound[rows]))
            wanted[np.flatnonzero(free), home[free]] = False
            # Where little can be left out, one comparison with all is faster than many small ones.
            wide = wanted.mean(1) > WIDE
            compare(rows[wide], 0, len(points))
            wanted[wide] = False
            for j in np.flatnonzero(wanted.any(0)):
                compare(rows[wanted[:, j]], starts[j], starts[j + 1])
        kept = np.isfinite(distance)
        return pd.DataFrame({"id": own[kept], "neighbor_id": names[kept], "distance": distance[kept]})

    return search


def _searched(
    asked: DataFrame, points: DataFrame, cells: list[str], exclude_self: bool, block: int, counter: Accumulator | None
) -> DataFrame:
    """One row per query and block of points: queries and points that share ``cells`` meet in blocks.

    ``asked``: cells, id, vec; ``points``: cells, vec, id, id2.  Both are written tables.
    """
    def count(rows: DataFrame, name: str) -> DataFrame:
        return rows.groupBy(*cells).agg(F.count(F.lit(1)).alias(name))

    sizes = count(asked, "q").join(count(points, "p"), cells)
    blocks = [F.ceil(F.col(c) / block).cast("int").alias(f"{c}_blocks") for c in ("q", "p")]
    sizes = materialise(sizes.select(*cells, *blocks, F.greatest("q", "p").alias("_rows")), "cuts")

    def dealt(rows: DataFrame, own: str, other: str) -> DataFrame:
        # Cells that only one side has find nothing here.
        cuts = join_back(rows, sizes, cells).where("q_blocks IS NOT NULL")
        mine = F.pmod(F.xxhash64("id"), F.col(f"{own}_blocks")).cast("int").alias(own)
        every = F.explode(F.sequence(F.lit(0), F.col(f"{other}_blocks") - 1)).alias(other)
        return cuts.select(*rows.columns, mine, every)

    keys = [*cells, "q", "p"]
    id_type = asked.schema["id"].dataType.simpleString()
    return (
        dealt(asked, "q", "p").groupBy(*keys).cogroup(dealt(points, "p", "q").groupBy(*keys))
        .applyInPandas(_search(exclude_self, counter), f"id {id_type}, neighbor_id {id_type}, distance double")
    )


def _nearest(found: DataFrame) -> DataFrame:
    best = found.groupBy("id").agg(F.min(F.struct("distance", "neighbor_id")).alias("b"))
    return best.select("id", "b.neighbor_id", "b.distance")


def nearest_in_cluster(
    queries: DataFrame,
    members: DataFrame,
    *,
    exclude_self: bool = False,
    cell_points: int = CELL_POINTS,
    max_pivots: int = MAX_PIVOTS,
    block: int = BLOCK,
    counter: Accumulator | None = None,
) -> DataFrame:
    """Nearest member in the query's cluster; the smaller id wins a tie.

    Both sides: id (of one type, unique among the queries), cluster, vec (array
    of numbers).  Result: id, neighbor_id, distance.  A query without any member
    has no row.  ``counter`` adds up the pairs compared.
    """
    spark = queries.sparkSession
    queries, points = _typed(queries), materialise(_points(_typed(members)), "points")
    pivots = spark.sparkContext.broadcast(_pivots(points, cell_points, max_pivots))
    cluster_type = points.schema["cluster"].dataType.simpleString()
    id_type = points.schema["id"].dataType.simpleString()

    def assign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for cluster, part in frame.groupby("cluster"):
                if cluster not in pivots.value:
                    yield part.assign(cell=0, reach=0.0, pivoted=False)
                    continue
                cell, reach = _placed(_matrix(part["vec"]), pivots.value[cluster])
                yield part.assign(cell=cell, reach=reach, pivoted=True)

    placed = points.mapInPandas(
        assign, f"cluster {cluster_type}, vec array<double>, id {id_type}, id2 {id_type}, cell int, reach double, pivoted boolean"
    )
    placed = materialise(placed, "cells")
    homes = queries.mapInPandas(assign, f"id {id_type}, cluster {cluster_type}, vec array<double>, cell int, reach double, pivoted boolean")
    homes = materialise(homes.select("cluster", "cell", "id", "vec"), "homes")
    known = placed.select("cluster", "cell", "vec", "id", "id2")
    found = materialise(_nearest(_searched(homes, known, ["cluster", "cell"], exclude_self, block, counter)), "found")
    if not pivots.value:
        return found

    # One row per pivot: as bounded as the pivots themselves.  Clusters of one cell have no pivot.
    ringed = placed.where("pivoted").groupBy("cluster", "cell").agg(F.min("reach").alias("near"), F.max("reach").alias("far"))
    rings = {(r["cluster"], r["cell"]): (r["near"], r["far"]) for r in ringed.collect()}
    shapes = spark.sparkContext.broadcast(rings)

    def route(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The other cells in which a query may find something closer than it has."""
        for frame in frames:
            for cluster, part in frame.groupby("cluster"):
                if cluster not in pivots.value:
                    continue
                centres = pivots.value[cluster]
                ring = np.array([shapes.value.get((cluster, j), (np.inf, -np.inf)) for j in range(len(centres))]).T
                # Rows that come out of a step are as bounded as its matrix, but hold a vector each.
                width = len(centres) * len(part["vec"].iloc[0])
                step = max(1, MATRIX // width)
                for at in range(0, len(part), step):
                    some = part.iloc[at : at + step]
                    home = some["cell"].to_numpy()
                    d2 = _distances(_matrix(some["vec"]), centres)
                    wanted = _open(d2, home, centres, (ring[0], ring[1]), some["distance"].fillna(np.inf).to_numpy())
                    wanted[np.arange(len(some)), home] = False
                    rows, cols = np.nonzero(wanted)
                    yield some.iloc[rows].assign(cell=cols.astype("int32"))[["cluster", "cell", "id", "vec", "distance"]]

    open_ = homes.join(found.select("id", "distance"), "id", "left").select("cluster", "cell", "id", "vec", "distance")
    routed = open_.mapInPandas(route, f"cluster {cluster_type}, cell int, id {id_type}, vec array<double>, distance double")
    others = _searched(materialise(routed, "routed"), known, ["cluster", "cell"], exclude_self, block, counter)
    return _nearest(found.unionByName(others))


def hashed_in_cluster(
    queries: DataFrame,
    members: DataFrame,
    *,
    exclude_self: bool = False,
    tables: int = TABLES,
    projections: int = PROJECTIONS,
    width: float = WIDTH,
    probes: int = PROBES,
    block: int = BLOCK,
    seed: int = 7,
    counter: Accumulator | None = None,
) -> DataFrame:
    """As ``nearest_in_cluster``, but a member is found only if it shares a bucket with the query.

    Each of the ``tables`` cuts ``projections`` random directions into buckets;
    their width is ``width`` times the distance within which nine in ten of
    ``probes`` queries have their nearest member, found exactly.  A nearest member at that
    distance is missed by all tables with a probability of about one in five
    hundred.  Candidates are compared exactly, buckets in blocks of bounded
    size.  Vectors are of one length.  A query that meets no member has no row.
    """
    spark = queries.sparkSession
    queries, points = materialise(_typed(queries), "queries"), materialise(_points(_typed(members)), "points")
    first = points.select(F.size("vec")).first()
    sample = queries.orderBy(F.xxhash64(F.lit(seed), "id")).limit(probes)
    near = nearest_in_cluster(sample, members, exclude_self=exclude_self, block=block)
    typical = near.where("distance > 0").agg(F.percentile("distance", 0.9)).first()[0] or 1.0
    chance = np.random.default_rng(seed)
    directions = chance.standard_normal((first[0] if first else 1, tables * projections))
    offsets = chance.uniform(0.0, 1.0, tables * projections)
    shared = spark.sparkContext.broadcast((directions / (width * typical), offsets))

    def buckets(vectors: pd.Series) -> np.ndarray:
        directions, offsets = shared.value
        return np.floor(_matrix(vectors) @ directions + offsets).astype("int64").reshape(len(vectors), tables, projections)

    def hashed(kept: list[str]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                if len(frame):
                    found = buckets(frame["vec"])
                    for t in range(tables):
                        yield frame[kept].assign(table=t, bucket=list(found[:, t]))

        return run

    cluster_type = points.schema["cluster"].dataType.simpleString()
    id_type = points.schema["id"].dataType.simpleString()
    places = "`table` int, bucket array<long>"
    asked = queries.mapInPandas(hashed(["id", "cluster", "vec"]), f"id {id_type}, cluster {cluster_type}, vec array<double>, {places}")
    known = points.mapInPandas(
        hashed(["cluster", "vec", "id", "id2"]), f"cluster {cluster_type}, vec array<double>, id {id_type}, id2 {id_type}, {places}"
    )
    asked, known = (materialise(t.withColumn("bucket", F.xxhash64("table", "bucket")).drop("table"), "buckets") for t in (asked, known))
    return _nearest(_searched(asked, known, ["cluster", "bucket"], exclude_self, block, counter))
