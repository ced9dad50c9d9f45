"""Centroid clustering in exact integers, each vector compared only with the centroids in its annulus.

Centroids are sorted by norm. By the triangle inequality |‖c‖ - ‖x‖| <= ‖c - x‖, so a centroid nearer than some
known one, at distance u, has a norm within u of the vector's. The known one is the nearest of the `near`
centroids whose norms are closest to the vector's; both ends of the annulus are found by binary search, a little
wider than floating point needs, so that ties on its boundary are compared too. All comparisons are of exact
squared distances.

A round is one pass over the vectors: each task adds up its vectors by cluster, Spark adds up the tasks' sums,
and the driver divides k sums. Nothing else moves; no cluster's vectors ever meet.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, stored

DIM, K, ROUNDS, SCALE, SEED = 64, 40, 5, 256, 2
NEAR = 3
#: Scaled components are held in [-2**40, 2**40]; those of up to 2**21 are compared in doubles, which are exact there.
WIDEST, EXACT = 1 << 40, 1 << 21
LARGEST = (1 << 63) - 1


@dataclass
class Clusters:
    """rows(all columns of the input, cluster int, distance long); centers: exact components by cluster number."""

    rows: DataFrame
    centers: list[list[int]]


class Annulus:
    """Finds the nearest of some integer centroids; of several that are as near, the one with the smallest number."""

    def __init__(self, centers: list[list[int]], near: int = NEAR) -> None:
        big = np.array(centers, object).reshape(len(centers), -1)
        squares = (big * big).sum(axis=1)
        self.order = np.array(sorted(range(len(centers)), key=lambda j: (squares[j], j)), np.int64)
        self.centers, self.squares = big[self.order], squares[self.order]
        self.norms = np.sqrt(self.squares.astype(np.float64))
        self.near = min(near, len(centers))
        self.wide = int(np.abs(big).max(initial=0)) > EXACT
        self.compared = 0

    def distances(self, x: np.ndarray, squares: np.ndarray, j: int) -> np.ndarray:
        """Exact squared distances of rows to the j-th centroid by norm: doubles, or objects where those aren't exact."""
        return squares - 2 * (x @ self.centers[j].astype(x.dtype)) + x.dtype.type(self.squares[j]) if x.dtype != object else squares - 2 * (x @ self.centers[j]) + self.squares[j]

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """int64 rows -> (cluster, squared distance), the latter at most LARGEST."""
        n = len(vectors)
        if not n:
            return np.empty(0, np.int32), np.empty(0, np.int64)
        exact = np.float64 if not self.wide and int(np.abs(vectors).max(initial=0)) <= EXACT else object
        x = vectors.astype(exact)
        squares = (x * x).sum(axis=1)
        norm = np.sqrt(squares.astype(np.float64))
        first = np.clip(np.searchsorted(self.norms, norm) - self.near // 2, 0, len(self.norms) - self.near)
        best = np.full(n, np.inf).astype(exact)
        number = np.full(n, len(self.norms), np.int64)
        done = np.zeros((n, len(self.norms)), bool)

        def compare(rows: np.ndarray, j: int) -> None:
            d = self.distances(x[rows], squares[rows], j)
            own = int(self.order[j])
            better = (d < best[rows]) | ((d == best[rows]) & (own < number[rows]))
            best[rows[better]], number[rows[better]] = d[better], own
            self.compared += len(rows)

        for step in range(self.near):
            at = first + step
            for j in np.unique(at).tolist():
                rows = np.flatnonzero(at == j)
                compare(rows, j)
                done[rows, j] = True
        reach = np.sqrt(best.astype(np.float64))
        slack = 1e-9 * (1 + norm + reach)
        low, high = np.searchsorted(self.norms, norm - reach - slack, "left"), np.searchsorted(self.norms, norm + reach + slack, "right")
        for j in range(int(low.min()), int(high.max())):
            rows = np.flatnonzero((low <= j) & (j < high) & ~done[:, j])
            if len(rows):
                compare(rows, j)
        distance = best.astype(np.int64) if exact is np.float64 else np.array([min(d, LARGEST) for d in best], np.int64)
        return number.astype(np.int32), distance


def usable(vector: Column, dim: int = DIM) -> Column:
    """Whether a vector is kept: so many components, none of them null or not finite."""
    return F.coalesce((F.size(vector) == dim) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))), F.lit(False))


def scaled(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of every component, as longs; beyond ±2**40 it stays there."""
    held = lambda x: F.greatest(F.least(x.cast("double") * F.lit(float(scale)), F.lit(float(WIDEST))), F.lit(float(-WIDEST)))
    return F.transform(vector, lambda x: F.floor(held(x)).cast("long"))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _sums(annulus: Annulus, dim: int):
    """Arrow batches (_v) -> (cluster, n, sums): a row for each cluster that a task has met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count, k = np.zeros((len(annulus.order), dim), np.int64), np.zeros(len(annulus.order), np.int64), np.arange(len(annulus.order), dtype=np.int32)

        def row() -> pa.RecordBatch:
            met = np.flatnonzero(count)
            return pa.RecordBatch.from_arrays([pa.array(k[met]), pa.array(count[met]), pa.array(list(total[met]), pa.list_(pa.int64()))], ["cluster", "n", "sums"])

        for b in batches:
            if count.sum() >= 1 << 21:  # as many components of 2**40 as a long holds
                yield row()
                total[:], count[:] = 0, 0
            x = _matrix(b.column(0), dim)
            number, _ = annulus.nearest(x)
            np.add.at(total, number, x)
            count += np.bincount(number, minlength=len(count))
        yield row()

    return run


def _assigned(annulus: Annulus, dim: int, at: int):
    """Arrow batches -> with cluster and distance; the vectors are the column at `at`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            number, distance = annulus.nearest(_matrix(b.column(at), dim))
            yield pa.RecordBatch.from_arrays([*b.columns[:at], pa.array(number), pa.array(distance)], [*b.schema.names[:at], "cluster", "distance"])

    return run


def cluster(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE, seed: int = SEED, key: str = "vec_id", column: str = "embedding") -> Clusters:
    """Lloyd's rounds over integer vectors, exact and the same in every run.

    Kept are vectors with `dim` components, none null or not finite; the others are left out. The first centroids
    are the k kept vectors whose `<seed>:<key>` has the least SHA-256; of rows with one key the least vector comes
    first, and rows without a key come after all others. With fewer than k vectors each is a centroid. A cluster
    without vectors keeps its centroid. Repeated rows all count. Components are held in ±2**40 (see scaled), a
    distance beyond a long is the largest long. An empty table, or one without a kept vector, gives no rows and no
    centroids. Columns of any name pass through, but for `cluster` and `distance`, which are replaced. What is
    collected: k vectors, and k sums a round.
    """
    bounded_batches(vectors.sparkSession)
    passed = [c for c in vectors.columns if c not in ("cluster", "distance")]
    packed = F.struct(*[vectors[f"`{c}`"] for c in passed]).alias("_row")
    kept = vectors.where(usable(F.col(f"`{column}`"), dim)).select(packed, F.col(f"`{key}`").alias("_key"), scaled(F.col(f"`{column}`"), scale).alias("_v"))
    kept = stored(kept, "scaled-vectors")
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("_key").cast("string")), 256)
    centers = [list(r[0]) for r in kept.orderBy(F.asc_nulls_last(drawn), "_v").select("_v").limit(k).collect()]  # k vectors
    shape = "cluster int, n long, sums array<bigint>"
    for _ in range(rounds if centers else 0):
        parts = kept.select("_v").mapInArrow(_sums(Annulus(centers), dim), shape)
        sums = [F.sum(F.col("sums")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(dim)]
        for r in parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*sums).alias("s")).collect():  # k rows
            centers[r.cluster] = [int(s) // r.n for s in r.s]
    if not centers:
        empty = kept.select("_row.*", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"))
        return Clusters(empty, centers)
    names = kept.select("_row", "_v")
    out = names.mapInArrow(_assigned(Annulus(centers), dim, 1), names.select("_row", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")).schema)
    return Clusters(out.select("_row.*", "cluster", "distance"), centers)


def summed(found: Clusters) -> DataFrame:
    """The rows with cluster_inertia and inertia (at most the largest long) and centroid_sha256, of the centroid's components as text."""
    spark = found.rows.sparkSession
    rows = stored(found.rows, "clustered")
    digests = [(j, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for j, c in enumerate(found.centers)]
    total = F.sum(F.col("distance").cast("decimal(38,0)"))
    own = {r.cluster: int(r.d) for r in rows.groupBy("cluster").agg(total.alias("d")).collect()}  # k rows
    every = min(sum(own.values()), LARGEST)
    table = spark.createDataFrame([(j, min(own.get(j, 0), LARGEST), every, h) for j, h in digests], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(table), "cluster")  # k rows
