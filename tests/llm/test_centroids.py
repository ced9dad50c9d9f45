"""Clusters by annulus search against Lloyd's rounds over every pair."""

import hashlib
import math
import random

import numpy as np

from layerwise.llm import centroids


def by_hand(rows, k=centroids.K, rounds=centroids.ROUNDS, dim=centroids.DIM):
    """rows (id, vector) -> sorted (id, vector, cluster, distance), all in Python's integers."""
    hold = lambda x: max(min(x * 256.0, float(centroids.WIDEST)), float(-centroids.WIDEST))
    kept = [(i, tuple(math.floor(hold(x)) for x in v)) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    drawn = lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1])
    centers = [v for _, v in sorted(kept, key=drawn)[:k]]
    away = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    own = lambda v: min((away(v, c), j) for j, c in enumerate(centers))
    for _ in range(rounds):
        at = [own(v)[1] for _, v in kept]
        for j in set(at):
            members = [v for (_, v), a in zip(kept, at) if a == j]
            centers[j] = tuple(sum(x) // len(members) for x in zip(*members))
    capped = lambda d, j: (j, min(d, centroids.LARGEST))
    return sorted(((i is None, i or 0, *capped(*own(v))) for i, v in kept)), centers


def found(spark, rows, shape="vec_id long, embedding array<double>", **more):
    got = centroids.cluster(spark.createDataFrame(rows, shape), **more)
    return sorted((r.vec_id is None, r.vec_id or 0, r.cluster, r.distance) for r in got.rows.collect()), got


def test_clusters_of_random_vectors(spark):
    rng = random.Random(1)
    rows = [(i, [rng.gauss(0, 1 + i % 5) for _ in range(8)]) for i in range(400)]
    expected, centers = by_hand(rows, k=12, dim=8)
    got, clusters = found(spark, rows, k=12, dim=8)
    assert got == expected and [tuple(c) for c in clusters.centers] == centers


def test_sums_and_digests(spark):
    rng = random.Random(2)
    rows = [(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(60)]
    expected, centers = by_hand(rows, k=5, dim=4)
    got = centroids.summed(centroids.cluster(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), k=5, dim=4)).collect()
    total = sum(r.distance for r in got)
    for r in got:
        assert r.inertia == total and r.cluster_inertia == sum(x.distance for x in got if x.cluster == r.cluster)
    assert {r.centroid_sha256 for r in got} <= {hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centers}
    assert len(got) == len(expected)


def test_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, v) for i, v in enumerate([None, [], [1.0], [1.0, None], [nan, 1.0], [inf, 0.0], [0.0, 0.0], [1e300, -1e300], [5e6, 1.0], [-1e-9, 1e-9], [0.5, 0.5], [0.5, 0.5]])]
    rows += [(None, [0.25, 0.25]), (10, [0.5, 0.5]), (10, [0.25, 9.0]), (-3, [0.0, 1.0])]  # no id; a repeated row; one id twice
    for k in (1, 3, 40):
        assert found(spark, rows, k=k, dim=2)[0] == by_hand(rows, k=k, dim=2)[0], k


def test_ties_go_to_the_smaller_number(spark):
    """Equal centroids, and vectors half-way between two of them, on the annulus' edge."""
    rows = [(i, [float(x), float(y)]) for i, (x, y) in enumerate([(0, 1), (0, -1), (1, 0), (-1, 0), (0, 0), (0, 1), (2, 0), (-2, 0)] * 3)]
    for rounds in (0, 1, 5):
        assert found(spark, rows, k=7, dim=2, rounds=rounds)[0] == by_hand(rows, k=7, dim=2, rounds=rounds)[0]


def test_nothing_to_cluster(spark):
    assert found(spark, [])[0] == [] and found(spark, [(1, None), (2, [1.0])])[0] == []
    assert centroids.summed(centroids.cluster(spark.createDataFrame([], "vec_id long, embedding array<float>"))).count() == 0


def test_clashing_columns_pass_through(spark):
    rows = [(i, [float(i), 1.0], "a", "b", "c", "d") for i in range(9)]
    got = centroids.cluster(spark.createDataFrame(rows, "vec_id long, embedding array<double>, _key string, _v string, cluster string, _row string"), k=2, dim=2).rows
    assert got.columns == ["vec_id", "embedding", "_key", "_v", "_row", "cluster", "distance"] and {r._v for r in got.collect()} == {"b"}


def test_the_annulus_leaves_most_centroids_out():
    """Where norms differ, few are compared; what it finds is the nearest all the same."""
    rng = np.random.default_rng(3)
    centers = (rng.normal(0, 1, (200, 16)) * np.linspace(1, 4000, 200)[:, None]).astype(np.int64)
    x = centers[rng.integers(0, 200, 3000)] + rng.integers(-3, 4, (3000, 16))
    a = centroids.Annulus([list(map(int, c)) for c in centers])
    number, distance = a.nearest(x)
    every = ((x[:, None] - centers[None]) ** 2).sum(axis=2)
    assert (distance == every.min(axis=1)).all() and (number == every.argmin(axis=1)).all()
    assert a.compared < 0.2 * len(x) * len(centers)
