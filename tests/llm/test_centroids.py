"""Centroid clustering in whole numbers, against brute force."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from coverlens.llm import centroids

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, clusters, rounds, length):
    kept = []
    for i, v, _ in rows:
        if v is not None and len(v) == length and all(x is not None and math.isfinite(x) and abs(x) < 2**17 for x in v):
            kept.append((i, tuple(math.floor(1024 * float(np.float32(x))) for x in v)))
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centers = [list(p) for _, p in order[:clusters]]

    def assign():
        distances = [[sum((a - b) ** 2 for a, b in zip(p, c)) for c in centers] for _, p in kept]
        return [(d.index(min(d)), min(d)) for d in distances]

    for _ in range(rounds):
        found = assign()
        for j in range(len(centers)):
            own = [p for (_, p), (c, _) in zip(kept, found) if c == j]
            if own:
                centers[j] = [sum(x) // len(own) for x in zip(*own)]
    found = assign()
    inertia = [sum(d for c, d in found if c == j) for j in range(len(centers))]
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centers]
    return sorted(((i, c, d, inertia[c], sum(inertia), digests[c]) for (i, _), (c, d) in zip(kept, found)), key=repr)


def vectors(seed, n, length):
    rng = random.Random(seed)
    middles = [[rng.uniform(-2, 2) for _ in range(length)] for _ in range(5)]
    rows = [(i, [x + rng.gauss(0, 0.3) for x in rng.choice(middles)], i % 3) for i in range(n)]
    nan, inf = float("nan"), float("inf")
    odd = [None, [], [0.0] * (length - 1), [nan] + [0.0] * (length - 1), [inf] + [0.0] * (length - 1), [None] + [0.0] * (length - 1), [3e38] * length]
    rows += [(1000 + i, v, 1) for i, v in enumerate(odd)]
    return rows + [rows[0], rows[0], (None, rows[1][1], None), (7, rows[2][1], 1), (2000, [0.0] * length, 0), (2001, [-130000.0] * length, 0)]


@pytest.mark.parametrize(("seed", "n", "clusters", "length"), [(1, 120, 8, 64), (2, 60, 3, 5), (3, 4, 8, 6)])
def test_equals_brute_force(spark, seed, n, clusters, length):
    rows = vectors(seed, n, length)
    table = spark.createDataFrame(rows, SCHEMA).repartition(3).withColumns({c: F.lit("x") for c in ("x", "cluster", "hash", "points", "near")})
    found = centroids.clustered(table, clusters, 4, length)
    assert sorted(map(tuple, found.collect()), key=repr) == brute(rows, clusters, 4, length)


def test_ties_go_to_the_first_and_empty_clusters_stay(spark):
    rows = [(i, [float(i % 2)], 0) for i in range(12)] + [(20, [0.5], 0)]
    found = centroids.clustered(spark.createDataFrame(rows, SCHEMA), 8, 3, 1)
    assert sorted(map(tuple, found.collect()), key=repr) == brute(rows, 8, 3, 1)


def test_empty(spark):
    assert centroids.clustered(spark.createDataFrame([], SCHEMA)).collect() == []
    assert centroids.clustered(spark.createDataFrame([(1, [1.0], 1)], SCHEMA)).collect() == []


def test_bounds_hold_and_spare_distances():
    rng = np.random.default_rng(5)
    middles = rng.integers(-3000, 3000, (8, 64))
    points = middles[rng.integers(0, 8, 3000)] + rng.integers(-200, 200, (3000, 64))
    pivots = centroids.far_apart(points[:64], 4)
    near = centroids.to_pivots(points, pivots)
    low = centroids.lower_bounds(near, centroids.to_pivots(middles, pivots), centroids.to_pivots(pivots, pivots))
    true = np.stack([centroids.squared(points, c) for c in middles], axis=1)
    assert (low * low <= true).all()
    cluster, distance, measured = centroids.nearest(points, near, middles, pivots)
    assert (cluster == true.argmin(axis=1)).all() and (distance == true.min(axis=1)).all()
    assert measured < 2 * len(points)


def test_bounds_hold_for_the_largest_components():
    edge = centroids.LARGEST - 1
    points = np.array([[edge] * 64, [-edge] * 64, [edge, -edge] * 32, [0] * 64, [1] + [0] * 63], np.int64)
    near = centroids.to_pivots(points, points[:4])
    low = centroids.lower_bounds(near, near, centroids.to_pivots(points[:4], points[:4]))
    exact = [[sum((int(a) - int(b)) ** 2 for a, b in zip(x, y)) for y in points] for x in points]
    assert all(float(low[i, j]) ** 2 <= exact[i][j] for i in range(5) for j in range(5))
    assert centroids.nearest(points, near, points, points[:4])[0].tolist() == [0, 1, 2, 3, 4]
