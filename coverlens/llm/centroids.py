"""Centroid clustering in whole numbers, with Ptolemaic pivots to spare distances.

Components are scaled and floored, so that distances, sums and centroids are exact. For any four points v, c, p, q of a
Euclidean space, |vp cq - vq cp| <= vc pq (Ptolemy). With the distances of a vector to a few fixed pivots cached beside
it, every pair of pivots so gives a lower bound of its distance to a centroid. Bounds are rounded down by more than
double precision can err; only centroids whose bound is not above the best distance so far are measured exactly.
"""

from __future__ import annotations

from hashlib import sha256
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coverlens.llm.common import small_batches
from coverlens.session import stored

CLUSTERS = 8
ROUNDS = 10
LENGTH = 64
SCALE = 1024
SEED = 3
PIVOTS = 4
# Vectors, by the order of their hashes, of which the pivots are chosen far apart.
POOL = 64
# Whole components stay below this, so that squared distances of 64 components fit 64 bits.
LARGEST = 1 << 27
# Of a product or quotient of square roots; double precision errs by far less.
ROUNDING = 2.0**-45
MEASURED = "vec_id long, points array<int>, near array<double>"
SUMS = "cluster int, place int, total long, n long"
ASSIGNED = "vec_id long, cluster int, distance long"


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact squared distances, row by row."""
    d = x - y
    return (d * d).sum(axis=-1)


def far_apart(pool: np.ndarray, n: int) -> np.ndarray:
    """Up to n different rows of the pool: the first, then always the one farthest from those taken."""
    chosen = pool[:1]
    gap = squared(pool, chosen[0]) if len(pool) else np.zeros(0, np.int64)
    while len(chosen) < n and gap.any():
        chosen = np.concatenate([chosen, pool[gap.argmax()][None]])
        gap = np.minimum(gap, squared(pool, chosen[-1]))
    return chosen


def to_pivots(points: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances of every point to every pivot."""
    return np.sqrt(np.stack([squared(points, p) for p in pivots], axis=1).astype(np.float64)) if len(pivots) else np.zeros((len(points), 0))


def lower_bounds(near: np.ndarray, far: np.ndarray, apart: np.ndarray) -> np.ndarray:
    """A row per vector, a column per centroid: a distance that the true one is not below. ``near`` and ``far`` have the
    distances of vectors and of centroids to the pivots, ``apart`` those between the pivots."""
    low = np.zeros((len(near), len(far)))
    for p, q in combinations(range(len(apart)), 2):
        x, y = near[:, p, None] * far[None, :, q], near[:, q, None] * far[None, :, p]
        np.maximum(low, (np.abs(x - y) - (x + y) * ROUNDING) * (1 - ROUNDING) / apart[p, q], out=low)
    return low


def nearest(points: np.ndarray, near: np.ndarray, centroids: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Each point's nearest centroid, of equally near ones the first, its squared distance, and how many were measured."""
    low = lower_bounds(near, to_pivots(centroids, pivots), to_pivots(pivots, pivots))
    least = low * low * (1 - ROUNDING)
    cluster = low.argmin(axis=1)
    first = cluster.copy()
    distance = squared(points, centroids[cluster])
    measured = len(points)
    for j in range(len(centroids)):
        rows = np.flatnonzero((least[:, j] <= distance) & (first != j))
        measured += len(rows)
        d = squared(points[rows], centroids[j])
        better = (d < distance[rows]) | ((d == distance[rows]) & (j < cluster[rows]))
        cluster[rows[better]], distance[rows[better]] = j, d[better]
    return cluster, distance, measured


def _points(batch, length: int) -> np.ndarray:
    return np.asarray(batch.column("points").flatten(), np.int64).reshape(batch.num_rows, length)


def _measuring(pivots: np.ndarray, length: int):
    def measure(batches):
        for batch in batches:
            near = to_pivots(_points(batch, length), pivots)
            lists = pa.ListArray.from_arrays(np.arange(batch.num_rows + 1, dtype=np.int32) * len(pivots), near.ravel())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("points"), lists], ["vec_id", "points", "near"])

    return measure


def _assigned(batch, centroids: np.ndarray, pivots: np.ndarray):
    points = _points(batch, centroids.shape[1])
    near = np.asarray(batch.column("near").flatten(), np.float64).reshape(batch.num_rows, len(pivots))
    return points, *nearest(points, near, centroids, pivots)[:2]


def _summing(centroids: np.ndarray, pivots: np.ndarray):
    k, length = centroids.shape

    def total(batches):
        sums, sizes = np.zeros((k, length), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            points, cluster, _ = _assigned(batch, centroids, pivots)
            for j in range(k):
                sums[j] += points[cluster == j].sum(axis=0)
            sizes += np.bincount(cluster, minlength=k)
        columns = [np.repeat(np.arange(k), length), np.tile(np.arange(length), k), sums.ravel(), np.repeat(sizes, length)]
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], [x.split()[0] for x in SUMS.split(", ")])

    return total


def _assigning(centroids: np.ndarray, pivots: np.ndarray):
    def assign(batches):
        for batch in batches:
            _, cluster, distance = _assigned(batch, centroids, pivots)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(cluster, pa.int32()), pa.array(distance, pa.int64())], ["vec_id", "cluster", "distance"])

    return assign


def clustered(
    rows: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, length: int = LENGTH, scale: int = SCALE, seed: int = SEED, pivots: int = PIVOTS
) -> DataFrame:
    """Per vector of ``rows`` (vec_id, embedding): vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    Vectors with exactly ``length`` components, none null or non-finite, are turned into floor(scale * x); others are left
    out, as are those with a scaled component of 2**27 or more, whose squared distances 64 bits do not hold. The first
    centroids are the vectors with the smallest sha256 of "seed:vec_id", in that order; of rows that share an id (a
    null id is empty text) those with the smallest components, repeated rows each. Fewer vectors mean fewer centroids.
    In each round every vector goes to its nearest centroid, of equally near ones to the first, and every centroid that
    has vectors becomes their mean, rounded down. Vectors are assigned once more after the last round.

    The driver holds the centroids, ``POOL`` vectors to choose pivots from, and sums per cluster and component, whatever
    the number of vectors. The scaled vectors are stored once with their distances to the pivots; no round shuffles them.
    """
    small_batches(rows)
    bound = LARGEST / scale
    values = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("x"))
    usable = (F.size("x") == length) & F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (x > -bound) & (x < bound))
    kept = values.where(F.coalesce(usable, F.lit(False))).select("vec_id", F.transform("x", lambda x: F.floor(x * scale).cast("int")).alias("points"))
    drawn = kept.withColumn("hash", F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256))
    pool = np.array([r.points for r in drawn.orderBy("hash", "points").limit(max(clusters, POOL)).collect()], np.int64).reshape(-1, length)
    centroids, fixed = pool[:clusters].copy(), far_apart(pool, pivots)
    table = stored(kept.mapInArrow(_measuring(fixed, length), MEASURED), "vectors")
    if not len(pool):
        empty = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
        return rows.sparkSession.createDataFrame([], empty)
    for _ in range(rounds):
        sums = table.mapInArrow(_summing(centroids, fixed), SUMS).groupBy("cluster", "place")
        for r in sums.agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n")).where("n > 0").collect():
            centroids[r.cluster, r.place] = int(r.total) // r.n
    assigned = table.mapInArrow(_assigning(centroids, fixed), ASSIGNED)
    inertia = {r.cluster: int(r.total) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()}
    digests = {j: sha256(",".join(map(str, centroids[j].tolist())).encode()).hexdigest() for j in inertia}

    def of_cluster(values: dict) -> F.Column:
        return F.create_map(*[F.lit(x) for pair in sorted(values.items()) for x in pair])[F.col("cluster")]

    return assigned.select(
        "vec_id",
        "cluster",
        "distance",
        of_cluster(inertia).cast("long").alias("cluster_inertia"),
        F.lit(sum(inertia.values())).cast("long").alias("inertia"),
        of_cluster(digests).alias("centroid_sha256"),
    )
