"""Near-duplicate vectors: int8 tile products with rigorous error bounds, full precision where the bound leaves doubt.

Equal vectors are one class from the start. The classes of a label are cut into tiles; a task multiplies two tiles of
int8 codes. For unit vectors x = s q + r (s the scale, q the code, r the rest), x.y - (s q).(t p) = r.y + (s q).u, of
which the absolute value is at most |r| + |s q| |u|, u being the rest of y. Only pairs that could reach the threshold
within that bound are computed from the original vectors, in double precision.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coverlens.llm.common import components, numbered, small_batches
from coverlens.session import stored

LEAST = 0.93
TILE = 512
# For rounding in the norms and products themselves, far above what double precision can lose.
SLACK = 1e-9
FOUND = "a long, b long, n long"


def quantised(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Codes (int8), scales, lengths of the rests and of the coded vectors, of the vectors brought to length 1."""
    # Dividing by the largest component first keeps squares of extreme values finite.
    unit = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    unit /= np.sqrt((unit * unit).sum(axis=1, keepdims=True))
    scale = np.abs(unit).max(axis=1) / 127
    codes = np.rint(unit / scale[:, None]).astype(np.int8)
    coded = codes * scale[:, None]
    rest = unit - coded
    return codes, scale, np.sqrt((rest * rest).sum(axis=1)), np.sqrt((coded * coded).sum(axis=1))


def possible(a, b, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of two quantised tiles whose cosine may reach ``least``."""
    # Products of 127 * 127 * dimensions are whole numbers that float32, or else float64, holds exactly.
    exact = np.float32 if 127 * 127 * a[0].shape[1] < 1 << 24 else np.float64
    product = a[0].astype(exact) @ b[0].astype(exact).T
    bound = a[2][:, None] + a[3][:, None] * b[2][None, :] + SLACK
    return np.nonzero(product * (a[1][:, None] * b[1][None, :]) + bound >= least)


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Row by row, in double precision."""
    x, y = (v / np.abs(v).max(axis=1, keepdims=True) for v in (x, y))
    return (x * y).sum(axis=1) / np.sqrt((x * x).sum(axis=1) * (y * y).sum(axis=1))


def links(x: np.ndarray, y: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of ``x`` and ``y`` with a cosine of at least ``least``."""
    i, j = possible(quantised(x), quantised(y), least)
    good = np.zeros(len(i), bool)
    for lo in range(0, len(i), 20_000):
        at = slice(lo, lo + 20_000)
        good[at] = cosines(x[i[at]], y[j[at]]) >= least
    return i[good], j[good]


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest node that each of n nodes reaches over the links."""
    root = np.arange(n)
    while True:
        least = np.minimum(root[i], root[j])
        after = root.copy()
        np.minimum.at(after, i, least)
        np.minimum.at(after, j, least)
        after = after[after]
        if (after == root).all():
            return root
        root = after


def _matrix(column: pa.Array, row: int, rows: int) -> np.ndarray:
    return np.asarray(column[row].values, np.float64).reshape(rows, -1)


def _tiles(least: float):
    def multiply(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                same = batch.column("tile")[row].as_py() == batch.column("other")[row].as_py()
                ids, weights = ([np.asarray(batch.column(c)[row].values) for c in (n, f"other_{n}")] for n in ("ids", "weights"))
                x, y = _matrix(batch.column("flat"), row, len(ids[0])), _matrix(batch.column("other_flat"), row, len(ids[1]))
                i, j = links(x, y, least)
                if same:
                    i, j = i[i < j], j[i < j]
                if not len(i):
                    continue
                counts = np.zeros(len(ids[0]) + len(ids[1]), np.int64)
                np.add.at(counts, i, weights[1][j])
                np.add.at(counts, j + len(ids[0]), weights[0][i])
                every = np.concatenate(ids)
                root = _roots(len(every), i, j + len(ids[0]))
                seen, joined = np.flatnonzero(counts), np.flatnonzero(root != np.arange(len(root)))
                a = pa.array(np.concatenate([every[seen], every[joined]]), pa.int64())
                b = pa.array([None] * len(seen) + every[root[joined]].tolist(), pa.int64())
                n = pa.array(counts[seen].tolist() + [None] * len(joined), pa.int64())
                yield pa.RecordBatch.from_arrays([a, b, n], ["a", "b", "n"])

    return multiply


def near_duplicate_vectors(rows: DataFrame, least: float = LEAST, tile: int = TILE) -> DataFrame:
    """Per row of ``rows`` (vec_id, embedding, label): vec_id, n_links, component_id, kept.

    Two rows are linked if their labels are equal and not null and their cosine is at least ``least``. Vectors that are
    null, empty, all zeros, or hold nulls or non-finite numbers link with nothing, nor do vectors of different lengths.
    n_links counts the other rows linked directly, repeated rows included; component_id is the smallest vec_id reachable,
    kept tells that it is the row's own. Rows that share a vec_id are separate rows. All pairs of a label are compared,
    in tiles, as the task asks; a pair of tiles returns counts and at most one edge per vector, never its pairs.
    """
    rows = small_batches(rows).select("vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.col("label").isNotNull() & F.coalesce(finite & F.exists("embedding", lambda x: x != 0), F.lit(False))
    rows = rows.withColumn("usable", usable)
    classes = rows.where("usable").groupBy("label", "embedding").agg(F.count("*").alias("weight"), F.min("vec_id").alias("first"))
    placed = numbered(classes.withColumn("length", F.size("embedding")), F.col("label"), F.col("length"))
    placed = stored(placed.withColumnRenamed("position", "cid"), "classes")
    starts = stored(placed.groupBy("label", "length").agg(F.min("cid").alias("start"), F.count("*").alias("size")), "label-starts")
    tiled = placed.join(starts, ["label", "length"]).withColumns(
        {"tile": F.floor((F.col("cid") - F.col("start")) / tile), "tiles": F.ceil(F.col("size") / tile)}
    )
    packed = tiled.groupBy("start", "tile", "tiles").agg(F.sort_array(F.collect_list(F.struct("cid", "weight", "embedding"))).alias("all"))
    packed = stored(
        packed.select("start", "tile", "tiles", F.col("all.cid").alias("ids"), F.col("all.weight").alias("weights"), F.flatten("all.embedding").alias("flat")),
        "tiles",
    )
    left = packed.withColumn("other", F.explode(F.sequence(F.col("tile"), F.col("tiles") - 1)))
    right = packed.select("start", F.col("tile").alias("other"), *[F.col(c).alias(f"other_{c}") for c in ("ids", "weights", "flat")])
    pairs = left.join(right, ["start", "other"]).select("tile", "other", *[c for n in ("ids", "weights", "flat") for c in (n, f"other_{n}")])
    found = stored(pairs.mapInArrow(_tiles(least), FOUND), "tile-links")
    counts = found.where("n IS NOT NULL").groupBy(F.col("a").alias("cid")).agg(F.sum("n").alias("linked"))
    labels = components(found.where("n IS NULL").select("a", "b")).select(F.col("node").alias("cid"), "component")
    table = placed.join(counts, "cid", "left").join(labels, "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    table = stored(table.select("cid", "label", "embedding", "weight", "first", "linked", "component"), "linked-classes")
    smallest = table.groupBy("component").agg(F.min("first").alias("smallest"))
    table = table.join(smallest, "component").select(
        F.col("label").alias("of"), F.col("embedding").alias("vector"), (F.col("weight") - 1 + F.coalesce("linked", F.lit(0))).alias("links"), "smallest"
    )
    joined = rows.join(stored(table, "vector-classes"), F.expr("usable AND label = of AND embedding = vector"), "left")
    return joined.select(
        "vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("links").isNull(), F.col("vec_id")).otherwise(F.col("smallest")).alias("component_id")
    ).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
