"""Uniform shuffle into shards of exact size, by a hypergeometric communication matrix.

Each partition of the input permutes its rows. How many of them go to which shard is drawn beforehand: a matrix
with a row per partition and a column per shard, distributed as if all rows had been shuffled together, so the
row sums are the partitions' sizes and the column sums the shards'. The rows are exchanged accordingly, and each
shard permutes what it gets.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from coverlens.llm.common import fresh, let, without
from coverlens.session import stored

# Rows that one task permutes in the second step; a larger shard is split into several such ranges.
RANGE_ROWS = 50_000


def _uniform(*parts) -> Column:
    """A number in [0, 1) from a hash of the parts."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") / float(1 << 53)


def hypergeometric(total: Column, marked: Column, drawn: Column, u: Column) -> Column:
    """How many of ``drawn`` items are marked, if ``marked`` of ``total`` are, for a uniform number ``u``.

    Inversion, going outwards from the most likely value. Only ratios of neighbouring probabilities are needed.
    Twelve standard deviations to either side hold all but 1e-30, less than the last bit of ``u``.
    """

    def draw(x: Column) -> Column:
        n, k, d = (x[c].cast("double") for c in ("n", "k", "d"))
        mode = F.least(F.greatest(F.floor((d + 1) * (k + 1) / (n + 2)).cast("double"), d + k - n, F.lit(0.0)), k, d)
        spread = F.sqrt(d * (k / n) * (1 - k / n) * ((n - d) / F.greatest(n - 1, F.lit(1.0))))
        reach = F.ceil(F.lit(12.0) * spread).cast("int") + 20
        return let(F.struct(n.alias("n"), k.alias("k"), d.alias("d"), mode.alias("m"), reach.alias("r"), x["u"].alias("u")), invert)

    def steps(x: Column, start: Column, visit) -> Column:
        """Visits mode, mode ± 1, ± 2, ... with the weight of each, relative to the mode's."""
        n, k, d, m = x["n"], x["k"], x["d"], x["m"]

        def step(s: Column, i: Column) -> Column:
            up, down = m + i, m - i
            rise = s["up"] * (k - up + 1) * (d - up + 1) / (up * (n - k - d + up))
            fall = s["down"] * (down + 1) * (n - k - d + down + 1) / ((k - down) * (d - down))
            rise = F.when((s["up"] > 0) & (up <= k) & (up <= d), rise).otherwise(0.0)
            fall = F.when((s["down"] > 0) & (down >= 0) & (n - k - d + down >= 0), fall).otherwise(0.0)
            return let(F.struct(rise.alias("up"), fall.alias("down")), lambda w: visit(s, i, w))

        return F.aggregate(F.sequence(F.lit(1), x["r"]), start, step)

    def invert(x: Column) -> Column:
        first = F.struct(F.lit(1.0).alias("up"), F.lit(1.0).alias("down"), F.lit(1.0).alias("sum"))
        mass = steps(
            x, first, lambda s, i, w: F.struct(w["up"].alias("up"), w["down"].alias("down"), (s["sum"] + w["up"] + w["down"]).alias("sum"))
        )["sum"]

        def find(y: Column) -> Column:
            left = x["u"] * y - 1.0
            begin = F.struct(F.lit(1.0).alias("up"), F.lit(1.0).alias("down"), left.alias("left"), F.when(left < 0, F.lit(0)).alias("at"))

            def visit(s: Column, i: Column, w: Column) -> Column:
                after_up, after = s["left"] - w["up"], s["left"] - w["up"] - w["down"]
                at = F.coalesce(s["at"], F.when((w["up"] > 0) & (after_up < 0), i), F.when((w["down"] > 0) & (after < 0), -i))
                return F.struct(w["up"].alias("up"), w["down"].alias("down"), after.alias("left"), at.alias("at"))

            return F.coalesce(steps(x, begin, visit)["at"], F.lit(0))

        return (x["m"] + let(mass, find)).cast("long")

    sure = F.when((drawn == 0) | (marked == 0), F.lit(0).cast("long")).when(marked == total, drawn).when(drawn == total, marked)
    given = F.struct(total.alias("n"), marked.alias("k"), drawn.alias("d"), u.alias("u"))
    return F.coalesce(sure, let(given, draw))


def _row(capacities: Column, drawn: Column, *seed) -> Column:
    """One row of the matrix: how many of ``drawn`` rows go to each shard with these free places."""

    def one(s: Column, capacity: Column) -> Column:
        u = _uniform(*seed, F.size(s["out"]))
        got = hypergeometric(s["total"], capacity, s["drawn"], u)

        def put(g: Column) -> Column:
            return F.struct(
                (s["total"] - capacity).alias("total"), (s["drawn"] - g).alias("drawn"), F.concat(s["out"], F.array(g)).alias("out")
            )

        return let(got, put)

    total = F.aggregate(capacities, F.lit(0).cast("long"), lambda x, y: x + y)
    start = F.struct(total.alias("total"), drawn.alias("drawn"), F.array().cast("array<bigint>").alias("out"))
    return F.aggregate(capacities, start, one)["out"]


def _rows(capacities: Column, counts: Column, *seed) -> Column:
    """The matrix for these row sums: an array with an array per row."""

    def one(s: Column, count: Column) -> Column:
        def put(row: Column) -> Column:
            free = F.zip_with(s["free"], row, lambda a, b: a - b)
            return F.struct(free.alias("free"), F.concat(s["out"], F.array(row)).alias("out"))

        return let(_row(s["free"], count, *seed, F.size(s["out"])), put)

    start = F.struct(capacities.alias("free"), F.array().cast("array<array<bigint>>").alias("out"))
    return F.aggregate(counts, start, one)["out"]


def communication_matrix(counts: DataFrame, shards: int, seed: int = 0) -> DataFrame:
    """From (block, n): a row (block, row) with the array of how many of the block's n rows go to each shard.

    Drawn in two levels, so that neither a task nor a row holds more than about the square root of the number of
    blocks: first for groups of neighbouring blocks, then within each group.
    """
    size = counts.agg(F.count("*")).first()[0]
    width = max(1, math.isqrt(size))
    groups = (
        counts.groupBy(F.floor(F.col("block") / width).alias("part"))
        .agg(F.sort_array(F.collect_list(F.struct("block", "n"))).alias("blocks"))
        .withColumn("sum", F.aggregate("blocks.n", F.lit(0).cast("long"), lambda a, b: a + b))
    )
    groups = stored(groups, "block-groups")
    whole = groups.agg(F.sort_array(F.collect_list(F.struct("part", "sum"))).alias("parts"))
    total = F.aggregate("parts.sum", F.lit(0).cast("long"), lambda a, b: a + b)
    sizes = F.transform(
        F.sequence(F.lit(0), F.lit(shards - 1)),
        lambda s: (F.floor(F.col("total") / shards) + F.when(s < F.col("total") % shards, 1).otherwise(0)).cast("long"),
    )
    whole = whole.withColumn("total", total).withColumn("drawn", _rows(sizes, F.col("parts.sum"), F.lit(seed), F.lit("groups")))
    outer = whole.select(F.inline(F.arrays_zip(F.col("parts.part").alias("part"), F.col("drawn").alias("free"))))
    inner = groups.join(stored(outer, "outer-matrix"), "part")
    inner = inner.withColumn("drawn", _rows(F.col("free"), F.col("blocks.n"), F.lit(seed), F.lit("blocks"), F.col("part")))
    return inner.select(F.inline(F.arrays_zip(F.col("blocks.block").alias("block"), F.col("drawn").alias("row"))))


def shard(docs: DataFrame, shards: int, seed: int = 0, range_rows: int = RANGE_ROWS) -> DataFrame:
    """All rows and columns of ``docs`` plus ``shard`` (int, from 0) and ``slot`` (long, gapless from 0 in the shard).

    Shard sizes differ by one row at most. Every assignment of rows to (shard, slot) is equally likely, as far as
    the 64-bit hashes that seed it are random; the same input partitions and seed give the same result.
    Columns named shard or slot in the input are replaced. Nulls, empty and repeated rows are rows like any other;
    rows that are equal in all columns are interchangeable. An empty input gives no rows.
    """
    docs = without(docs, "shard", "slot")
    at, block, column, cell, order = fresh(docs, "at", "block", "column", "cell", "order")
    # The partitions permute their rows and are written once: from then on block and place are facts, not plans.
    # Maps cannot be hashed; their text can.
    parts = [F.to_json(f"`{f.name}`") if f.dataType.typeName() in ("map", "variant") else F.col(f"`{f.name}`") for f in docs.schema]
    local = stored(
        docs.sortWithinPartitions(F.xxhash64(F.lit(seed), *parts)).withColumn(at, F.monotonically_increasing_id()), "permuted"
    )
    counts = stored(local.groupBy(F.shiftright(at, 33).alias("block")).agg(F.count("*").alias("n")), "block-counts")
    matrix = communication_matrix(counts, shards, seed)
    bounds = F.transform(F.sequence(F.lit(1), F.lit(shards)), lambda i: F.aggregate(F.slice("row", F.lit(1), i), F.lit(0).cast("long"), lambda a, b: a + b))
    matrix = stored(matrix.select(F.col("block").alias(block), bounds.alias(column)), "matrix")
    total = counts.agg(F.sum("n")).first()[0] or 0
    cells = max(1, -(-total // shards // range_rows))
    place = F.col(at).bitwiseAND((1 << 33) - 1)
    drawn = (
        local.withColumn(block, F.shiftright(at, 33))
        .join(matrix, block)
        .withColumn("shard", F.aggregate(column, F.lit(0), lambda n, end: n + (end <= place).cast("int")))
        .withColumn(order, F.xxhash64(F.lit(seed), F.lit("slot"), at))
        .withColumn(cell, F.floor((F.col(order) / float(1 << 64) + 0.5) * cells).cast("int"))
        .drop(block, column)
    )
    if cells == 1:
        within = Window.partitionBy("shard").orderBy(order, at)
        return drawn.withColumn("slot", F.row_number().over(within).cast("long") - 1).drop(at, order, cell)
    earlier = Window.partitionBy("shard").orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
    first = F.coalesce(F.sum("n").over(earlier), F.lit(0))
    offsets = drawn.groupBy("shard", cell).agg(F.count("*").alias("n")).select("shard", cell, first.alias(block))
    within = Window.partitionBy("shard", cell).orderBy(order, at)
    slotted = drawn.withColumn("slot", F.row_number().over(within)).join(stored(offsets, "cell-offsets"), ["shard", cell])
    return slotted.withColumn("slot", F.col(block) + F.col("slot") - 1).drop(at, order, cell, block)
