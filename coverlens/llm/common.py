"""Pieces that several operators share: names, row numbers, connected components."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from coverlens.session import stored

# What a Python worker gets at once. Spark's own limit of 64 MB is much for two workers beside a small heap.
BATCH_BYTES = 4 << 20
# Words are what white space of these six characters separates.
WORD = r"[^\x20\x09-\x0D]+"


def fresh(df: DataFrame, *wanted: str) -> list[str]:
    """The wanted names, each with underscores in front until no column of ``df`` has it, whatever its case."""
    taken = {c.lower() for c in df.columns}
    names = []
    for name in wanted:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        names.append(name)
    return names


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without its own columns of these names, so that an operator may add its own."""
    drop = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in drop])


def small_batches(df: DataFrame) -> DataFrame:
    """Lets the session send at most 4 MB, or one row, to a Python worker at once, if its limit is higher. Returns ``df``."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    limit = int(conf.get(name).rstrip("bB"))
    if not 0 < limit <= BATCH_BYTES:
        conf.set(name, str(BATCH_BYTES))
    return df


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), body)[0]


def numbered(df: DataFrame, *order: Column, name: str = "position") -> DataFrame:
    """Adds a gapless long from 0 in the given order; rows that tie get any order among themselves. Without an order
    the rows are numbered as they come: by partition, and in each as they stand.

    Sorts by ranges in parallel, writes the result once, and adds to each row the count of the partitions before its own.
    Only one number per partition is gathered.
    """
    at, part, before = fresh(df, "at", "part", "before")
    sorted_rows = stored((df.orderBy(*order) if order else df).withColumn(at, F.monotonically_increasing_id()), "numbered")
    sizes = sorted_rows.groupBy(F.shiftright(at, 33).alias(part)).agg(F.count("*").alias(before))
    earlier = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    sizes = stored(sizes.select(part, F.coalesce(F.sum(before).over(earlier), F.lit(0)).alias(before)), "offsets")
    place = F.col(before) + F.col(at).bitwiseAND((1 << 33) - 1)
    rows = sorted_rows.withColumn(part, F.shiftright(at, 33)).join(sizes, part)
    return rows.withColumn(name, place).drop(at, part, before)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components: a row (node, component) per node of an edge, the component being its smallest node.

    Alternates "larger neighbours to the smallest" and "smaller neighbours to the smallest" until every node hangs
    on its component's smallest one. Neighbours are only ever aggregated with ``min``, which combines before the
    shuffle. Each round is written to the shared folder, so lineage stays short. Null ends and loops are ignored.
    """
    pairs = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    current = stored(pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).distinct(), "edges")
    state = _fingerprint(current)
    while True:
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        least = least.select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = stored(large, "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        small = small.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        current = stored(small, "small-star")
        before, state = state, _fingerprint(current)
        if before == state:
            break
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("component"))
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots).distinct()


def _fingerprint(edges: DataFrame):
    total = F.sum(F.xxhash64("u", "v").cast(T.DecimalType(38, 0)))
    return edges.agg(F.count("*"), total).first()
