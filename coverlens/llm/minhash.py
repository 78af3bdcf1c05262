"""Near-duplicate documents by min-max hashing, with every link confirmed on the full shingle sets.

Each hash function gives two signature values, the smallest and the largest hash of a document's shingles, so half as
many evaluations make a signature. Bands of three smallest and three largest values are the buckets. Documents with
equal sets are one class from the start. Within a bucket, classes are compared with one hub each and not with each
other; only classes that are still apart afterwards, and whose counts leave a link possible, are paired.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coverlens.llm.common import WORD, components, fresh, small_batches
from coverlens.llm.text import chunks, layout, mixed, shingles, word_hashes
from coverlens.session import stored

WIDTH = 5
# Similarity as a fraction: a link needs 100 * common >= 85 * together.
PERCENT = 85
# 40 bands of 6 values from 120 hash functions: a pair at 0.85 shares no band with probability 6e-9.
BANDS, HALF = 40, 3
# Shingles are counted in so many cells by their hash; a pair has no more in common than the cells' smaller counts add up to.
CELLS = 64
_random = np.random.default_rng(7)
_FACTOR = _random.integers(1 << 63, size=BANDS * HALF, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_OFFSET = _random.integers(1 << 63, size=BANDS * HALF, dtype=np.uint64)
_FOLD = _random.integers(1 << 63, size=2 * HALF, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signature(sets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smallest and largest value of each hash function over a set."""
    low, high = np.full(len(_FACTOR), ~np.uint64(0)), np.zeros(len(_FACTOR), np.uint64)
    for i in range(0, len(sets), 1024):
        values = sets[i : i + 1024, None] * _FACTOR + _OFFSET
        np.minimum(low, values.min(axis=0), out=low)
        np.maximum(high, values.max(axis=0), out=high)
    return low, high


def bands(sets: np.ndarray) -> np.ndarray:
    """A bucket number per band, the band's own number mixed in."""
    low, high = (x.reshape(BANDS, HALF) for x in signature(sets))
    folded = (np.hstack([low, high]) * _FOLD).sum(axis=1, dtype=np.uint64)
    return mixed(folded + np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def _texts(column: pa.Array):
    """The shingle set of each text, in order."""
    offsets, data = layout(column)
    for lo, hi in chunks(offsets):
        yield from shingles(*word_hashes(offsets[lo : hi + 1], data), WIDTH)


def _digest(sets: np.ndarray) -> bytes | None:
    return hashlib.blake2b(sets.tobytes(), digest_size=16).digest() if len(sets) else None


def _signed(batches):
    for batch in batches:
        sizes, digests, buckets = [], [], []
        for found in _texts(batch.column("text")):
            sizes.append(len(found))
            digests.append(_digest(found))
            buckets.append(bands(found) if len(found) else None)
        own = [pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(buckets, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), *own], ["doc_id", "text_key", "n", "digest", "bands"])


def _sets(batches):
    for batch in batches:
        found = list(_texts(batch.column("text")))
        values = pa.ListArray.from_arrays(
            np.cumsum([0] + [len(x) for x in found], dtype=np.int32), np.concatenate(found or [np.zeros(0, np.uint64)]).view(np.int64)
        )
        digests = pa.array([_digest(x) for x in found], pa.binary())
        cells = [np.bincount((x % np.uint64(CELLS)).astype(np.int64), minlength=CELLS) for x in found]
        yield pa.RecordBatch.from_arrays([digests, values, pa.array(cells, pa.list_(pa.int32()))], ["digest", "shingles", "cells"])


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of pairs (a, b) of classes, those whose full sets are similar enough. Written, as two stages read it."""
    common = F.size(F.array_intersect("sa", "sb"))
    both = (
        pairs.join(sets.select(F.col("cid").alias("a"), F.col("shingles").alias("sa")), "a")
        .join(sets.select(F.col("cid").alias("b"), F.col("shingles").alias("sb")), "b")
        .select("a", "b", common.alias("common"), (F.size("sa") + F.size("sb")).alias("sizes"))
    )
    return stored(both.where(F.col("common") * 100 >= (F.col("sizes") - F.col("common")) * PERCENT).select("a", "b"), "links")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, text_key, n_shingles, class_id, component_id, kept.

    n_shingles is the number of distinct runs of five words in lower case (a shorter text is one run; without words
    none). component_id is the smallest doc_id reachable by links; without shingles, or links, the document's own.
    kept tells that the document has the smallest doc_id. text_key is a hash of the text, to find the row again;
    class_id numbers the component within this run, null without shingles.
    Repeated rows are each returned. A row without doc_id takes part; its component has the smallest id there is,
    or null. Classes, links and components stay distributed; an empty input gives no rows.
    """
    docs = small_batches(docs).select("doc_id", "text")
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text_key long, n long, digest binary, bands array<long>"
    signed = stored(docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text").mapInArrow(_signed, schema), "signatures")
    grouped = signed.where("n > 0").groupBy("digest").agg(F.min("doc_id").alias("first"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    classes = stored(grouped.withColumn("cid", F.monotonically_increasing_id()), "classes")

    # Buckets with several classes.
    rows = classes.select("cid", F.explode("bands").alias("bucket"))
    shared = rows.groupBy("bucket").agg(F.count("*").alias("many")).where("many > 1").select("bucket")
    members = stored(rows.join(shared, "bucket"), "members")
    # Their sets, read again from the texts: only of classes that share a bucket.
    active = stored(members.select("cid").distinct().join(classes.select("cid", "first", "digest"), "cid"), "active")
    picked = docs.join(active.select(F.col("first").alias("id")).distinct(), F.col("doc_id").eqNullSafe(F.col("id")), "left_semi")
    read = picked.select("text").mapInArrow(_sets, "digest binary, shingles array<long>, cells array<int>")
    sets = read.join(active.select("cid", "digest"), "digest").groupBy("cid").agg(F.first("shingles").alias("shingles"), F.first("cells").alias("cells"))
    sets = stored(sets, "sets")
    # A shingle that no other class has can be in no intersection. That bounds a class's best similarity, and the sizes
    # that a partner may have: common <= own - unique, so 85 * (own + partner - common) <= 100 * common.
    alone = sets.select("cid", F.explode("shingles").alias("s")).groupBy("s").agg(F.count("*").alias("many"), F.min("cid").alias("cid"))
    # What is left of a class's cells without these shingles bounds what it has in common with any one partner.
    cell = F.pmod("s", F.lit(CELLS)).cast("int")
    unique = alone.where("many = 1").groupBy("cid", cell.alias("cell")).agg(F.count("*").cast("int").alias("many"))
    unique = unique.groupBy("cid").agg(F.sum("many").alias("unique"), F.map_from_entries(F.collect_list(F.struct("cell", "many"))).alias("gone"))
    sizes = sets.select("cid", F.size("shingles").cast("long").alias("n"), "cells").join(unique, "cid", "left").fillna(0, ["unique"])
    sizes = sizes.withColumns(
        {"least": F.expr(f"ceil(n * {PERCENT} / 100)"), "most": F.expr(f"floor((n - unique) * {100 + PERCENT} / {PERCENT}) - n")}
    ).where("most >= least")
    left = F.when(F.col("gone").isNull(), F.col("cells")).otherwise(
        F.transform("cells", lambda c, i: c - F.coalesce(F.try_element_at("gone", i), F.lit(0)))
    )
    sizes = stored(sizes.withColumn("cells", left).drop("gone"), "sizes")
    fits = "x.n BETWEEN y.least AND y.most AND y.n BETWEEN x.least AND x.most"

    # A star per bucket: all against the class with the fewest shingles of its own.
    members = stored(members.join(sizes.drop("cells"), "cid"), "fitting-members")
    hubs = members.groupBy("bucket").agg(F.min(F.struct("unique", "cid", "n", "least", "most")).alias("hub"), F.count("*").alias("many"))
    hubs = hubs.where("many > 1").select("bucket", "hub.*")
    star = members.alias("x").join(hubs.alias("y"), F.expr(f"x.bucket = y.bucket AND x.cid <> y.cid AND {fits}"))
    star = star.select(F.least("x.cid", "y.cid").alias("a"), F.greatest("x.cid", "y.cid").alias("b")).distinct()
    star = stored(star, "star-pairs")
    links = _confirmed(star, sets)
    labels = stored(components(links), "first-components")

    # What is still apart within a bucket.
    named = members.join(labels.select(F.col("node").alias("cid"), "component"), "cid", "left")
    named = stored(named.withColumn("component", F.coalesce("component", "cid")), "named-members")
    split = named.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high")
    split = stored(named.join(split.select("bucket"), "bucket").join(sizes.select("cid", "cells"), "cid"), "split-members")
    enough = f"aggregate(zip_with(x.cells, y.cells, (p, q) -> least(p, q)), 0, (p, q) -> p + q) * {100 + PERCENT} >= (x.n + y.n) * {PERCENT}"
    apart = split.alias("x").join(
        split.alias("y"), F.expr(f"x.bucket = y.bucket AND x.cid < y.cid AND x.component <> y.component AND {fits} AND {enough}")
    )
    apart = apart.select(F.col("x.cid").alias("a"), F.col("y.cid").alias("b")).distinct().join(star, ["a", "b"], "left_anti")
    more = _confirmed(apart, sets)
    if not more.isEmpty():
        labels = stored(components(links.unionByName(more)), "components")

    named = classes.join(labels.select(F.col("node").alias("cid"), "component"), "cid", "left")
    named = stored(named.select("digest", "first", F.coalesce("component", "cid").alias("component")), "named-classes")
    smallest = named.groupBy("component").agg(F.min("first").alias("component_id"))
    table = stored(named.join(smallest, "component").select(F.col("digest").alias("of"), F.col("component").alias("class_id"), "component_id"), "class-components")
    out = signed.join(table, F.col("digest") == F.col("of"), "left")
    component = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    out = out.select("doc_id", "text_key", F.col("n").alias("n_shingles"), "class_id", component.alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with one document left of each group, the one with the smallest id, its columns unchanged.

    Of repeated rows with words one stays. Documents without words are in no group: all their rows stay.
    """
    worded = F.coalesce(F.col("text").rlike(WORD), F.lit(False))
    wordless, docs = docs.where(~worded), docs.where(worded)
    found = near_duplicates(docs).withColumn("rank", F.struct(F.col("doc_id").isNull().alias("x"), "doc_id", "text_key"))
    kept = found.groupBy("class_id").agg(F.min("rank").alias("rank"))
    kept_id, kept_key = fresh(docs, "kept_id", "kept_key")
    kept = stored(kept.select(F.col("rank.doc_id").alias(kept_id), F.col("rank.text_key").alias(kept_key)), "kept")
    rows = docs.join(kept, F.col("doc_id").eqNullSafe(F.col(kept_id)) & (F.xxhash64("text") == F.col(kept_key)))
    return rows.dropDuplicates([kept_id, kept_key]).select(*[F.col(f"`{c}`") for c in docs.columns]).union(wordless)
