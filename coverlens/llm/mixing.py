"""Mixing sources to target weights: repetition rates per source, floor(rate) copies plus a seeded Bernoulli one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coverlens.llm.common import WORD, fresh, numbered, without
from coverlens.session import stored

OWN = ("size", "source_size", "target", "rate", "copies")


def words(text: str = "text") -> Column:
    """Number of words; 0 for a missing text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def seeded(key: str, seed: str) -> Column:
    """A number in [0, 1) from the key: 52 bits of an MD5, which SQL engines share. A missing key counts as empty."""
    digits = F.substring(F.md5(F.concat(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(":" + seed))), 1, 13)
    return F.conv(digits, 16, 10).cast("double") / float(1 << 52)


def rates(sources: DataFrame, cycle: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """From a row (source, source_size) per source: adds target and rate.

    Sources in code-point order, null last, weigh the numbers of ``cycle`` in turn and share all sizes. No target
    exceeds ``most`` times the source's size; what is over goes to the others by weight, again until none is above.
    Each round is one aggregate over the sources; the driver sees three sums. A source of size 0 has target 0 and rate 0.
    """
    ranked = numbered(sources, F.col("source").asc_nulls_last(), name="rank")
    weight = F.element_at(F.array(*[F.lit(c) for c in cycle]), (F.col("rank") % len(cycle)).cast("int") + 1).cast("long")
    ranked = stored(ranked.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * most).alias("cap")), "sources")
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    above = F.lit(False)
    capped = -1
    while True:
        free = ranked.agg(
            F.sum(F.when(above, F.col("cap")).otherwise(0)),
            F.sum(F.when(above, 0).otherwise(F.col("weight"))),
            F.count_if(above),
        ).first()
        if free[2] == capped or not free[1]:
            break
        share, capped = (total - free[0], free[1]), free[2]
        # Exact while the sums are integers: share * weight > cap, without a division.
        above = F.col("weight") * F.lit(share[0]).cast("decimal(30,0)") > F.col("cap") * F.lit(share[1]).cast("decimal(10,0)")
    if capped < 0:
        share = (0, 1)
    open_target = F.lit(float(share[0])) / F.lit(float(share[1])) * F.col("weight")
    target = F.when(above, F.col("cap").cast("double")).otherwise(open_target)
    rate = F.when(F.col("source_size") == 0, 0.0).when(above, float(most)).otherwise(F.least(target / F.col("source_size"), F.lit(float(most))))
    return ranked.select("source", target.alias("target"), rate.alias("rate"))


def mix(docs: DataFrame, cycle: tuple[int, ...] = (1, 2, 3), most: int = 3, seed: str = "mix") -> DataFrame:
    """All rows and columns plus size (words), source_size, target, rate and copies, the times the mix takes the document.

    Needs doc_id, source and text. A missing or empty text has size 0; such a document is copied by its source's
    rate like the others and takes no words. A missing source is a source of its own, the last one. The extra copy is
    decided by a hash of doc_id, so reruns agree and rows that share a doc_id share the decision. Input columns that
    have one of the added names are replaced. An empty input gives no rows.
    """
    docs = without(docs, *OWN).withColumn("size", words())
    (key,) = fresh(docs, "key")
    totals = stored(docs.groupBy("source").agg(F.sum("size").alias("source_size")), "source-sizes")
    found = rates(totals, cycle, most).withColumnRenamed("source", key)
    table = stored(totals.withColumnRenamed("source", "s").join(found, F.col("s").eqNullSafe(F.col(key))).drop("s"), "rates")
    mixed = docs.join(table, docs["source"].eqNullSafe(table[key])).drop(key)
    extra = (seeded("doc_id", seed) < F.col("rate") - F.floor("rate")).cast("long")
    return mixed.withColumn("copies", F.floor("rate") + extra)


def emitted(mixed: DataFrame) -> DataFrame:
    """Each document as often as the mix takes it, without the columns that ``mix`` added."""
    (copy,) = fresh(mixed, "copy")
    repeated = mixed.where("copies > 0").withColumn(copy, F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return repeated.drop(copy, *OWN)
