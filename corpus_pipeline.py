"""Documents to a training mix: quality, near duplicates, benchmark decontamination, source mixing, shards.

Every stage gets what its predecessor kept and works on all of it. All but the last return the columns of documents,
whatever these are named; the last adds shard and slot in place of columns of these names. Nulls, empty texts and empty
tables pass as the operators define it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coverlens.llm import decontamination, minhash, mixing, quality, sharding
from coverlens.llm.common import fresh
from coverlens.session import stored

SHARDS = 24


def _kept(docs: DataFrame, own: tuple[str, ...], stage: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What ``stage`` returns, with the columns of ``docs``: those named like one that the operator adds stand aside meanwhile."""
    clashing = [c for c in docs.columns if c.lower() in own]
    aside = dict(zip(clashing, fresh(docs, *[f"aside_{c}" for c in clashing])))
    result = stage(docs.withColumnsRenamed(aside))
    return result.select(*[F.col(f"`{aside.get(c, c)}`").alias(c) for c in docs.columns])


def accept_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the quality classifier rejects."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return _kept(docs, quality.OWN, lambda own: quality.judged(own, labels).where("accepted"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return minhash.deduplicated(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents of which a twentieth or more is benchmark text."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _kept(docs, decontamination.OWN, lambda own: decontamination.decontaminated(own, benchmark))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target asks for."""
    return _kept(docs, mixing.OWN, lambda own: mixing.emitted(mixing.mix(own)))


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with its shard and its place there."""
    return sharding.shard(docs, SHARDS)


STAGES = [
    ("quality classifier", accept_quality),
    ("near duplicates", drop_near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("source mixing", mix_sources),
    ("sharding", shard),
]

# The first and the last stage cannot be said in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each but the last written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
