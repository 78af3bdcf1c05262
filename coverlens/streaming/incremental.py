"""Resumable ingestion: each run takes the newly landed pages and adds only studies not emitted before."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from coverlens import schema
from coverlens.functions import vocab
from coverlens.functions.labels import Rules
from coverlens.operators.dedupe import first_wins
from coverlens.plans.ingest import eligible
from coverlens.sources import files
from coverlens.sources.contracts import require_path
from coverlens.sources.pages import pick_studies, readable_pages, stream_pages, with_derived
from coverlens.sources.seen import SeenIds

STORED = schema.TIDY + ", stream string, batch_id bigint"


def _stored(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema(STORED).parquet(out)


def read_ingested(spark: SparkSession, out: str) -> DataFrame:
    """Everything emitted so far, with the batch that emitted it. Batch numbers are those of a checkpoint's own count."""
    return _stored(spark, require_path(spark, out)).drop("stream")


def _seen(spark: SparkSession, out: str) -> SeenIds:
    """The IDs of everything emitted, a generation per batch, beside the output and hidden from its readers."""
    return SeenIds(spark, f"{out}/_seen")


def _index_emitted(spark: SparkSession, out: str, seen: SeenIds, but: str) -> None:
    """Adds the batches whose output is complete and whose IDs are not yet in the set, as after a crash between the two."""
    known = seen.generations()
    for stream in files.folders(spark, out):
        for batch in files.folders(spark, f"{out}/{stream}") if stream.startswith("stream=") else []:
            name = f"{stream}/{batch}"
            if name not in known and name != but and files.exists(spark, f"{out}/{name}/_SUCCESS"):
                seen.add(spark.read.schema(schema.TIDY).parquet(f"{out}/{name}"), name)


def add_batch(studies: DataFrame, batch_id: int, out: str, stream: str = "0", rules: Rules = vocab.AREA_RULES) -> None:
    """Adds the first arrival of each study that no other batch has emitted.

    The candidates are stored, so that they are computed once, in a folder of their stream and batch. The batch owns the
    output folder and the generation of seen IDs of its ``stream`` and ``batch_id``; a replay rewrites both. What has been
    emitted is every other generation, so a stream that starts anew with another checkpoint, and counts from 0 again, neither
    repeats studies nor overwrites them. Of the seen IDs only those buckets are read that may hold one of the batch.
    """
    spark = studies.sparkSession
    files.make_folder(spark, out)
    own = f"stream={stream}/batch_id={batch_id}"
    candidates_path = f"{out}/_candidates/{own}"  # hidden from readers of ``out``
    candidates = first_wins(studies, "nct_id", schema.ARRIVAL).drop(*schema.ARRIVAL)
    candidates.write.mode("overwrite").parquet(candidates_path)
    candidates = spark.read.schema(schema.PICKED).parquet(candidates_path)
    seen = _seen(spark, out)
    _index_emitted(spark, out, seen, but=own)
    fresh = with_derived(seen.unseen(candidates, without=own), rules).select(*schema.TIDY_COLUMNS)
    fresh.write.mode("overwrite").parquet(f"{out}/{own}")
    seen.add(spark.read.schema(schema.TIDY).parquet(f"{out}/{own}"), own)
    files.delete(spark, candidates_path)


def _stream_of(spark: SparkSession, checkpoint: str) -> str:
    """The id that Spark gave the stream when its checkpoint was new."""
    text = spark.read.text(f"{checkpoint.rstrip('/')}/metadata").first()[0]
    return f"s{json.loads(text)['id']}"


def start_incremental(
    spark: SparkSession,
    landing: str,
    out: str,
    checkpoint: str,
    max_files_per_trigger: int | None = None,
    multi_line: bool = True,
    rules: Rules = vocab.AREA_RULES,
    skip_unreadable: bool = False,
    **window,
) -> StreamingQuery:
    """Processes all pages landed since the last run under this checkpoint, then stops. A page or study that
    cannot be read fails the run, unless told to skip such."""
    pages = stream_pages(spark, landing, max_files_per_trigger, multi_line)
    studies = eligible(pick_studies(readable_pages(pages, skip_unreadable), skip_unreadable), **window)

    def add(batch: DataFrame, batch_id: int) -> None:
        add_batch(batch, batch_id, out.rstrip("/"), _stream_of(batch.sparkSession, checkpoint), rules)

    return (
        studies.writeStream.foreachBatch(add)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def run_incremental(spark: SparkSession, landing: str, out: str, checkpoint: str, **options) -> DataFrame:
    """:func:`start_incremental` to its end; returns everything emitted so far."""
    files.make_folder(spark, out)
    start_incremental(spark, landing, out, checkpoint, **options).awaitTermination()
    return read_ingested(spark, out)
