"""Landed pages to the tidy table, in batch."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from coverlens import schema
from coverlens.functions import vocab
from coverlens.functions.dates import within
from coverlens.functions.labels import Rules, has_status
from coverlens.operators.dedupe import first_wins, unseen_only
from coverlens.session import stored
from coverlens.sources.pages import pick_or_reject, pick_studies, read_pages, readable_pages, with_derived
from coverlens.sources.seen import SeenIds
from coverlens.sources.tidy import read_tidy, write_tidy


def is_eligible(
    start_from: str = vocab.START_FROM,
    start_to: str = vocab.START_TO,
    statuses: Iterable[str] = vocab.ELIGIBLE_STATUSES,
) -> Column:
    """Whether a study starts in the window and has one of the statuses."""
    return within("start_date", start_from, start_to) & has_status("overall_status", statuses)


def eligible(studies: DataFrame, **window) -> DataFrame:
    """Studies that start in the window and have one of the statuses."""
    return studies.where(is_eligible(**window))


def ingest(
    spark: SparkSession,
    path: str,
    seen: DataFrame | None = None,
    max_pages: int | None = None,
    multi_line: bool = True,
    rules: Rules = vocab.AREA_RULES,
    rejects: str | None = None,
    **window,
) -> DataFrame:
    """The tidy table of the pages under ``path``: eligible, first arrival per ID, none of the seen IDs.

    Filters come before de-duplication, so a rejected version of a study does not hide a later one;
    classification comes after it, on the rows that stay. A page or a study that cannot be read fails the job; with a path
    for ``rejects`` it is left out and written there instead (:func:`rejected`), when this is called; the pages are then
    read once, and the eligible studies stored.
    """
    pages = read_pages(spark, path, max_pages, multi_line)
    if rejects:
        found = stored(pick_or_reject(pages, is_eligible(**window)), "studies")
        found.where(F.size("faults") > 0).select(*schema.REJECTED).write.mode("overwrite").parquet(rejects)
        studies = found.where(F.size("faults") == 0).drop("faults", "record")
    else:
        studies = eligible(pick_studies(readable_pages(pages)), **window)
    fresh = first_wins(studies, "nct_id", schema.ARRIVAL)
    if seen is not None:
        fresh = unseen_only(fresh, seen)
    return with_derived(fresh, rules).select(*schema.TIDY_COLUMNS)


def ingest_run(spark: SparkSession, path: str, out: str, seen: SeenIds, run: int, **options) -> DataFrame:
    """One numbered run of a repeated batch ingestion: adds the studies that no earlier run has emitted.

    The run owns the folder ``run=N`` under ``out`` and generation ``N`` of the seen IDs, and looks at all others,
    later ones too. Running it again replaces both. The eligible studies are stored first; of the seen IDs only those buckets
    are read that may hold one of theirs, and neither these nor theirs are broadcast.
    """
    folder = f"{out.rstrip('/')}/run={run}"
    studies = stored(ingest(spark, path, **options), "run")
    write_tidy(seen.unseen(studies, without=run).select(*schema.TIDY_COLUMNS), folder, mode="overwrite")
    written = read_tidy(spark, folder)
    seen.add(written, generation=run)
    return written
