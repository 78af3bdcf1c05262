"""From the tidy table to the columns that metrics and charts use."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from coverlens import schema
from coverlens.functions import vocab
from coverlens.functions.dates import year_of
from coverlens.functions.labels import bucket_of_clean, parse_flag, phase_or_na
from coverlens.functions.text import has_phrase, strip, title_case, upper_strip
from coverlens.operators.dedupe import first_wins
from coverlens.sources.contracts import require_columns, with_defaults
from coverlens.sources.tidy import nulls_for_na


def normalize(
    df: DataFrame,
    first_by: Sequence[str] | None = None,
    na_tokens: bool = False,
    buckets: Mapping[str, str] = vocab.SPONSOR_BUCKETS,
    terminated: Sequence[str] = vocab.TERMINATED_STATUSES,
    completed: Sequence[str] = vocab.COMPLETED_STATUSES,
) -> DataFrame:
    """Cleans the tidy columns and adds the derived ones; one pass, no shuffle unless ``first_by`` is given.

    ``first_by`` keeps the first row per ID in that order; leave it out for a table that ingestion has
    already made unique. ``na_tokens`` turns missing-value texts such as the ``N/A`` phase into null.
    """
    require_columns(df, schema.REQUIRED)
    if first_by:
        df = first_wins(df, "nct_id", first_by)
    if na_tokens:
        df = nulls_for_na(df)
    df = with_defaults(
        df, {"therapeutic_area": F.lit(vocab.DEFAULT_AREA), "why_stopped": F.lit(None).cast("string")}
    )
    if "start_year" not in df.columns:
        df = df.withColumn("start_year", year_of("start_date") if "start_date" in df.columns else F.lit(None).cast("int"))
    flag_is_text = isinstance(df.schema["has_dmc"].dataType, T.StringType)
    cleaned = df.withColumns(
        {
            "has_dmc": parse_flag("has_dmc") if flag_is_text else F.col("has_dmc").cast("boolean"),
            "sponsor_class": upper_strip("sponsor_class"),
            "study_type": strip(title_case("study_type")),
            "overall_status": upper_strip("overall_status"),
            "why_stopped_text": F.lower("why_stopped"),
            "is_phase3": has_phrase("phase", "Phase 3"),
            "is_phase4": has_phrase("phase", "Phase 4"),
            "phase_label": phase_or_na("phase"),
        }
    )
    return cleaned.withColumns(
        {
            "sponsor_bucket": bucket_of_clean("sponsor_class", buckets),
            "is_phase34": F.col("is_phase3") | F.col("is_phase4"),
            "is_terminated_like": F.coalesce(F.col("overall_status").isin(list(terminated)), F.lit(False)),
            "is_completed": F.coalesce(F.col("overall_status").isin(list(completed)), F.lit(False)),
            "phase_is_na": F.col("phase_label") == vocab.PHASE_NA,
        }
    )
