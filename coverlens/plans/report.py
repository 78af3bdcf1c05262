"""All metrics and chart tables from one pass over the records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coverlens.functions import vocab
from coverlens.functions.labels import phase_or_na
from coverlens.functions.text import has_any, let
from coverlens.operators import charts, gaps, odds, outcomes, prevalence
from coverlens.session import stored
from coverlens.sources.sinks import write_metrics

DIMENSIONS = ["phase", "sponsor_bucket", "study_type", "therapeutic_area"]


def record_cells(
    normalized: DataFrame, safety: Sequence[str] = vocab.SAFETY_KEYS, futility: Sequence[str] = vocab.FUTILITY_KEYS
) -> DataFrame:
    """Records counted per combination of everything that any metric looks at.

    ``n_rows`` counts records, ``n_keys`` those with an ID. The size depends on the number of distinct
    combinations, so each metric after this costs next to nothing, whatever the size of the record table.
    """
    reason = F.col("why_stopped_text")
    signals = {
        "has_text": F.coalesce(F.length(reason) > 0, F.lit(False)),
        "safety_hit": F.coalesce(let(reason, lambda t: has_any(t, safety)), F.lit(False)),
        "futility_hit": F.coalesce(let(reason, lambda t: has_any(t, futility)), F.lit(False)),
    }
    by = [*DIMENSIONS, "start_year", "is_terminated_like", "is_completed", *signals]
    cells = (
        normalized.withColumns(signals)
        .withColumn("has_dmc", F.coalesce("has_dmc", F.lit(False)))
        .groupBy("has_dmc", *by)
        .agg(F.count(F.lit(1)).alias("n_rows"), F.count("nct_id").alias("n_keys"))
    )
    return cells.withColumn("phase_label", phase_or_na("phase"))


def report_tables(
    cells: DataFrame,
    text_denominator: str = "with_text",
    top: int = vocab.TOP_AREAS,
    high_risk: Sequence[str] = vocab.HIGH_RISK_AREAS,
) -> dict[str, DataFrame]:
    """Every table of the report, computed from :func:`record_cells`."""
    if text_denominator not in ("with_text", "all_rows"):
        raise ValueError("text_denominator is 'with_text' or 'all_rows'.")
    rows, both = {"rows": "n_rows"}, {"rows": "n_rows", "keys": "n_keys"}
    told = cells.where("has_text") if text_denominator == "with_text" else cells
    signals = {"safety": F.col("safety_hit"), "futility": F.col("futility_hit")}
    return {
        "metric_prevalence_overall": prevalence.prevalence_overall(cells, **rows),
        "metric_prevalence_by_phase": prevalence.prevalence_by(cells, "phase", **rows),
        "metric_prevalence_by_sponsor": prevalence.prevalence_by(cells, "sponsor_bucket", **rows),
        "metric_prevalence_by_studytype": prevalence.prevalence_by(cells, "study_type", **rows),
        "metric_prevalence_by_therapeutic_area": prevalence.prevalence_by(cells, "therapeutic_area", **rows),
        "metric_oversight_gaps_phase34_industry_interventional": gaps.cohort_gaps(cells, labels=high_risk, **rows),
        "metric_outcomes_by_dmc": outcomes.outcomes_by_flag(cells, **both),
        "metric_whystopped_by_dmc": outcomes.signals_by_flag(told, signals, **both),
        "chart_heatmap_sponsor_area": charts.heatmap_cells(cells, n=top, **both),
        "chart_trend_by_sponsor": charts.yearly_trend(cells, **both),
        "chart_trend_by_phase": charts.phase_trend(cells, **both),
        "model_crude_odds": odds.crude_odds(cells, **rows),
    }


def write_report(
    normalized: DataFrame,
    folder: str,
    text_denominator: str = "with_text",
    adjusted: bool = False,
    top: int = vocab.TOP_AREAS,
    high_risk: Sequence[str] = vocab.HIGH_RISK_AREAS,
    safety: Sequence[str] = vocab.SAFETY_KEYS,
    futility: Sequence[str] = vocab.FUTILITY_KEYS,
) -> list[str]:
    """Counts the records once, stores the counts, and writes every table as CSV.

    ``adjusted`` adds the odds of termination without the flag, adjusted for phase and sponsor.
    """
    cells = stored(record_cells(normalized, safety, futility), "cells")
    tables = report_tables(cells, text_denominator, top, high_risk)
    if adjusted:
        tables["model_adjusted_odds"] = odds.adjusted_odds(cells, ["phase_label", "sponsor_bucket"], rows="n_rows")
    return write_metrics(tables, folder)
