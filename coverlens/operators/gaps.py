"""Records without the flag inside a cohort, and inside chosen subgroups of it."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coverlens.functions import vocab
from coverlens.functions.labels import known, late_phase
from coverlens.functions.measures import count_rows, count_where, percent, round2_exact


def late_phase_industry_cohort(phase: str = "phase") -> Column:
    """Interventional industry records in phase 3 or 4, on normalised columns."""
    return late_phase(phase) & (F.col("study_type") == "Interventional") & (F.col("sponsor_bucket") == "Industry")


def cohort_gaps(
    df: DataFrame,
    cohort: Column | None = None,
    subgroup: str = "therapeutic_area",
    labels: Sequence[str] = vocab.HIGH_RISK_AREAS,
    flag: str = "has_dmc",
    rows: str | None = None,
    name: str = "dmc",
    all_caption: str = vocab.COHORT_ALL,
    caption: Callable[[str], str] = lambda label: label + vocab.COHORT_SUFFIX,
) -> DataFrame:
    """subgroup, total, without_*, without_*_pct: the whole cohort first, then the subgroups by label.

    All counts come from one aggregation over the cohort, so a subgroup without records has its row too.
    """
    inside = df.where(late_phase_industry_cohort() if cohort is None else cohort)
    without = ~known(flag)
    captions = [all_caption]
    sums = [count_rows(rows).alias("t0"), count_where(without, rows).alias("w0")]
    for i, label in enumerate(sorted(labels), start=1):
        member = F.col(subgroup).eqNullSafe(F.lit(label))
        captions.append(caption(label))
        sums += [count_where(member, rows).alias(f"t{i}"), count_where(member & without, rows).alias(f"w{i}")]
    lines = [
        F.struct(F.lit(text).alias("subgroup"), F.col(f"t{i}").alias("total"), F.col(f"w{i}").alias(f"without_{name}"))
        for i, text in enumerate(captions)
    ]
    table = inside.agg(*sums).select(F.inline(F.array(*lines)))
    return table.withColumn(f"without_{name}_pct", round2_exact(percent(f"without_{name}", "total")))
