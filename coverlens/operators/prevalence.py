"""How many records carry the flag: overall, by a dimension, by many dimensions at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coverlens.functions.labels import known
from coverlens.functions.measures import count_rows, count_where, percent, round2, round2_exact
from coverlens.sources.contracts import require_columns


def _shares(name: str, total: str = "total", rounding=round2) -> list[Column]:
    with_flag = F.col(f"with_{name}")
    return [
        F.col(total),
        with_flag,
        (F.col(total) - with_flag).alias(f"without_{name}"),
        rounding(percent(with_flag, total)).alias(f"with_{name}_pct"),
    ]


def prevalence_overall(df: DataFrame, flag: str = "has_dmc", rows: str | None = None, name: str = "dmc") -> DataFrame:
    """One row: total_trials, with_*, without_*, with_*_pct. An empty table gives zeros."""
    counts = df.agg(
        count_rows(rows).alias("total_trials"), count_where(known(flag), rows).alias(f"with_{name}")
    )
    return counts.select(*_shares(name, "total_trials", round2_exact))


def prevalence_by(
    df: DataFrame, by: str, flag: str = "has_dmc", rows: str | None = None, name: str = "dmc"
) -> DataFrame:
    """One row per value of ``by`` (null is a value), highest rounded percentage first, then largest total."""
    require_columns(df, [by])
    counts = df.groupBy(by).agg(count_rows(rows).alias("total"), count_where(known(flag), rows).alias(f"with_{name}"))
    return counts.select(by, *_shares(name)).orderBy(F.desc(f"with_{name}_pct"), F.desc("total"), by)


def prevalence_sets(
    df: DataFrame, dims: Sequence[str], flag: str = "has_dmc", rows: str | None = None, name: str = "dmc"
) -> DataFrame:
    """Overall and every single-dimension breakdown from one scan: dimension, label, counts, percentage.

    Records are first counted per combination of the dimensions, so the expansion into one copy per
    grouping set happens on the combinations and not on the records. An empty table gives the overall row,
    of zeros. The overall percentage is rounded as in :func:`prevalence_overall`, the others as in :func:`prevalence_by`.
    """
    require_columns(df, dims)
    combos = df.groupBy(*dims).agg(count_rows(rows).alias("_n"), count_where(known(flag), rows).alias("_w"))
    nothing = [F.lit(0 if c in ("_n", "_w") else None).cast(combos.schema[c].dataType).alias(c) for c in combos.columns]
    combos = combos.unionByName(df.sparkSession.range(1).select(*nothing))
    sets = combos.groupingSets([[], *[[d] for d in dims]], *dims).agg(
        F.sum("_n").alias("total"), F.sum("_w").alias(f"with_{name}"), *[F.grouping(d).alias(f"_g_{d}") for d in dims]
    )
    dimension = F.coalesce(*[F.when(F.col(f"_g_{d}") == 0, d) for d in dims], F.lit("overall"))
    label = F.coalesce(*[F.when(F.col(f"_g_{d}") == 0, F.col(d).cast("string")) for d in dims])
    sets = sets.withColumns({"dimension": dimension, "label": label}).where("total > 0 OR dimension = 'overall'")
    part = percent(f"with_{name}", "total")
    pct = F.when(F.col("dimension") == "overall", round2_exact(part)).otherwise(round2(part))
    return sets.select("dimension", "label", *_shares(name)[:-1], pct.alias(f"with_{name}_pct"))
