"""Outcomes and stop reasons with and without the flag."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coverlens.functions import vocab
from coverlens.functions.labels import flag_label, known
from coverlens.functions.measures import count_keys, count_where, percent, round2
from coverlens.functions.text import mentions


def _by_label(df: DataFrame, flag: str, label: str, sums: Sequence[Column]) -> DataFrame:
    return df.groupBy(known(flag).alias("_flag")).agg(*sums).withColumn(label, flag_label("_flag"))


def outcomes_by_flag(
    df: DataFrame,
    flag: str = "has_dmc",
    key: str = "nct_id",
    terminated: Column | str = "is_terminated_like",
    completed: Column | str = "is_completed",
    rows: str | None = None,
    keys: str | None = None,
    label: str = "has_dmc_label",
) -> DataFrame:
    """label, total, terminated_like, completed, terminated_like_pct; highest rate first.

    ``total`` counts records with a key, the outcome columns count all records.
    """
    terminated, completed = (F.col(c) if isinstance(c, str) else c for c in (terminated, completed))
    counts = _by_label(
        df,
        flag,
        label,
        [
            count_keys(key, keys).alias("total"),
            count_where(terminated, rows).alias("terminated_like"),
            count_where(completed, rows).alias("completed"),
        ],
    )
    pct = round2(percent("terminated_like", "total")).alias("terminated_like_pct")
    return counts.select(label, "total", "terminated_like", "completed", pct).orderBy(
        F.desc("terminated_like_pct"), label
    )


def signals_by_flag(
    df: DataFrame,
    signals: Mapping[str, Column],
    flag: str = "has_dmc",
    key: str = "nct_id",
    rows: str | None = None,
    keys: str | None = None,
    label: str = "has_dmc_label",
) -> DataFrame:
    """label, n_with_text, then hits and rate of each signal; highest first rate first."""
    sums = [count_keys(key, keys).alias("n_with_text")]
    sums += [count_where(hit, rows).alias(f"{s}_hits") for s, hit in signals.items()]
    hits = [F.col(f"{s}_hits") for s in signals]
    rates = [round2(percent(f"{s}_hits", "n_with_text")).alias(f"{s}_rate_pct") for s in signals]
    counts = _by_label(df, flag, label, sums).select(label, "n_with_text", *hits, *rates)
    return counts.orderBy(F.desc(f"{next(iter(signals))}_rate_pct"), label)


def keyword_signals_by_flag(
    df: DataFrame,
    text: str = "why_stopped",
    lists: Mapping[str, Sequence[str]] | None = None,
    denominator: str = "with_text",
    flag: str = "has_dmc",
    key: str = "nct_id",
    label: str = "has_dmc_label",
) -> DataFrame:
    """Share of stop reasons that mention a word of each list.

    ``denominator="with_text"`` counts records that give a reason; ``"all_rows"`` counts every record.
    The hits are the same either way.
    """
    if denominator not in ("with_text", "all_rows"):
        raise ValueError(f"Unknown denominator '{denominator}'.")
    lists = lists or {"safety": vocab.SAFETY_KEYS, "futility": vocab.FUTILITY_KEYS}
    base = df if denominator == "all_rows" else df.where(F.length(text) > 0)
    return signals_by_flag(base, {s: mentions(text, words) for s, words in lists.items()}, flag, key, label=label)


def signal_ratios(
    rates: DataFrame, signals: Sequence[str] = ("safety", "futility"), label: str = "has_dmc_label"
) -> DataFrame:
    """One row: rate with the flag over rate without it, per signal; null where that is undefined.

    Takes the table of :func:`signals_by_flag` and divides the unrounded rates.
    """

    def of(column: str, side: str) -> Column:
        return F.max(F.when(F.col(label) == side, F.col(column)))

    sides = {"w": vocab.WITH_LABEL, "n": vocab.WITHOUT_LABEL}
    columns = ["n_with_text", *[f"{s}_hits" for s in signals]]
    flat = rates.agg(*[of(c, text).alias(f"{c}_{side}") for side, text in sides.items() for c in columns])
    rate = {
        (s, side): F.try_divide(f"{s}_hits_{side}", F.col(f"n_with_text_{side}")) for s in signals for side in sides
    }
    return flat.select(*[F.try_divide(rate[s, "w"], rate[s, "n"]).alias(f"{s}_ratio") for s in signals])
