"""Tables behind the charts: category ranks, two-way cells, matrix, yearly trends."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coverlens.functions import vocab
from coverlens.functions.labels import known
from coverlens.functions.measures import count_keys, count_rows, count_where, percent
from coverlens.session import stored


def category_counts(df: DataFrame, column: str, rows: str | None = None) -> DataFrame:
    """Frequency of each non-null value, most frequent first; ties by value."""
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(count_rows(rows).alias("n"))
    return counts.orderBy(F.desc("n"), column)


def distinct_labels(df: DataFrame, column: str) -> DataFrame:
    """The distinct non-null values in order."""
    return df.where(F.col(column).isNotNull()).select(column).distinct().orderBy(column)


def top_categories(df: DataFrame, column: str, n: int = vocab.TOP_AREAS, rows: str | None = None) -> DataFrame:
    """The ``n`` most frequent values; at the cut the smaller value wins a tie."""
    return category_counts(df, column, rows).limit(n)


def in_top_categories(df: DataFrame, column: str, n: int = vocab.TOP_AREAS, rows: str | None = None) -> DataFrame:
    """Rows whose value is among the ``n`` most frequent. Spark picks the join by the list's size."""
    return df.join(top_categories(df, column, n, rows).select(column), column, "left_semi")


def _counted(
    df: DataFrame, by: Sequence[str], flag: str, key: str, rows: str | None, keys: str | None, name: str
) -> DataFrame:
    return df.groupBy(*by).agg(
        count_rows(rows).alias("_n"),
        count_keys(key, keys).alias("total"),
        count_where(known(flag), rows).alias(f"with_{name}"),
    )


def _finished(counts: DataFrame, by: Sequence[str], name: str) -> DataFrame:
    pct = percent(f"with_{name}", "total").alias(f"with_{name}_pct")
    return counts.dropna(subset=list(by)).select(*by, "total", f"with_{name}", pct)


def _pair_counts(
    df: DataFrame, row: str, column: str, flag: str, key: str, rows: str | None, keys: str | None, name: str
) -> DataFrame:
    counts = _counted(df.dropna(subset=[column]), [row, column], flag, key, rows, keys, name)
    return stored(counts, "pair-counts") if rows is None else counts


def heatmap_cells(
    df: DataFrame,
    row: str = "sponsor_bucket",
    column: str = "therapeutic_area",
    n: int = vocab.TOP_AREAS,
    flag: str = "has_dmc",
    key: str = "nct_id",
    rows: str | None = None,
    keys: str | None = None,
    name: str = "dmc",
) -> DataFrame:
    """row, column, total, with_*, with_*_pct (unrounded) for the ``n`` most frequent column values.

    The records are read once: pair counts are stored, and both the ranking and the cells come from them.
    A table that is counted already (``rows`` is given) is read twice instead.
    """
    counts = _pair_counts(df, row, column, flag, key, rows, keys, name)
    return _finished(in_top_categories(counts, column, n, "_n"), [row, column], name)


def cell_matrix(
    cells: DataFrame,
    values: Sequence[str],
    row: str = "sponsor_bucket",
    column: str = "therapeutic_area",
    value: str = "with_dmc_pct",
) -> DataFrame:
    """Cells as a matrix: one sorted row per ``row``, one column per value in alphabetical order, null if absent."""
    return cells.groupBy(row).pivot(column, sorted(values)).agg(F.first(value)).orderBy(row)


def heatmap_matrix(
    df: DataFrame,
    row: str = "sponsor_bucket",
    column: str = "therapeutic_area",
    n: int = vocab.TOP_AREAS,
    flag: str = "has_dmc",
    key: str = "nct_id",
    rows: str | None = None,
    keys: str | None = None,
    name: str = "dmc",
) -> DataFrame:
    """The heat map of the ``n`` most frequent column values.

    Its columns must be known to plan it, so the ``n`` labels are fetched first.
    """
    counts = _pair_counts(df, row, column, flag, key, rows, keys, name)
    top = [r[0] for r in top_categories(counts, column, n, "_n").select(column).collect()]
    cells = _finished(counts.where(F.col(column).isin(top)), [row, column], name)
    return cell_matrix(cells, top, row, column, f"with_{name}_pct")


def value_range(cells: DataFrame, value: str = "with_dmc_pct") -> DataFrame:
    """Smallest and largest value, nulls ignored."""
    return cells.agg(F.min(value).alias("vmin"), F.max(value).alias("vmax"))


def yearly_trend(
    df: DataFrame,
    group: str = "sponsor_bucket",
    year: str = "start_year",
    flag: str = "has_dmc",
    key: str = "nct_id",
    exclude: Column | None = None,
    rows: str | None = None,
    keys: str | None = None,
    name: str = "dmc",
) -> DataFrame:
    """year, group, total, with_*, with_*_pct (unrounded), by group and year; rows without either are left out."""
    kept = df if exclude is None else df.where(~exclude)
    by = [year, group]
    return _finished(_counted(kept.dropna(subset=by), by, flag, key, rows, keys, name), by, name).orderBy(group, year)


def phase_trend(df: DataFrame, group: str = "phase_label", **options) -> DataFrame:
    """:func:`yearly_trend` by phase, without the records that have none."""
    return yearly_trend(df, group=group, exclude=F.col(group) == vocab.PHASE_NA, **options)
