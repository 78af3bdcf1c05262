"""Counting expressions shared by all metrics.

``weight`` names a column with the number of records a row stands for. It lets the same metric run on
records (no weight) and on a pre-aggregated table.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from coverlens.functions.text import ColumnOrName, as_col


def count_rows(weight: str | None = None) -> Column:
    if weight is None:
        return F.count(F.lit(1))
    return F.coalesce(F.sum(weight), F.lit(0)).cast("bigint")


def count_where(condition: Column, weight: str | None = None) -> Column:
    if weight is None:
        return F.count_if(condition)
    return F.coalesce(F.sum(F.when(condition, F.col(weight))), F.lit(0)).cast("bigint")


def count_keys(key: str, weight: str | None = None) -> Column:
    """Records with a non-null key."""
    return F.count(key) if weight is None else count_rows(weight)


def percent(part: ColumnOrName, whole: ColumnOrName) -> Column:
    """``part / whole`` in percent, 0.0 for an empty whole."""
    part, whole = as_col(part), as_col(whole)
    return F.when(whole > 0, part / whole * 100.0).otherwise(F.lit(0.0))


def round2_exact(c: ColumnOrName) -> Column:
    """Two decimals by the exact binary value, as Python's ``round`` decides; a true half goes to even. For values >= 0.

    Half a step is compared with 200 times the value, which is the sum of two products without rounding.
    """
    c = as_col(c)
    high = c * 134217729.0 - (c * 134217729.0 - c)  # the upper 26 bits
    below = F.floor(c * 100.0).cast("double")
    beyond_half = (high * 200.0 - (below * 2.0 + 1.0)) + (c - high) * 200.0
    up = (beyond_half > 0) | ((beyond_half == 0) & (below % 2 == 1))
    return (below + F.when(up, 1.0).otherwise(0.0)) / 100.0


def round2(c: ColumnOrName) -> Column:
    """Two decimals, halves to even, in the floating-point steps that numpy uses."""
    return F.rint(as_col(c) * 100.0) / 100.0
