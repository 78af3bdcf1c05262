"""Dates given to the day, the month or the year."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from coverlens.functions import vocab
from coverlens.functions.text import ColumnOrName, as_col


def partial_date(c: ColumnOrName) -> Column:
    """``YYYY``, ``YYYY-M[M]`` or ``YYYY-M[M]-D[D]`` as a date (first of the period); anything else is null.

    Spark's cast reads all three forms; the pattern keeps out what it also accepts (signs, padding,
    year zero, longer years, time suffixes).
    """
    c = as_col(c)
    return F.when(c.rlike(r"^(?!0000)\d{4}(-\d{1,2}){0,2}\z"), c.try_cast("date"))


def within(c: ColumnOrName, start: str = vocab.START_FROM, end: str = vocab.START_TO) -> Column:
    """True if the partial date lies in ``[start, end]``; null and unreadable dates are outside."""
    bounds = F.lit(start).cast("date"), F.lit(end).cast("date")
    return F.coalesce(partial_date(c).between(*bounds), F.lit(False))


def year_of(c: ColumnOrName) -> Column:
    return F.year(partial_date(c))
