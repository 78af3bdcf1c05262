"""First-wins de-duplication and the set operations around it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def first_wins(df: DataFrame, key: str | Sequence[str], order_by: Sequence[str]) -> DataFrame:
    """The first row of each key in the given order.

    Spark plans ``row_number() = 1`` with a group limit below the shuffle: every map task passes on one
    row per key, so a key that holds a third of the table still reaches the reducer as a handful of rows.
    """
    keys = [key] if isinstance(key, str) else list(key)
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order_by))
    return df.withColumn("_place", place).where("_place = 1").drop("_place")


def unseen_only(df: DataFrame, seen: DataFrame, key: str = "nct_id") -> DataFrame:
    """Rows whose key is not among the seen ones. Only the key column of ``seen`` is read, repeats combined before the shuffle.

    After :func:`first_wins` on the same key the rows are already partitioned for this join.
    """
    return df.join(seen.select(key).distinct(), key, "left_anti")


def unseen_in_small_batch(df: DataFrame, seen: DataFrame, key: str = "nct_id") -> DataFrame:
    """:func:`unseen_only` for a stored batch that is small next to the seen set.

    The seen keys are first reduced to those in the batch. That join may broadcast the batch's keys, if
    Spark finds them small enough, and then the large set is scanned but never shuffled.
    """
    known = seen.select(key).join(df.select(key), key, "left_semi")
    return df.join(known, key, "left_anti")


def merged_ids(old: DataFrame, new: DataFrame, key: str = "nct_id") -> DataFrame:
    """All distinct keys of both."""
    return old.select(key).union(new.select(key)).distinct()
