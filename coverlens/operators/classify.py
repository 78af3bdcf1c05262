"""First-match classification of long texts by many keys."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coverlens.functions import vocab
from coverlens.functions.labels import Rules
from coverlens.functions.text import ColumnOrName, as_col


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt to all cores where the scan has fewer tasks than there are cores, for work that costs more per byte than a shuffle.

    A table of many files or row groups has tasks enough and is not shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def word_index(text: ColumnOrName) -> Column:
    """The text's distinct words, as blanks separate them. A key without a blank is inside the text if it is inside one of these."""
    return F.array_join(F.array_distinct(F.split(as_col(text), " ")), " ")


def _names(df: DataFrame, *wanted: str) -> list[str]:
    taken = {c.lower() for c in df.columns}
    while any(w.lower() in taken for w in wanted):
        wanted = tuple(f"_{w}" for w in wanted)
    return list(wanted)


def _any_key(text: Column, words: Column, keys: Iterable[str]) -> Column:
    return reduce(or_, [F.contains(text if " " in k else words, F.lit(k)) for k in keys], F.lit(False))


def classified(
    df: DataFrame, text: ColumnOrName, to: str = "therapeutic_area", rules: Rules = vocab.AREA_RULES, default: str = vocab.DEFAULT_AREA
) -> DataFrame:
    """``df`` with a column ``to``: the label of the first rule with a key inside the (lower-case) text.

    The same labels as :func:`coverlens.functions.labels.area_of`, for texts of many words: a text is split once, and
    its distinct words are searched instead of the whole text for every key that has no blank. Text and words are columns
    of their own below the rules, so that both are computed once and the search is compiled code. A null text gets the default.
    """
    own, words = _names(df, "own_text", "own_words")
    staged = df.withColumn(own, as_col(text)).withColumn(words, word_index(own))
    label = F.when(F.lit(False), F.lit(default))
    for name, keys in rules:
        label = label.when(_any_key(F.col(own), F.col(words), keys), name)
    return staged.withColumn(to, label.otherwise(default)).drop(own, words)
