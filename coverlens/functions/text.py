"""Text cleaning and keyword matching."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from coverlens.functions import vocab

ColumnOrName = Column | str


def as_col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once per row, wherever the optimizer moves the expression.

    An expression used by dozens of branches is otherwise copied into each of them.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(c: ColumnOrName) -> Column:
    """Removes all leading and trailing white space (Spark's one-argument trim removes blanks only)."""
    return F.btrim(as_col(c), F.lit(vocab.WHITESPACE))


def upper_strip(c: ColumnOrName) -> Column:
    return strip(F.upper(as_col(c)))


def title_case(c: ColumnOrName) -> Column:
    """Upper-cases every letter that follows a non-letter, so ``EXPANDED_ACCESS`` is ``Expanded_Access``.

    ``initcap`` starts words at blanks only; texts where that is enough take this shorter way.
    """
    c = as_col(c)
    words = F.split(F.lower(c), r"(?<!\p{Ll})(?=\p{Ll})")
    by_letter = F.array_join(F.transform(words, lambda w: F.initcap(w)), "")
    return F.when(c.rlike(r"[^\p{L} ]\p{L}"), by_letter).otherwise(F.initcap(c))


def null_if_na(c: ColumnOrName, tokens: Iterable[str] = vocab.NA_TOKENS) -> Column:
    """Null for the texts that stand for a missing value."""
    c = as_col(c)
    return F.when(~c.isin(list(tokens)), c)


def joined_lower(items: ColumnOrName) -> Column:
    """List of texts to one lower-case text; a null element counts as empty but keeps its separator."""
    return F.lower(F.array_join(as_col(items), " ", ""))


def has_any(text: Column, keys: Iterable[str]) -> Column:
    """True if any key occurs inside the text. Null text gives null; no keys give false."""
    return reduce(or_, [F.contains(text, F.lit(k)) for k in keys], F.lit(False))


def mentions(text: ColumnOrName, keys: Iterable[str]) -> Column:
    """Case-insensitive keyword signal; null text mentions nothing."""
    return F.coalesce(let(F.lower(as_col(text)), lambda t: has_any(t, keys)), F.lit(False))


def has_phrase(text: ColumnOrName, phrase: str) -> Column:
    """True if the phrase occurs as whole words, in any case; null text gives false."""
    return F.coalesce(as_col(text).rlike(rf"(?i)\b\Q{phrase}\E\b"), F.lit(False))
