"""Reading loosely typed JSON values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from coverlens.functions.text import ColumnOrName, as_col


def json_path(text: ColumnOrName, path: str) -> Column:
    """Value at a dotted path of a JSON text; a missing step or unreadable text gives null."""
    return F.get_json_object(as_col(text), f"$.{path}")


def _at(path: str | None) -> str:
    return f"$.{path}" if path else "$"


def variant_text(v: ColumnOrName, path: str | None = None) -> Column:
    """A VARIANT scalar, or the one at a dotted path in it, as text; an object or list gives its JSON."""
    return F.try_variant_get(as_col(v), _at(path), "string")


def variant_is_object(v: ColumnOrName, path: str | None = None) -> Column:
    """Whether a VARIANT, or what is at a dotted path in it, is an object."""
    return F.try_variant_get(as_col(v), _at(path), "struct<>").isNotNull()


def variant_list(v: ColumnOrName, path: str | None = None) -> Column:
    """A VARIANT that is a list or a single value, as a list of texts; null and empty give the empty list."""
    one = F.filter(F.array(variant_text(v, path)), lambda x: x.isNotNull() & (x != ""))
    return F.coalesce(F.try_variant_get(as_col(v), _at(path), "array<string>"), one)


def json_list(text: ColumnOrName) -> Column:
    """:func:`variant_list` of a JSON text."""
    return variant_list(F.try_parse_json(as_col(text)))
