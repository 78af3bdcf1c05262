"""From raw codes to the labels that results are grouped by."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from coverlens.functions import vocab
from coverlens.functions.text import ColumnOrName, as_col, has_any, has_phrase, let, strip, title_case, upper_strip

Rules = Sequence[tuple[str, Sequence[str]]]


def _lookup(c: Column, table: Mapping) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[c]


def parse_flag(c: ColumnOrName) -> Column:
    """``true`` / ``false`` in any case and padding; any other text is unknown (null)."""
    return _lookup(F.lower(strip(as_col(c))), {"true": True, "false": False})


def known(flag: ColumnOrName) -> Column:
    """An unknown flag counts as not set."""
    return F.coalesce(as_col(flag), F.lit(False))


def flag_label(flag: ColumnOrName, yes: str = vocab.WITH_LABEL, no: str = vocab.WITHOUT_LABEL) -> Column:
    return F.when(known(flag), yes).otherwise(no)


def phase_of_code(code: ColumnOrName, table: Mapping[str, str] = vocab.PHASE_LABELS) -> Column:
    """Phase code to label; an unlisted code becomes title case; null and empty give null."""
    code = as_col(code)
    return F.when(code != "", F.coalesce(_lookup(F.upper(code), table), title_case(code)))


def phase_of_codes(codes: ColumnOrName, table: Mapping[str, str] = vocab.PHASE_LABELS) -> Column:
    """List of phase codes to its distinct labels, sorted and joined with ``/``; nothing left gives null."""
    labels = F.filter(F.transform(as_col(codes), lambda c: phase_of_code(c, table)), lambda x: x.isNotNull() & (x != ""))
    return F.nullif(F.array_join(F.array_sort(F.array_distinct(labels)), "/"), F.lit(""))


def phase_or_na(phase: ColumnOrName) -> Column:
    """Chart label of a phase: null, blank and ``NaN`` read as ``N/A``."""
    label = strip(as_col(phase))
    return F.when(label.isNull() | label.isin("", "NaN"), vocab.PHASE_NA).otherwise(label)


def bucket_of(
    c: ColumnOrName, table: Mapping[str, str] = vocab.SPONSOR_BUCKETS, default: str = vocab.DEFAULT_BUCKET
) -> Column:
    """Maps a code, in any case and padding, to its bucket; everything else goes to the default bucket."""
    return bucket_of_clean(upper_strip(c), table, default)


def bucket_of_clean(
    c: ColumnOrName, table: Mapping[str, str] = vocab.SPONSOR_BUCKETS, default: str = vocab.DEFAULT_BUCKET
) -> Column:
    """:func:`bucket_of` for codes that :func:`upper_strip` has already cleaned."""
    return F.coalesce(_lookup(as_col(c), table), F.lit(default))


def in_statuses(status: ColumnOrName, statuses: Iterable[str]) -> Column:
    """Case-insensitive membership; null and empty are in no set."""
    return F.coalesce(F.upper(as_col(status)).isin([s.upper() for s in statuses]), F.lit(False))


def has_status(status: ColumnOrName, statuses: Iterable[str]) -> Column:
    """Membership for a status that is stored in upper case, as ingestion stores it: a filter that reaches the scan."""
    return as_col(status).isin([s.upper() for s in statuses])


def late_phase(phase: ColumnOrName) -> Column:
    return has_phrase(phase, "Phase 3") | has_phrase(phase, "Phase 4")


def area_of(text: ColumnOrName, rules: Rules = vocab.AREA_RULES, default: str = vocab.DEFAULT_AREA) -> Column:
    """Label of the first rule with a key inside the (lower-case) text."""

    def first_match(t: Column) -> Column:
        label = F.when(F.lit(False), F.lit(default))
        for name, keys in rules:
            label = label.when(has_any(t, keys), name)
        return label.otherwise(default)

    return let(as_col(text), first_match)
