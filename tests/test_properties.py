"""Random inputs against plain Python. Each example is a batch of values, so that it costs one Spark job."""

import json
import re
from datetime import date

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from coverlens.functions import dates, labels, nested, text, vocab

few = settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))


def batch(values, size=120):
    return st.lists(st.one_of(st.none(), values), min_size=size, max_size=size)


def python_date(value):
    match = re.fullmatch("([0-9]{4})(?:-([0-9]{1,2})(?:-([0-9]{1,2}))?)?", value or "")
    try:
        return match and date(*[int(part or 1) for part in match.groups()])
    except ValueError:
        return None


number = st.integers(0, 35).map(str) | st.integers(0, 35).map("{:02d}".format)
year = st.integers(1980, 2040).map(str) | st.sampled_from(["0000", "999", "20100", "+2010"])
date_like = st.one_of(
    year,
    st.tuples(year, number).map("-".join),
    st.tuples(year, number, number).map("-".join),
    st.tuples(year, number, number).map(lambda p: "-".join(p) + "T00"),
    st.text("0123456789-", max_size=11),
)


@few
@given(batch(date_like))
def test_partial_date(column, values):
    assert column(values, dates.partial_date("x")) == [python_date(v) for v in values]


@few
@given(batch(st.text("aBcÉé _-'1./", max_size=12)))
def test_title_case(column, values):
    assert column(values, text.title_case("x")) == [v if v is None else v.title() for v in values]


@few
@given(batch(st.text(" \t\n\xa0  xy", max_size=8)))
def test_strip(column, values):
    assert column(values, text.strip("x")) == [v if v is None else v.strip() for v in values]


@few
@given(batch(st.text(" \ttTrRuUeE", max_size=7) | st.sampled_from([" True", "FALSE\n", "false", "yes"])))
def test_flag(column, values):
    known = {"true": True, "false": False}
    assert column(values, labels.parse_flag("x")) == [known.get((v or "").strip().lower()) for v in values]


def python_phase(codes):
    found = set(map(str.upper, filter(None, codes or [])))
    labelled = [vocab.PHASE_LABELS[c] if c in vocab.PHASE_LABELS else c.title() for c in found]
    return "/".join(sorted(labelled)) if found else None


code = st.sampled_from([*vocab.PHASE_LABELS, "phase2", "PHASE5", "other_kind", "", None])


@few
@given(batch(st.lists(code, max_size=4)))
def test_phases(column, values):
    assert column(values, labels.phase_of_codes("x"), "array<string>") == [python_phase(v) for v in values]


keys = [k for _, words in vocab.AREA_RULES for k in words]
piece = st.sampled_from(keys) | st.sampled_from([k[:-1] for k in keys]) | st.sampled_from([" ", "s", "ms", "x"])


@few
@given(batch(st.lists(st.none() | piece.map(str.title), max_size=4)))
def test_area(column, values):
    patterns = [(re.compile("|".join(map(re.escape, words))), label) for label, words in vocab.AREA_RULES]

    def expected(conditions):
        whole = " ".join("" if c is None else c.lower() for c in conditions or [])
        return next((label for pattern, label in patterns if pattern.search(whole)), vocab.DEFAULT_AREA)

    joined = text.joined_lower("x")
    wanted = [expected(v) for v in values]
    assert column(values, labels.area_of(joined), "array<string>") == wanted


@few
@given(batch(st.text('ab"[],\\é', max_size=6)))
def test_scalar_and_list_json(column, values):
    as_scalar = [None if v is None else json.dumps(v) for v in values]
    as_list = [None if v is None else json.dumps([v, None]) for v in values]
    assert column(as_scalar, nested.json_list("x")) == [[v] if v else [] for v in values]
    assert column(as_list, nested.json_list("x")) == [[] if v is None else [v, None] for v in values]
