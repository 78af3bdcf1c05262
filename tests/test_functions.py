import random

import numpy as np
import pandas as pd
import pytest

from coverlens.functions import dates, labels, measures, nested, text, vocab
from coverlens.operators.classify import classified

X = "x"


def test_title_case(column):
    values = ["EXPANDED_ACCESS", "INTERVENTIONAL", "", None, "they're 2nd-rate", "a1b", "élan vital"]
    assert column(values, text.title_case(X)) == [v if v is None else v.title() for v in values]


def test_strip_removes_all_white_space(column):
    values = ["\t a  b \n", "plain", "   ", None, "　x "]
    assert column(values, text.strip(X)) == [v if v is None else v.strip() for v in values]


def test_upper_strip(column):
    assert column([" industry\n", None], text.upper_strip(X)) == ["INDUSTRY", None]


def test_na_tokens(column):
    values = ["N/A", "None", "null", "", "NULL", "nan", "keep", "n/a ", None]
    assert column(values, text.null_if_na(X)) == [None] * 6 + ["keep", "n/a ", None]


def test_flag_from_text(column):
    values = [" TRUE ", "false", "yes", "1", "t", None, "False\n"]
    assert column(values, labels.parse_flag(X)) == [True, False, None, None, None, None, False]


def test_unknown_flag_is_not_set(column):
    assert column([True, False, None], labels.known(X), "boolean") == [True, False, False]
    assert column([True, False, None], labels.flag_label(X), "boolean") == ["With DMC", "No DMC", "No DMC"]


def test_phase_of_code(column):
    values = ["PHASE1", "phase2", "NA", "EARLY_PHASE1", "PHASE5", "", None]
    expected = ["Phase 1", "Phase 2", "N/A", "Early Phase 1", "Phase5", None, None]
    assert column(values, labels.phase_of_code(X)) == expected


def test_phase_of_codes(column):
    values = [
        ["PHASE1", "PHASE2"],
        ["PHASE2", "PHASE1", "PHASE1"],
        ["NA"],
        ["EARLY_PHASE1"],
        [],
        None,
        ["PHASE5"],
        [None, ""],
        ["PHASE1", "EARLY_PHASE1"],
    ]
    expected = ["Phase 1/Phase 2", "Phase 1/Phase 2", "N/A", "Early Phase 1", None, None, "Phase5", None]
    expected.append("Early Phase 1/Phase 1")
    assert column(values, labels.phase_of_codes(X), "array<string>") == expected


def test_phase_label_for_charts(column):
    assert column([None, "", "NaN", " Phase 2 ", "  "], labels.phase_or_na(X)) == ["N/A", "N/A", "N/A", "Phase 2", "N/A"]


def test_area_of_conditions(column):
    cases = [
        (["Lung cancer"], "Oncology"),
        (["Diabetic heart disease"], "Cardiovascular"),
        (["Preterm delivery"], "Gastroenterology"),
        (["Symptoms of flu"], "Neurology"),
        (["Symptoms"], "Other/Unclassified"),
        (["Symptoms", None], "Neurology"),
        ([], "Other/Unclassified"),
        (None, "Other/Unclassified"),
        (["Sma type 1"], "Genetic/Rare"),
    ]
    out = column([c for c, _ in cases], labels.area_of(text.joined_lower(X)), "array<string>")
    assert out == [label for _, label in cases]


def brute_area(value):
    ranks = [rank for rank, (_, keys) in enumerate(vocab.AREA_RULES) for key in keys if (value or "").count(key)]
    return vocab.AREA_RULES[min(ranks)][0] if ranks else vocab.DEFAULT_AREA


def test_classifier_agrees_with_brute_force(column):
    rng = random.Random(7)
    keys = [k for _, ks in vocab.AREA_RULES for k in ks]
    values = [
        "".join(rng.choice([rng.choice(keys), rng.choice(keys)[:-1], " ", "x"]) for _ in range(rng.randint(0, 9)))
        for _ in range(600)
    ] + [None, ""]
    expected = [brute_area(v) for v in values]
    assert column(values, labels.area_of(X)) == expected
    assert len(set(expected)) == len(vocab.AREA_RULES) + 1


def test_bucket(column):
    values = ["network", " industry ", "FED", None, "ACADEMIC", "nih", "OTHER"]
    assert column(values, labels.bucket_of(X)) == ["Academic", "Industry", "Other", "Other", "Academic", "NIH", "Other"]


def test_keyword_lists(column):
    values = ["Adverse Event", "michael left", "lack of efficacy", "business decision", None, ""]
    assert column(values, text.mentions(X, vocab.SAFETY_KEYS)) == [True, True, False, False, False, False]
    assert column(values, text.mentions(X, vocab.FUTILITY_KEYS)) == [False, False, True, False, False, False]


def test_late_phase(column):
    values = ["Phase 2/Phase 3", "phase 3", "Phase 2/3", "Phase 30", None, "Phase 4"]
    assert column(values, labels.late_phase(X)) == [True, True, False, False, False, True]


def test_statuses(column):
    values = ["completed", "RECRUITING", "", None, "Withdrawn"]
    assert column(values, labels.in_statuses(X, vocab.ELIGIBLE_STATUSES)) == [True, False, False, False, True]


@pytest.mark.parametrize(
    "value, inside",
    [
        ("2010-01-01", True),
        ("2010-01", True),
        ("2010", True),
        ("2009-12-31", False),
        ("2025-12-31", True),
        ("2026", False),
        ("2010-1-5", True),
        ("2010-02-30", False),
        ("201", False),
        ("2010-01-05T00:00", False),
        ("2010-13", False),
        ("2010-01-05\n", False),
        ("+2010", False),
        (" 2010", False),
        ("12010", False),
        ("", False),
        (None, False),
    ],
)
def test_window(column, value, inside):
    assert column([value], dates.within(X)) == [inside]


def test_year(column):
    assert column(["2011-05", "2012", "2013-2-3", "x", None], dates.year_of(X)) == [2011, 2012, 2013, None, None]


def test_json_list(column):
    values = ['"asthma"', '["a", null]', "[]", "null", '""', None, "not json", "7", '{"a": 1}']
    expected = [["asthma"], ["a", None], [], [], [], [], [], ["7"]]
    assert column(values, nested.json_list(X))[:8] == expected


def test_json_path(column):
    values = ['{"a": {"b": 1}}', '{"a": 2}', "{", None]
    assert column(values, nested.json_path(X, "a.b")) == ["1", None, None, None]


def test_percent_of_nothing_is_zero(spark):
    df = spark.createDataFrame([(1, 0), (1, 4)], "a bigint, b bigint")
    assert [r[0] for r in df.select(measures.percent("a", "b")).collect()] == [0.0, 25.0]


def test_rounding_is_numpys(column):
    pairs = [(w, t) for t in (7, 16, 800, 4000, 20000, 262125) for w in range(0, t + 1, max(1, t // 900))]
    values = [w / t * 100 for w, t in pairs]
    assert column(values, measures.round2(X), "double") == pd.Series(values).round(2).tolist()
    assert column([0.125, 0.375], measures.round2(X), "double") == [0.12, 0.38]
    assert np.isclose(column([28.566904], measures.round2(X), "double")[0], 28.57)


def test_classified_equals_area_of(spark):
    rules = [*vocab.AREA_RULES, ("Blanks", [" x", "y "]), ("Empty", [])]
    cases = [None, "", " ", "  ", "symptoms", "symptoms of", "forms", "lung  cancer", "tay-sachs", "ulcerative", "ulcerative colitis", "a\nheart\tb", "no x", "y", "yy z", "é rare"]
    cases += [" ".join(c or "" for c in cases[i : i + 4]) for i in range(len(cases))]
    df = spark.createDataFrame([(c, 1) for c in cases], "own_text string, Own_Words int")
    found = classified(df, "own_text", "area", rules).withColumn("wanted", labels.area_of("own_text", rules)).collect()
    assert [r.area for r in found] == [r.wanted for r in found] and len({r.area for r in found}) > 5
    assert found[0].own_text is None and found[0].Own_Words == 1
