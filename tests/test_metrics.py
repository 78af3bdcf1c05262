"""Edges of the metrics: empty input, ties, missing groups, missing values."""

import itertools
import math
import random

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from coverlens.functions import measures
from coverlens.operators import charts, odds, prevalence
from coverlens.operators.gaps import cohort_gaps
from coverlens.operators.outcomes import keyword_signals_by_flag, outcomes_by_flag, signal_ratios
from coverlens.operators.prevalence import prevalence_by, prevalence_overall


def frame(spark, values, columns):
    return spark.createDataFrame(values, columns)


def test_empty_table(spark):
    empty = frame(spark, [], "has_dmc boolean, phase string, n bigint")
    assert rows(prevalence_overall(empty)) == [(0, 0, 0, 0.0)]
    assert rows(prevalence_overall(empty, rows="n")) == [(0, 0, 0, 0.0)]
    assert rows(prevalence_by(empty, "phase")) == []


def test_null_group_unknown_flag_and_ties(spark):
    df = frame(
        spark,
        [("b", True), ("b", False), ("a", True), ("a", None), (None, None), ("c", True), ("d", True), ("d", True)],
        "g string, has_dmc boolean",
    )
    assert rows(prevalence_by(df, "g")) == [
        ("d", 2, 2, 0, 100.0),
        ("c", 1, 1, 0, 100.0),
        ("a", 2, 1, 1, 50.0),
        ("b", 2, 1, 1, 50.0),
        (None, 1, 0, 1, 0.0),
    ]
    with pytest.raises(ValueError, match="nope"):
        prevalence_by(df, "nope")


def test_other_flag_names(spark):
    df = frame(spark, [("x", True), ("x", None)], "g string, audited boolean")
    out = prevalence_by(df, "g", flag="audited", name="audit")
    assert out.columns == ["g", "total", "with_audit", "without_audit", "with_audit_pct"]
    assert rows(out) == [("x", 2, 1, 1, 50.0)]


def test_gap_rows_without_records(spark):
    df = frame(
        spark,
        [("Phase 3", "Interventional", "Industry", "Oncology", None), ("Phase 1", "Interventional", "Industry", "Oncology", None)],
        "phase string, study_type string, sponsor_bucket string, therapeutic_area string, has_dmc boolean",
    )
    out = rows(cohort_gaps(df, labels=["Oncology", "Cardiovascular"]))
    assert [r[1:] for r in out] == [(1, 1, 100.0), (0, 0, 0.0), (1, 1, 100.0)]
    assert out[1][0].startswith("Cardiovascular • ")
    assert [r[1:] for r in rows(cohort_gaps(df.where("false"), labels=["Oncology"]))] == [(0, 0, 0.0)] * 2


def test_total_counts_keys_and_outcomes_count_rows(spark):
    df = frame(
        spark,
        [("1", True, True, False), (None, True, True, False), ("2", None, False, True)],
        "nct_id string, has_dmc boolean, is_terminated_like boolean, is_completed boolean",
    )
    assert rows(outcomes_by_flag(df)) == [("With DMC", 1, 2, 0, 200.0), ("No DMC", 1, 0, 1, 0.0)]


def test_signal_denominators(spark):
    df = frame(
        spark,
        [("1", True, "Toxicity"), ("2", True, None), ("3", False, "futility, RISK"), ("4", False, None), ("5", None, "")],
        "nct_id string, has_dmc boolean, why_stopped string",
    )
    told = keyword_signals_by_flag(df)
    assert rows(told) == [("No DMC", 1, 1, 1, 100.0, 100.0), ("With DMC", 1, 1, 0, 100.0, 0.0)]
    everyone = rows(keyword_signals_by_flag(df, denominator="all_rows"))
    assert everyone == [("With DMC", 2, 1, 0, 50.0, 0.0), ("No DMC", 3, 1, 1, 33.33, 33.33)]
    assert rows(signal_ratios(told)) == [(1.0, 0.0)]
    assert rows(signal_ratios(told.where("has_dmc_label = 'With DMC'"))) == [(None, None)]
    with pytest.raises(ValueError):
        keyword_signals_by_flag(df, denominator="some")


def test_top_ties_and_matrix(spark):
    data = [("x", "b", True), ("y", "b", False), ("x", "a", True), ("y", "c", None), ("y", "c", True), (None, "a", True)]
    data += [("x", None, True)] * 5
    df = frame(spark, [(i, *r) for i, r in enumerate(data)], "nct_id int, sponsor_bucket string, therapeutic_area string, has_dmc boolean")
    assert rows(charts.category_counts(df, "therapeutic_area")) == [("a", 2), ("b", 2), ("c", 2)]
    assert rows(charts.top_categories(df, "therapeutic_area", 2)) == [("a", 2), ("b", 2)]
    assert rows(charts.distinct_labels(df, "therapeutic_area")) == [("a",), ("b",), ("c",)]
    cells = charts.heatmap_cells(df, n=2)
    assert sorted(rows(cells)) == [("x", "a", 1, 1, 100.0), ("x", "b", 1, 1, 100.0), ("y", "b", 1, 0, 0.0)]
    matrix = charts.heatmap_matrix(df, n=2)
    assert matrix.columns == ["sponsor_bucket", "a", "b"]
    assert rows(matrix) == [("x", 100.0, 100.0), ("y", None, 0.0)]
    assert rows(charts.cell_matrix(cells, ["b", "a", "z"])) == [("x", 100.0, 100.0, None), ("y", None, 0.0, None)]
    assert rows(charts.value_range(cells)) == [(0.0, 100.0)]
    assert sorted(rows(charts.in_top_categories(df, "therapeutic_area", 10**6))) == sorted(
        rows(df.where("therapeutic_area is not null").select("therapeutic_area", "nct_id", "sponsor_bucket", "has_dmc"))
    )


def test_trends(spark):
    df = frame(
        spark,
        [
            ("1", 2012, "Phase 2", True),
            ("2", 2011, "Phase 2", None),
            ("3", None, "Phase 2", True),
            ("4", 2011, "N/A", True),
            ("5", 2011, "Phase 1", False),
            (None, 2011, "Phase 1", True),
        ],
        "nct_id string, start_year int, phase_label string, has_dmc boolean",
    )
    everyone = rows(charts.yearly_trend(df, "phase_label"))
    assert everyone == [
        (2011, "N/A", 1, 1, 100.0),
        (2011, "Phase 1", 1, 1, 100.0),
        (2011, "Phase 2", 1, 0, 0.0),
        (2012, "Phase 2", 1, 1, 100.0),
    ]
    assert rows(charts.phase_trend(df)) == everyone[1:]


def newton(design, outcome):
    """Unweighted logistic regression on single records."""
    beta = np.zeros(design.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-design @ beta))
        information = design.T @ (design * (p * (1 - p))[:, None])
        beta = beta + np.linalg.solve(information, design.T @ (outcome - p))
    return beta, np.sqrt(np.diag(np.linalg.inv(information)))


def test_adjusted_odds_against_numpy(spark):
    rng = random.Random(5)
    data = []
    for _ in range(4000):
        phase, sponsor = rng.choice(["P1", "P2", "P3"]), rng.choice(["Industry", "NIH"])
        flag = rng.choice([True, False, None])
        score = -1 + 0.5 * (not flag) + 0.4 * (phase == "P2") - 0.7 * (phase == "P3") + 0.3 * (sponsor == "NIH")
        data.append((phase, sponsor, flag, rng.random() < 1 / (1 + math.exp(-score))))
    data.append((None, "NIH", True, True))  # left out
    df = frame(spark, data, "phase string, sponsor_bucket string, has_dmc boolean, is_terminated_like boolean")
    factors = ["phase", "sponsor_bucket"]
    design = np.array([[not f, p == "P2", p == "P3", s == "Industry", 1] for p, s, f, _ in data[:-1]], dtype=float)
    beta, errors = newton(design, np.array([y for *_, y in data[:-1]], dtype=float))
    fitted = odds.adjusted_odds(df, factors, base={"sponsor_bucket": "NIH"}).collect()
    assert [r.term for r in fitted] == ["without_flag", "phase=P2", "phase=P3", "sponsor_bucket=Industry", "intercept"]
    assert [r.coefficient for r in fitted] == pytest.approx(beta, rel=1e-7)
    assert [r.std_error for r in fitted] == pytest.approx(errors, rel=1e-6)
    assert [r.odds_ratio for r in fitted] == pytest.approx(np.exp(beta), rel=1e-7)
    assert [r.ci_high for r in fitted] == pytest.approx(np.exp(beta + odds.Z95 * errors), rel=1e-6)
    assert {r.n for r in fitted} == {4000}


def test_crude_odds_with_an_empty_cell(spark):
    df = frame(spark, [(True, True), (False, False)], "has_dmc boolean, is_terminated_like boolean")
    assert rows(odds.crude_odds(df)) == [(0, 1, 1, 0, None, None, None)]
    even = df.select("has_dmc", F.explode(F.array(F.lit(True), F.lit(False))).alias("is_terminated_like"))
    assert rows(odds.crude_odds(even))[0][4] == pytest.approx(1.0)


def test_adjusted_odds_with_many_levels(spark):
    df = spark.range(300 * 8).selectExpr(
        "CAST(id % 300 AS STRING) AS level", "id % 3 = 0 AS has_dmc", "xxhash64(id) % 4 = 0 AS is_terminated_like"
    )
    fitted = odds.adjusted_odds(df, ["level"])
    terms = [r.term for r in fitted.collect()]
    assert len(terms) == 301 and terms[0] == "without_flag" and terms[1] == "level=1" and terms[-1] == "intercept"


def firth(design, outcome):
    """Penalised logistic regression on single records, from the full information matrix."""
    beta = np.zeros(design.shape[1])
    for _ in range(500):
        p = 1 / (1 + np.exp(-design @ beta))
        w = p * (1 - p)
        inverse = np.linalg.inv(design.T @ (design * w[:, None]))
        leverage = w * ((design @ inverse) * design).sum(1)
        beta = beta + inverse @ design.T @ (outcome - p + leverage * (0.5 - p))
    return beta, np.sqrt(np.diag(inverse))


@pytest.mark.parametrize("small", [0, odds.logit.SMALL])
@pytest.mark.parametrize("penalised", [False, True])
def test_levels_in_tables_and_on_the_driver(spark, monkeypatch, small, penalised):
    rng = random.Random(8)
    data = [(rng.randrange(6), rng.choice("abc"), rng.random() < 0.5, rng.random()) for _ in range(900)]
    data = [(f"L{level}", kind, flag, u < 0.3 + 0.05 * level + 0.1 * (kind == "b")) for level, kind, flag, u in data]
    if penalised:  # a separated level, and one that always has the outcome
        data += [("L8", "a", i % 2 == 0, False) for i in range(9)] + [("L9", "b", i % 3 == 0, True) for i in range(7)]
    df = frame(spark, data, "level string, kind string, has_dmc boolean, is_terminated_like boolean")
    levels = sorted({x[0] for x in data})[1:]
    design = np.array([[not f, *(a == v for v in levels), k == "b", k == "c", 1] for a, k, f, _ in data], dtype=float)
    beta, errors = (firth if penalised else newton)(design, np.array([x[3] for x in data], dtype=float))
    fit = odds.logit.fit
    monkeypatch.setattr(odds.logit, "fit", lambda *args: fit(*args, small=small))
    fitted = odds.adjusted_odds(df, ["level", "kind"], penalised=penalised).collect()
    assert [r.term for r in fitted] == ["without_flag", *(f"level={v}" for v in levels), "kind=b", "kind=c", "intercept"]
    assert [r.coefficient for r in fitted] == pytest.approx(beta, rel=1e-6, abs=1e-8)
    assert [r.std_error for r in fitted] == pytest.approx(errors, rel=1e-6)


@pytest.mark.parametrize("small", [0, odds.logit.SMALL])
def test_levels_with_equal_counts_get_equal_estimates(spark, monkeypatch, small):
    """Levels that differ only in which cells the outcomes fall into have the same sufficient statistics."""
    records = {(kind, flag): 6 + i for i, (kind, flag) in enumerate((k, f) for k in "ab" for f in (False, True))}
    shares = [x for x in itertools.product(range(2, 6), repeat=4) if sum(x) == 15][:24]
    data = [
        (f"L{i:02d}", kind, flag, place < hits)
        for i, share in enumerate(shares)
        for ((kind, flag), n), hits in zip(records.items(), share)
        for place in range(n)
    ]
    df = frame(spark, data, "level string, kind string, has_dmc boolean, is_terminated_like boolean")
    fit = odds.logit.fit
    monkeypatch.setattr(odds.logit, "fit", lambda *args: fit(*args, small=small))
    fitted = odds.adjusted_odds(df, ["level", "kind"]).where("term LIKE 'level=%'").collect()
    assert len(fitted) == 23 and {repr(r.coefficient) for r in fitted} == {"0.0"} and len({r.std_error for r in fitted}) == 1


def test_flag_that_all_records_carry_and_absent_base(spark):
    df = frame(spark, [("a", True, True), ("a", True, False), ("b", True, False)], "level string, has_dmc boolean, is_terminated_like boolean")
    assert all(math.isnan(r.std_error) for r in odds.adjusted_odds(df, ["level"]).collect())
    with pytest.raises(ValueError, match="base level"):
        odds.adjusted_odds(df, ["level"], base={"level": "c"})


def test_hundred_thousand_levels(spark):
    df = spark.range(3_000_000).selectExpr(
        "id % 100000 AS level", "id % 7 < 3 AS has_dmc", "pmod(xxhash64(id), 10) < IF(id % 7 < 3, 3, 5) AS is_terminated_like"
    )
    fit = odds.logit.fit(
        df.selectExpr("CAST(level AS STRING) AS level", "IF(has_dmc, array(), array(0)) AS terms", "is_terminated_like AS y")
        .groupBy("level", "terms")
        .agg(F.count("*").cast("double").alias("n"), F.sum(F.col("y").cast("double")).alias("y")),
        1,
    )
    # Odds of 1 against 3/7; one intercept per 30 records adds the bias that such a model is known for.
    assert 0.8 < fit.slopes[0] < 0.92
    assert fit.levels.count() == 100_000 and fit.levels.where("isnan(alpha) OR abs(alpha) > 10").isEmpty()


def test_python_and_numpy_rounding(spark, column):
    values = [1 / 4000 * 100, 3 / 4000 * 100, 0.0, 100.0, 12.345, 0.125, 0.375, 1.005, 2.675, 33.33499999999999]
    expected = [round(v, 2) for v in values]
    assert column(values, measures.round2_exact("x"), "double") == expected
    rng = random.Random(3)
    values = [rng.randrange(t + 1) / t * 100 for t in (rng.choice([8, 200, 400, 4000, 8000, 16000, 12345]) for _ in range(20000))]
    assert column(values, measures.round2_exact("x"), "double") == [round(v, 2) for v in values]
    df = spark.range(4000).select((F.col("id") < 1).alias("has_dmc"), F.lit("all").alias("g"))
    assert prevalence.prevalence_overall(df).first().with_dmc_pct == 0.03
    assert prevalence.prevalence_by(df, "g").first().with_dmc_pct == 0.02


def test_sets_of_an_empty_table(spark):
    df = spark.createDataFrame([], "a string, b int, has_dmc boolean")
    assert rows(prevalence.prevalence_sets(df, ["a", "b"])) == [("overall", None, 0, 0, 0, 0.0)]
