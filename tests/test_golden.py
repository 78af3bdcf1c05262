import golden
import pytest
from conftest import rows

from coverlens.operators.gaps import cohort_gaps
from coverlens.operators.odds import adjusted_odds, crude_odds
from coverlens.operators.outcomes import keyword_signals_by_flag, outcomes_by_flag, signal_ratios
from coverlens.operators.prevalence import prevalence_by, prevalence_overall, prevalence_sets
from coverlens.plans.normalize import normalize


@pytest.mark.parametrize(
    "table", [golden.PHASE, golden.SPONSOR, golden.STUDY_TYPE, golden.AREA], ids=["phase", "sponsor", "type", "area"]
)
def test_prevalence_by(spark, table):
    records = golden.expand(spark, golden.with_and_without(table), "label string, has_dmc boolean")
    assert rows(prevalence_by(records, "label")) == table
    assert rows(prevalence_overall(records)) == [golden.OVERALL]
    sets = {r[1]: r[1:] for r in rows(prevalence_sets(records, ["label"])) if r[0] == "label"}
    assert sets == {r[0]: r for r in table}


def test_gaps(spark):
    groups = {c.split(" • ")[0]: (t, w) for c, t, w, _ in golden.GAPS[1:]}
    groups["Neurology"] = tuple(
        golden.GAPS[0][i + 1] - sum(v[i] for v in groups.values()) for i in range(2)
    )
    counted = []
    for label, (total, without) in groups.items():
        counted += [(without, label, False, "Phase 3"), (total - without, label, True, "Phase 2/Phase 3")]
    counted += [(50, "Oncology", False, "Phase 2")]
    records = golden.expand(spark, counted, "therapeutic_area string, has_dmc boolean, phase string").selectExpr(
        "*", "'Interventional' AS study_type", "'Industry' AS sponsor_bucket"
    )
    assert rows(cohort_gaps(records)) == golden.GAPS


def test_outcomes(spark):
    counted = []
    for label, _, stopped, done, _ in golden.OUTCOMES:
        counted += [(stopped, label == "With DMC", " withdrawn"), (done, label == "With DMC", "Completed")]
    records = golden.expand(spark, counted, "has_dmc boolean, overall_status string").selectExpr(
        "*", "null AS sponsor_class", "'x' AS study_type", "'Phase 1' AS phase"
    )
    records = normalize(records)
    assert rows(outcomes_by_flag(records)) == golden.OUTCOMES
    odds = crude_odds(records).first()
    assert round(odds.odds_ratio, 3) == 0.634
    assert odds.ci_low < odds.odds_ratio < odds.ci_high
    fitted = {r.term: r for r in adjusted_odds(records, factors=[]).collect()}
    assert fitted["without_flag"].odds_ratio == pytest.approx(odds.odds_ratio, rel=1e-9)
    assert fitted["without_flag"].ci_low == pytest.approx(odds.ci_low, rel=1e-7)
    assert fitted["without_flag"].n == golden.OVERALL[0]


def test_why_stopped(spark):
    counted = []
    for label, total, safety, futility, _, _ in golden.WHY_STOPPED:
        flag = label == "With DMC"
        counted += [(safety, flag, "Toxicity"), (futility, flag, "Lack of efficacy")]
        counted += [(1000, flag, "Slow accrual"), (7, flag, ""), (total - safety - futility - 1007, flag, None)]
    records = golden.expand(spark, counted, "has_dmc boolean, why_stopped string")
    everyone = keyword_signals_by_flag(records, denominator="all_rows")
    assert rows(everyone) == golden.WHY_STOPPED
    ratios = rows(signal_ratios(everyone))[0]
    assert [round(r, 2) for r in ratios] == [2.09, 3.78]
    told = {r[0]: r for r in rows(keyword_signals_by_flag(records))}
    for label, _, safety, futility, _, _ in golden.WHY_STOPPED:
        assert told[label][1:4] == (safety + futility + 1000, safety, futility)
