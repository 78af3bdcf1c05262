"""Tidy files, seen IDs, contracts, normalisation, report."""

import random
from collections import defaultdict

import pytest
from conftest import rows
from pyspark.sql import functions as F

from coverlens import schema
from coverlens.operators.dedupe import first_wins, merged_ids, unseen_in_small_batch, unseen_only
from coverlens.plans.normalize import normalize
from coverlens.plans.report import record_cells, report_tables, write_report
from coverlens.session import stored
from coverlens.sources.seen import SeenIds, read_id_list, write_id_list
from coverlens.sources.tidy import CSV_ORDER, read_tidy, read_tidy_csv, write_tidy, write_tidy_csv

TIDY_ROW = ("N1", True, "N/A", "INTERVENTIONAL", "INDUSTRY", "COMPLETED", 'a "quoted", text\nin two lines ',
            "2012-03", "2013", ["it's", 'say "x"', None], "Oncology", 2012)


def test_tidy_round_trips(spark, tmp_path):
    df = spark.createDataFrame([TIDY_ROW, ("N2", None, *[None] * 8, "None", None)], schema.TIDY)
    write_tidy(df, str(tmp_path / "parquet"))
    assert sorted(rows(read_tidy(spark, str(tmp_path / "parquet")))) == sorted(rows(df))
    write_tidy_csv(df, str(tmp_path / "csv"))
    kept = read_tidy_csv(spark, str(tmp_path / "csv"), na_tokens=False).drop(*CSV_ORDER)
    assert sorted(rows(kept)) == sorted(rows(df))
    cleaned = {r.nct_id: r for r in read_tidy_csv(spark, str(tmp_path / "csv")).collect()}
    assert (cleaned["N1"].phase, cleaned["N2"].therapeutic_area) == (None, None)


def test_foreign_csv(spark, tmp_path):
    """Python list texts, float years, ``True`` / ``False`` / blank flags; first row of an ID wins."""
    head = ",".join(schema.TIDY_COLUMNS)
    (tmp_path / "in.csv").write_text(
        f"{head}\n"
        "N1,True,Phase 3,INTERVENTIONAL,INDUSTRY,COMPLETED,,2012-03,,\"['Asthma', \"\"Crohn's\"\"]\",Oncology,2012.0\n"
        'N2,,,OBSERVATIONAL,NIH,TERMINATED,"said ""no""\nand left",,,[],Neurology,\n'
        "N1,False,Phase 1,OBSERVATIONAL,NIH,WITHDRAWN,None,2013,,[],Neurology,2013.0\n"
    )
    df = read_tidy_csv(spark, str(tmp_path / "in.csv"))
    first = {r.nct_id: r for r in first_wins(df, "nct_id", CSV_ORDER).collect()}
    assert (first["N1"].has_dmc, first["N1"].phase, first["N1"].start_year) == (True, "Phase 3", 2012)
    assert first["N1"].conditions == ["Asthma", "Crohn's"]
    assert (first["N2"].has_dmc, first["N2"].why_stopped, first["N2"].start_year) == (None, 'said "no"\nand left', None)
    with pytest.raises(FileNotFoundError):
        read_tidy_csv(spark, str(tmp_path / "absent.csv"))


def test_id_list(spark, tmp_path):
    assert read_id_list(spark, str(tmp_path / "none")).count() == 0
    (tmp_path / "ids.txt").write_text("N2\n\n  N1 \nN2\n")
    assert sorted(rows(read_id_list(spark, str(tmp_path / "ids.txt")))) == [("N1",), ("N2",)]
    df = spark.createDataFrame([(f"N{i % 40:02d}",) for i in range(200)], "nct_id string")
    write_id_list(df, str(tmp_path / "out"))
    lines = [x for f in sorted((tmp_path / "out").glob("part-*")) for x in f.read_text().split()]
    assert lines == [f"N{i:02d}" for i in range(40)]


def test_seen_ids(spark, tmp_path):
    seen = SeenIds(spark, str(tmp_path / "seen"))
    assert seen.load().count() == 0
    batch = spark.createDataFrame([("B",), ("A",), ("A",), ("",), (None,)], "nct_id string")
    assert seen.add(batch) == 1
    assert seen.add(spark.createDataFrame([("C",), ("A",)], "nct_id string")) == 2
    assert sorted(rows(seen.load())) == [("A",), ("B",), ("C",)]
    seen.add(spark.createDataFrame([("C",)], "nct_id string"), generation=2)  # the run is repeated
    assert sorted(rows(seen.load())) == [("A",), ("B",), ("C",)]
    seen.reset()
    assert seen.load().count() == 0
    assert seen.add(spark.createDataFrame([("D",)], "nct_id string")) == 1
    assert rows(SeenIds(spark, str(tmp_path / "seen")).load()) == [("D",)]


def test_first_wins_against_brute_force(spark):
    """One key holds a third of the rows."""
    rng = random.Random(3)
    data = [(rng.choice(["hot", None, *"abcdefgh"]) if i % 3 else "hot", rng.random(), i) for i in range(3000)]
    best = {}
    for key, place, i in data:
        best[key] = min(best.get(key, (2, 0)), (place, i))
    df = spark.createDataFrame(data, "key string, place double, i int").repartition(7)
    first = first_wins(df, "key", ["place", "i"])
    assert {(k, p, i) for k, p, i in rows(first)} == {(k, *v) for k, v in best.items()}
    assert sorted(map(str, rows(first_wins(first, "key", ["place", "i"])))) == sorted(map(str, rows(first)))


def test_set_operations(spark):
    new = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "nct_id string, n int")
    old = spark.createDataFrame([("b",), ("b",), ("x",)], "nct_id string")
    assert sorted(rows(unseen_only(new, old))) == [("a", 1), ("c", 3)]
    assert sorted(rows(unseen_in_small_batch(new, old))) == [("a", 1), ("c", 3)]
    assert sorted(rows(merged_ids(new, old))) == [("a",), ("b",), ("c",), ("x",)]


def raw(spark, values, columns):
    return spark.createDataFrame(values, columns)


def test_contract(spark):
    full = spark.createDataFrame([("x",) * len(schema.REQUIRED)], schema.REQUIRED)
    for name in schema.REQUIRED:
        with pytest.raises(ValueError, match=name):
            normalize(full.drop(name))


def test_normalize(spark):
    columns = "nct_id string, has_dmc string, phase string, study_type string, sponsor_class string, overall_status string, start_date string, place int"
    df = spark.createDataFrame(
        [
            ("N1", "True", "N/A", "EXPANDED_ACCESS ", " network", "Withdrawn ", "2012-5", 1),
            ("N1", "False", "Phase 3", "INTERVENTIONAL", "NIH", "COMPLETED", "2013", 2),
            ("N2", "yes", "Phase 2/Phase 3", None, None, None, "bad", 3),
            ("N3", None, "phase 4", "OBSERVATIONAL", "industry", "completed", None, 4),
        ],
        columns,
    )
    out = {r.nct_id: r.asDict() for r in normalize(df, first_by=["place"]).collect()}
    n1, n2, n3 = out["N1"], out["N2"], out["N3"]
    assert (n1["has_dmc"], n1["study_type"], n1["sponsor_bucket"]) == (True, "Expanded_Access", "Academic")
    assert (n1["overall_status"], n1["is_terminated_like"], n1["is_completed"]) == ("WITHDRAWN", True, False)
    assert (n1["start_year"], n1["therapeutic_area"], n1["why_stopped"]) == (2012, "Other/Unclassified", None)
    assert (n1["phase"], n1["phase_label"], n1["phase_is_na"], n1["is_phase34"]) == ("N/A", "N/A", True, False)
    assert (n2["has_dmc"], n2["study_type"], n2["sponsor_bucket"], n2["is_completed"]) == (None, None, "Other", False)
    assert (n2["is_phase3"], n2["is_phase4"], n2["is_phase34"], n2["start_year"]) == (True, False, True, None)
    assert (n3["is_phase4"], n3["is_completed"], n3["sponsor_class"]) == (True, True, "INDUSTRY")
    merged = {r.nct_id: r.phase for r in normalize(df, first_by=["place"], na_tokens=True).collect()}
    assert merged["N1"] is None


@pytest.fixture(scope="module")
def records(spark):
    rng = random.Random(11)
    data = [
        (
            f"N{i}" if rng.random() > 0.02 else None,
            rng.choice([True, False, None]),
            rng.choice(["Phase 1", "Phase 3", "Phase 2/Phase 3", "Phase 4", None]),
            rng.choice(["INTERVENTIONAL", "OBSERVATIONAL"]),
            rng.choice(["INDUSTRY", "NIH", "FED"]),
            rng.choice(["COMPLETED", "TERMINATED", "SUSPENDED"]),
            rng.choice([None, "", "toxicity", "futility", "money"]),
            rng.choice([None, 2011, 2012, 2013]),
            rng.choice(["Oncology", "Neurology", "Cardiovascular"]),
        )
        for i in range(2000)
    ]
    columns = "nct_id string, has_dmc boolean, phase string, study_type string, sponsor_class string, overall_status string, why_stopped string, start_year int, therapeutic_area string"
    return stored(normalize(spark.createDataFrame(data, columns)), "records")


def test_report_equals_the_metrics_on_records(spark, records, tmp_path):
    from coverlens.operators import charts, gaps, odds, outcomes, prevalence

    for denominator in ("with_text", "all_rows"):
        tables = report_tables(stored(record_cells(records), "cells"), denominator)
        direct = {
            "metric_prevalence_overall": prevalence.prevalence_overall(records),
            "metric_prevalence_by_phase": prevalence.prevalence_by(records, "phase"),
            "metric_prevalence_by_sponsor": prevalence.prevalence_by(records, "sponsor_bucket"),
            "metric_prevalence_by_studytype": prevalence.prevalence_by(records, "study_type"),
            "metric_prevalence_by_therapeutic_area": prevalence.prevalence_by(records, "therapeutic_area"),
            "metric_oversight_gaps_phase34_industry_interventional": gaps.cohort_gaps(records),
            "metric_outcomes_by_dmc": outcomes.outcomes_by_flag(records),
            "metric_whystopped_by_dmc": outcomes.keyword_signals_by_flag(records, denominator=denominator),
            "chart_trend_by_sponsor": charts.yearly_trend(records),
            "chart_trend_by_phase": charts.phase_trend(records),
            "model_crude_odds": odds.crude_odds(records),
        }
        for name, table in direct.items():
            assert rows(tables[name]) == rows(table), name
        heatmap = "chart_heatmap_sponsor_area"
        assert sorted(rows(tables[heatmap])) == sorted(rows(charts.heatmap_cells(records)))
    paths = write_report(records, str(tmp_path / "report"), adjusted=True)
    assert len(paths) == len(tables) + 1
    factors = ["phase_label", "sponsor_bucket"]
    direct = {r.term: r.odds_ratio for r in odds.adjusted_odds(records, factors).collect()}
    written = spark.read.option("header", True).csv(f"{tmp_path}/report/model_adjusted_odds")
    assert {r.term: float(r.odds_ratio) for r in written.collect()} == pytest.approx(direct)
    with pytest.raises(ValueError):
        odds.adjusted_odds(records.where("false"), factors)
    written = spark.read.option("header", True).csv(f"{tmp_path}/report/metric_prevalence_by_phase")
    assert written.columns == ["phase", "total", "with_dmc", "without_dmc", "with_dmc_pct"]
    assert len(list((tmp_path / "report" / "metric_prevalence_by_phase").glob("part-*"))) == 1


def test_sets_equal_single_breakdowns(spark, records):
    from coverlens.operators.prevalence import prevalence_by, prevalence_overall, prevalence_sets

    dims = ["phase", "sponsor_bucket", "therapeutic_area"]
    sets = defaultdict(set)
    for dimension, *rest in rows(prevalence_sets(records, dims)):
        sets[dimension].add(tuple(rest))
    assert sets.pop("overall") == {(None, *rows(prevalence_overall(records))[0])}
    assert sets == {d: set(rows(prevalence_by(records, d))) for d in dims}
    assert sum(r[1] for r in rows(prevalence_by(records, "phase"))) == records.count()


def test_dirty_columns_are_counted_not_lost(spark, records):
    cells = record_cells(records)
    assert cells.agg(F.sum("n_rows")).first()[0] == 2000
    assert cells.agg(F.sum("n_keys")).first()[0] == records.where("nct_id is not null").count()


@pytest.mark.parametrize("missing", schema.REQUIRED)
def test_required_columns_of_files(spark, tmp_path, missing):
    df = spark.createDataFrame([TIDY_ROW], schema.TIDY)
    df.drop(missing).write.parquet(str(tmp_path / "parquet"))
    with pytest.raises(ValueError, match=missing):
        read_tidy(spark, str(tmp_path / "parquet"))
    df.drop(missing, "conditions").write.option("header", True).csv(str(tmp_path / "csv"))
    with pytest.raises(ValueError, match=missing):
        read_tidy_csv(spark, str(tmp_path / "csv"))
