"""Shapes of physical plans that matter at scale."""

import pytest
from pyspark.sql import functions as F

from coverlens import schema
from coverlens.functions.labels import area_of, has_status, in_statuses
from coverlens.functions.text import joined_lower
from coverlens.operators import charts, dedupe, prevalence
from coverlens.operators.classify import classified
from coverlens.plans.normalize import normalize
from coverlens.plans.report import record_cells
from coverlens.sources.tidy import read_tidy, write_tidy


@pytest.fixture(scope="module")
def tidy_path(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tidy") / "t")
    write_tidy(spark.createDataFrame([("N1", True, *["x"] * 7, ["a"], "Oncology", 2012)], schema.TIDY), path)
    return path


@pytest.fixture()
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def shuffles(df):
    return plan(df).count("Exchange hashpartitioning")


def test_status_filter_reaches_the_scan(spark, tidy_path):
    df = read_tidy(spark, tidy_path).where(has_status("overall_status", ["completed", "Terminated"])).select("nct_id")
    assert "PushedFilters: [In(overall_status" in plan(df)
    assert "ReadSchema: struct<nct_id:string,overall_status:string>" in plan(df)


def test_metrics_read_only_their_columns(spark, tidy_path):
    df = prevalence.prevalence_by(normalize(read_tidy(spark, tidy_path)), "study_type")
    assert "ReadSchema: struct<has_dmc:boolean,study_type:string>" in plan(df)
    assert shuffles(df) == 1


def test_counts_are_combined_before_the_shuffle(spark, tidy_path):
    tables = [prevalence.prevalence_by(read_tidy(spark, tidy_path), "phase"), record_cells(normalize(read_tidy(spark, tidy_path)))]
    for df in tables:
        assert "partial_count" in plan(df) and shuffles(df) == 1


def test_sets_expand_counts_not_records(spark, tidy_path):
    lines = plan(prevalence.prevalence_sets(read_tidy(spark, tidy_path), ["phase", "study_type"])).splitlines()
    expand = next(i for i, line in enumerate(lines) if "Expand" in line)
    assert "Union" in lines[expand + 1] and "HashAggregate" in lines[expand + 2]


def test_hot_keys_are_cut_before_the_shuffle(spark, tidy_path):
    lines = plan(dedupe.first_wins(read_tidy(spark, tidy_path), "nct_id", ["start_date"])).splitlines()
    exchange = next(i for i, line in enumerate(lines) if "Exchange hashpartitioning(nct_id" in line)
    assert "WindowGroupLimit" in lines[exchange + 1] and "Partial" in lines[exchange + 1]


def test_anti_join_reuses_the_partitioning(spark, tidy_path, no_broadcast):
    df = read_tidy(spark, tidy_path)
    fresh = dedupe.unseen_only(dedupe.first_wins(df, "nct_id", ["start_date"]), df.select("nct_id"))
    assert "SortMergeJoin" in plan(fresh) or "ShuffledHashJoin" in plan(fresh)
    assert shuffles(fresh) == 2  # the records once, the seen IDs once


def test_small_batch_does_not_shuffle_the_seen_ids(spark, tidy_path):
    batch, seen = read_tidy(spark, tidy_path), read_tidy(spark, tidy_path)
    assert shuffles(dedupe.unseen_in_small_batch(batch, seen)) == 0


def test_top_list_join_is_left_to_the_session(spark, tidy_path, no_broadcast):
    df = read_tidy(spark, tidy_path)
    assert "BroadcastHashJoin" not in plan(charts.in_top_categories(df, "phase", 12))


def test_no_python_in_the_row_path(spark, tidy_path):
    df = normalize(read_tidy(spark, tidy_path)).withColumns(
        {"area": area_of(joined_lower("conditions")), "keep": in_statuses("overall_status", ["x"])}
    )
    assert "Python" not in plan(df) and "Exchange" not in plan(df)


def test_long_texts_are_classified_in_compiled_code(spark, tmp_path):
    """The text is lower-cased and split once, below the rules; no lambda and no Python."""
    spark.createDataFrame([("Heart",)], "text string").write.parquet(str(tmp_path / "t"))
    df = classified(spark.read.parquet(str(tmp_path / "t")), F.lower("text"), "area")
    shown = plan(df)
    assert "transform(array(lower" not in shown and "lambda" not in shown and "Python" not in shown
    assert shown.count("lower(text") == 1 and shown.count("array_distinct") == 1 and shuffles(df) == 0
