"""The metrics with their default arguments, over a record table with every raw column.

The records are the line items. Their columns are mapped to the raw texts a registry export holds,
with the usual dirt: padding, mixed case, unknown words, dates of three lengths, repeated IDs.
"""

from __future__ import annotations

from functools import reduce

from catalog.common import (
    ODDS_ESTIMATES,
    registry_of,
    rounded,
    sql_any,
    sql_area,
    sql_cells,
    sql_gaps,
    sql_logit,
    sql_outcomes,
    sql_overall,
    sql_prevalence,
    sql_round,
    sql_signals,
    table,
)
from coverlens.functions import vocab
from coverlens.functions.labels import area_of
from coverlens.operators import charts, gaps, odds, outcomes, prevalence
from coverlens.operators.dedupe import first_wins
from coverlens.plans.normalize import normalize
from coverlens.plans.report import record_cells, report_tables
from coverlens.session import stored

QUERIES: dict = {}
ORACLES: dict = {}
register = registry_of(QUERIES)

# Valid in both SQL dialects: this is the input, not what is checked.
RAW = {
    "nct_id": "concat('REG', CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING))",
    "has_dmc": "CASE l_returnflag WHEN 'A' THEN ' True ' WHEN 'R' THEN 'false' ELSE 'unknown' END",
    "phase": """CASE WHEN l_tax > 0.075 THEN NULL WHEN l_linenumber = 1 THEN 'Phase 1' WHEN l_linenumber = 2 THEN 'Phase 1/Phase 2'
        WHEN l_linenumber = 3 THEN 'Phase 2' WHEN l_linenumber = 4 THEN 'Phase 2/Phase 3' WHEN l_linenumber = 5 THEN 'Phase 3'
        WHEN l_linenumber = 6 THEN 'Phase 4' ELSE 'N/A' END""",
    "study_type": """CASE WHEN l_quantity <= 30 THEN 'INTERVENTIONAL' WHEN l_quantity <= 45 THEN 'OBSERVATIONAL '
        ELSE 'EXPANDED_ACCESS' END""",
    "sponsor_class": """CASE WHEN l_discount < 0.035 THEN ' industry ' WHEN l_discount < 0.055 THEN 'NIH' WHEN l_discount < 0.065 THEN 'network'
        WHEN l_discount < 0.075 THEN 'ACADEMIC' WHEN l_discount < 0.095 THEN 'FED' END""",
    "overall_status": """CASE WHEN l_linestatus = 'O' THEN 'completed' WHEN month(l_shipdate) <= 4 THEN 'Terminated '
        WHEN month(l_shipdate) <= 8 THEN 'WITHDRAWN' ELSE ' suspended' END""",
    "why_stopped": """CASE WHEN l_linestatus = 'O' THEN NULL WHEN month(l_shipdate) = 1 THEN 'Serious Adverse events'
        WHEN month(l_shipdate) = 2 THEN 'Lack of Efficacy' WHEN month(l_shipdate) = 3 THEN 'Business decision'
        WHEN month(l_shipdate) = 4 THEN 'FUTILITY at interim' WHEN month(l_shipdate) = 5 THEN '' WHEN month(l_shipdate) = 6 THEN NULL
        WHEN month(l_shipdate) = 7 THEN 'Slow accrual' WHEN month(l_shipdate) = 8 THEN 'Michael left the site'
        WHEN month(l_shipdate) = 9 THEN 'No benefit; high risk' WHEN month(l_shipdate) = 10 THEN 'Toxicity'
        ELSE 'Funding' END""",
    "start_date": """CASE WHEN l_linenumber <= 3 THEN CAST(CAST(l_shipdate AS DATE) AS STRING)
        WHEN l_linenumber = 4 THEN concat(CAST(year(l_shipdate) AS STRING), '-', CAST(month(l_shipdate) AS STRING))
        WHEN l_linenumber = 5 THEN CAST(year(l_shipdate) AS STRING)
        WHEN l_linenumber = 6 THEN concat(CAST(year(l_shipdate) AS STRING), '-', CAST(month(l_shipdate) AS STRING),
                                          '-', CAST(day(l_shipdate) AS STRING))
        ELSE concat(CAST(CAST(l_shipdate AS DATE) AS STRING), 'T00:00') END""",
    "condition_text": """CASE WHEN l_quantity < 6 THEN 'lung cancer' WHEN l_quantity < 11 THEN 'diabetic heart disease'
        WHEN l_quantity < 15 THEN 'hiv infection' WHEN l_quantity < 19 THEN 'symptoms of flu' WHEN l_quantity < 22 THEN 'preterm delivery'
        WHEN l_quantity < 25 THEN 'major depression' WHEN l_quantity < 28 THEN 'thyroid nodule' WHEN l_quantity < 31 THEN 'mild asthma'
        WHEN l_quantity < 33 THEN 'rheumatic pain' WHEN l_quantity < 35 THEN 'skin rash' WHEN l_quantity < 37 THEN 'pregnancy'
        WHEN l_quantity < 39 THEN 'glaucoma' WHEN l_quantity < 41 THEN 'sickle cell' WHEN l_quantity < 42 THEN 'sma type 1'
        ELSE 'symptoms' END""",
}
FIRST_BY = ["l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice"]


def records(spark, sf):
    """The raw table, normalised; the earliest record of an ID counts."""
    raw = table(spark, sf, "lineitem").selectExpr(*[f"{sql} AS {name}" for name, sql in RAW.items()], *FIRST_BY)
    first = first_wins(raw, "nct_id", FIRST_BY)
    return normalize(first.withColumn("therapeutic_area", area_of("condition_text")))


_TYPES = "CASE WHEN l_quantity <= 30 THEN 'Interventional' WHEN l_quantity <= 45 THEN 'Observational' ELSE 'Expanded_Access' END"
_BUCKET = """CASE upper(trim(sponsor_class)) WHEN 'INDUSTRY' THEN 'Industry' WHEN 'NIH' THEN 'NIH' WHEN 'ACADEMIC' THEN 'Academic'
    WHEN 'NETWORK' THEN 'Academic' ELSE 'Other' END"""
_RAW = ", ".join(f"{sql} AS {name}" for name, sql in RAW.items())
RECORDS = f"""(SELECT nct_id, CASE lower(trim(has_dmc)) WHEN 'true' THEN true WHEN 'false' THEN false END AS has_dmc,
    phase, type_label AS study_type, upper(trim(sponsor_class)) AS sponsor_class, {_BUCKET} AS sponsor_bucket,
    upper(trim(overall_status)) AS overall_status, why_stopped, lower(why_stopped) AS why_stopped_text, start_date, start_year,
    {sql_area('condition_text')} AS therapeutic_area,
    coalesce(phase IN ('Phase 2/Phase 3', 'Phase 3'), false) AS is_phase3, coalesce(phase = 'Phase 4', false) AS is_phase4,
    coalesce(phase IN ('Phase 2/Phase 3', 'Phase 3', 'Phase 4'), false) AS is_phase34,
    coalesce(upper(trim(overall_status)) <> 'COMPLETED', false) AS is_terminated_like,
    coalesce(upper(trim(overall_status)) = 'COMPLETED', false) AS is_completed,
    coalesce(phase, 'N/A') AS phase_label, coalesce(phase, 'N/A') = 'N/A' AS phase_is_na
  FROM (SELECT {_RAW}, {_TYPES} AS type_label, CASE WHEN l_linenumber <= 6 THEN year(l_shipdate)::INT END AS start_year,
               {', '.join(FIRST_BY)}
        FROM lineitem)
  QUALIFY row_number() OVER (PARTITION BY nct_id ORDER BY {', '.join(FIRST_BY)}) = 1)"""


@register
def registry_normalized(spark, sf):
    return records(spark, sf).drop("condition_text", *FIRST_BY)


ORACLES["registry_normalized"] = f"FROM {RECORDS}"

QUERIES["registry_prevalence_overall"] = lambda spark, sf: prevalence.prevalence_overall(records(spark, sf))
ORACLES["registry_prevalence_overall"] = sql_overall(RECORDS, "has_dmc")


def _by(column):
    return lambda spark, sf: prevalence.prevalence_by(records(spark, sf), column)


for _name, _dim in {
    "phase": "phase",
    "sponsor": "sponsor_bucket",
    "study_type": "study_type",
    "area": "therapeutic_area",
}.items():
    QUERIES[f"registry_prevalence_by_{_name}"] = _by(_dim)
    ORACLES[f"registry_prevalence_by_{_name}"] = sql_prevalence(RECORDS, _dim, "has_dmc")

QUERIES["registry_gaps"] = lambda spark, sf: gaps.cohort_gaps(records(spark, sf))
ORACLES["registry_gaps"] = sql_gaps(
    RECORDS,
    "is_phase34 AND study_type = 'Interventional' AND sponsor_bucket = 'Industry'",
    "therapeutic_area",
    {None: vocab.COHORT_ALL, **{a: a + vocab.COHORT_SUFFIX for a in vocab.HIGH_RISK_AREAS}},
    "has_dmc",
    "dmc",
)

QUERIES["registry_outcomes"] = lambda spark, sf: outcomes.outcomes_by_flag(records(spark, sf))
ORACLES["registry_outcomes"] = sql_outcomes(RECORDS, "is_terminated_like", "is_completed", "nct_id", "has_dmc")

_HITS = {
    "safety": sql_any("why_stopped_text", vocab.SAFETY_KEYS),
    "futility": sql_any("why_stopped_text", vocab.FUTILITY_KEYS),
}
QUERIES["registry_why_stopped"] = lambda spark, sf: outcomes.keyword_signals_by_flag(records(spark, sf))
ORACLES["registry_why_stopped"] = sql_signals(
    f"(FROM {RECORDS} WHERE length(why_stopped) > 0)", _HITS, "nct_id", "has_dmc"
)
QUERIES["registry_why_stopped_all"] = lambda spark, sf: outcomes.keyword_signals_by_flag(
    records(spark, sf), denominator="all_rows"
)
ORACLES["registry_why_stopped_all"] = sql_signals(RECORDS, _HITS, "nct_id", "has_dmc")

_TOP = (
    f"SELECT therapeutic_area FROM {RECORDS} GROUP BY 1 ORDER BY count(*) DESC, therapeutic_area LIMIT {vocab.TOP_AREAS}"
)
QUERIES["registry_heatmap"] = lambda spark, sf: charts.heatmap_cells(records(spark, sf))
ORACLES["registry_heatmap"] = sql_cells(
    f"(FROM {RECORDS} WHERE therapeutic_area IN ({_TOP}))", "sponsor_bucket, therapeutic_area", "has_dmc", "nct_id"
)

QUERIES["registry_trend_by_sponsor"] = lambda spark, sf: charts.yearly_trend(records(spark, sf))
ORACLES["registry_trend_by_sponsor"] = sql_cells(
    f"(FROM {RECORDS} WHERE start_year IS NOT NULL)", "start_year, sponsor_bucket", "has_dmc", "nct_id"
)

QUERIES["registry_trend_by_phase"] = lambda spark, sf: charts.phase_trend(records(spark, sf))
ORACLES["registry_trend_by_phase"] = sql_cells(
    f"(FROM {RECORDS} WHERE start_year IS NOT NULL AND NOT phase_is_na)", "start_year, phase_label", "has_dmc", "nct_id"
)


@register
def registry_adjusted_odds(spark, sf):
    """Termination without the flag, adjusted for phase and sponsor."""
    labelled = records(spark, sf).select("phase_label", "sponsor_bucket", "has_dmc", "is_terminated_like")
    return rounded(odds.adjusted_odds(labelled, ["phase_label", "sponsor_bucket"]), ODDS_ESTIMATES)


ORACLES["registry_adjusted_odds"] = sql_logit(
    RECORDS,
    "phase_label",
    "phase_label",
    "has_dmc",
    "is_terminated_like",
    {f"sponsor_bucket={b}": f"sponsor_bucket = '{b}'" for b in ("Industry", "NIH", "Other")},
)


# Each report table reduced to: label, whole, part, percentage.
_LONG = {
    "metric_prevalence_overall": ("'all'", "total_trials", "with_dmc", "with_dmc_pct"),
    "metric_prevalence_by_phase": ("phase", "total", "with_dmc", "with_dmc_pct"),
    "metric_prevalence_by_sponsor": ("sponsor_bucket", "total", "with_dmc", "with_dmc_pct"),
    "metric_prevalence_by_studytype": ("study_type", "total", "with_dmc", "with_dmc_pct"),
    "metric_prevalence_by_therapeutic_area": ("therapeutic_area", "total", "with_dmc", "with_dmc_pct"),
    "metric_oversight_gaps_phase34_industry_interventional": ("subgroup", "total", "without_dmc", "without_dmc_pct"),
    "metric_outcomes_by_dmc": ("has_dmc_label", "total", "terminated_like", "terminated_like_pct"),
    "metric_whystopped_by_dmc": ("has_dmc_label", "n_with_text", "futility_hits", "safety_rate_pct"),
    "chart_heatmap_sponsor_area": ("concat(sponsor_bucket, '/', therapeutic_area)", "total", "with_dmc", "with_dmc_pct"),
    "chart_trend_by_sponsor": ("concat(sponsor_bucket, '/', start_year)", "total", "with_dmc", "with_dmc_pct"),
    "chart_trend_by_phase": ("concat(phase_label, '/', start_year)", "total", "with_dmc", "with_dmc_pct"),
}
_SOURCES = {
    "metric_prevalence_overall": "registry_prevalence_overall",
    "metric_prevalence_by_phase": "registry_prevalence_by_phase",
    "metric_prevalence_by_sponsor": "registry_prevalence_by_sponsor",
    "metric_prevalence_by_studytype": "registry_prevalence_by_study_type",
    "metric_prevalence_by_therapeutic_area": "registry_prevalence_by_area",
    "metric_oversight_gaps_phase34_industry_interventional": "registry_gaps",
    "metric_outcomes_by_dmc": "registry_outcomes",
    "metric_whystopped_by_dmc": "registry_why_stopped",
    "chart_heatmap_sponsor_area": "registry_heatmap",
    "chart_trend_by_sponsor": "registry_trend_by_sponsor",
    "chart_trend_by_phase": "registry_trend_by_phase",
}


def _long(name, label, whole, part, pct):
    return [f"'{name}' AS table_name", f"{label} AS label", f"{whole} AS whole", f"{part} AS part", f"{pct} AS pct"]


@register
def registry_report(spark, sf):
    """Every table of the report from one pass over the records, stacked."""
    tables = report_tables(stored(record_cells(records(spark, sf)), "cells"))
    return reduce(
        lambda a, b: a.unionByName(b), [tables[name].selectExpr(*_long(name, *columns)) for name, columns in _LONG.items()]
    )


ORACLES["registry_report"] = " UNION ALL ".join(
    f"SELECT {', '.join(_long(name, *columns))} FROM ({ORACLES[_SOURCES[name]]})" for name, columns in _LONG.items()
)


# Every number of the report. Counts and percentages alike become doubles.
_CROSS = {
    "without_yes": "NOT coalesce(has_dmc, false) AND coalesce(is_terminated_like, false)",
    "without_no": "NOT coalesce(has_dmc, false) AND NOT coalesce(is_terminated_like, false)",
    "with_yes": "coalesce(has_dmc, false) AND coalesce(is_terminated_like, false)",
    "with_no": "coalesce(has_dmc, false) AND NOT coalesce(is_terminated_like, false)",
}
_RATIO = ["odds_ratio", "ci_low", "ci_high"]
_NUMBERS = {
    "metric_prevalence_overall": "total_trials with_dmc without_dmc with_dmc_pct",
    **{name: "total with_dmc without_dmc with_dmc_pct" for name in _LONG if name.startswith("metric_prevalence_by_")},
    "metric_oversight_gaps_phase34_industry_interventional": "total without_dmc without_dmc_pct",
    "metric_outcomes_by_dmc": "total terminated_like completed terminated_like_pct",
    "metric_whystopped_by_dmc": "n_with_text safety_hits futility_hits safety_rate_pct futility_rate_pct",
    **{name: "total with_dmc with_dmc_pct" for name in _LONG if name.startswith("chart_")},
    "model_crude_odds": " ".join([*_CROSS, *_RATIO]),
}


def _numbers(name):
    label = _LONG[name][0] if name in _LONG else "'all'"
    return [f"'{name}' AS table_name", f"{label} AS label", *(f"CAST({n} AS DOUBLE) AS {n}" for n in _NUMBERS[name].split())]


@register
def registry_report_numbers(spark, sf):
    """All twelve tables of the one-pass report with all their numbers: table, label, measure, value; nulls left out."""
    tables = report_tables(stored(record_cells(records(spark, sf)), "cells"))
    assert set(tables) == set(_NUMBERS), "a table of the report is not compared"
    tables["model_crude_odds"] = rounded(tables["model_crude_odds"], _RATIO)
    long = [
        tables[name].selectExpr(*_numbers(name)).unpivot(["table_name", "label"], _NUMBERS[name].split(), "measure", "value")
        for name in _NUMBERS
    ]
    return reduce(lambda a, b: a.unionByName(b), long).where("value IS NOT NULL")


_LOG = "(ln(without_yes / without_no) - ln(with_yes / with_no))"
_SE = "sqrt(1 / without_yes + 1 / without_no + 1 / with_yes + 1 / with_no)"
_CRUDE = (
    "SELECT *, "
    + ", ".join(f"{sql_round(f'exp({_LOG} + {z} * {_SE})', 1_000_000)} AS {name}" for name, z in zip(_RATIO, (0.0, -odds.Z95, odds.Z95)))
    + f" FROM (SELECT {', '.join(f'count(*) FILTER (WHERE {inside}) AS {name}' for name, inside in _CROSS.items())} FROM {RECORDS})"
)
ORACLES["registry_report_numbers"] = "SELECT table_name, label, measure, value FROM (" + " UNION ALL ".join(
    f"SELECT table_name, label, measure, value FROM (UNPIVOT (SELECT {', '.join(_numbers(name))} FROM ({ORACLES[_SOURCES[name]] if name in _SOURCES else _CRUDE})) "
    f"ON {', '.join(_NUMBERS[name].split())} INTO NAME measure VALUE value)"
    for name in _NUMBERS
) + ")"
