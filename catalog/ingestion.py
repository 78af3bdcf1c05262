"""De-duplication, seen IDs, landed pages, CSV and the incremental stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.common import registry_of, table
from coverlens.operators import dedupe
from coverlens.plans.ingest import ingest, ingest_run
from coverlens.session import shared_path
from coverlens.sources.seen import SeenIds
from coverlens.sources.tidy import read_tidy, read_tidy_csv, write_tidy_csv
from coverlens.streaming.incremental import run_incremental

QUERIES: dict = {}
ORACLES: dict = {}
register = registry_of(QUERIES)


@register
def first_wins(spark, sf):
    """First event of each user."""
    return dedupe.first_wins(table(spark, sf, "events").drop("ts"), "user_id", ["event_id"])


ORACLES["first_wins"] = """
SELECT event_id, user_id, event_type, value, props FROM events
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1
"""


@register
def unseen_only(spark, sf):
    """Customers whose first order falls into the second crawl, with that order."""
    orders = table(spark, sf, "orders")
    seen = orders.where("o_orderdate < '1995-06-01'")
    later = dedupe.first_wins(orders.where("o_orderdate >= '1995-06-01'"), "o_custkey", ["o_orderkey"])
    return dedupe.unseen_only(later, seen, "o_custkey").drop("o_orderdate")


ORACLES["unseen_only"] = """
SELECT * EXCLUDE (o_orderdate) FROM (
  SELECT * FROM orders WHERE o_orderdate >= '1995-06-01'
  QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1) later
WHERE NOT EXISTS (SELECT 1 FROM orders seen WHERE seen.o_custkey = later.o_custkey AND seen.o_orderdate < '1995-06-01')
"""


@register
def merged_ids(spark, sf):
    orders = table(spark, sf, "orders")
    return dedupe.merged_ids(orders.where("o_orderstatus = 'F'"), orders.where("o_orderstatus = 'O'"), "o_custkey")


ORACLES["merged_ids"] = (
    "SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' UNION SELECT o_custkey FROM orders WHERE o_orderstatus = 'O'"
)


@register
def seen_union(spark, sf):
    """IDs of two runs, kept in a seen-ID folder; the state before the reset no longer counts."""
    orders = table(spark, sf, "orders").select(F.concat(F.lit(" C"), "o_custkey").alias("id"), "o_orderstatus")
    seen = SeenIds(spark, shared_path(spark, "seen"), key="id")
    seen.add(orders.where("o_orderstatus = 'P'"))
    seen.reset()
    seen.add(orders.where("o_orderstatus = 'F'"))
    seen.add(orders.where("o_orderstatus = 'O'"))
    return seen.load()


ORACLES["seen_union"] = "SELECT DISTINCT 'C' || o_custkey AS id FROM orders WHERE o_orderstatus IN ('F', 'O')"

# --- landed pages: every order is a page with two studies, one named after the customer, one after the day

WINDOW = {"start_from": "1996-01-01", "start_to": "2000-09-15"}
_TEXT_DATE = """CASE o_orderpriority
    WHEN '1-URGENT' THEN CAST(CAST(o_orderdate AS DATE) AS STRING)
    WHEN '2-HIGH' THEN concat(CAST(year(o_orderdate) AS STRING), '-', CAST(month(o_orderdate) AS STRING))
    WHEN '3-MEDIUM' THEN CAST(year(o_orderdate) AS STRING)
    WHEN '4-NOT SPECIFIED' THEN concat(CAST(year(o_orderdate) AS STRING), '-', CAST(month(o_orderdate) AS STRING),
                                       '-', CAST(day(o_orderdate) AS STRING))
    ELSE concat(CAST(CAST(o_orderdate AS DATE) AS STRING), 'T00:00') END"""
_STATUS = """CASE WHEN o_totalprice < 50000 THEN 'Recruiting' WHEN o_totalprice > 490000 THEN NULL
    WHEN o_orderstatus = 'F' THEN 'terminated' WHEN o_orderstatus = 'O' THEN 'COMPLETED' ELSE 'Withdrawn' END"""
_TYPE = "CASE WHEN o_totalprice > 200000 THEN 'INTERVENTIONAL' ELSE 'OBSERVATIONAL' END"
_CLASS = "CASE WHEN o_totalprice > 300000 THEN 'INDUSTRY' WHEN o_totalprice > 100000 THEN 'NIH' END"
_REASON = "CASE WHEN o_orderstatus = 'F' THEN 'He said \"no\",\nand left' END"
_CUSTOMER_ID = "concat('C', CAST(o_custkey AS STRING))"
_DAY_ID = "CASE WHEN o_orderstatus = 'P' THEN '' ELSE concat('D', CAST(CAST(o_orderdate AS DATE) AS STRING)) END"

# Loosely typed fields, as the JSON that arrives and as what must become of it.
_FLAG_JSON = "CASE o_orderstatus WHEN 'F' THEN 'true' WHEN 'O' THEN '\"false\"' ELSE 'null' END"
_FLAG = "CASE o_orderstatus WHEN 'F' THEN true WHEN 'O' THEN false END"
_PHASES_JSON = """CASE o_orderpriority WHEN '1-URGENT' THEN '["PHASE2","PHASE1","PHASE1"]' WHEN '2-HIGH' THEN '"PHASE3"'
    WHEN '3-MEDIUM' THEN '["NA"]' WHEN '4-NOT SPECIFIED' THEN '[]' ELSE 'null' END"""
_PHASE = """CASE o_orderpriority WHEN '1-URGENT' THEN 'Phase 1/Phase 2' WHEN '2-HIGH' THEN 'Phase 3'
    WHEN '3-MEDIUM' THEN 'N/A' END"""
_CONDITIONS_JSON = """CASE o_orderstatus WHEN 'F' THEN '["Symptoms",null]' WHEN 'O' THEN '"Heart failure"' ELSE '[]' END"""
_CONDITIONS = """CASE o_orderstatus WHEN 'F' THEN 'Symptoms|~' WHEN 'O' THEN 'Heart failure' ELSE '' END"""
_AREA = "CASE o_orderstatus WHEN 'F' THEN 'Neurology' WHEN 'O' THEN 'Cardiovascular' ELSE 'Other/Unclassified' END"


def _study(key):
    return f"""named_struct('protocolSection', named_struct(
        'identificationModule', named_struct('nctId', {key}),
        'oversightModule', named_struct('oversightHasDmc', parse_json({_FLAG_JSON})),
        'designModule', named_struct('studyType', {_TYPE}, 'phases', parse_json({_PHASES_JSON})),
        'sponsorCollaboratorsModule', named_struct('leadSponsor', named_struct('class', {_CLASS})),
        'statusModule', named_struct('overallStatus', {_STATUS}, 'whyStopped', {_REASON},
            'startDateStruct', named_struct('date', {_TEXT_DATE}),
            'primaryCompletionDateStruct', named_struct('date', CAST(year(o_orderdate) AS STRING))),
        'conditionsModule', named_struct('conditions', parse_json({_CONDITIONS_JSON}))))"""


def land_pages(orders, folder, before="CAST(NULL AS STRING)"):
    """Writes one JSON page per order and line; ``before`` is SQL for the JSON of one more study, put first, or null."""
    studies = f"array({_study(_CUSTOMER_ID)}, {_study(_DAY_ID)})"
    pages = orders.selectExpr(f"to_json(struct(o_orderkey AS pageNo, {studies} AS studies)) AS page", f"{before} AS before")
    # Quotes inside of texts are escaped, so this names the array alone.
    opening = "'\"studies\":['"
    pages.selectExpr(f"replace(page, {opening}, concat({opening}, coalesce(before || ',', ''))) AS value").write.mode("append").text(folder)


def _comparable(tidy):
    return tidy.withColumn("conditions", F.array_join("conditions", "|", "~"))


_STUDIES = f"""
SELECT id AS nct_id, {_FLAG} AS has_dmc, {_PHASE} AS phase, {_TYPE} AS study_type, {_CLASS} AS sponsor_class,
       upper({_STATUS}) AS overall_status, {_REASON} AS why_stopped, {_TEXT_DATE} AS start_date,
       CAST(year(o_orderdate) AS STRING) AS primary_completion_date, {_CONDITIONS} AS conditions,
       {_AREA} AS therapeutic_area, year(start_day)::INT AS start_year, o_orderdate, o_orderkey, pos
FROM (
  SELECT *, CASE WHEN o_orderpriority IN ('1-URGENT', '4-NOT SPECIFIED') THEN o_orderdate::DATE
                 WHEN o_orderpriority = '2-HIGH' THEN date_trunc('month', o_orderdate)::DATE
                 WHEN o_orderpriority = '3-MEDIUM' THEN date_trunc('year', o_orderdate)::DATE END AS start_day
  FROM (SELECT *, {_CUSTOMER_ID} AS id, 0 AS pos FROM orders UNION ALL SELECT *, {_DAY_ID} AS id, 1 AS pos FROM orders))
WHERE id <> '' AND start_day BETWEEN DATE '{WINDOW["start_from"]}' AND DATE '{WINDOW["start_to"]}'
  AND upper({_STATUS}) IN ('COMPLETED', 'TERMINATED', 'WITHDRAWN', 'SUSPENDED')
"""
_HELPERS = "o_orderdate, o_orderkey, pos"


@register
def page_ingest(spark, sf):
    """All orders as landed pages, read, filtered and de-duplicated; days that had an order in 1996 are seen."""
    folder = shared_path(spark, "pages")
    orders = table(spark, sf, "orders")
    land_pages(orders, folder)
    seen = orders.where("year(o_orderdate) = 1996").select(F.expr(_DAY_ID).alias("nct_id"))
    return _comparable(ingest(spark, folder, seen=seen, multi_line=False, **WINDOW))


ORACLES["page_ingest"] = f"""
SELECT * EXCLUDE ({_HELPERS}) FROM (
  SELECT * FROM ({_STUDIES}) QUALIFY row_number() OVER (PARTITION BY nct_id ORDER BY o_orderkey, pos) = 1)
WHERE nct_id NOT IN (SELECT {_DAY_ID} FROM orders WHERE year(o_orderdate) = 1996)
"""


# Every page has one study too many, which has a text or a list where an object belongs; none for every third order.
_BAD_STUDY = """CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CASE o_orderkey % 5
    WHEN 0 THEN '"no study"' WHEN 1 THEN '{"protocolSection":[1]}'
    WHEN 2 THEN '{"protocolSection":{"identificationModule":{"nctId":"X1"},"statusModule":"done"}}'
    WHEN 3 THEN '{"protocolSection":{"identificationModule":{"nctId":["X2"]},"statusModule":{"startDateStruct":2}}}'
    ELSE '{"protocolSection":{"identificationModule":"X3","designModule":7}}' END END"""
_FAULTS = """CASE o_orderkey % 5 WHEN 0 THEN 'study' WHEN 1 THEN 'protocolSection' WHEN 2 THEN 'protocolSection.statusModule'
    WHEN 3 THEN 'protocolSection.statusModule.startDateStruct|protocolSection.identificationModule.nctId'
    ELSE 'protocolSection.identificationModule|protocolSection.designModule' END"""


@register
def study_rejects(spark, sf):
    """Rejected studies by order, and the studies beside them, all of which are ingested."""
    folder, rejects = shared_path(spark, "pages"), shared_path(spark, "rejects")
    land_pages(table(spark, sf, "orders"), folder, before=_BAD_STUDY)
    kept = ingest(spark, folder, multi_line=False, rejects=rejects, **WINDOW)
    bad = spark.read.parquet(rejects).select(
        "page_no", F.col("pos").cast("bigint").alias("pos"), F.array_join("faults", "|").alias("what")
    )
    whole = kept.select(F.lit(None).cast("bigint").alias("page_no"), F.lit(None).cast("bigint").alias("pos"), F.col("nct_id").alias("what"))
    return bad.unionByName(whole)


ORACLES["study_rejects"] = f"""
SELECT o_orderkey AS page_no, 0::BIGINT AS pos, {_FAULTS} AS what FROM orders WHERE o_orderkey % 3 <> 0
UNION ALL SELECT DISTINCT NULL::BIGINT, NULL::BIGINT, nct_id FROM ({_STUDIES})
"""


@register
def incremental_ingest(spark, sf):
    """Orders land in three drops by year; the stream is restarted after each and emits new studies only."""
    folder, out, checkpoint = (shared_path(spark, name) for name in ("landing", "ingested", "progress"))
    orders = table(spark, sf, "orders")
    for drop in ("year(o_orderdate) < 1997", "year(o_orderdate) IN (1997, 1998)", "year(o_orderdate) > 1998"):
        land_pages(orders.where(drop), folder)
        emitted = run_incremental(spark, folder, out, checkpoint, multi_line=False, **WINDOW)
    return _comparable(emitted)


_DROP = "CASE WHEN year(o_orderdate) < 1997 THEN 0 WHEN year(o_orderdate) <= 1998 THEN 1 ELSE 2 END"
ORACLES["incremental_ingest"] = f"""
SELECT * EXCLUDE ({_HELPERS}), ({_DROP})::BIGINT AS batch_id FROM ({_STUDIES})
QUALIFY row_number() OVER (PARTITION BY nct_id ORDER BY {_DROP}, o_orderkey, pos) = 1
"""


@register
def restarted_ingest(spark, sf):
    """The same drops; after the first, the stream starts anew with another checkpoint and sees all pages again."""
    folder, out, *checkpoints = (shared_path(spark, name) for name in ("landing", "ingested", "progress", "progress"))
    orders = table(spark, sf, "orders")
    for drop, checkpoint in zip(("year(o_orderdate) < 1997", "year(o_orderdate) >= 1997"), checkpoints):
        land_pages(orders.where(drop), folder)
        emitted = run_incremental(spark, folder, out, checkpoint, multi_line=False, **WINDOW)
    return _comparable(emitted.drop("batch_id"))


ORACLES["restarted_ingest"] = f"""
SELECT * EXCLUDE ({_HELPERS}) FROM ({_STUDIES})
QUALIFY row_number() OVER (PARTITION BY nct_id ORDER BY year(o_orderdate) >= 1997, o_orderkey, pos) = 1
"""


@register
def page_cap(spark, sf):
    """The first pages of a crawl; one page in ten cannot be read and goes to the rejects.

    Pages are landed once, the readable ones apart: an unreadable page has no number and could not be capped."""
    folder, rejects = shared_path(spark, "pages"), shared_path(spark, "rejects")
    good, broken = f"{folder}/crawl=readable", f"{folder}/crawl=broken"
    orders = table(spark, sf, "orders")
    land_pages(orders.where("o_orderkey % 10 <> 3"), good)
    orders.where("o_orderkey % 10 = 3").selectExpr("concat('{\"pageNo\": ', o_orderkey, ', \"studies\": [ {bad') AS value").write.mode("append").text(broken)
    whole = ingest(spark, folder, multi_line=False, rejects=rejects, **WINDOW)
    capped = ingest(spark, good, max_pages=5000, multi_line=False, **WINDOW)
    counted = [df.agg(F.lit(what).alias("what"), F.count("*").alias("n")) for df, what in ((whole, "whole"), (capped, "capped"), (spark.read.parquet(rejects), "unreadable"))]
    return counted[0].unionByName(counted[1]).unionByName(counted[2])


ORACLES["page_cap"] = f"""
SELECT 'whole' AS what, count(DISTINCT nct_id) AS n FROM ({_STUDIES}) WHERE o_orderkey % 10 <> 3
UNION ALL SELECT 'capped', count(DISTINCT nct_id) FROM ({_STUDIES}) WHERE o_orderkey % 10 <> 3 AND o_orderkey <= 5000
UNION ALL SELECT 'unreadable', count(*) FROM orders WHERE o_orderkey % 10 = 3
"""


@register
def page_cap_rows(spark, sf):
    """The rows of the first 5,000 pages of a crawl."""
    land_pages(table(spark, sf, "orders"), folder := shared_path(spark, "pages"))
    return _comparable(ingest(spark, folder, max_pages=5000, multi_line=False, **WINDOW))


ORACLES["page_cap_rows"] = f"""
SELECT * EXCLUDE ({_HELPERS}) FROM ({_STUDIES}) WHERE o_orderkey <= 5000
QUALIFY row_number() OVER (PARTITION BY nct_id ORDER BY o_orderkey, pos) = 1
"""


@register
def repeated_runs(spark, sf):
    """Two batch runs over a growing folder; the second reads all pages and adds the studies not emitted before."""
    folder, out, state = (shared_path(spark, name) for name in ("landing", "runs", "seen"))
    orders, seen, runs = table(spark, sf, "orders"), SeenIds(spark, state), []
    for run, drop in enumerate(("year(o_orderdate) < 1998", "year(o_orderdate) >= 1998"), start=1):
        land_pages(orders.where(drop), folder)
        emitted = ingest_run(spark, folder, out, seen, run, multi_line=False, **WINDOW)
        runs.append(_comparable(emitted).withColumn("run", F.lit(run)))
    return runs[0].unionByName(runs[1])


_RUN = "CASE WHEN year(o_orderdate) < 1998 THEN 1 ELSE 2 END"
ORACLES["repeated_runs"] = f"""
SELECT * EXCLUDE ({_HELPERS}), ({_RUN})::INT AS run FROM ({_STUDIES})
QUALIFY row_number() OVER (PARTITION BY nct_id ORDER BY {_RUN}, o_orderkey, pos) = 1
"""


@register
def tidy_csv(spark, sf):
    """Documents as a tidy table with whole texts as stop reasons, to CSV and back."""
    folder = shared_path(spark, "tidy-csv")
    docs = table(spark, sf, "documents").select(
        F.concat(F.lit("D"), "doc_id").alias("nct_id"),
        F.when(F.col("lang") != "es", F.col("n_chars") > 500).alias("has_dmc"),
        F.expr("CASE lang WHEN 'en' THEN 'N/A' WHEN 'fr' THEN 'Phase 2' END").alias("phase"),
        F.col("source").alias("study_type"),
        F.lit("None").alias("sponsor_class"),
        F.lit("COMPLETED").alias("overall_status"),
        F.col("text").alias("why_stopped"),
        F.lit("2010-05").alias("start_date"),
        F.lit(None).cast("string").alias("primary_completion_date"),
        F.array("lang", F.concat(F.lit('"'), "source", F.lit('", it\'s'))).alias("conditions"),
        F.lit("Other/Unclassified").alias("therapeutic_area"),
        F.when(F.col("lang") == "en", 2010).alias("start_year"),
    )
    write_tidy_csv(docs, folder)
    return _comparable(read_tidy_csv(spark, folder).drop("csv_file", "csv_block", "csv_row"))


ORACLES["tidy_csv"] = """
SELECT 'D' || doc_id AS nct_id, CASE WHEN lang <> 'es' THEN n_chars > 500 END AS has_dmc,
       CASE lang WHEN 'fr' THEN 'Phase 2' END AS phase, source AS study_type, NULL::VARCHAR AS sponsor_class,
       'COMPLETED' AS overall_status, text AS why_stopped, '2010-05' AS start_date,
       NULL::VARCHAR AS primary_completion_date, lang || '|"' || source || '", it''s' AS conditions,
       'Other/Unclassified' AS therapeutic_area, CASE lang WHEN 'en' THEN 2010 END::INT AS start_year
FROM documents
"""


@register
def tidy_csv_reordered(spark, sf):
    """Columns of a CSV in another order, optional ones absent: found by name, defaults for the rest."""
    folder = shared_path(spark, "tidy-csv")
    docs = table(spark, sf, "documents").select(
        F.lit("NIH").alias("sponsor_class"),
        F.when(F.col("lang") != "es", F.col("n_chars") > 500).cast("string").alias("has_dmc"),
        F.lit("COMPLETED").alias("overall_status"),
        F.col("source").alias("study_type"),
        F.concat(F.lit("D"), "doc_id").alias("nct_id"),
        F.lit("Phase 2").alias("phase"),
    )
    docs.write.option("header", True).csv(folder)
    return _comparable(read_tidy_csv(spark, folder).drop("csv_file", "csv_block", "csv_row"))


@register
def tidy_defaults(spark, sf):
    """The same from Parquet."""
    folder = shared_path(spark, "tidy")
    docs = table(spark, sf, "documents").selectExpr(
        "'NIH' AS sponsor_class", "CASE WHEN lang <> 'es' THEN n_chars > 500 END AS has_dmc", "'COMPLETED' AS overall_status",
        "source AS study_type", "concat('D', doc_id) AS nct_id", "'Phase 2' AS phase",
    )
    docs.write.parquet(folder)
    return _comparable(read_tidy(spark, folder))


ORACLES["tidy_csv_reordered"] = ORACLES["tidy_defaults"] = """
SELECT 'D' || doc_id AS nct_id, CASE WHEN lang <> 'es' THEN n_chars > 500 END AS has_dmc, 'Phase 2' AS phase,
       source AS study_type, 'NIH' AS sponsor_class, 'COMPLETED' AS overall_status, NULL::VARCHAR AS why_stopped,
       NULL::VARCHAR AS start_date, NULL::VARCHAR AS primary_completion_date, NULL::VARCHAR AS conditions,
       'Other/Unclassified' AS therapeutic_area, NULL::INT AS start_year
FROM documents
"""
