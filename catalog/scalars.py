"""Column expressions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.common import registry_of, table
from coverlens.functions import dates, labels, nested, text, vocab
from coverlens.functions.measures import percent, round2

QUERIES: dict = {}
ORACLES: dict = {}
register = registry_of(QUERIES)


@register
def nested_get(spark, sf):
    """A path that exists, two that do not; records without a value are dropped."""
    events = table(spark, sf, "events").select(
        "event_id",
        nested.json_path("props", "k").alias("k"),
        nested.json_path("props", "k.deeper").alias("deeper"),
        nested.json_path("props", "absent.x").alias("absent"),
    )
    return events.where("k <> ''")


ORACLES["nested_get"] = """
SELECT event_id, json_extract_string(props, '$.k') AS k, json_extract_string(props, '$.k.deeper') AS deeper,
       json_extract_string(props, '$.absent.x') AS absent
FROM events WHERE json_extract_string(props, '$.k') <> ''
"""


@register
def list_coerce(spark, sf):
    """User turns as one JSON string, assistant turns as a list, system turns as null."""
    one = F.to_json(F.array("text"))
    given = (
        F.when(F.col("role") == "user", F.regexp_replace(one, r"^\[|\]\z", ""))
        .when(F.col("role") == "assistant", F.to_json(F.array("text", F.lit(None), "role"), {"ignoreNullFields": "false"}))
        .otherwise("null")
    )
    turns = table(spark, sf, "conversations").select("conv_id", "turn", nested.json_list(given).alias("items"))
    return turns.select(
        "conv_id", "turn", F.size("items").cast("bigint").alias("n_items"), text.joined_lower("items").alias("joined")
    )


ORACLES["list_coerce"] = """
SELECT conv_id, turn,
       CASE role WHEN 'user' THEN CASE WHEN text = '' THEN 0 ELSE 1 END WHEN 'assistant' THEN 3 ELSE 0 END::BIGINT AS n_items,
       CASE role WHEN 'user' THEN lower(text) WHEN 'assistant' THEN lower(text) || '  assistant' ELSE '' END AS joined
FROM conversations
"""

# Codes made from an order's priority and status.
_FIRST = "CASE o_orderpriority WHEN '1-URGENT' THEN 'PHASE3' WHEN '2-HIGH' THEN 'phase2' WHEN '3-MEDIUM' THEN 'NA' WHEN '5-LOW' THEN '' END"
_SECOND = "CASE o_orderstatus WHEN 'F' THEN 'EARLY_PHASE1' WHEN 'O' THEN 'PHASE2' WHEN 'P' THEN 'long_term' END"
_FIRST_LABEL = "CASE o_orderpriority WHEN '1-URGENT' THEN 'Phase 3' WHEN '2-HIGH' THEN 'Phase 2' WHEN '3-MEDIUM' THEN 'N/A' END"
_SECOND_LABEL = "CASE o_orderstatus WHEN 'F' THEN 'Early Phase 1' WHEN 'O' THEN 'Phase 2' WHEN 'P' THEN 'Long_Term' END"


@register
def code_labels(spark, sf):
    return table(spark, sf, "orders").select(
        "o_orderkey",
        labels.phase_of_code(F.expr(_FIRST)).alias("first_label"),
        labels.phase_of_code(F.expr(_SECOND)).alias("second_label"),
    )


ORACLES["code_labels"] = f"SELECT o_orderkey, {_FIRST_LABEL} AS first_label, {_SECOND_LABEL} AS second_label FROM orders"


@register
def label_set_join(spark, sf):
    """Up to three codes per order, with repeats, as one label."""
    codes = F.when(F.col("o_totalprice") > 20000, F.array(F.expr(_SECOND), F.expr(_FIRST), F.expr(_FIRST)))
    return table(spark, sf, "orders").select("o_orderkey", labels.phase_of_codes(codes).alias("label"))


ORACLES["label_set_join"] = f"""
SELECT o_orderkey, CASE WHEN o_totalprice > 20000 THEN
       array_to_string(list_sort(list_distinct([{_SECOND_LABEL}, {_FIRST_LABEL}])), '/') END AS label
FROM orders
"""

# Dates to the day, month or year, without padding, or with a time of day, which does not count as a date.
DATE_TEXT = """CASE o_orderpriority
    WHEN '1-URGENT' THEN CAST(CAST(o_orderdate AS DATE) AS STRING)
    WHEN '2-HIGH' THEN concat(CAST(year(o_orderdate) AS STRING), '-', CAST(month(o_orderdate) AS STRING))
    WHEN '3-MEDIUM' THEN CAST(year(o_orderdate) AS STRING)
    WHEN '4-NOT SPECIFIED' THEN concat(CAST(year(o_orderdate) AS STRING), '-', CAST(month(o_orderdate) AS STRING),
                                       '-', CAST(day(o_orderdate) AS STRING))
    ELSE concat(CAST(CAST(o_orderdate AS DATE) AS STRING), 'T00:00') END"""


@register
def date_window(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", F.expr(DATE_TEXT).alias("text"))
    return orders.where(dates.within("text", "1996-02-01", "2000-06-15")).select(
        "o_orderkey", "text", dates.year_of("text").alias("year")
    )


ORACLES["date_window"] = f"""
SELECT o_orderkey, text, year(d)::INT AS year FROM (
  SELECT o_orderkey, {DATE_TEXT} AS text,
         CASE WHEN o_orderpriority IN ('1-URGENT', '4-NOT SPECIFIED') THEN o_orderdate::DATE
              WHEN o_orderpriority = '2-HIGH' THEN date_trunc('month', o_orderdate)::DATE
              WHEN o_orderpriority = '3-MEDIUM' THEN date_trunc('year', o_orderdate)::DATE END AS d
  FROM orders)
WHERE d BETWEEN DATE '1996-02-01' AND DATE '2000-06-15'
"""


@register
def partial_dates(spark, sf):
    """The same texts parsed, unreadable ones included."""
    return table(spark, sf, "orders").select("o_orderkey", dates.partial_date(F.expr(DATE_TEXT)).cast("string").alias("day"))


ORACLES["partial_dates"] = f"""
SELECT o_orderkey, CASE
  WHEN regexp_full_match(text, '[0-9]{{4}}') THEN try_strptime(text, '%Y')
  WHEN regexp_full_match(text, '[0-9]{{4}}-[0-9]{{1,2}}') THEN try_strptime(text, '%Y-%m')
  WHEN regexp_full_match(text, '[0-9]{{4}}-[0-9]{{1,2}}-[0-9]{{1,2}}') THEN try_strptime(text, '%Y-%m-%d') END::DATE::VARCHAR AS day
FROM (SELECT o_orderkey, {DATE_TEXT} AS text FROM orders)
"""

_MIXED_CASE = "CASE event_type WHEN 'click' THEN 'Click' WHEN 'error' THEN '' WHEN 'view' THEN NULL ELSE upper(event_type) END"


@register
def status_filter(spark, sf):
    events = table(spark, sf, "events").selectExpr("event_id", f"{_MIXED_CASE} AS status")
    return events.where(labels.in_statuses("status", ["click", "Purchase", "view"]))


ORACLES["status_filter"] = f"""
SELECT event_id, status FROM (SELECT event_id, {_MIXED_CASE} AS status FROM events)
WHERE upper(status) IN ('CLICK', 'PURCHASE', 'VIEW')
"""

_FLAG_TEXT = "CASE o_orderstatus WHEN 'F' THEN ' TRUE ' WHEN 'O' THEN 'false' ELSE 'yes' END"


@register
def bool_coerce(spark, sf):
    flag = labels.parse_flag(F.expr(_FLAG_TEXT))
    return table(spark, sf, "orders").select(
        "o_orderkey", flag.alias("flag"), labels.known(flag).alias("known"), labels.flag_label(flag).alias("label")
    )


ORACLES["bool_coerce"] = f"""
SELECT o_orderkey, o_orderstatus = 'F' AS known,
       CASE o_orderstatus WHEN 'F' THEN true WHEN 'O' THEN false END AS flag,
       CASE o_orderstatus WHEN 'F' THEN '{vocab.WITH_LABEL}' ELSE '{vocab.WITHOUT_LABEL}' END AS label
FROM orders
"""

_PART_NAME = "CASE WHEN p_size > 45 THEN NULL WHEN p_size > 30 THEN concat(upper(p_name), 's') ELSE upper(p_name) END"


@register
def token_flags(spark, sf):
    """Whole words in any case; a plural is another word, and a missing name has none."""
    parts = table(spark, sf, "part").selectExpr("p_partkey", f"{_PART_NAME} AS name")
    ring, rod = text.has_phrase("name", "ring"), text.has_phrase("name", "rod")
    return parts.select("p_partkey", ring.alias("ring"), rod.alias("rod"), (ring | rod).alias("either"))


ORACLES["token_flags"] = f"""
SELECT p_partkey, coalesce(regexp_matches(name, '\\bring\\b', 'i'), false) AS ring,
       coalesce(regexp_matches(name, '\\brod\\b', 'i'), false) AS rod,
       coalesce(regexp_matches(name, '\\b(ring|rod)\\b', 'i'), false) AS either
FROM (SELECT p_partkey, {_PART_NAME} AS name FROM part)
"""

_DIRTY = "CASE WHEN p_size < 10 THEN 'N/A' WHEN p_size < 20 THEN 'None' WHEN p_size < 25 THEN '' WHEN p_size < 30 THEN 'n/a ' ELSE p_name END"


@register
def na_tokens(spark, sf):
    return table(spark, sf, "part").select("p_partkey", text.null_if_na(F.expr(_DIRTY)).alias("name"))


ORACLES["na_tokens"] = f"SELECT p_partkey, CASE WHEN p_size >= 25 THEN {_DIRTY} END AS name FROM part"


@register
def clean_codes(spark, sf):
    """Upper case without surrounding white space; captions built from the result."""
    segment = text.upper_strip(F.concat(F.lit(" \t"), F.lower("c_mktsegment"), F.lit("\n")))
    return table(spark, sf, "customer").select(
        "c_custkey", segment.alias("segment"), F.concat(segment, F.lit(" • all")).alias("caption")
    )


ORACLES["clean_codes"] = (
    "SELECT c_custkey, upper(c_mktsegment) AS segment, upper(c_mktsegment) || ' • all' AS caption FROM customer"
)


@register
def guarded_percent(spark, sf):
    """Quantity per size in percent, with sizes that are zero, and its rounding."""
    parts = table(spark, sf, "part").selectExpr("p_partkey", "p_partkey AS part", "greatest(p_size - 10, 0) AS whole")
    pct = percent("part", "whole")
    return parts.select("p_partkey", pct.alias("pct"), round2(pct).alias("pct2"))


ORACLES["guarded_percent"] = """
SELECT p_partkey, pct, round_even(pct * 100, 0) / 100 AS pct2 FROM (
  SELECT p_partkey, CASE WHEN p_size > 10 THEN p_partkey::DOUBLE / (p_size - 10) * 100::DOUBLE ELSE 0::DOUBLE END AS pct
  FROM part)
"""
