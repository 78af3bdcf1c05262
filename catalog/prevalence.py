"""Prevalence of the flag, and gaps in a cohort."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.common import (
    ORDER_FLAG,
    registry_of,
    sql_area,
    sql_gaps,
    sql_overall,
    sql_prevalence,
    table,
)
from coverlens.functions.labels import area_of, bucket_of
from coverlens.functions.text import title_case
from coverlens.operators.classify import classified, spread
from coverlens.operators.gaps import cohort_gaps
from coverlens.operators.prevalence import prevalence_by, prevalence_overall, prevalence_sets
from coverlens.session import shared_path
from coverlens.sources.sinks import write_metrics

QUERIES: dict = {}
ORACLES: dict = {}
register = registry_of(QUERIES)

SEGMENT_BUCKETS = {"BUILDING": "Industry", "AUTOMOBILE": "NIH", "MACHINERY": "Academic", "FURNITURE": "Academic"}
TOPIC_RULES = [
    ("French", ["eau", "ç"]),
    ("Spanish", ["ción", "ñ", " los "]),
    ("German", ["sch", "ß", " und "]),
    ("English", ["tion", " the "]),
]


def _orders(spark, sf):
    return table(spark, sf, "orders").withColumn("flag", F.expr(ORDER_FLAG))


_ORDERS = f"(SELECT *, {ORDER_FLAG} AS flag FROM orders)"


QUERIES["prevalence_overall"] = lambda spark, sf: prevalence_overall(_orders(spark, sf), "flag")
ORACLES["prevalence_overall"] = sql_overall(_ORDERS)


@register
def prevalence_by_priority(spark, sf):
    """The lowest priority reads as null, which stays a group of its own."""
    keyed = _orders(spark, sf).withColumn("priority", F.expr("nullif(o_orderpriority, '5-LOW')"))
    return prevalence_by(keyed, "priority", "flag")


ORACLES["prevalence_by_priority"] = sql_prevalence(
    f"(SELECT flag, nullif(o_orderpriority, '5-LOW') AS priority FROM {_ORDERS})", "priority"
)


@register
def metric_files(spark, sf):
    """The same table written as a CSV metric and read back."""
    (path,) = write_metrics({"by_priority": prevalence_by_priority(spark, sf)}, shared_path(spark, "metrics"))
    columns = "priority string, total bigint, with_dmc bigint, without_dmc bigint, with_dmc_pct double"
    return spark.read.schema(columns).option("header", True).csv(path)


ORACLES["metric_files"] = ORACLES["prevalence_by_priority"]


@register
def prevalence_by_bucket(spark, sf):
    customers = table(spark, sf, "customer").select(
        bucket_of(F.concat(F.lit(" "), F.lower("c_mktsegment"), F.lit("\t")), SEGMENT_BUCKETS).alias("bucket"),
        (F.col("c_acctbal") > 5000).alias("flag"),
    )
    return prevalence_by(customers, "bucket", "flag")


ORACLES["prevalence_by_bucket"] = sql_prevalence(
    "(SELECT c_acctbal > 5000 AS flag, CASE c_mktsegment "
    + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in SEGMENT_BUCKETS.items())
    + " ELSE 'Other' END AS bucket FROM customer)",
    "bucket",
)


@register
def prevalence_by_role(spark, sf):
    turns = table(spark, sf, "conversations").select(
        title_case(F.concat(F.upper("role"), F.lit("_TURN in 2ND"))).alias("role_label"),
        (F.length("text") > 300).alias("flag"),
    )
    return prevalence_by(turns, "role_label", "flag")


ORACLES["prevalence_by_role"] = sql_prevalence(
    "(SELECT upper(role[1]) || lower(role[2:]) || '_Turn In 2Nd' AS role_label, length(text) > 300 AS flag "
    "FROM conversations)",
    "role_label",
)


@register
def prevalence_by_area(spark, sf):
    """Whole documents through the default rules."""
    docs = spread(table(spark, sf, "documents").select("text", (F.col("n_chars") > 500).alias("flag")))
    return prevalence_by(classified(docs, F.lower("text"), "area"), "area", "flag")


ORACLES["prevalence_by_area"] = sql_prevalence(
    f"(SELECT {sql_area('lower(text)')} AS area, n_chars > 500 AS flag FROM documents)", "area"
)


@register
def prevalence_by_topic(spark, sf):
    """Whole documents through other rules."""
    docs = table(spark, sf, "documents").select(
        area_of(F.lower("text"), TOPIC_RULES, "None").alias("topic"), (F.col("n_chars") > 500).alias("flag")
    )
    return prevalence_by(docs, "topic", "flag")


ORACLES["prevalence_by_topic"] = sql_prevalence(
    f"(SELECT {sql_area('lower(text)', TOPIC_RULES, 'None')} AS topic, n_chars > 500 AS flag FROM documents)", "topic"
)


@register
def prevalence_all_sets(spark, sf):
    orders = _orders(spark, sf).withColumns(
        {"priority": F.expr("nullif(o_orderpriority, '5-LOW')"), "year": F.year("o_orderdate")}
    )
    return prevalence_sets(orders, ["priority", "year"], "flag")


_SETS = (
    f"SELECT 'overall' AS dimension, NULL::VARCHAR AS label, flag FROM {_ORDERS} "
    f"UNION ALL SELECT 'priority', nullif(o_orderpriority, '5-LOW'), flag FROM {_ORDERS} "
    f"UNION ALL SELECT 'year', year(o_orderdate)::VARCHAR, flag FROM {_ORDERS}"
)
ORACLES["prevalence_all_sets"] = sql_prevalence(f"({_SETS})", "dimension, label")


@register
def oversight_gaps(spark, sf):
    """Large recent orders; the last subgroup has no orders and must still show."""
    orders = _orders(spark, sf)
    cohort = (F.col("o_totalprice") > 100000) & (F.year("o_orderdate") >= 1997)
    return cohort_gaps(
        orders,
        cohort,
        "o_orderpriority",
        ["3-MEDIUM", "1-URGENT", "9-NONE"],
        "flag",
        all_caption="All orders",
        caption=lambda label: f"{label} • large recent orders",
    )


ORACLES["oversight_gaps"] = sql_gaps(
    _ORDERS,
    "o_totalprice > 100000 AND year(o_orderdate) >= 1997",
    "o_orderpriority",
    {
        None: "All orders",
        "1-URGENT": "1-URGENT • large recent orders",
        "3-MEDIUM": "3-MEDIUM • large recent orders",
        "9-NONE": "9-NONE • large recent orders",
    },
    "flag",
    "dmc",
)
