"""Tables behind the charts."""

from __future__ import annotations

from catalog.common import ORDER_FLAG, registry_of, sql_cells, sql_pct, table
from coverlens.functions.labels import phase_or_na
from coverlens.operators import charts

QUERIES: dict = {}
ORACLES: dict = {}
register = registry_of(QUERIES)

PART_TYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]


def _parts(spark, sf):
    return table(spark, sf, "part").selectExpr("*", "p_size > 25 AS flag")


_PARTS = "(SELECT *, p_size > 25 AS flag FROM part)"
_TOP = "SELECT p_brand FROM part WHERE p_brand IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, p_brand LIMIT 12"

QUERIES["category_frequency"] = lambda spark, sf: charts.category_counts(_parts(spark, sf), "p_brand")
ORACLES["category_frequency"] = "SELECT p_brand, count(*) AS n FROM part GROUP BY 1"

QUERIES["distinct_labels"] = lambda spark, sf: charts.distinct_labels(_parts(spark, sf), "p_type")
ORACLES["distinct_labels"] = "SELECT DISTINCT p_type FROM part"

QUERIES["top_categories"] = lambda spark, sf: charts.top_categories(_parts(spark, sf), "p_brand")
ORACLES["top_categories"] = f"SELECT p_brand, count(*) AS n FROM part WHERE p_brand IN ({_TOP}) GROUP BY 1"

QUERIES["top_category_rows"] = lambda spark, sf: charts.in_top_categories(_parts(spark, sf), "p_brand").select(
    "p_partkey", "p_brand"
)
ORACLES["top_category_rows"] = f"SELECT p_partkey, p_brand FROM part WHERE p_brand IN ({_TOP})"


def _heatmap(spark, sf):
    return charts.heatmap_cells(_parts(spark, sf), "p_type", "p_brand", flag="flag", key="p_partkey")


QUERIES["heatmap_cells"] = _heatmap
ORACLES["heatmap_cells"] = sql_cells(
    f"(FROM {_PARTS} WHERE p_brand IN ({_TOP}))", "p_type, p_brand", key="p_partkey"
)


@register
def heatmap_matrix(spark, sf):
    """Brands by type; all six types are among the most frequent ones."""
    return charts.heatmap_matrix(_parts(spark, sf), "p_brand", "p_type", flag="flag", key="p_partkey").select(
        "p_brand", *PART_TYPES
    )


def _column(name):
    inside = f"p_type = '{name}'"
    total = f"count(p_partkey) FILTER (WHERE {inside})"
    return f"CASE WHEN {total} > 0 THEN {sql_pct(f'count(*) FILTER (WHERE {inside} AND flag)', total)} END AS {name}"


ORACLES["heatmap_matrix"] = (
    f"SELECT p_brand, {', '.join(map(_column, PART_TYPES))} FROM {_PARTS} GROUP BY 1"
)



@register
def heatmap_matrix_cut(spark, sf):
    """Types by the 12 most frequent of the 25 brands: the matrix, turned back into its filled cells."""
    matrix = charts.heatmap_matrix(_parts(spark, sf), "p_type", "p_brand", flag="flag", key="p_partkey")
    cells = matrix.unpivot("p_type", [c for c in matrix.columns if c != "p_type"], "p_brand", "with_dmc_pct")
    return cells.where("with_dmc_pct IS NOT NULL")


ORACLES["heatmap_matrix_cut"] = f"SELECT p_type, p_brand, with_dmc_pct FROM ({ORACLES['heatmap_cells']})"

QUERIES["heatmap_range"] = lambda spark, sf: charts.value_range(_heatmap(spark, sf))
ORACLES["heatmap_range"] = (
    f"SELECT min(with_dmc_pct) AS vmin, max(with_dmc_pct) AS vmax FROM ({ORACLES['heatmap_cells']})"
)

# The year of January orders is unknown, and so is the priority of low ones.
_YEAR = "CASE WHEN month(o_orderdate) > 1 THEN CAST(year(o_orderdate) AS INT) END"
_PRIORITY = "CASE o_orderpriority WHEN '5-LOW' THEN NULL WHEN '1-URGENT' THEN '  ' ELSE o_orderpriority END"


def _orders(spark, sf):
    return table(spark, sf, "orders").selectExpr(
        "o_orderkey", f"{ORDER_FLAG} AS flag", f"{_YEAR} AS year", f"{_PRIORITY} AS priority"
    )


_ORDERS = f"(SELECT o_orderkey, {ORDER_FLAG} AS flag, {_YEAR} AS year, {_PRIORITY} AS priority FROM orders)"


@register
def trend_by_group(spark, sf):
    return charts.yearly_trend(_orders(spark, sf), "priority", "year", "flag", "o_orderkey")


ORACLES["trend_by_group"] = sql_cells(
    f"(FROM {_ORDERS} WHERE year IS NOT NULL AND priority IS NOT NULL)", "year, priority", key="o_orderkey"
)


@register
def trend_excl_na(spark, sf):
    labelled = _orders(spark, sf).withColumn("priority", phase_or_na("priority"))
    return charts.phase_trend(labelled, "priority", year="year", flag="flag", key="o_orderkey")


ORACLES["trend_excl_na"] = sql_cells(
    f"(FROM {_ORDERS} WHERE year IS NOT NULL AND trim(priority) <> '')", "year, priority", key="o_orderkey"
)
