"""Outcomes, keyword signals and odds with and without the flag."""

from __future__ import annotations

from catalog.common import (
    ITEM_FLAG,
    ODDS_ESTIMATES,
    registry_of,
    rounded,
    sql_any,
    sql_logit,
    sql_outcomes,
    sql_round,
    sql_signals,
    table,
)
from coverlens.functions import vocab
from coverlens.operators import odds
from coverlens.operators.outcomes import keyword_signals_by_flag, outcomes_by_flag as by_flag, signal_ratios

QUERIES: dict = {}
ORACLES: dict = {}
register = registry_of(QUERIES)

_SIZE = "CASE WHEN l_quantity > 25 THEN 'large' ELSE 'small' END"


def _items(spark, sf):
    """Line items; a missing key (line 7) is not counted in the total."""
    return table(spark, sf, "lineitem").selectExpr(
        f"{ITEM_FLAG} AS flag",
        "nullif(l_linenumber, 7) AS line",
        "l_linestatus = 'F' AS stopped",
        "l_linestatus = 'O' AS done",
        "l_linenumber",
        "l_partkey",
        f"{_SIZE} AS size",
    )


_ITEMS = (
    f"(SELECT {ITEM_FLAG} AS flag, nullif(l_linenumber, 7) AS line, l_linestatus = 'F' AS stopped, "
    f"l_linestatus = 'O' AS done, l_linenumber, l_partkey, {_SIZE} AS size FROM lineitem)"
)


@register
def outcomes_by_flag(spark, sf):
    return by_flag(_items(spark, sf), "flag", "line", "stopped", "done")


ORACLES["outcomes_by_flag"] = sql_outcomes(_ITEMS, "stopped", "done", "line")

# Documents as stop reasons, of all languages; one in ten has none, one in ten an empty one.
_REASON = "CASE doc_id % 10 WHEN 3 THEN NULL WHEN 7 THEN '' ELSE text END"
LISTS = {"safety": vocab.SAFETY_KEYS + ["tion", "eau"], "futility": vocab.FUTILITY_KEYS + ["thou"]}


def _reasons(spark, sf):
    return table(spark, sf, "documents").selectExpr("doc_id", f"{_REASON} AS reason", "n_chars > 500 AS flag")


_REASONS = f"(SELECT doc_id, {_REASON} AS reason, n_chars > 500 AS flag FROM documents)"
_HITS = {s: sql_any("lower(reason)", words) for s, words in LISTS.items()}


def _signals(denominator):
    return lambda spark, sf: keyword_signals_by_flag(
        _reasons(spark, sf), "reason", LISTS, denominator, flag="flag", key="doc_id"
    )


QUERIES["keyword_signal_with_text"] = _signals("with_text")
QUERIES["keyword_signal_all_rows"] = _signals("all_rows")
ORACLES["keyword_signal_with_text"] = sql_signals(f"(FROM {_REASONS} WHERE length(reason) > 0)", _HITS, "doc_id")
ORACLES["keyword_signal_all_rows"] = sql_signals(_REASONS, _HITS, "doc_id")

QUERIES["rate_ratio"] = lambda spark, sf: signal_ratios(_signals("with_text")(spark, sf))
_RATE = (
    "max(CASE WHEN has_dmc_label = '{label}' THEN {s}_hits::DOUBLE END) / "
    "nullif(max(CASE WHEN has_dmc_label = '{label}' THEN n_with_text END), 0)"
)
ORACLES["rate_ratio"] = (
    "SELECT "
    + ", ".join(
        f"({_RATE.format(label=vocab.WITH_LABEL, s=s)}) / nullif({_RATE.format(label=vocab.WITHOUT_LABEL, s=s)}, 0) "
        f"AS {s}_ratio"
        for s in LISTS
    )
    + f" FROM ({ORACLES['keyword_signal_with_text']})"
)


@register
def crude_odds(spark, sf):
    return rounded(odds.crude_odds(_items(spark, sf), "flag", "stopped"), ["odds_ratio", "ci_low", "ci_high"])


_CELL = "count(*) FILTER (WHERE {0}coalesce(flag, false) AND {1}stopped) AS {2}"
_TWO_BY_TWO = (
    "SELECT "
    + ", ".join(
        [
            _CELL.format("NOT ", "", "without_yes"),
            _CELL.format("NOT ", "NOT ", "without_no"),
            _CELL.format("", "", "with_yes"),
            _CELL.format("", "NOT ", "with_no"),
        ]
    )
    + f" FROM {_ITEMS}"
)
_LOG = "(ln(without_yes / without_no) - ln(with_yes / with_no))"
_SE = "sqrt(1 / without_yes + 1 / without_no + 1 / with_yes + 1 / with_no)"
ORACLES["crude_odds"] = (
    f"SELECT without_yes, without_no, with_yes, with_no, {sql_round(f'exp({_LOG})', 1_000_000)} AS odds_ratio, "
    f"{sql_round(f'exp({_LOG} - {odds.Z95} * {_SE})', 1_000_000)} AS ci_low, "
    f"{sql_round(f'exp({_LOG} + {odds.Z95} * {_SE})', 1_000_000)} AS ci_high FROM ({_TWO_BY_TWO})"
)


@register
def adjusted_odds(spark, sf):
    """Two factors."""
    return rounded(odds.adjusted_odds(_items(spark, sf), ["l_linenumber", "size"], "flag", "stopped"), ODDS_ESTIMATES)


@register
def adjusted_odds_one_factor(spark, sf):
    return rounded(odds.adjusted_odds(_items(spark, sf), ["l_linenumber"], "flag", "stopped"), ODDS_ESTIMATES)


ORACLES["adjusted_odds"] = sql_logit(
    _ITEMS, "l_linenumber", "l_linenumber", "flag", "stopped", {"size=small": "size = 'small'"}
)
ORACLES["adjusted_odds_one_factor"] = sql_logit(_ITEMS, "l_linenumber", "l_linenumber", "flag", "stopped", {})


@register
def adjusted_odds_many_levels(spark, sf):
    """A factor with as many levels as there are parts, beside a small one."""
    return rounded(odds.adjusted_odds(_items(spark, sf), ["l_partkey", "size"], "flag", "stopped"), ODDS_ESTIMATES)


ORACLES["adjusted_odds_many_levels"] = sql_logit(
    _ITEMS, "l_partkey", "l_partkey", "flag", "stopped", {"size=small": "size = 'small'"}
)

# An outcome that no record with the flag has: the plain fit has no finite estimate. With a flag alone, the penalised
# estimates are those of counts with a half added to each cell.
_ONE_SIDED = "stopped AND NOT coalesce(flag, false)"


@register
def penalised_odds(spark, sf):
    items = _items(spark, sf).selectExpr("flag", f"{_ONE_SIDED} AS one_sided")
    fitted = odds.adjusted_odds(items, [], "flag", "one_sided", penalised=True)
    return rounded(fitted, ODDS_ESTIMATES[:2]).select("term", "coefficient", "std_error", "n")


_HALVES = (
    "SELECT n1::BIGINT AS n1, n0::BIGINT AS n0, (y1 + 0.5::DOUBLE) / (n1 + 1) AS p1, (y0 + 0.5::DOUBLE) / (n0 + 1) AS p0 FROM ("
    "SELECT count(*) FILTER (WHERE NOT coalesce(flag, false)) AS n1, count(*) FILTER (WHERE coalesce(flag, false)) AS n0, "
    f"count(*) FILTER (WHERE {_ONE_SIDED}) AS y1, count(*) FILTER (WHERE coalesce(flag, false) AND {_ONE_SIDED}) AS y0 FROM {_ITEMS})"
)
ORACLES["penalised_odds"] = (
    f"SELECT term, {sql_round('b', 1_000_000)} AS coefficient, {sql_round('e', 1_000_000)} AS std_error, "
    "n FROM ("
    "SELECT 'without_flag' AS term, ln(p1 / (1 - p1)) - ln(p0 / (1 - p0)) AS b, "
    f"sqrt(1 / (n1 * p1 * (1 - p1)) + 1 / (n0 * p0 * (1 - p0))) AS e, n1 + n0 AS n FROM ({_HALVES}) UNION ALL "
    f"SELECT 'intercept', ln(p0 / (1 - p0)), sqrt(1 / (n0 * p0 * (1 - p0))), n1 + n0 FROM ({_HALVES}))"
)
