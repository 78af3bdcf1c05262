"""Shared pieces: table access, SQL fragments, a decorator that registers a query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coverlens.functions import vocab
from coverlens.operators.odds import Z95

# Flag of an order: set, not set, unknown.
ORDER_FLAG = "CASE o_orderstatus WHEN 'F' THEN true WHEN 'O' THEN false END"
ITEM_FLAG = "CASE l_returnflag WHEN 'A' THEN true WHEN 'R' THEN false END"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sql_pct(part: str, whole: str) -> str:
    """Unrounded percentage, 0.0 for an empty whole."""
    return f"CASE WHEN ({whole}) > 0 THEN ({part})::DOUBLE / ({whole}) * 100.0::DOUBLE ELSE 0.0::DOUBLE END"


def sql_pct2(part: str, whole: str) -> str:
    return sql_round(sql_pct(part, whole), 100)


def sql_exact2(part: str, whole: str) -> str:
    """Two decimals as C's printf writes them, which decides on the exact binary value."""
    return f"printf('%.2f', {sql_pct(part, whole)})::DOUBLE"


def sql_round(value: str, scale: int) -> str:
    return f"round_even(({value}) * {scale}::DOUBLE, 0) / {scale}::DOUBLE"


def rounded(df: DataFrame, columns: list[str], scale: int = 1_000_000) -> DataFrame:
    """Six decimals: results of exp and ln may differ in the last bits between math libraries."""
    return df.withColumns({c: F.rint(F.col(c) * float(scale)) / float(scale) for c in columns})


def sql_prevalence(source: str, by: str, flag: str = "flag", name: str = "dmc") -> str:
    on = f"count(*) FILTER (WHERE {flag})"
    return (
        f"SELECT {by}, count(*) AS total, {on} AS with_{name}, count(*) - {on} AS without_{name}, "
        f"{sql_pct2(on, 'count(*)')} AS with_{name}_pct FROM {source} GROUP BY ALL"
    )


def sql_overall(source: str, flag: str = "flag", name: str = "dmc") -> str:
    on = f"count(*) FILTER (WHERE {flag})"
    return (
        f"SELECT count(*) AS total_trials, {on} AS with_{name}, count(*) - {on} AS without_{name}, "
        f"{sql_exact2(on, 'count(*)')} AS with_{name}_pct FROM {source}"
    )


def sql_cells(source: str, by: str, flag: str = "flag", key: str = "1", name: str = "dmc") -> str:
    on, total = f"count(*) FILTER (WHERE {flag})", f"count({key})"
    return (
        f"SELECT {by}, {total} AS total, {on} AS with_{name}, {sql_pct(on, total)} AS with_{name}_pct "
        f"FROM {source} GROUP BY ALL"
    )


def sql_any(text: str, keys) -> str:
    return "(" + " OR ".join(f"contains({text}, {quoted(k)})" for k in keys) + ")"


def sql_area(text: str, rules=vocab.AREA_RULES, default: str = vocab.DEFAULT_AREA) -> str:
    """First matching rule, over lower-case text."""
    cases = " ".join(f"WHEN {sql_any(text, keys)} THEN {quoted(label)}" for label, keys in rules)
    return f"CASE {cases} ELSE {quoted(default)} END"


def sql_gaps(source: str, cohort: str, subgroup: str, captions: dict[str | None, str], flag: str, name: str) -> str:
    def line(label, caption):
        inside = "true" if label is None else f"{subgroup} = {quoted(label)}"
        total = f"count(*) FILTER (WHERE {inside})"
        without = f"count(*) FILTER (WHERE {inside} AND NOT coalesce({flag}, false))"
        return (
            f"SELECT {quoted(caption)} AS subgroup, {total} AS total, {without} AS without_{name}, "
            f"{sql_exact2(without, total)} AS without_{name}_pct FROM {source} WHERE {cohort}"
        )

    return " UNION ALL ".join(line(label, caption) for label, caption in captions.items())


FLAG_LABEL = f"CASE WHEN coalesce({{flag}}, false) THEN {quoted(vocab.WITH_LABEL)} ELSE {quoted(vocab.WITHOUT_LABEL)} END"


def sql_outcomes(source: str, terminated: str, completed: str, key: str, flag: str = "flag") -> str:
    stopped = f"count(*) FILTER (WHERE {terminated})"
    return (
        f"SELECT {FLAG_LABEL.format(flag=flag)} AS has_dmc_label, count({key}) AS total, "
        f"{stopped} AS terminated_like, count(*) FILTER (WHERE {completed}) AS completed, "
        f"{sql_pct2(stopped, f'count({key})')} AS terminated_like_pct FROM {source} GROUP BY 1"
    )


def sql_signals(source: str, hits: dict[str, str], key: str, flag: str = "flag") -> str:
    parts = [f"count(*) FILTER (WHERE {hit}) AS {s}_hits" for s, hit in hits.items()]
    parts += [
        f"{sql_pct2(f'count(*) FILTER (WHERE {hit})', f'count({key})')} AS {s}_rate_pct" for s, hit in hits.items()
    ]
    return (
        f"SELECT {FLAG_LABEL.format(flag=flag)} AS has_dmc_label, count({key}) AS n_with_text, {', '.join(parts)} "
        f"FROM {source} GROUP BY 1"
    )


ODDS_ESTIMATES = ["coefficient", "std_error", "odds_ratio", "ci_low", "ci_high"]


def sql_logit(source: str, group: str, name: str, flag: str, outcome: str, slopes: dict[str, str]) -> str:
    """Newton's method in SQL for a logit with one intercept ``a`` per value of ``group``, a slope for the
    missing flag, and one for each condition in ``slopes``.

    The intercepts' block of the information matrix is diagonal. Eliminating it leaves a small matrix ``m``
    over the slopes, which is inverted in place, one pivot per nested SELECT.
    """
    terms = {"without_flag": f"NOT coalesce({flag}, false)", **slopes}
    k = range(len(terms))

    def each(template: str, separator: str = ", ") -> str:
        return separator.join(template.format(i=i) for i in k)

    def pairs(template: str, separator: str = ", ") -> str:
        return separator.join(template.format(i=i, j=j) for i in k for j in k)

    def pivot(p: int, inner: str) -> str:
        def entry(i: int, j: int) -> str:
            if i == p and j == p:
                return f"1 / m{p}{p}"
            if i == p:
                return f"m{p}{j} / m{p}{p}"
            if j == p:
                return f"-m{i}{p} / m{p}{p}"
            return f"m{i}{j} - m{i}{p} * m{p}{j} / m{p}{p}"

        return f"SELECT * REPLACE ({', '.join(f'{entry(i, j)} AS m{i}{j}' for i in k for j in k)}) FROM ({inner})"

    inverse = f"""
      SELECT *, {pairs('sum(w * x{i} * x{j}) OVER () - sum(w * x{i} * s{j} / dg) OVER () AS m{i}{j}')},
             {each('sum(r * x{i}) OVER () - sum(r * s{i} / dg) OVER () AS u{i}')} FROM (
        SELECT *, sum(w) OVER (PARTITION BY g) AS dg, sum(r) OVER (PARTITION BY g) AS rg,
               {each('sum(w * x{i}) OVER (PARTITION BY g) AS s{i}')} FROM (
          SELECT *, n * p * (1 - p) AS w, y - n * p AS r FROM (
            SELECT *, 1 / (1 + exp(-(a + {each('b{i} * x{i}', ' + ')}))) AS p FROM newton WHERE step < 25)))"""
    for p in k:
        inverse = pivot(p, inverse)
    steps = ", ".join("(" + " + ".join(f"m{i}{j} * u{j}" for j in k) + f") AS db{i}" for i in k)
    slope_rows = " UNION ALL ".join(
        f"SELECT {quoted(term)}, b{i}, sqrt(v{i}{i}) FROM base" for i, term in enumerate(terms)
    )
    spread = pairs("q{i} * q{j} * v{i}{j}", " + ")
    return f"""
WITH RECURSIVE cells AS (
  SELECT ({group})::VARCHAR AS g, {', '.join(f'({c})::INT::DOUBLE AS x{i}' for i, c in enumerate(terms.values()))},
         count(*)::DOUBLE AS n, (count(*) FILTER (WHERE {outcome}))::DOUBLE AS y
  FROM {source} GROUP BY ALL
), newton AS (
  SELECT 0 AS step, g, {each('x{i}')}, n, y, 0::DOUBLE AS a, {each('0::DOUBLE AS b{i}')},
         {pairs('0::DOUBLE AS v{i}{j}')}, 0::DOUBLE AS d, {each('0::DOUBLE AS c{i}')} FROM cells
  UNION ALL
  SELECT step + 1, g, {each('x{i}')}, n, y, a + (rg - {each('s{i} * db{i}', ' - ')}) / dg, {each('b{i} + db{i}')},
         {pairs('m{i}{j}')}, dg, {each('s{i}')} FROM (SELECT *, {steps} FROM ({inverse}))
), fitted AS (
  SELECT DISTINCT g, a, {each('b{i}')}, {pairs('v{i}{j}')}, d, {each('c{i}')} FROM newton WHERE step = 25
), base AS (
  SELECT * FROM fitted WHERE g = (SELECT min(g) FROM fitted)
), levels AS (
  SELECT {quoted(name + '=')} || f.g AS term, f.a - base.a AS coefficient, 1 / f.d + 1 / base.d AS own,
         {each('f.c{i} / f.d - base.c{i} / base.d AS q{i}')}, {pairs('f.v{i}{j} AS v{i}{j}')}
  FROM fitted f, base WHERE f.g <> base.g
  UNION ALL SELECT 'intercept', a, 1 / d, {each('c{i} / d')}, {pairs('v{i}{j}')} FROM base
), terms AS (
  SELECT term, coefficient, sqrt(own + {spread}) AS std_error FROM levels UNION ALL {slope_rows}
)
SELECT term, {sql_round('coefficient', 1_000_000)} AS coefficient, {sql_round('std_error', 1_000_000)} AS std_error,
       {sql_round('exp(coefficient)', 1_000_000)} AS odds_ratio,
       {sql_round(f'exp(coefficient - {Z95} * std_error)', 1_000_000)} AS ci_low,
       {sql_round(f'exp(coefficient + {Z95} * std_error)', 1_000_000)} AS ci_high,
       (SELECT sum(n)::BIGINT FROM cells) AS n
FROM terms
"""


def registry_of(queries: dict):
    def register(function):
        queries[function.__name__] = function
        return function

    return register
