"""Odds of an outcome without the flag, crude and adjusted for other factors."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coverlens.functions.labels import known
from coverlens.functions.measures import count_rows, count_where
from coverlens.operators import logit
from coverlens.session import stored

Z95 = 1.959963984540054  # 97.5 % point of the normal distribution


def crude_odds(
    df: DataFrame, flag: str = "has_dmc", outcome: Column | str = "is_terminated_like", rows: str | None = None
) -> DataFrame:
    """One row: 2×2 counts and the odds ratio of the outcome without the flag, with its 95 % interval.

    An empty cell leaves ratio and interval null.
    """
    happened = F.coalesce(F.col(outcome) if isinstance(outcome, str) else outcome, F.lit(False))
    has = known(flag)
    counts = df.agg(
        count_where(~has & happened, rows).alias("without_yes"),
        count_where(~has & ~happened, rows).alias("without_no"),
        count_where(has & happened, rows).alias("with_yes"),
        count_where(has & ~happened, rows).alias("with_no"),
    )
    a, b, c, d = (F.col(x).cast("double") for x in ("without_yes", "without_no", "with_yes", "with_no"))
    full = (a > 0) & (b > 0) & (c > 0) & (d > 0)
    log_or = F.when(full, F.ln(F.try_divide(a, b)) - F.ln(F.try_divide(c, d)))
    inverse = [F.try_divide(F.lit(1.0), x) for x in (a, b, c, d)]
    counts = counts.withColumns({"_log": log_or, "_se": F.sqrt(sum(inverse[1:], inverse[0]))})
    return counts.select(
        "without_yes",
        "without_no",
        "with_yes",
        "with_no",
        F.exp("_log").alias("odds_ratio"),
        F.exp(F.col("_log") - Z95 * F.col("_se")).alias("ci_low"),
        F.exp(F.col("_log") + Z95 * F.col("_se")).alias("ci_high"),
    )


def adjusted_odds(
    df: DataFrame,
    factors: Sequence[str] = ("phase_label", "sponsor_bucket"),
    flag: str = "has_dmc",
    outcome: Column | str = "is_terminated_like",
    base: dict[str, str] | None = None,
    rows: str | None = None,
    penalised: bool = False,
) -> DataFrame:
    """Logistic regression of the outcome on the missing flag and the factors: one row per model term, in the factors' order.

    Records are first counted per combination of flag and factor levels; the estimates are those of a fit on the
    records, from a table whose size depends on the number of combinations only. Counting and fitting run while this is
    called. A record without a level of some factor is left out. The base level of a factor is its first in order unless
    ``base`` names another, which must occur.

    The factor with most levels may have any number of them: beyond a few million numbers they stay in tables. The levels of all other factors
    together are terms that the driver solves for, at the square of their number.
    ``penalised`` is Firth's fit, finite on separated cells too. Without it the estimates of separated
    levels or terms are large, with large errors. Errors are NaN if a term follows from the others, such as
    a flag that all records carry.
    """
    spark = df.sparkSession
    happened = F.coalesce(F.col(outcome) if isinstance(outcome, str) else outcome, F.lit(False))
    levels_as_text = [F.col(f).cast("string").alias(f"f{i}") for i, f in enumerate(factors)]
    counts = (
        df.dropna(subset=list(factors))
        .groupBy((~known(flag)).alias("without"), *levels_as_text)
        .agg(count_rows(rows).alias("n"), count_where(happened, rows).alias("n_happened"))
        .where("n > 0")
    )
    counts = stored(counts, "odds-counts")
    measures = [F.sum("n"), F.count(F.lit(1))]
    for i in range(len(factors)):
        measures += [F.count_distinct(f"f{i}"), F.min(f"f{i}")]
    n, n_cells, *found = counts.agg(*measures).first()
    if not n:
        raise ValueError("No records with all factors.")
    first = [str((base or {}).get(f, found[2 * i + 1])) for i, f in enumerate(factors)]
    wide = max(range(len(factors)), key=lambda i: found[2 * i], default=None)

    places, terms = [(-1, "")], ["without_flag"]
    numbers = [F.when(F.col("without"), F.lit(0))]
    for i, factor in enumerate(factors):
        if i == wide:
            continue
        levels = [r[0] for r in counts.select(f"f{i}").distinct().orderBy(f"f{i}").collect()]
        _require_level(factor, first[i], first[i] in levels)
        levels.remove(first[i])
        at = F.array_position(logit.constant(levels, "array<string>"), F.col(f"f{i}")).cast("int")
        numbers.append(F.when(at > 0, at + (len(terms) - 1)))
        places += [(i, level) for level in levels]
        terms += [f"{factor}={level}" for level in levels]
    cells = counts.select(
        (F.lit("") if wide is None else F.col(f"f{wide}")).alias("level"),
        F.array_sort(F.array_compact(F.array(*numbers))).alias("terms"),
        F.col("n").cast("double").alias("n"),
        F.col("n_happened").cast("double").alias("y"),
    )
    model = logit.fit(cells, len(terms), penalised, n_cells)
    reference = "" if wide is None else first[wide]
    base_level = next(iter(model.levels.where(F.col("level") == reference).collect()), None)
    _require_level("" if wide is None else factors[wide], reference, base_level is not None)
    fitted = _own_terms(model, base_level, [*places, (len(factors), "")], [*terms, "intercept"], spark)
    if wide is not None:
        fitted = fitted.union(_level_terms(model, base_level, wide, factors[wide]))
    return fitted.orderBy("place", "level").select(
        "term",
        "coefficient",
        "std_error",
        F.exp("coefficient").alias("odds_ratio"),
        F.exp(F.col("coefficient") - Z95 * F.col("std_error")).alias("ci_low"),
        F.exp(F.col("coefficient") + Z95 * F.col("std_error")).alias("ci_high"),
        F.lit(n).cast("bigint").alias("n"),
    )


def _require_level(factor: str, level: str, found: bool) -> None:
    if not found:
        raise ValueError(f"{factor} has no records of the base level {level}.")


def _row_of(level, terms: int) -> np.ndarray:
    """A level's row of the information matrix as shares of its own entry."""
    row = np.zeros(terms)
    for entry in level.entries:
        row[entry.term] = entry.w / level.d
    return row


def _own_terms(model: logit.Fit, base_level, places, terms, spark) -> DataFrame:
    """The flag, the levels of all factors but the widest, and the intercept, which is the base level's."""
    u = _row_of(base_level, len(model.slopes))
    variances = [*np.diag(model.inverse), 1 / base_level.d + u @ model.inverse @ u]
    errors = np.sqrt(variances) if model.identified else np.full(len(variances), np.nan)
    estimates = [*model.slopes, base_level.alpha]
    rows = [(*at, term, float(b), float(e)) for at, term, b, e in zip(places, terms, estimates, errors)]
    return spark.createDataFrame(rows, "place int, level string, term string, coefficient double, std_error double")


def _level_terms(model: logit.Fit, base_level, place: int, factor: str) -> DataFrame:
    """The widest factor's levels against its base level."""
    u = _row_of(base_level, len(model.slopes))
    inverse, across = logit.constant(model.inverse.tolist(), "array<array<double>>"), logit.constant((model.inverse @ u).tolist())

    def over(each):
        return F.aggregate("entries", F.lit(0.0), lambda s, e: s + e["w"] * each(e["term"])) / F.col("d")

    own = over(lambda t: over(lambda v: F.get(F.get(inverse, t), v)))
    variance = 1 / F.col("d") + own - 2 * over(lambda t: F.get(across, t)) + float(1 / base_level.d + u @ model.inverse @ u)
    return model.levels.where(F.col("level") != base_level.level).select(
        F.lit(place).alias("place"),
        "level",
        F.concat(F.lit(f"{factor}="), "level").alias("term"),
        (F.col("alpha") - base_level.alpha).alias("coefficient"),
        (F.sqrt(variance) if model.identified else F.lit(float("nan"))).alias("std_error"),
    )
