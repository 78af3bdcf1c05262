"""Logistic regression on counted cells, with one intercept per level of a factor that may have any number of levels.

A cell is a combination of a level and the terms that hold in it, with how many records it counts (``n``) and how many of
them had the outcome (``y``). The intercepts' block of the information matrix is diagonal, as a cell has one level. Grouped
sums per level therefore eliminate it, and what is left for the driver is the Schur complement over the other terms. The
levels, their intercepts and their steps stay in tables.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coverlens.session import stored

TOLERANCE = 1e-14  # of the squared last step, measured in standard errors
MOST_STEPS = 100
HALVINGS = 6
SMALL = 4_000_000  # cells times terms that a fit on the driver may take, 32 MB
DEPENDENT = 1e-9  # share of a term's information that the other terms and levels leave, below which it is none


@dataclass
class Fit:
    """Estimates; ``levels`` holds level, alpha (intercept), d and entries (its row of the information matrix)."""

    levels: DataFrame
    slopes: np.ndarray
    inverse: np.ndarray  # of the Schur complement: covariance of the slopes
    identified: bool


@dataclass
class _State:
    """Sums at one point, and the Newton step from there."""

    levels: DataFrame
    slopes: np.ndarray
    inverse: np.ndarray
    identified: bool
    step: np.ndarray
    objective: float
    decrement: float

    def moved(self, share: float = 1.0) -> tuple[DataFrame, np.ndarray]:
        steps = constant(self.step.tolist())
        carried = F.aggregate("entries", F.lit(0.0), lambda s, e: s + e["w"] * F.get(steps, e["term"]))
        moved = F.col("alpha") + share * (F.col("g") - carried) / F.col("d")
        return self.levels.withColumn("alpha", moved), self.slopes + share * self.step


def constant(values: list, kind: str = "array<double>") -> Column:
    """A small array of the driver's as a single literal."""
    return F.from_json(F.lit(json.dumps(values)), kind)


def _sums(cells: DataFrame, levels: DataFrame, slopes: np.ndarray, inverse: np.ndarray | None = None) -> DataFrame:
    """Information, score and likelihood, summed per level and pair of terms (-1: the level's own intercept).

    The score is taken from counts, which are exact, and fitted sums: levels that agree in these get the same bits.
    With the inverse of the information at this very point, and ``levels`` with their rows of it, the score is the penalised one.
    """
    beta = constant(slopes.tolist())
    if inverse is not None:
        cov = constant(inverse.tolist(), "array<array<double>>")
        row = lambda t: F.aggregate("entries", F.lit(0.0), lambda s, e: s + F.get(F.get(cov, t), e["term"]) * e["w"])
        levels = levels.withColumn("vu", F.transform(F.sequence(F.lit(0), F.lit(len(slopes) - 1)), lambda t: row(t) / F.col("d")))
        levels = levels.withColumn("q", F.aggregate("entries", F.lit(0.0), lambda s, e: s + F.get("vu", e["term"]) * e["w"]) / F.col("d"))
        levels = levels.select("level", "alpha", "d", "vu", "q")
    else:
        levels = levels.select("level", "alpha")
    eta = F.col("alpha") + F.aggregate("terms", F.lit(0.0), lambda s, t: s + F.get(beta, t))
    scored = cells.join(levels, "level").select("*", F.inline("cells")).drop("cells").withColumn("eta", eta)
    scored = scored.withColumns({"mu": 1 / (1 + F.exp(-F.col("eta"))), "nu": 1 / (1 + F.exp("eta"))})
    missed = F.col("n") - F.col("y")
    scored = scored.withColumns(
        {
            "w": F.col("n") * F.col("mu") * F.col("nu"),
            "hit": F.col("n") * F.col("mu"),
            "miss": F.col("n") * F.col("nu"),
            "added": F.lit(0.0),
            "ll": -F.col("y") * F.log1p(F.exp(-F.col("eta"))) - missed * F.log1p(F.exp("eta")),
        }
    )
    if inverse is not None:
        own = F.aggregate(
            "terms",
            F.lit(0.0),
            lambda s, t: s + F.aggregate("terms", F.lit(0.0), lambda z, u: z + F.get(F.get(cov, t), u)) - 2 * F.get("vu", t),
        )
        leverage = F.col("w") * (1 / F.col("d") + own + F.col("q"))
        scored = scored.withColumn("added", leverage * (F.col("nu") - F.col("mu")) / 2)
    places = F.concat(F.array(F.lit(-1)), F.col("terms"))
    pairs = F.flatten(
        F.transform(
            places,
            lambda i: F.transform(F.filter(places, lambda j: j >= i), lambda j: F.struct(i.alias("i"), j.alias("j"))),
        )
    )
    measures = ["n", "y", "hit", "miss", "added", "w", "ll"]
    each = scored.select("level", "alpha", *measures, F.explode(pairs).alias("at"))
    each = each.select("level", "alpha", *measures, "at.i", "at.j")
    sums = each.groupBy("level", "i", "j").agg(F.max("alpha").alias("alpha"), *[F.sum(x).alias(x) for x in measures])
    # Of the two forms, the one whose terms are small where nearly all or nearly none have the outcome.
    score = F.when(2 * F.col("hit") > F.col("n"), F.col("miss") - missed).otherwise(F.col("y") - F.col("hit")) + F.col("added")
    return stored(sums.select("level", "i", "j", "alpha", "w", score.alias("r"), "ll"), "logit-sums")


def _state(sums: DataFrame, slopes: np.ndarray, penalised: bool) -> _State:
    itself, term = F.col("j") == -1, F.struct(F.col("j").alias("term"), "w", "r")
    levels = (
        sums.where("i = -1")
        .groupBy("level")
        .agg(
            F.max("alpha").alias("alpha"),
            F.max(F.when(itself, F.col("w"))).alias("d"),
            F.max(F.when(itself, F.col("r"))).alias("g"),
            F.max(F.when(itself, F.col("ll"))).alias("ll"),
            F.array_sort(F.collect_list(F.when(~itself, term))).alias("entries"),
        )
    )
    nothing = F.lit(0.0)
    raw = sums.where("i >= 0").select("i", "j", F.col("w").alias("raw"), "w", nothing.alias("r"), nothing.alias("ll"))
    # A level's row times itself: no more entries than there are terms besides the levels.
    rest = levels.select("d", "g", "entries", F.explode("entries").alias("a")).select(
        "d", "g", "a", F.explode(F.filter("entries", lambda e: e["term"] >= F.col("a.term"))).alias("b")
    )
    rest = rest.select(
        F.col("a.term").alias("i"),
        F.col("b.term").alias("j"),
        nothing.alias("raw"),
        (-F.col("a.w") * F.col("b.w") / F.col("d")).alias("w"),
        F.when(F.col("a.term") == F.col("b.term"), F.col("a.r") - F.col("a.w") * F.col("g") / F.col("d")).otherwise(0.0).alias("r"),
        nothing.alias("ll"),
    )
    whole = levels.select(
        F.lit(-1).alias("i"),
        F.lit(-1).alias("j"),
        nothing.alias("raw"),
        F.ln("d").alias("w"),
        (F.col("g") * F.col("g") / F.col("d")).alias("r"),
        "ll",
    )
    totals = raw.union(rest).union(whole).groupBy("i", "j").agg(*[F.sum(x).alias(x) for x in ("raw", "w", "r", "ll")])
    p = len(slopes)
    matrix, score, size = np.zeros((p, p)), np.zeros(p), np.ones(p)
    log_d = own = likelihood = 0.0
    for i, j, a, w, r, ll in totals.collect():
        if i < 0:
            log_d, own, likelihood = w, r, ll
            continue
        matrix[i, j] = matrix[j, i] = w
        if i == j:
            score[i], size[i] = r, a
    return _State(levels, slopes, *_solved(matrix, score, size, log_d, own, likelihood, penalised))


def _solved(matrix, score, size, log_d, own, likelihood, penalised):
    """Covariance of the slopes, whether all are identified, their step, the objective and the squared step of everything."""
    scale = 1 / np.sqrt(np.maximum(size, np.finfo(float).tiny))
    values, vectors = np.linalg.eigh(matrix * scale[:, None] * scale)
    good = values > DEPENDENT
    inverse = (vectors[:, good] / values[good]) @ vectors[:, good].T * scale[:, None] * scale
    step = inverse @ score
    if penalised:
        likelihood += (log_d + np.log(values[good]).sum() - 2 * np.log(scale).sum()) / 2
    return inverse, bool(good.all()), step, float(likelihood), float(own + score @ step)


class _Counted:
    """Cells on the driver: the same sums and steps as those of the tables.

    Sums run in the order of levels and terms, and rows are multiplied one by one: levels that agree get the same bits.
    """

    def __init__(self, cells: DataFrame, terms: int):
        self.spark, rows = cells.sparkSession, cells.select("level", "terms", "n", "y").collect()
        rows.sort(key=lambda r: (r.level, r.terms))
        self.names = sorted({r.level for r in rows})
        at = {level: i for i, level in enumerate(self.names)}
        self.level = np.array([at[r.level] for r in rows])
        self.n, self.y = (np.array([r[c] for r in rows]) for c in ("n", "y"))
        self.x = np.zeros((len(rows), terms))
        for i, r in enumerate(rows):
            self.x[i, r.terms] = 1.0

    def per_level(self, values):
        return np.bincount(self.level, values, len(self.names))

    def start(self):
        n, y = self.per_level(self.n), self.per_level(self.y)
        return np.log((y + 0.5) / (n - y + 0.5)), None, None

    def state(self, levels, slopes, penalised) -> _CountedState:
        alpha = levels[0]
        eta = alpha[self.level] + (self.x * slopes).sum(1)
        mu, nu = 1 / (1 + np.exp(-eta)), 1 / (1 + np.exp(eta))
        n, y, hit, miss = map(self.per_level, (self.n, self.y, self.n * mu, self.n * nu))
        own = np.where(2 * hit > n, miss - (n - y), y - hit)
        w, r = self.n * mu * nu, self.y * nu - (self.n - self.y) * mu
        likelihood = -(self.y * np.log1p(np.exp(-eta)) + (self.n - self.y) * np.log1p(np.exp(eta))).sum()
        d = self.per_level(w)
        carried = np.stack([self.per_level(w * x) for x in self.x.T], axis=1)
        raw = self.x.T @ (w[:, None] * self.x)
        matrix = raw - carried.T @ (carried / d[:, None])

        def solved(r, g):
            score = self.x.T @ r - carried.T @ (g / d)
            return *_solved(matrix, score, np.diag(raw), np.log(d).sum(), (g * g / d).sum(), likelihood, penalised), g

        found = solved(r, own)
        if penalised:
            apart = self.x - (carried / d[:, None])[self.level]
            added = w * (1 / d[self.level] + ((apart @ found[0]) * apart).sum(1)) * (nu - mu) / 2
            found = solved(r + added, own + self.per_level(added))
        return _CountedState((alpha, d, carried), slopes, *found)

    def table(self, levels) -> DataFrame:
        alpha, d, carried = levels
        rows = [
            (name, float(a), float(b), [(int(t), float(row[t])) for t in np.flatnonzero(row)])
            for name, a, b, row in zip(self.names, alpha, d, carried)
        ]
        return self.spark.createDataFrame(rows, "level string, alpha double, d double, entries array<struct<term:int,w:double>>")


@dataclass
class _CountedState(_State):
    levels: tuple
    g: np.ndarray

    def moved(self, share: float = 1.0):
        alpha, d, carried = self.levels
        return (alpha + share * (self.g - (carried * self.step).sum(1)) / d, d, carried), self.slopes + share * self.step


def fit(cells: DataFrame, terms: int, penalised: bool = False, n_cells: int | None = None, small: int = SMALL) -> Fit:
    """Fits ``cells`` (level, terms: ascending numbers below ``terms``, n, y) by Newton's method, with steps halved that make it worse.

    ``penalised`` adds half the log determinant of the information to the likelihood (Jeffreys' prior), which
    keeps all estimates finite. Without it a level or term whose records all agree has no finite estimate: it grows by about
    one a step until the likelihood no longer notices. The sums take two jobs a step, four if penalised; the driver holds
    ``terms`` squared numbers. If ``n_cells`` is told and ``n_cells * terms`` is at most ``small``, the cells are fetched once and the driver takes
    the same steps on them.
    """
    if n_cells is not None and n_cells * terms <= small:
        counted = _Counted(cells, terms)
        levels, *rest = _steps(counted.state, counted.start(), terms, penalised)
        return Fit(counted.table(levels), *rest)
    totals = cells.groupBy("level").agg(F.sum("n").alias("n"), F.sum("y").alias("y"))
    # A level's cells in one row, in order, so that its sums do not depend on how rows arrive.
    cells = stored(cells.groupBy("level").agg(F.array_sort(F.collect_list(F.struct("terms", "n", "y"))).alias("cells")), "logit-cells")
    start = F.ln((F.col("y") + 0.5) / (F.col("n") - F.col("y") + 0.5))

    def state(levels, slopes, penalised):
        found = _state(_sums(cells, levels, slopes), slopes, penalised)
        return _state(_sums(cells, found.levels, slopes, found.inverse), slopes, penalised) if penalised else found

    return Fit(*_steps(state, totals.select("level", start.alias("alpha")), terms, penalised))


def _steps(state_at, levels, terms: int, penalised: bool):
    slopes, last, halved = np.zeros(terms), None, 0
    for _ in range(MOST_STEPS):
        state = state_at(levels, slopes, penalised)
        if last and halved < HALVINGS and state.objective < last.objective - 1e-9 * abs(last.objective):
            halved += 1
            levels, slopes = last.moved(0.5**halved)
            continue
        levels, slopes = state.moved()
        last, halved = state, 0
        if state.decrement < TOLERANCE:
            break
    return levels, slopes, last.inverse, last.identified
