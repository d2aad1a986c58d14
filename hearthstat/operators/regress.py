"""No-intercept least squares with confidence intervals.

The first factor is coded in full, every other factor against its first level,
and rows with a missing value are left out. Columns that earlier ones determine
are dropped in term order. Work over the rows is one Spark aggregation in either
form; only matrices of the listed terms' size reach the driver.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark import StorageLevel
from pyspark.ml.feature import OneHotEncoder, StringIndexerModel, VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.classify import rank_of
from .absorb import fit_absorbed
from .linear import gram, independent, independent_columns, triangle
from .polynomials import Poly, orthogonal

# Two-sided 95% normal quantile.
Z95 = 1.959963984540054
# The most listed terms, as their cross-product is solved on the driver. A factor of more
# levels is absorbed; its coefficients are then rows of a distributed table.
LISTED_TERMS = 4096
# The most listed terms for which rows are factored orthogonally. With more, their
# cross-product is solved, which tells columns apart to a hundredth of that only.
QR_TERMS = 256

COEF_SCHEMA = "term string, estimate double, std_error double, ci_low double, ci_high double, n long"


def coefficient_columns(z: float = Z95) -> list[Column]:
    """Interval columns from estimate and std_error."""
    half = F.col("std_error") * F.lit(float(z))
    return [(F.col("estimate") - half).alias("ci_low"), (F.col("estimate") + half).alias("ci_high")]


def group_mean_ols(
    df: DataFrame, y: str, factor: str, z: float = Z95, levels: list[str] | None = None, keep: int | None = None
) -> DataFrame:
    """``y ~ 0 + factor`` in closed form: group means with the pooled variance.

    In order of ``levels``, others after them by name; optionally the first ``keep``.
    """
    g = F.col(factor).cast("string")
    groups = (
        df.filter(F.col(y).isNotNull() & F.col(factor).isNotNull())
        .groupBy(g.alias("term"))
        .agg(
            F.avg(y).alias("estimate"),
            F.count(F.lit(1)).alias("n"),
            (F.coalesce(F.var_samp(y), F.lit(0.0)) * (F.count(F.lit(1)) - 1)).alias("__ss"),
        )
    )
    # Over the levels' rows, which the table lists and sorts anyway; the table is read once.
    levels_all = Window.partitionBy(F.lit(0))
    pooled = F.try_divide(
        F.sum("__ss").over(levels_all), F.sum("n").over(levels_all) - F.count(F.lit(1)).over(levels_all)
    )
    table = groups.withColumn("std_error", F.sqrt(pooled / F.col("n")))
    order = [rank_of("term", levels)] if levels else []
    table = table.orderBy(*[c.asc_nulls_last() for c in order], "term")
    table = table.select("term", "estimate", "std_error", *coefficient_columns(z), "n")
    return table if keep is None else table.limit(keep)


@dataclass
class Factor:
    """Categorical term. ``levels`` in order, or None to use the sorted values found.

    An absorbed factor (a census tract, say) may have any number of levels, in the order
    of their names. The table of the fit is the same; one or two factors of a formula, not
    the first, can be absorbed.
    """

    name: str
    levels: list[str] | None = None
    absorb: bool = False


@dataclass
class Effects:
    """An absorbed factor's coefficients: ``size`` rows (level, estimate, std_error) after the first ``before`` terms."""

    name: str
    before: int
    rows: DataFrame
    size: int


@dataclass
class Fit:
    """Coefficients in term order; aliased terms are listed apart.

    ``absorbed`` holds those of absorbed factors, as distributed tables.
    """

    terms: list[str]
    estimate: np.ndarray
    cov: np.ndarray
    n: int
    df_residual: int
    sigma2: float
    aliased: list[str] = field(default_factory=list)
    absorbed: list[Effects] = field(default_factory=list)

    @property
    def std_error(self) -> np.ndarray:
        return np.sqrt(np.maximum(np.diag(self.cov), 0.0))

    @property
    def effects(self) -> DataFrame | None:
        """All coefficients of absorbed factors, with the terms' names."""
        return reduce(DataFrame.unionByName, [self._named(e, e.rows) for e in self.absorbed]) if self.absorbed else None

    def _named(self, effects: Effects, rows: DataFrame) -> DataFrame:
        term = F.concat(F.lit(f"{effects.name}:"), F.col("level")).alias("term")
        return rows.select(term, "estimate", "std_error", F.lit(self.n).cast("long").alias("n"))

    def table(self, spark: SparkSession, z: float = Z95, keep: int | None = None) -> DataFrame:
        """Coefficient table, optionally only the first ``keep`` terms, as if all levels were listed."""
        rows = [(t, float(b), float(s), self.n) for t, b, s in zip(self.terms, self.estimate, self.std_error)]
        cuts = [e.before for e in self.absorbed]
        parts, left = [], keep
        for i, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(rows)])):
            some = rows[a:b] if left is None else rows[a:b][:left]
            if some:
                parts.append(spark.createDataFrame(some, "term string, estimate double, std_error double, n long"))
            left = None if left is None else left - len(some)
            if i < len(self.absorbed) and left != 0:
                e = self.absorbed[i]
                parts.append(self._named(e, e.rows if left is None else e.rows.orderBy("level").limit(left)))
                left = None if left is None else left - min(left, e.size)
        if not parts:
            return spark.createDataFrame([], COEF_SCHEMA)
        table = reduce(DataFrame.unionByName, parts)
        return table.select("term", "estimate", "std_error", *coefficient_columns(z), "n")


def _profile(data: DataFrame, factors: list[Factor], numbers: list[str]) -> tuple[dict, int, dict]:
    """Levels that occur in level order, row count, and column means, from one aggregation.

    Rows are combined per factor level, so what reaches the driver is one row
    per level, at most LISTED_TERMS + 1 of them.
    """
    tags = F.array(*[F.struct(F.lit(i).alias("f"), F.col(f.name).alias("v")) for i, f in enumerate(factors)])
    rows = (
        data.select(F.explode(tags).alias("__t"), *numbers)
        .groupBy("__t.f", "__t.v")
        .agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(c) for c in numbers])
        .limit(LISTED_TERMS + 1)
        .collect()
    )
    if len(rows) > LISTED_TERMS:
        raise ValueError(f"more than {LISTED_TERMS} factor levels; absorb the widest")
    levels = {}
    for i, f in enumerate(factors):
        seen = {r["v"] for r in rows if r["f"] == i}
        levels[f.name] = [v for v in f.levels if v in seen] if f.levels else sorted(seen)
    # Every row falls in exactly one level of the first factor.
    base = [r for r in rows if r["f"] == 0]
    n = sum(r["n"] for r in base)
    means = {c: sum(r[c] * r["n"] for r in base) / n for c in numbers} if n else {}
    return levels, n, means


def solve_normal(gram: np.ndarray, n: int, names: list[str]) -> Fit:
    """Solve from the cross-product of [X y], dropping aliased columns in term order."""
    k = len(names)
    xtx, xty, yty = gram[:k, :k], gram[:k, k], gram[k, k]
    kept = independent(xtx, np.diag(xtx))
    inv = np.linalg.inv(xtx[np.ix_(kept, kept)])
    beta = inv @ xty[kept]
    dof = n - len(kept)
    sigma2 = float(max(yty - beta @ xty[kept], 0.0) / dof) if dof > 0 else float("nan")
    dropped = [names[j] for j in range(k) if j not in kept]
    return Fit([names[j] for j in kept], beta, inv * sigma2, n, dof, sigma2, dropped)


def solve_triangle(factor: np.ndarray, n: int, names: list[str]) -> Fit:
    """Solve from the triangular factor of [X y], dropping aliased columns in term order."""
    k = len(names)
    kept, basis, r = independent_columns(factor, k)
    along = basis.T @ factor[:, k]
    left = factor[:, k] - basis @ along
    inv = np.linalg.inv(r)
    dof = n - len(kept)
    sigma2 = float(left @ left / dof) if dof > 0 else float("nan")
    dropped = [names[j] for j in range(k) if j not in kept]
    return Fit([names[j] for j in kept], inv @ along, inv @ inv.T * sigma2, n, dof, sigma2, dropped)


Term = Factor | Poly | str


def formula_ols(df: DataFrame, y: str, first: Factor, terms: list[Term]) -> Fit:
    """``y ~ 0 + first + terms``; a plain string is a numeric covariate, a ``Poly`` orthogonal polynomials of one.

    Jobs over the complete rows, which are kept while they run: factor levels
    and means, and one orthogonal factorisation, or cross-product where factors
    are absorbed or terms are many. Covariates are centred before that, which
    keeps year-like columns from drowning the rest; the shift is undone afterwards.
    """
    factors = [first, *[t for t in terms if isinstance(t, Factor)]]
    numbers = list(dict.fromkeys(t if isinstance(t, str) else t.name for t in terms if not isinstance(t, Factor)))
    absorbed = [f for f in factors if f.absorb]
    if len(absorbed) > 2 or first.absorb:
        raise ValueError("one or two factors, and not the first, can be absorbed")
    data = df.select(
        F.col(y).cast("double").alias("__y"),
        *[F.col(f.name).cast("string").alias(f.name) for f in factors],
        *[F.col(c).cast("double").alias(c) for c in numbers],
    ).dropna()
    for f in factors:
        if f.levels:
            data = data.filter(F.col(f.name).isin(f.levels))
    data = data.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        listed: list[Factor | str] = []
        curves = {}
        for t in terms:
            if isinstance(t, Poly):
                columns = orthogonal(data, t.name, t.degree).columns(F.col(t.name))
                names = [t.term(j + 1) for j in range(t.degree)]
                curves |= dict(zip(names, columns))
                listed += names
            else:
                listed.append(t)
        coded = data.withColumns(curves) if curves else data
        return _fit_absorbed(coded, first, listed) if absorbed else _fit(coded, first, listed)
    finally:
        data.unpersist()


@dataclass
class _Design:
    """Coded rows (vector column ``__x`` = terms then y) and what is known about them."""

    rows: DataFrame
    names: list[str]
    levels: dict[str, list[str]]
    n: int
    centre: dict[str, float]


def _code(data: DataFrame, first: Factor, terms: list[Factor | str], keep: tuple[str, ...] = ()) -> _Design:
    """Dummies, of all levels for the first factor, and centred covariates."""
    factors = [first, *[t for t in terms if isinstance(t, Factor)]]
    numbers = [t for t in terms if isinstance(t, str)]
    levels, n, centre = _profile(data, factors, [*numbers, "__y"])
    if n == 0:
        raise ValueError("no complete rows to fit")
    coded = data.select(
        *keep,
        *[F.col(f.name) for f in factors],
        *[(F.col(c) - F.lit(centre[c])).alias(c) for c in [*numbers, "__y"]],
    )
    names: list[str] = []
    inputs: list[str] = []
    for t in [first, *terms]:
        if isinstance(t, str):
            names.append(t)
            inputs.append(t)
            continue
        lv = levels[t.name]
        every = t is first
        if not every and len(lv) == 1:
            continue
        # The encoder drops the last category, so the reference level goes last.
        order = lv if every else lv[1:] + lv[:1]
        index = StringIndexerModel.from_labels(order, inputCol=t.name, outputCol=f"__i_{t.name}")
        one_hot = OneHotEncoder(inputCol=f"__i_{t.name}", outputCol=f"__v_{t.name}", dropLast=not every)
        coded = index.transform(coded)
        coded = one_hot.fit(coded).transform(coded)
        names += [f"{t.name}:{v}" for v in (lv if every else lv[1:])]
        inputs.append(f"__v_{t.name}")
    rows = VectorAssembler(inputCols=[*inputs, "__y"], outputCol="__x").transform(coded)
    return _Design(rows.select(*keep, "__x"), names, levels, n, centre)


def _uncentred(fit: Fit, d: _Design, first: Factor) -> Fit:
    """Undo the centring of covariates and y.

    The first factor's dummies add up to 1, so shifting a covariate (or y)
    shifts exactly those coefficients.
    """
    of_first = np.array([t in d.names[: len(d.levels[first.name])] for t in fit.terms])
    back = np.eye(len(fit.terms))
    for j, term in enumerate(fit.terms):
        back[of_first, j] -= d.centre.get(term, 0.0)
    fit.estimate = back @ fit.estimate + np.where(of_first, d.centre["__y"], 0.0)
    fit.cov = back @ fit.cov @ back.T
    return fit


def _fit(data: DataFrame, first: Factor, terms: list[Factor | str]) -> Fit:
    d = _code(data, first, terms)
    if len(d.names) <= QR_TERMS:
        return _uncentred(solve_triangle(triangle(d.rows, "__x", len(d.names) + 1), d.n, d.names), d, first)
    return _uncentred(solve_normal(gram(d.rows, "__x"), d.n, d.names), d, first)


def _fit_absorbed(data: DataFrame, first: Factor, terms: list[Factor | str]) -> Fit:
    """The same fit with one or two factors' levels taken out before solving."""
    absorbed = [t.name for t in terms if isinstance(t, Factor) and t.absorb]
    rest = [t for t in terms if not (isinstance(t, Factor) and t.absorb)]
    d = _code(data, first, rest, keep=tuple(absorbed))
    place: list[int] = []
    for i, t in enumerate([first, *terms]):
        if isinstance(t, Factor) and t.absorb:
            continue
        width = 1 if isinstance(t, str) else len(d.levels[t.name]) - (i > 0)
        place += [sum(isinstance(u, Factor) and u.absorb for u in terms[: max(i - 1, 0)])] * width
    solved = fit_absorbed(d.rows, absorbed, place, d.n)
    names = [d.names[j] for j in solved.kept]
    dropped = [d.names[j] for j in range(len(d.names)) if j not in solved.kept]
    effects = [
        Effects(f, sum(place[j] <= i for j in solved.kept), rows, size)
        for i, (f, rows, size) in enumerate(zip(absorbed, solved.effects, solved.levels))
    ]
    fit = Fit(names, solved.estimate, solved.cov, d.n, solved.dof, solved.sigma2, dropped, effects)
    return _uncentred(fit, d, first)
