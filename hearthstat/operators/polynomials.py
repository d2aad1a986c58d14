"""Orthogonal polynomials of a column, by the three-term recurrence over all rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Poly:
    """A numeric term of a model as orthogonal polynomials up to ``degree``."""

    name: str
    degree: int

    def term(self, j: int) -> str:
        return f"poly({self.name}, {self.degree}){j}"


@dataclass
class Recurrence:
    """p[j + 1] = (x - centre[j]) p[j] - ratio[j] p[j - 1], and each one's length over the rows."""

    centre: list[float]
    ratio: list[float]
    length: list[float]

    def columns(self, x: Column) -> list[Column]:
        """The polynomials but the constant one, each of length 1 over the rows they were fitted on."""
        x = x.cast("double")
        before, p, out = F.lit(0.0), F.lit(1.0), []
        for a, b, length in zip(self.centre, self.ratio, self.length):
            before, p = p, (x - F.lit(a)) * p - F.lit(b) * before
            out.append(p / F.lit(length))
        return out


def orthogonal(df: DataFrame, column: str, degree: int) -> Recurrence:
    """Fitted to the rows where the column is neither null nor a NaN: one aggregate for each degree, and one more.

    A degree that the column's distinct values do not reach is an error.
    """
    if degree < 1:
        raise ValueError("the degree is at least 1")
    x = F.col(column).cast("double")
    rows = df.select(x.alias("x")).filter(F.col("x").isNotNull() & ~F.isnan("x"))
    x = F.col("x")
    fit = Recurrence([], [], [])
    square = 0.0
    for j in range(degree + 1):
        p = fit.columns(x)[-1] * F.lit(fit.length[-1]) if j else F.lit(1.0)
        sums = rows.select(p.alias("p"), "x").agg(
            F.sum(F.col("p") * F.col("p")).alias("s"),
            F.try_divide(F.sum(F.col("x") * F.col("p") * F.col("p")), F.sum(F.col("p") * F.col("p"))).alias("a"),
            F.max(F.abs("p")).alias("most"),
            F.count(F.lit(1)).alias("n"),
            F.max(F.abs(F.col("x") - (F.lit(fit.centre[0]) if j else F.lit(0.0)))).alias("width"),
        ).first()
        s = sums["s"] or 0.0
        if not sums["n"] or j and s <= sums["n"] * (1e-7 * sums["width"] ** j) ** 2:
            raise ValueError(f"{column} has too few distinct values for degree {j}")
        if j:
            fit.length[-1] = s**0.5
        if j < degree:
            fit.centre.append(sums["a"])
            fit.ratio.append(s / square if j else 0.0)
            fit.length.append(1.0)
        square = s
    return fit
