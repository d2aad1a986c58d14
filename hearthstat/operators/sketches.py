"""Stored summaries that can be merged: approximate quantiles and distinct counts.

A sketch of a fixed size stands for the rows of a group, say a year. Sketches of several
groups combine to that of all their rows, without reading them again, and no group's
rows meet in one task. The exact forms stay the default of every published table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Values that a quantile sketch keeps on its widest level, and the logarithm of a counting sketch's registers.
QUANTILE_K = 2000
DISTINCT_LG_K = 14


def rank_error(k: int = QUANTILE_K) -> float:
    """The share of the rows by which a quantile's rank is off, at most, with odds of 99 in 100."""
    return 2.296 / k**0.9021


def distinct_error(lg_k: int = DISTINCT_LG_K) -> float:
    """The relative standard error of a distinct count."""
    return 1.04 / 2 ** (lg_k / 2)


def sketches(
    df: DataFrame,
    by: list[str],
    quantiles: dict[str, str] | None = None,
    distinct: dict[str, list[str]] | None = None,
    k: int = QUANTILE_K,
    lg_k: int = DISTINCT_LG_K,
) -> DataFrame:
    """One row for each group: ``n`` and a binary sketch under each new name.

    ``quantiles`` maps names to numeric columns; missing values and NaNs are left out.
    ``distinct`` maps names to lists of columns whose combinations are counted; one that
    is missing in part or in whole counts like any other, as in the exact tables.
    """
    quantiles, distinct = quantiles or {}, distinct or {}

    def value(c: str) -> Column:
        x = F.col(c).cast("double")
        return F.when(~F.isnan(x), x)

    def combination(cols: list[str]) -> Column:
        return F.to_json(F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(cols)]), {"ignoreNullFields": "false"})

    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.kll_sketch_agg_double(value(c), F.lit(k)).alias(name) for name, c in quantiles.items()],
        *[F.hll_sketch_agg(combination(cols), F.lit(lg_k)).alias(name) for name, cols in distinct.items()],
    )


def merged(stored: DataFrame, by: list[str], quantiles: list[str] = (), distinct: list[str] = ()) -> DataFrame:
    """Sketches of coarser groups from stored ones, whatever they were grouped by."""
    return stored.groupBy(*by).agg(
        F.sum("n").alias("n"),
        *[F.kll_merge_agg_double(c).alias(c) for c in quantiles],
        *[F.hll_union_agg(c).alias(c) for c in distinct],
    )


def quantile_of(sketch: str, p: float = 0.5) -> Column:
    """The value of rank ``p``, NULL for a sketch of no values."""
    return F.when(F.kll_sketch_get_n_double(sketch) > 0, F.kll_sketch_get_quantile_double(sketch, F.lit(float(p))))


def distinct_of(sketch: str) -> Column:
    return F.hll_sketch_estimate(sketch)
