"""Exact weighted quantiles that never bring a whole group to one task.

``percentile`` and a window over the group both gather every distinct value of
a group in one place. Here the rank is narrowed first:

1. rows are combined to (group, value, weight) - a shuffle with map-side combine;
2. those are combined again to a histogram on a coarse key that never
   decreases as the value grows, so it can be read without sorting values;
3. a running total over the histogram finds the one or two bars that hold the
   wanted ranks;
4. only the values inside those bars are sorted.

Ranks follow the rule: position 1 + (n - 1) p in the weight-expanded sample,
interpolated between its two neighbours. Weights may be fractional; zero
weights are ignored. p = 0.5 without weights is the ordinary median.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Histogram bars per unit of log-value: a bar is about 0.01% wide, so money
# amounts from 1 to ten million take some 130,000 bars, and a bar at 50,000
# spans about 6.
BARS = 8192


def _bar(value: Column, bars: int) -> Column:
    return F.floor(F.signum(value) * F.log1p(F.abs(value)) * bars)


def grouped_quantile(
    df: DataFrame,
    keys: list[str],
    measures: dict[str, str],
    p: float = 0.5,
    weight: str | None = None,
    na_rm: bool = False,
    bars: int = BARS,
    totals: dict[str, Column] | None = None,
) -> DataFrame:
    """One row per group with the ``p`` quantile of each measure.

    ``measures`` maps output names to input columns; they share one pass over
    the data. A NULL value makes the group's result NULL unless ``na_rm``,
    where rows with a NULL value or weight are left out. The result does not
    depend on ``bars``; raise it where very many different values crowd together.

    ``totals`` are columns summed over all rows of each group in the same pass; a
    NULL among them makes the total NULL.
    """
    w = F.lit(1).cast("long") if weight is None else F.col(weight)
    names = list(measures)
    sums = {f"__t{i}": c for i, c in enumerate((totals or {}).values())}
    holes = [f"{t}_null" for t in sums]
    grp = [f"__k{i}" for i in range(len(keys))] + ["__m"]

    long = df.select(
        *[F.col(k).alias(g) for k, g in zip(keys, grp)],
        w.alias("__w"),
        *[c.alias(t) for t, c in sums.items()],
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(i).alias("m"), F.col(measures[n]).cast("double").alias("v"))
                    for i, n in enumerate(names)
                ]
            )
        ).alias("__x"),
    ).select(
        *grp[:-1],
        F.col("__x.m").alias("__m"),
        F.when(~F.isnan("__x.v"), F.col("__x.v")).alias("__v"),
        "__w",
        *sums,
    )
    if na_rm:
        # Keep a zero-weight marker so that a group of only NULLs still appears.
        unusable = F.col("__v").isNull() | F.col("__w").isNull()
        long = long.withColumns(
            {"__w": F.when(unusable, 0).otherwise(F.col("__w")), "__v": F.when(~unusable, F.col("__v"))}
        )

    counts = (
        long.groupBy(*grp, "__v")
        .agg(
            F.sum("__w").alias("__w"),
            *[F.sum(t).alias(t) for t in sums],
            *[F.bool_or(F.col(t).isNull()).alias(h) for t, h in zip(sums, holes)],
        )
        .withColumn("__bar", _bar(F.col("__v"), bars))
    )
    series = Window.partitionBy(*grp)
    running = series.orderBy(F.asc_nulls_first("__bar"))
    histogram = (
        counts.groupBy(*grp, "__bar")
        .agg(
            F.sum(F.when(F.col("__v").isNotNull(), F.col("__w")).otherwise(0)).alias("__bw"),
            *[F.sum(t).alias(t) for t in sums],
            *[F.bool_or(h).alias(h) for h in holes],
        )
        .withColumns(
            {
                "__upto": F.sum("__bw").over(running.rowsBetween(Window.unboundedPreceding, 0)),
                "__n": F.sum("__bw").over(series),
                "__has_null": F.bool_or(F.col("__bar").isNull()).over(series),
                **{t: F.when(~F.bool_or(h).over(series), F.sum(t).over(series)) for t, h in zip(sums, holes)},
            }
        )
    )
    position = 1 + (F.col("__n") - 1) * F.lit(float(p))
    histogram = histogram.withColumns(
        {
            "__lo": F.when(
                F.col("__n") > 0, F.least(F.greatest(F.floor(position), F.lit(1)), F.col("__n"))
            ),
            "__frac": position - F.floor(position),
        }
    ).withColumns(
        {
            "__hi": F.when(F.col("__n") > 0, F.least(F.col("__lo") + 1, F.col("__n"))),
            "__before": F.col("__upto") - F.col("__bw"),
        }
    )

    def holds(rank: str) -> Column:
        return (F.col("__before") < F.col(rank)) & (F.col(rank) <= F.col("__upto"))

    # A group without any weight keeps its bars and ends up NULL.
    wanted = histogram.filter(holds("__lo") | holds("__hi") | (F.col("__n") == 0)).select(
        *[F.col(g).alias(f"__r{g}") for g in [*grp, "__bar"]],
        "__before", "__lo", "__hi", "__frac", "__has_null", *[F.col(t).alias(f"__r{t}") for t in sums],
    )
    same = F.lit(True)
    for g in [*grp, "__bar"]:
        same = same & F.col(g).eqNullSafe(F.col(f"__r{g}"))

    def value_at(rank: str) -> Column:
        # Fractional weights added in another order may end a hair below the
        # last rank; the largest value is then the one meant.
        at_or_above = F.min(F.when(F.col("__rank") >= F.col(rank), F.col("__v")))
        return F.coalesce(at_or_above, F.max(F.when(F.col(rank).isNotNull(), F.col("__v"))))

    inside = Window.partitionBy(*grp, "__bar").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)
    picked = (
        counts.join(wanted, same)
        .withColumn("__rank", F.col("__before") + F.sum("__w").over(inside))
        .groupBy(*grp)
        .agg(
            value_at("__lo").alias("lo"),
            value_at("__hi").alias("hi"),
            F.max("__frac").alias("frac"),
            F.bool_or("__has_null").alias("has_null"),
            *[F.max(f"__r{t}").alias(t) for t in sums],
        )
    )
    value = F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("frac")
    if not na_rm:
        value = F.when(~F.col("has_null"), value)
    return (
        picked.withColumn("__q", value)
        .groupBy(*grp[:-1])
        .agg(
            *[F.max(F.when(F.col("__m") == i, F.col("__q"))).alias(n) for i, n in enumerate(names)],
            *[F.max(F.when(F.col("__m") == 0, F.col(t))).alias(n) for t, n in zip(sums, totals or {})],
        )
        .withColumnsRenamed(dict(zip(grp, keys)))
    )


def grouped_median(
    df: DataFrame,
    keys: list[str],
    measures: dict[str, str],
    na_rm: bool = False,
    totals: dict[str, Column] | None = None,
) -> DataFrame:
    return grouped_quantile(df, keys, measures, 0.5, None, na_rm, totals=totals)
