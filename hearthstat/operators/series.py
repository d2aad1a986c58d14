"""Ordering, base-period indexes and reshaping of summary tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.semantics import ratio
from .staging import checkpointed


def arrange(df: DataFrame, *cols: str | Column) -> DataFrame:
    """Ascending sort with missing values last."""
    return df.orderBy(*[F.asc_nulls_last(c) if isinstance(c, str) else c.asc_nulls_last() for c in cols])


def numbered(df: DataFrame, order: list[Column] | None = None, name: str = "row", start: int = 1) -> DataFrame:
    """Rows numbered from ``start``, in ``order`` or, without one, as they lie (a sorted table's own order).

    Rows are dealt into ranges of the order, which also part rows that are all alike, and
    keep their place in the range; each range is then moved by the rows before it. Only
    one number for every range reaches the driver. The rows are written once to the
    checkpoint folder, so that a range has the same rows in both steps.
    """
    rows = df
    if order is not None:
        rows = df.withColumn("__tie", F.monotonically_increasing_id())
        order = [*order, F.col("__tie")]
        rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("__tie")
    rows = checkpointed(rows.withColumn("__place", F.monotonically_increasing_id()))
    part = F.shiftright("__place", 33)
    sizes = rows.groupBy(part.alias("part")).count().orderBy("part").collect()
    offsets, at = [], start
    for r in sizes:
        offsets.append((r["part"], at))
        at += r["count"]
    before = df.sparkSession.createDataFrame(offsets, "__part long, __before long")
    placed = rows.join(F.broadcast(before), part == F.col("__part"))
    within = F.col("__place").bitwiseAND((1 << 33) - 1)
    return placed.select(*[F.col(f"`{c}`") for c in df.columns], (F.col("__before") + within).alias(name))


def index_to_base(
    df: DataFrame, indexes: dict[str, str], by: list[str], order: str = "year", base: int | None = None
) -> DataFrame:
    """Add columns ``measure / base measure * 100`` within each ``by`` group.

    ``indexes`` maps the new column to the measure. The base is the first
    period, or the period ``base``; over a base of 0 the index is infinite, or
    NULL where the measure is 0 too. For already aggregated tables: a group is
    one series with one row per period, so its window partition holds only as
    many rows as there are periods.
    """
    series = Window.partitionBy(*by)
    whole = series.orderBy(F.asc_nulls_last(order)).rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )

    def at_base(measure: str) -> Column:
        if base is None:
            return F.first_value(measure).over(whole)
        return F.max(F.when(F.col(order) == base, F.col(measure))).over(series)

    return df.withColumns({new: ratio(m, at_base(m)) * 100 for new, m in indexes.items()})


def longer(df: DataFrame, cols: list[str], names_to: str, values_to: str = "value") -> DataFrame:
    """Wide to long over ``cols``; all other columns repeat."""
    ids = [c for c in df.columns if c not in cols]
    wide = df.select(*ids, *[F.col(c).cast("double") for c in cols])
    return wide.unpivot(ids, cols, names_to, values_to)


def wider(df: DataFrame, ids: list[str], names_from: str, values: list, agg: Column) -> DataFrame:
    """Long to wide. The column values are given, so no pass is spent finding them."""
    return df.groupBy(*ids).pivot(names_from, values).agg(agg)


def columns_between(df: DataFrame, first: str, last: str) -> list[str]:
    """Names from ``first`` to ``last`` in table order, both included."""
    return df.columns[df.columns.index(first) : df.columns.index(last) + 1]


def columns_containing(df: DataFrame, text: str) -> list[str]:
    """Names with ``text`` in them, ignoring case."""
    return [c for c in df.columns if text.lower() in c.lower()]


def stack_rows(*dfs: DataFrame) -> DataFrame:
    """Union by name; a column some table lacks is NULL there."""
    out = dfs[0]
    for df in dfs[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out
