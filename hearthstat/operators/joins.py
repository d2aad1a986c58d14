"""Equi-joins on shared columns where NULL matches NULL, safe under key skew.

A key that holds much of a table is left to adaptive execution, which splits its
partition by what the tasks before wrote. Unlike a salt taken from the rows' contents,
that also parts rows that are all alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Parts into which a full join deals the rows of a key.
SPREAD = 8


def shared_columns(left: DataFrame, right: DataFrame) -> list[str]:
    """Columns both sides have, in the left side's order."""
    return [c for c in left.columns if c in right.columns]


def natural_join(
    left: DataFrame,
    right: DataFrame,
    how: str = "inner",
    on: list[str] | None = None,
    null_safe: bool = True,
    reshuffle: bool = False,
) -> DataFrame:
    """Join on all shared columns (or ``on``); each key appears once in the result.

    ``null_safe`` keys compare with ``<=>``, which Spark still plans as an
    equi-join. A full join, which adaptive execution cannot split, deals the left
    side's rows of a key into parts by itself (see ``_full``).

    Adaptive execution also only splits a skewed key where both sides come
    straight from a shuffle, not where an earlier join on the key left its
    partitioning. ``reshuffle`` joins on the key's hash as well, so that both
    sides are shuffled for this join.
    """
    keys = shared_columns(left, right) if on is None else on
    if not keys:
        raise ValueError("the two sides share no column to join on")
    if how == "full":
        return _full(left, right, keys, null_safe)
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"unsupported join type {how!r}")

    if reshuffle:
        key_hash = F.xxhash64(*keys).alias("__hash")
        left, right = left.select("*", key_hash), right.select("*", key_hash)
        return natural_join(left, right, how, [*keys, "__hash"], null_safe).drop("__hash")

    renamed = right.withColumnsRenamed({k: f"__r_{k}" for k in keys})

    def same(k: str) -> Column:
        l, r = F.col(k), F.col(f"__r_{k}")
        return l.eqNullSafe(r) if null_safe else l == r

    joined = left.join(renamed, reduce(Column.__and__, [same(k) for k in keys]), how)
    return joined.drop(*[f"__r_{k}" for k in keys])


def _dealt(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """Rows with a part: the first of each key in part 0, the others in turn."""
    for batch in batches:
        if not batch.num_rows:
            continue
        numbers = [batch.column(k).dictionary_encode(null_encoding="encode").indices.to_numpy() for k in keys]
        first = np.unique(np.stack(numbers), axis=1, return_index=True)[1]
        part = np.arange(batch.num_rows, dtype=np.int32) % SPREAD
        part[first] = 0
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(part)], [*batch.schema.names, "__part"])


def _full(left: DataFrame, right: DataFrame, keys: list[str], null_safe: bool) -> DataFrame:
    """Full join that reads each side once and parts the left side's rows of a key.

    Left rows go to SPREAD parts of their key and right rows, of which a key should have
    few, to all of them. Some left row of every key is in part 0, so a right row without a
    partner there has none anywhere, and elsewhere it does not count.
    """
    schema = T.StructType([*left.schema.fields, T.StructField("__part", T.IntegerType())])
    dealt = left.mapInArrow(partial(_dealt, keys=keys), schema).withColumn("__left", F.lit(True))
    copies = right.withColumnsRenamed({k: f"__r_{k}" for k in keys}).withColumn(
        "__copy", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1)))
    )
    same = [F.col(k).eqNullSafe(F.col(f"__r_{k}")) if null_safe else F.col(k) == F.col(f"__r_{k}") for k in keys]
    joined = dealt.join(copies, reduce(Column.__and__, same, F.col("__part") == F.col("__copy")), "full")
    kept = joined.filter(F.col("__left").isNotNull() | (F.col("__copy") == 0))
    both = [F.when(F.col("__left"), F.col(k)).otherwise(F.col(f"__r_{k}")).alias(k) for k in keys]
    rest = [c for c in right.columns if c not in keys]
    return kept.select(*[both[keys.index(c)] if c in keys else F.col(c) for c in left.columns], *rest)


def by_key(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Inner join on one text column, NULL matching NULL, whose result is dealt by that column's hash alone.

    Both sides are shuffled for this join, so a hot key can be split, and the result can be
    written in buckets of the key as it is (`stage_bucketed(dealt=True)`). NULL goes by an
    unlikely text; the second condition keeps it apart from that text.
    """
    plain = [F.coalesce(key, F.lit("\0")).alias("__key"), F.col(key).isNull().alias("__none")]
    others = [c for c in left.columns if c != key]
    rest = [c for c in right.columns if c != key]
    renamed = right.select(plain[0].alias("__r_key"), plain[1].alias("__r_none"), *rest)
    # Not written as an equality, which would be shuffled by as well.
    alike = F.when(F.col("__none"), F.col("__r_none")).otherwise(~F.col("__r_none"))
    joined = left.select(*plain, *others).join(renamed.hint("merge"), (F.col("__key") == F.col("__r_key")) & alike)
    return joined.select(F.when(~F.col("__none"), F.col("__key")).alias(key), *others, *rest)


def with_group_totals(df: DataFrame, key: str, totals: dict[str, Column]) -> DataFrame:
    """Put per-group aggregates back on every row of the group.

    A window over ``key`` would sort a whole group in one task. Here the groups
    are aggregated (combined map-side) and joined back by a fresh shuffle, in
    which adaptive execution can split a large group.
    """
    grouped = df.groupBy(key).agg(*[c.alias(n) for n, c in totals.items()])
    return natural_join(df, grouped, "left", [key], reshuffle=True).select(*df.columns, *totals)
