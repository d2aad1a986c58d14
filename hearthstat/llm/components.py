"""Connected components of an undirected graph by alternating large and small stars.

Each round only groups and joins on node ids, with minima combined before the
shuffle, so a node with very many links is split like any other skewed join
key. Rounds grow with the logarithm of the graph.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from hearthstat.llm.staging import stage


def _counted(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The table written, with its rows' number and sum of hashes, which are taken while writing."""
    seen = Observation()
    total = F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))
    written = stage(edges.observe(seen, F.count(F.lit(1)).alias("n"), total.alias("sum")))
    return written, (seen.get.get("n", 0), seen.get.get("sum"))


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every end of an edge (a, b); the component is its smallest node.

    Self-links, repeated and reversed links are allowed; rows with a null end are ignored.
    """
    e = edges.where("a is not null and b is not null and a <> b")
    e, state = _counted(e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while state[0]:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        linked = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e, after = _counted(linked.unionByName(low.select("a", F.col("m").alias("b"))).distinct())
        if after == state:
            break
        state = after
    roots = e.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
