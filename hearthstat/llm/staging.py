"""Intermediate tables in the folder that driver and executors share, and size-checked broadcasts."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a table of a few numbers that may be broadcast; about 30 MB as a hash table.
BROADCAST_ROWS = 1_000_000

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a temporary folder where it is unset (one machine, as in tests)."""
    root = spark.conf.get("spark.checkpoint.dir", "")
    if root:
        return root.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _own:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        _own[app] = "file://" + tempfile.mkdtemp(prefix="hearthstat-")
    return _own[app]


def stage(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it again: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clean(spark: SparkSession) -> None:
    """Have the shuffle files and broadcasts removed that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.java.lang.System.gc()


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint if the (staged) table has at most so many rows; else a plain join follows."""
    return F.broadcast(df) if df.count() <= rows else df


def runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.RecordBatch]:
    """Sorted rows, those with equal first columns (integers) at a time."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        values = np.stack([batch.column(c).to_numpy() for c in range(keys)], axis=1).astype(np.int64)
        cuts = [0, *(np.flatnonzero((values[1:] != values[:-1]).any(1)) + 1).tolist(), len(values)]
        for a, b in zip(cuts[:-1], cuts[1:]):
            part = batch.slice(a, b - a)
            if held and [c[0].as_py() for c in held[0].columns[:keys]] != values[a].tolist():
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held = []
            held.append(part)
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest of n numbers that each is connected to by the pairs (a, b)."""
    root = np.arange(n)
    while True:
        low = root.copy()
        np.minimum.at(low, a, root[b])
        np.minimum.at(low, b, root[a])
        low = low[low]
        if (low == root).all():
            return root
        root = low
