"""Whitening of embeddings: an exact covariance from Spark, its leading components by spectrum slicing.

An entry c becomes the whole number x = floor(1024 * c) + 100000. Counts, sums and
products of centred x are whole numbers, added exactly over all vectors, so the
covariance is rounded only once, whatever the order of the rows. Tasks add up their rows
and send one table of sums each; what reaches the driver is the matrix of dimensions by
dimensions, and its size does not depend on the rows.

Left out are vectors that are null, empty, or hold a null, a non-finite entry or one
beyond LARGEST (about a billion), where products of all rows could no longer be added
exactly. Where vectors differ in length, the commonest length counts (of equally common
ones the longest), and those of other lengths are left out too. Components without
variance can't be scaled to one and are left out, so equal vectors, or a single one, give
no components. Rows that repeat an id, or have none, are vectors like any other. Of the
table's columns only vec_id and embedding are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthstat.llm.spectrum import leading

COMPONENTS = 8
SCALE = 1024
OFFSET = 100_000
LARGEST = 1 << 40
#: Whole numbers up to here are exact in double precision.
EXACT = 1 << 53
WHOLE = pa.decimal128(38, 0)


def wholes(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of the usable rows, and their x as whole numbers."""
    at = np.flatnonzero(pc.fill_null(pc.equal(pc.list_value_length(column), dim), False).to_numpy(zero_copy_only=False))
    c = column.take(pa.array(at)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    with np.errstate(over="ignore", invalid="ignore"):
        x = np.floor(c.reshape(len(at), dim) * SCALE) + OFFSET
        fine = (np.abs(x) <= LARGEST).all(1)  # never true of a null, which is a NaN here
    return at[fine], x[fine].astype(np.int64)


def products(d: np.ndarray) -> np.ndarray:
    """dᵀd of whole numbers as Python's, exactly."""
    total = np.zeros((d.shape[1], d.shape[1]), dtype=object)
    most = int(np.abs(d).max(initial=1))
    rows = EXACT // (most * most)
    if not rows:
        return np.dot(d.T.astype(object), d.astype(object))
    for a in range(0, len(d), rows):
        part = d[a : a + rows].astype(np.float64)
        total += (part.T @ part).astype(np.int64).astype(object)
    return total


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each length of vectors: n and the sums of x."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        column = batch.column(0)
        for dim in pc.unique(pc.drop_null(pc.list_value_length(column))).to_pylist():
            if dim:
                at, x = wholes(column, dim)
                part = np.array([len(at), *x.sum(0).tolist()], dtype=object)
                sums[dim] = sums.get(dim, 0) + part
    yield _packed(sums, WHOLE)


def _products(batches: Iterator[pa.RecordBatch], centre: np.ndarray) -> Iterator[pa.RecordBatch]:
    dim = len(centre)
    total = 0
    for batch in batches:
        total = total + products(wholes(batch.column(0), dim)[1] - centre).ravel()
    yield _packed({} if isinstance(total, int) else {dim: total}, WHOLE)


def _moments(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Sums of whitened coordinates, which are centred, and of their products."""
    total = np.zeros(k + k * k)
    for batch in batches:
        z = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, k)
        total += np.concatenate([z.sum(0), (z.T @ z).ravel()])
    yield _packed({k: total}, pa.float64())


def _packed(sums: dict[int, np.ndarray], kind: pa.DataType) -> pa.RecordBatch:
    wrap: Callable = Decimal if kind == WHOLE else float
    values = pa.array([[wrap(v) for v in s] for s in sums.values()], pa.list_(kind))
    return pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), values], ["dim", "v"])


def _total(parts: DataFrame) -> DataFrame:
    """(dim, pos, v): the tasks' tables of sums added up place by place."""
    return parts.select("dim", F.posexplode("v").alias("pos", "v")).groupBy("dim", "pos").agg(F.sum("v").alias("v"))


def _values(total: DataFrame) -> list:
    return [r["v"] for r in sorted(total.collect(), key=lambda r: r["pos"])]


@dataclass
class Whitening:
    """n vectors with sums of x per dimension, and the leading components of x's covariance."""

    n: int
    sums: list[int]
    trace: float
    values: np.ndarray
    vectors: np.ndarray

    @property
    def explained(self) -> list[float]:
        return [float(e) / self.trace for e in self.values]

    @property
    def centre(self) -> np.ndarray:
        """The whole part of each dimension's mean."""
        return np.array([s // self.n for s in self.sums], dtype=np.int64)


def fit(embeddings: DataFrame, k: int = COMPONENTS) -> Whitening:
    """Two passes: counts and sums, then products of what is left of x without the mean's whole part."""
    rows = embeddings.select("embedding")
    total = _total(rows.mapInArrow(_sums, "dim int, v array<decimal(38,0)>"))
    dim = total.where("pos = 0 and v > 0").orderBy(F.desc("v"), F.desc("dim")).first()
    if dim is None:
        return Whitening(0, [], 0.0, np.zeros(0), np.zeros((0, 0)))
    n, *sums = (int(v) for v in _values(total.where(F.col("dim") == dim["dim"])))
    model = Whitening(n, sums, 0.0, np.zeros(0), np.zeros((len(sums), 0)))
    centre = model.centre
    parts = rows.mapInArrow(partial(_products, centre=centre), "dim int, v array<decimal(38,0)>")
    squares = np.array([int(v) for v in _values(_total(parts))], dtype=object).reshape(len(sums), len(sums))
    left = np.array([s - n * int(c) for s, c in zip(sums, centre)], dtype=object)
    numerators = n * squares - np.outer(left, left)
    covariance = np.array([[v / (n * n) for v in row] for row in numerators.tolist()])
    model.trace = int(np.trace(numerators)) / (n * n)
    model.values, model.vectors = leading(covariance, k)
    return model


def deviations(d: np.ndarray, n: int, left: list[int]) -> list[int]:
    """The sum over dimensions of (n * d - left) ** 2, exactly."""
    most = (n * int(np.abs(d).max(initial=0)) + max(map(abs, left), default=0)) ** 2 * max(d.shape[1], 1)
    kind = np.int64 if most < 1 << 62 else object
    t = d.astype(kind) * n - np.array(left, dtype=kind)
    return (t * t).sum(1).tolist()


def _whitened(batches: Iterator[pa.RecordBatch], model: Whitening) -> Iterator[pa.RecordBatch]:
    n, centre = model.n, model.centre
    left = [s - n * int(c) for s, c in zip(model.sums, centre)]
    mean = np.array([v / n for v in left])
    for batch in batches:
        at, x = wholes(batch.column(1), len(centre))
        d = x - centre
        z = (d - mean) @ model.vectors / np.sqrt(model.values)
        places = pa.array(np.arange(0, z.size + 1, max(z.shape[1], 1))[: len(z) + 1], pa.int32())
        far = [Decimal(v) if v < 10**38 else None for v in deviations(d, n, left)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(at)), pa.array(far, WHOLE), pa.ListArray.from_arrays(places, pa.array(z.ravel()))],
            ["vec_id", "deviation", "whitened"],
        )


def transform(embeddings: DataFrame, model: Whitening) -> DataFrame:
    """(vec_id, deviation, whitened array) of each usable vector; none if the model has no components.

    The deviation is null where it needs more than 38 digits.
    """
    schema = f"vec_id {embeddings.schema['vec_id'].dataType.simpleString()}, deviation decimal(38,0), whitened array<double>"
    if not len(model.values):
        return embeddings.sparkSession.createDataFrame([], schema)
    return embeddings.select("vec_id", "embedding").mapInArrow(partial(_whitened, model=model), schema)


def identity_error(whitened: DataFrame, n: int, k: int) -> float:
    """The largest entry by which the covariance of the whitened vectors differs from the identity."""
    if not k:
        return 0.0
    parts = whitened.select("whitened").mapInArrow(partial(_moments, k=k), "dim int, v array<double>")
    total = np.array(_values(_total(parts))) / n
    return float(np.abs(total[k:].reshape(k, k) - np.outer(total[:k], total[:k]) - np.eye(k)).max())


def op11_whitening(spark, sf_dir: str) -> DataFrame:
    """A row for each vector and component; deviation is null where it needs more than 64 bits."""
    embeddings = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    model = fit(embeddings)
    rows = transform(embeddings, model)
    error = identity_error(rows, model.n, len(model.values))
    explained = F.array(*map(F.lit, model.explained)) if model.explained else F.array().cast("array<double>")
    rows = rows.select("vec_id", F.expr("try_cast(deviation AS bigint)").alias("deviation"), F.posexplode("whitened").alias("at", "whitened"))
    return rows.select(
        "vec_id",
        (F.col("at") + 1).alias("component"),
        F.lit(model.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(explained, F.col("at")).alias("explained"),
        F.lit(error).alias("identity_error"),
    )
