"""Cross-products and orthogonal factors of tall tables, and which of their columns are determined by earlier ones."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame

# A column is aliased when what earlier ones leave of its squared length is less than this
# share: a hundred-thousandth of the length, below which cross-products are rounding noise.
ALIAS_TOL = 1e-10
# The same for an orthogonal factor, as a share of the length itself.
QR_TOL = 1e-7
# Numbers in the block of rows that is factored at once.
BLOCK = 1 << 20


def gram(df: DataFrame, cols: str) -> np.ndarray:
    """Cross-product of a vector column: partial sums per partition, tree-combined."""
    vectors = MLUtils.convertVectorColumnsFromML(df.select(cols), cols)
    return RowMatrix(vectors).computeGramianMatrix().toArray()


def independent(cross: np.ndarray, scale: np.ndarray) -> list[int]:
    """Columns that the kept ones before them do not determine, by elimination.

    ``scale`` holds the squared lengths that what is left is compared with.
    """
    left = cross.copy()
    kept = []
    for j in range(len(left)):
        if scale[j] > 0 and left[j, j] > ALIAS_TOL * scale[j]:
            kept.append(j)
            left[j + 1 :, j + 1 :] -= np.outer(left[j + 1 :, j], left[j, j + 1 :] / left[j, j])
    return kept


def _stacked(parts: list[np.ndarray]) -> np.ndarray:
    return np.linalg.qr(np.vstack(parts), mode="r")


def _factored(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """One triangle for the rows of a task."""
    factor = np.zeros((0, width))
    step = max(BLOCK // width, width)
    for batch in batches:
        rows = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
        for a in range(0, len(rows), step):
            factor = _stacked([factor, rows[a : a + step]])
    yield pa.RecordBatch.from_arrays([pa.array([factor.tobytes()], pa.binary())], ["r"])


def triangle(df: DataFrame, cols: str, width: int) -> np.ndarray:
    """The triangular factor of a vector column's rows: each task factors its own, then the factors in a tree.

    Unlike the cross-product, it keeps columns apart that differ by a ten-millionth of
    their length. A task holds BLOCK numbers and a triangle of ``width`` columns.
    """
    arrays = df.select(vector_to_array(cols).alias("x"))
    parts = arrays.mapInArrow(partial(_factored, width=width), "r binary").rdd
    factors = parts.map(lambda row: np.frombuffer(row["r"]).reshape(-1, width))
    return factors.treeReduce(lambda a, b: _stacked([a, b]), 3) if parts.getNumPartitions() else np.zeros((0, width))


def independent_columns(factor: np.ndarray, columns: int) -> tuple[list[int], np.ndarray, np.ndarray]:
    """The first ``columns`` that earlier kept ones do not determine; their orthonormal basis, and its triangle."""
    basis = np.zeros((len(factor), 0))
    kept: list[int] = []
    for j in range(columns):
        x = factor[:, j]
        length = np.linalg.norm(x)
        left = x - basis @ (basis.T @ x)
        left = left - basis @ (basis.T @ left)
        if length and np.linalg.norm(left) > QR_TOL * length:
            kept.append(j)
            basis = np.column_stack([basis, left / np.linalg.norm(left)])
    return kept, basis, basis.T @ factor[:, kept]
