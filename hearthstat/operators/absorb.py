"""Least squares with one or two factors of very many levels taken out before solving.

What listing every level would give, by way of tables of the size of the factors:

* Rows are combined to cells of the factors. One factor is eliminated level by level: its
  levels are rows of a distributed table (`_Levels.table`), each with its column means and
  its neighbours, the levels of the other factor that it meets. There may be any number.
* The other, coded 0 to p - 1, leads to a system over p unknowns that is never formed:
  conjugate gradients multiply with it by a pass over the distributed table, with vectors
  of p numbers a column broadcast and summed in a tree, CODED of them at most. Up to DENSE
  levels it is formed after all, block by block, and inverted, which gives the levels'
  errors too; beyond, the levels of both factors have estimates only.
* The listed columns that neither factor nor earlier columns determine (W) are solved for
  from the cross-products that remain. Every other column, and every connected part of the
  graph of cells, stands for one linear dependency. Listing drops the reference levels and
  then, from the right, the last column of each dependency; the solution is moved along the
  dependencies until those columns' coefficients are 0.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .linear import ALIAS_TOL, gram, independent
from .series import numbered
from .staging import checkpointed

# The most numbers that a pass broadcasts or a task sums, 32 MB.
BLOCK = 1 << 22
# The most levels of the narrower of two absorbed factors.
CODED = 1 << 20
# The most of them for which their system is inverted, in 300 MB.
DENSE = 6000
ITERATIONS = 1000
EXACT = 1e-13

@dataclass
class _Batch:
    """Levels of a batch as arrays; `row` and `code` are the ends of the graph's edges."""

    name: pa.Array
    n: np.ndarray
    mean: np.ndarray
    row: np.ndarray
    code: np.ndarray
    count: np.ndarray

    @staticmethod
    def of(batch: pa.RecordBatch) -> _Batch:
        def numbers(i: int) -> np.ndarray:
            return batch.column(i).flatten().to_numpy(zero_copy_only=False)

        degree = np.diff(batch.column(3).offsets.to_numpy())
        rows = batch.num_rows
        return _Batch(
            batch.column(0), batch.column(1).to_numpy(), numbers(2).reshape(rows, -1), np.repeat(np.arange(rows), degree),
            numbers(3), numbers(4),
        )

    def through(self, values: np.ndarray) -> np.ndarray:
        """Each level's mean of `values` (a row for each code) over its rows."""
        out = np.zeros((len(self.n), values.shape[1]))
        step = max(BLOCK // max(values.shape[1], 1), 1)
        for a in range(0, len(self.row), step):
            edge = slice(a, a + step)
            np.add.at(out, self.row[edge], self.count[edge, None] * values[self.code[edge]])
        return out / self.n[:, None]

    def back(self, values: np.ndarray, total: np.ndarray) -> None:
        """Add, for each code, the sums of `values` (a row for each level) over its rows."""
        step = max(BLOCK // max(values.shape[1], 1), 1)
        for a in range(0, len(self.row), step):
            edge = slice(a, a + step)
            np.add.at(total, self.code[edge], self.count[edge, None] * values[self.row[edge]])


Pass = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[_Batch]:
    return (_Batch.of(batch) for batch in batches if batch.num_rows)


def _summing(batches: Iterator[pa.RecordBatch], shape: tuple[int, int], values) -> Iterator[pa.RecordBatch]:
    """One array of a task: its levels' means (of the columns, or of broadcast values) brought to the codes."""
    total = np.zeros(shape)
    for b in _each(batches):
        b.back(b.mean if values is None else b.through(values.value), total)
    yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["v"])


def _joining(batches: Iterator[pa.RecordBatch], labels) -> Iterator[pa.RecordBatch]:
    low = labels.value.copy()
    for b in _each(batches):
        least = np.full(len(b.n), len(low))
        np.minimum.at(least, b.row, low[b.code])
        np.minimum.at(low, b.code, least[b.row])
    yield pa.RecordBatch.from_arrays([pa.array([low.tobytes()], pa.binary())], ["v"])


class _Levels:
    """The eliminated factor as a distributed table, and passes over it."""

    def __init__(self, table: DataFrame, codes: int = 0, cells: DataFrame | None = None):
        self.table, self.codes, self.cells = table, codes, cells
        self.context = table.sparkSession.sparkContext

    def reduced(self, step: Pass, dtype: type, combine: Callable) -> np.ndarray:
        parts = self.table.mapInArrow(step, "v binary").rdd.map(lambda r: np.frombuffer(r["v"], dtype).copy())
        return parts.treeReduce(combine, 2)

    def sums(self, values: np.ndarray | None, width: int) -> np.ndarray:
        """For each code, what the levels' means add up to over its rows."""
        shared = None if values is None else self.context.broadcast(values)
        total = self.reduced(partial(_summing, shape=(self.codes, width), values=shared), float, np.add)
        if shared:
            shared.unpersist()
        return total.reshape(self.codes, width)

    def parts(self) -> np.ndarray:
        """For each code, the smallest one that cells connect it to."""
        labels = np.arange(self.codes)
        while True:
            low = self.reduced(partial(_joining, labels=self.context.broadcast(labels)), np.int64, np.minimum)
            low = low[low]
            if (low == labels).all():
                return labels
            labels = low


class _System:
    """The coded factor's normal equations with the other factor eliminated; the first code of each part is held at 0."""

    def __init__(self, levels: _Levels, rows_of: np.ndarray, part: np.ndarray):
        self.levels, self.rows_of, self.part = levels, rows_of, part
        self.held = np.flatnonzero(part == np.arange(len(part)))
        self.width = max(BLOCK // max(len(part), 1), 1)
        self.inverse: np.ndarray | None = None
        if 0 < len(part) <= DENSE:
            full = np.concatenate([self._times(e) for e in self._blocks(np.eye(len(part)))], axis=1)
            free = np.setdiff1d(np.arange(len(part)), self.held)
            self.inverse = np.zeros_like(full)
            self.inverse[np.ix_(free, free)] = np.linalg.inv(full[np.ix_(free, free)])
            self.inverse = (self.inverse + self.inverse.T) / 2

    def _blocks(self, x: np.ndarray) -> list[np.ndarray]:
        return [x[:, a : a + self.width] for a in range(0, x.shape[1], self.width)]

    def _times(self, x: np.ndarray) -> np.ndarray:
        return self.rows_of[:, None] * x - self.levels.sums(np.ascontiguousarray(x), x.shape[1])

    def solve(self, right: np.ndarray, terms: np.ndarray) -> np.ndarray:
        """For right sides that add up to 0 in every part; `terms` are the numbers that they are the difference of."""
        if not right.size:
            return right
        if self.inverse is not None:
            return self.inverse @ right
        blocks = zip(self._blocks(right), self._blocks(terms))
        return np.concatenate([self._gradients(*b) for b in blocks], axis=1)

    def _gradients(self, right: np.ndarray, terms: np.ndarray) -> np.ndarray:
        size = np.maximum(np.abs(right).max(0), np.abs(terms).max(0))
        # What rounding leaves in the null space of a part would never go away.
        mean = np.zeros_like(right)
        np.add.at(mean, self.part, right)
        x, left = np.zeros_like(right), right - (mean / np.bincount(self.part, minlength=len(right)).clip(1)[:, None])[self.part]
        weight = 1 / self.rows_of[:, None]
        along = left * weight
        product = (left * along).sum(0)
        for _ in range(ITERATIONS):
            active = np.abs(left).max(0) > EXACT * size
            if not active.any():
                break
            image = self._times(along)
            curve = (along * image).sum(0)
            step = np.divide(product, curve, out=np.zeros_like(curve), where=active & (curve > 0))
            x += step * along
            left -= step * image
            after = (left * left * weight).sum(0)
            along = left * weight + np.divide(after, product, out=np.zeros_like(after), where=active & (product > 0)) * along
            product = after
        if (np.abs(left).max(0) > 1e-8 * size).any():
            raise ArithmeticError("the absorbed factors' system did not converge; list one of them")
        return x - x[self.part]

    def column(self, weights: np.ndarray) -> np.ndarray:
        """The inverse, zero where held, times columns of any sums."""
        moved = weights.copy()
        np.subtract.at(moved, self.part, weights)
        return self.solve(moved, moved)


def greedy(columns: np.ndarray, basis: np.ndarray, most: int) -> list[int]:
    """Rows of `columns`, in order, that neither the basis nor rows taken before span; `most` is full rank."""
    taken: list[int] = []
    at, held = 0, basis.shape[1]
    rest = columns - (columns @ basis) @ basis.T
    while at < len(rest) and held + len(taken) < most:
        new = np.flatnonzero((rest[at:] * rest[at:]).sum(1) > ALIAS_TOL)
        if not len(new):
            break
        at += int(new[0])
        x = rest[at] / np.linalg.norm(rest[at])
        taken.append(at)
        at += 1
        rest[at:] -= np.outer(rest[at:] @ x, x)
    return taken


def _span(vectors: list[np.ndarray], rank: int) -> np.ndarray:
    basis = np.zeros((rank, 0))
    for v in vectors:
        x = v - basis @ (basis.T @ v)
        x = x - basis @ (basis.T @ x)
        basis = np.column_stack([basis, x / np.linalg.norm(x)])
    return basis


@dataclass
class _Shares:
    """What every level's coefficient is made of, broadcast to the tasks."""

    coded: np.ndarray  # p x (k + 1): the coded factor's part of each column
    part_of: np.ndarray  # p: index of the connected part
    parts: int
    dependencies: np.ndarray  # (k + 1) x z, in units of length

    def columns(self, b: _Batch) -> np.ndarray:
        """The eliminated factor's part of each column, at each level."""
        return b.mean - b.through(self.coded) if len(self.coded) else b.mean

    def dependent(self, b: _Batch) -> np.ndarray:
        """Each level's entries in the dependencies."""
        out = np.zeros((len(b.n), self.parts + self.dependencies.shape[1]))
        if self.parts:
            first = np.flatnonzero(np.diff(b.row, prepend=-1))
            out[b.row[first], self.part_of[b.code[first]]] = 1.0
        out[:, self.parts :] = -self.columns(b) @ self.dependencies
        return out


def _candidates(batches: Iterator[pa.RecordBatch], shares, basis: np.ndarray, most: int) -> Iterator[pa.RecordBatch]:
    """Of a task's levels, the last ones that span what those after them do not: what is chosen of all is among them."""
    held: list[tuple[str, np.ndarray]] = []
    for b in _each(batches):
        values = shares.value.dependent(b)
        names = b.name.to_pylist()
        order = sorted(range(len(names)), key=names.__getitem__, reverse=True)
        held += [(names[order[i]], values[order[i]]) for i in greedy(values[order], basis, most)]
        held.sort(key=lambda x: x[0], reverse=True)
        held = [held[i] for i in greedy(np.array([v for _, v in held]), basis, most)] if held else []
    yield pa.RecordBatch.from_arrays(
        [pa.array([n for n, _ in held], pa.string()), pa.array([v.tolist() for _, v in held], pa.list_(pa.float64()))], ["g", "v"]
    )


def _effects(batches: Iterator[pa.RecordBatch], shares, made) -> Iterator[pa.RecordBatch]:
    """(g, estimate, error): coefficient, and its variance over sigma2 but for the coded factor's own."""
    s, m = shares.value, made.value
    for b in _each(batches):
        own, moved = s.columns(b), s.dependent(b) @ m.along.T
        estimate = own @ m.level_of - moved @ m.dropped
        by_w = (-own[:, m.w] - moved @ m.by_w) @ m.root
        error = 1 / b.n + (by_w * by_w).sum(1) + ((moved @ m.between) * moved).sum(1)
        if len(s.coded):
            error = error - 2 * (moved * b.through(m.reach)).sum(1)
        yield pa.RecordBatch.from_arrays([b.name, pa.array(estimate), pa.array(error)], ["g", "estimate", "error"])


def _quadratic(batches: Iterator[pa.RecordBatch], block, at: int) -> Iterator[pa.RecordBatch]:
    """(g, error): a block of rows of the inverse between a level's neighbours."""
    values = block.value
    for b in _each(batches):
        inside = (b.code >= at) & (b.code < at + values.shape[1])
        mean = b.through(values)  # of the inverse's columns `at` and on, over all neighbours
        error = np.zeros(len(b.n))
        row, code = b.row[inside], b.code[inside] - at
        np.add.at(error, row, b.count[inside] * mean[row, code])
        yield pa.RecordBatch.from_arrays([b.name, pa.array(error / b.n)], ["g", "error"])


@dataclass
class _Made:
    """How level coefficients of the listed form are made from those at hand."""

    level_of: np.ndarray
    along: np.ndarray
    dropped: np.ndarray
    w: list[int]
    by_w: np.ndarray
    root: np.ndarray
    between: np.ndarray
    reach: np.ndarray


@dataclass
class Absorbed:
    """The listed terms kept, their coefficients, and a table (level, estimate, std_error) for each absorbed factor."""

    kept: list[int]
    estimate: np.ndarray
    cov: np.ndarray
    dof: int
    sigma2: float
    effects: list[DataFrame]
    levels: list[int]


def _table(spark: SparkSession, rows: DataFrame, wide: str, coded: str | None) -> tuple[_Levels, DataFrame | None, int]:
    """The eliminated factor's levels, the codes of the other one, and how many there are."""
    cells = rows.groupBy(*[c for c in (wide, coded) if c]).agg(
        F.count(F.lit(1)).cast("double").alias("n"), Summarizer.mean(F.col("__x")).alias("mean")
    )
    if coded is None:
        none = [F.array().cast(kind).alias(name) for kind, name in (("array<int>", "codes"), ("array<double>", "counts"))]
        table = cells.select(F.col(wide).alias("g"), "n", vector_to_array("mean").alias("mean"), *none)
        return _Levels(checkpointed(table)), None, 0
    cells = checkpointed(cells)
    names = checkpointed(numbered(cells.select(F.col(coded).alias("level")).distinct(), [F.col("level")], "code", start=0))
    p = names.count()
    if p > CODED:
        raise ValueError(f"more than {CODED} levels in both absorbed factors")
    joined = cells.join(names, cells[coded] == names["level"])
    table = joined.groupBy(F.col(wide).alias("g")).agg(
        F.sum("n").alias("n"),
        vector_to_array(Summarizer.mean(F.col("mean"), F.col("n"))).alias("mean"),
        F.sort_array(F.collect_list(F.struct(F.col("code").cast("int").alias("code"), F.col("n").alias("n")))).alias("edges"),
    )
    table = table.select("g", "n", "mean", F.col("edges.code").alias("codes"), F.col("edges.n").alias("counts"))
    return _Levels(checkpointed(table), p, joined), names, p


def _collected(levels: DataFrame) -> _Batch:
    """A few levels on the driver."""
    return _Batch.of(levels.toArrow().combine_chunks().to_batches()[0])


def fit_absorbed(rows: DataFrame, factors: list[str], place: list[int], n: int) -> Absorbed:
    """`rows` has the factors' columns, in term order, and `__x`, the listed columns and y; `place` says how many
    absorbed factors come before each listed column."""
    spark = rows.sparkSession
    k = len(place)
    counts = rows.agg(*[F.approx_count_distinct(f).alias(f) for f in factors]).first() if len(factors) > 1 else None
    coded = None if counts is None else min(reversed(factors), key=lambda f: counts[f])
    wide = next(f for f in factors if f != coded)
    levels, names, p = _table(spark, rows, wide, coded)
    if (k + 1) * p > 4 * BLOCK:
        raise ValueError("too many listed terms for so many levels; absorb or drop some")

    total = gram(rows, "__x")
    root_n = F.sqrt("n")
    weighted = levels.table.select(array_to_vector(F.transform("mean", lambda v: v * root_n)).alias("__x"))
    within = total - gram(weighted, "__x")
    n_wide = levels.table.count()
    part, rows_of = np.zeros(0, int), np.zeros(0)
    own = np.zeros((0, k + 1))
    system = None
    if p:
        rows_of, own = _coded_sums(levels.cells, p, k + 1)
        part = levels.parts()
        system = _System(levels, rows_of, part)
        right = own - levels.sums(None, k + 1)
        own = system.solve(right, own)
        within = within - right.T @ own
        within = (within + within.T) / 2
    parts = np.unique(part)

    scale = np.diag(total)[:k]
    w = independent(within[:k, :k], scale)
    z = [j for j in range(k) if j not in w]
    inv = np.linalg.inv(within[np.ix_(w, w)])
    beta = inv @ within[w, k]
    dof = n - len(w) - (n_wide + p - len(parts))
    sigma2 = float(max(within[k, k] - beta @ within[w, k], 0.0) / dof) if dof > 0 else float("nan")

    # The dependencies: columns not in W less W's part in them, in units of their length; then the parts.
    unit = np.sqrt(np.where(scale > 0, scale, 1.0) / n)
    z_of = np.zeros((k + 1, len(z)))
    z_of[z, range(len(z))] = 1.0
    z_of[w] -= inv @ within[np.ix_(w, z)]
    z_of /= unit[z]
    rank = len(parts) + len(z)
    shares = _Shares(own, np.searchsorted(parts, part), len(parts), z_of)
    shared = spark.sparkContext.broadcast(shares)
    of_codes = np.zeros((p, rank))
    if p:
        of_codes[np.arange(p), shares.part_of] = -1.0
        of_codes[:, len(parts) :] = -own @ z_of
    of_listed = np.concatenate([np.zeros((k, len(parts))), z_of[:k]], axis=1)

    # Columns that listing drops: the first level of each factor, then from the right.
    dropped: list[tuple[str, object, np.ndarray]] = []

    for f in factors:
        if f == wide:
            first = _collected(levels.table.orderBy("g").limit(1))
            dropped.append(("wide", first.name[0].as_py(), shares.dependent(first)[0]))
        else:
            dropped.append(("coded", 0, of_codes[0]))
    dropped = [dropped[i] for i in greedy(np.array([v for *_, v in dropped]), np.zeros((rank, 0)), rank)]

    def basis() -> np.ndarray:
        return _span([v for *_, v in dropped], rank)

    for i in range(len(factors), -1, -1):
        late = [j for j in reversed(z) if place[j] == i]
        lengths = np.array([of_listed[j] * unit[j] for j in late]).reshape(len(late), rank)
        dropped += [("listed", late[a], lengths[a]) for a in greedy(lengths, basis(), rank)]
        if not i or len(dropped) == rank:
            continue
        if factors[i - 1] == wide:
            step = partial(_candidates, shares=shared, basis=basis(), most=rank)
            found = levels.table.mapInArrow(step, "g string, v array<double>").collect()
            found.sort(key=lambda r: r["g"], reverse=True)
            values = np.array([r["v"] for r in found]).reshape(len(found), rank)
            dropped += [("wide", found[a]["g"], values[a]) for a in greedy(values, basis(), rank)]
        else:
            back = np.arange(p)[::-1]
            dropped += [("coded", int(back[a]), of_codes[back[a]]) for a in greedy(of_codes[back], basis(), rank)]

    # Their own estimates and covariances, in the form at hand.
    level_of = np.zeros(k + 1)
    level_of[k] = 1.0
    level_of[w] = -beta
    names_wide = [d for kind, d, _ in dropped if kind == "wide"]
    at_wide: dict[str, tuple[float, np.ndarray, np.ndarray]] = {}
    if names_wide:
        b = _collected(levels.table.filter(F.col("g").isin(names_wide)))
        mean_codes = np.zeros((len(b.n), p))
        np.add.at(mean_codes, (b.row, b.code), b.count)
        mean_codes /= b.n[:, None]
        at_wide = {g: (x, c, m) for g, x, c, m in zip(b.name.to_pylist(), b.n, shares.columns(b), mean_codes)}
    r = len(dropped)
    entries = np.zeros((rank, r))
    theta, by_w = np.zeros(r), np.zeros((r, len(w)))
    reach = np.zeros((p, r))
    for i, (kind, d, v) in enumerate(dropped):
        entries[:, i] = of_listed[d] if kind == "listed" else v
        if kind == "listed":
            continue
        columns = at_wide[d][1] if kind == "wide" else own[d]
        theta[i], by_w[i] = columns @ level_of, -columns[w]
        if p:
            reach[:, i] = at_wide[d][2] if kind == "wide" else -np.eye(1, p, d)[0]
    if p:
        reach = system.column(reach)
    between = np.zeros((r, r))
    for i, (kind, d, _) in enumerate(dropped):
        if kind == "wide":
            between[i] = at_wide[d][2] @ reach
            between[i, i] += 1 / at_wide[d][0]
        elif kind == "coded":
            between[i] = -reach[d]
    between = (between + between.T) / 2
    along = np.linalg.inv(entries)  # r x rank: how far to move along each dependency

    # The listed terms.
    kept = [j for j in range(k) if j not in {d for kind, d, _ in dropped if kind == "listed"}]
    estimate = np.zeros(k)
    estimate[w] = beta
    own_w = np.zeros((k, len(w)))
    own_w[w, range(len(w))] = 1.0
    moved = of_listed @ along.T
    estimate = estimate - moved @ theta
    through = own_w - moved @ by_w
    cov = (through @ inv @ through.T + moved @ between @ moved.T) * sigma2

    # The levels.
    root = np.linalg.cholesky(inv) if len(w) else np.zeros((0, 0))
    made = _Made(level_of, along, theta, w, by_w, root, between, reach)
    shared_made = spark.sparkContext.broadcast(made)
    tables = []
    for f in factors:
        gone = [d for kind, d, _ in dropped if kind == ("wide" if f == wide else "coded")]
        if f == wide:
            table = levels.table.mapInArrow(
                partial(_effects, shares=shared, made=shared_made), "g string, estimate double, error double"
            )
            table = table.filter(~F.col("g").isin(gone)) if gone else table
            if p:
                table = _with_quadratic(table, levels, system)
            table = table.withColumnRenamed("g", "level")
        else:
            moved = of_codes @ along.T
            value = own @ level_of - moved @ theta
            error = np.full(p, np.nan)
            if system.inverse is not None:
                by = (-own[:, w] - moved @ by_w) @ root
                error = np.diag(system.inverse) + (by * by).sum(1) + ((moved @ between) * moved).sum(1) + 2 * (moved * reach).sum(1)
            arrays = pa.table({"code": np.arange(p), "estimate": value, "error": error})
            table = spark.createDataFrame(arrays).filter(~F.col("code").isin(gone)).join(names, "code")
            table = table.withColumn("error", F.nanvl("error", F.lit(None).cast("double")))
        tables.append(table.select("level", "estimate", F.sqrt(F.greatest("error", F.lit(0.0)) * F.lit(sigma2)).alias("std_error")))
        if system is not None and system.inverse is None:
            tables[-1] = tables[-1].withColumn("std_error", F.lit(None).cast("double"))
    sizes = [(n_wide if f == wide else p) - sum(kind == ("wide" if f == wide else "coded") for kind, *_ in dropped) for f in factors]
    return Absorbed(kept, estimate[kept], cov[np.ix_(kept, kept)], dof, sigma2, tables, sizes)


def _coded_sums(cells: DataFrame, p: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of each code, and the sums of the columns over them."""
    found = (
        cells.groupBy("code")
        .agg(F.sum("n").alias("n"), vector_to_array(Summarizer.mean(F.col("mean"), F.col("n"))).alias("mean"))
        .toArrow()
        .sort_by("code")
        .combine_chunks()
    )
    n = found.column("n").to_numpy()
    mean = found.column("mean").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(p, width)
    return n, mean * n[:, None]


def _with_quadratic(table: DataFrame, levels: _Levels, system: _System) -> DataFrame:
    """The errors with the coded factor's own added, a block of its inverse at a time."""
    if system.inverse is None:
        return table
    passes = [table.select("g", "estimate", "error")]
    for at in range(0, len(system.inverse), system.width):
        block = levels.context.broadcast(np.ascontiguousarray(system.inverse[:, at : at + system.width]))
        part = levels.table.mapInArrow(partial(_quadratic, block=block, at=at), "g string, error double")
        passes.append(part.select("g", F.lit(None).cast("double").alias("estimate"), "error"))
    added = reduce(DataFrame.unionByName, passes).groupBy("g").agg(F.max("estimate").alias("estimate"), F.sum("error").alias("error"))
    return added.filter(F.col("estimate").isNotNull())
