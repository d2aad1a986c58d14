"""Near-duplicate embeddings: random-hyperplane sign hashing, exact cosines, connected components.

Vectors with the same components are one node from the start. Each node is hashed in
several tables, by the signs of its products with random hyperplanes; a pair whose
cosine is the threshold shares a bucket in some table with odds of 1 - MISS, a nearer
pair with better ones. The bits of a table grow with the logarithm of the nodes, so
that buckets stay near BUCKET vectors, and the tables follow from bits and MISS.

A bucket of more than BLOCK vectors is dealt into blocks, and every pair of blocks is a
task's work of its own. First the signs of all tables are compared there, some bytes a
vector, and only vectors with a partner whose signs differ little enough go on: near
vectors miss that with odds of 4e-6 (DEVIATIONS). Of these, the vectors themselves meet
in the same blocks, and all cosines are computed in double precision. A pair that
several tables would find counts in the first of them only, so what leaves a task is not
the pairs but, for each vector, the number of its links and the smallest vector that it
is connected to. Nothing is capped: a bucket of any size is compared in full.

A vector that is null, zero, or holds a null or a non-finite component links with
nothing; neither does one without an id, or one with another number of components. A
row that repeats an id with another vector is the same node.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthstat.llm.components import components
from hearthstat.llm.staging import roots, runs, small, stage
from hearthstat.llm.texts import seeds

MISS = 1e-4
BUCKET = 64
BLOCK = 1024
#: Standard deviations by which more signs of near vectors may differ than expected.
DEVIATIONS = 4.5


def plan(n: int, cosine: float) -> tuple[int, int]:
    """Bits and tables for n vectors."""
    agree = 1 - math.acos(cosine) / math.pi
    bits = min(max(math.ceil(math.log2(max(n, 1) / BUCKET)), 4), 60)
    return bits, math.ceil(math.log(MISS) / math.log1p(-(agree**bits)))


def planes(dim: int, bits: int, tables: int) -> np.ndarray:
    """Fixed normal directions, dim x (tables * bits)."""
    n = dim * bits * tables
    u = ((seeds(2 * n, 9) >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53
    return (np.sqrt(-2 * np.log(u[:n])) * np.cos(2 * np.pi * u[n:])).reshape(dim, bits * tables)


class Hashes:
    """Bucket codes of unit vectors of any number of components."""

    def __init__(self, bits: int, tables: int):
        self.bits, self.tables = bits, tables
        self.known: dict[int, np.ndarray] = {}

    def signs(self, vectors: np.ndarray) -> np.ndarray:
        dim = vectors.shape[1]
        if dim not in self.known:
            self.known[dim] = planes(dim, self.bits, self.tables)
        return (vectors @ self.known[dim] > 0).reshape(len(vectors), self.tables, self.bits)

    def codes(self, vectors: np.ndarray) -> np.ndarray:
        return self.signs(vectors) @ (1 << np.arange(self.bits, dtype=np.int64))


def units(raw: list[bytes], kind: type = np.float64) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1).astype(np.float64)
    # Scaled first, so that squares neither overflow nor vanish.
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _packed(batches: Iterator[pa.RecordBatch], kind: type) -> Iterator[pa.RecordBatch]:
    """Components as bytes, as wide as they come; null for a vector that can't be compared."""
    for batch in batches:
        out = []
        for v in batch.column(1):
            x = None
            if v.is_valid and len(v.values) and not v.values.null_count:
                x = v.values.to_numpy(zero_copy_only=False).astype(kind) + kind(0)
                x = x.tobytes() if np.isfinite(x).all() and x.any() else None
            out.append(x)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["vec_id", "v"])


def _hashed(batches: Iterator[pa.RecordBatch], bits: int, tables: int, kind: type) -> Iterator[pa.RecordBatch]:
    hashes = Hashes(bits, tables)
    for batch in batches:
        node, raw = batch.column(0).to_numpy(), batch.column(1).to_pylist()
        lengths = np.array([len(x) for x in raw])
        for length in np.unique(lengths).tolist():
            at = np.flatnonzero(lengths == length)
            signs = hashes.signs(units([raw[i] for i in at.tolist()], kind))
            codes = signs @ (1 << np.arange(bits, dtype=np.int64))
            packed = np.packbits(signs.reshape(len(at), -1), axis=1)
            packed = np.pad(packed, ((0, 0), (0, -packed.shape[1] % 8)))
            sketches = np.repeat(np.array([x.tobytes() for x in packed], dtype=object), tables)
            # Vectors of different lengths never share a bucket.
            codes = codes * 65536 + (length // 8) % 65536 if bits <= 46 else codes
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(node[at], tables)), pa.array(np.tile(np.arange(tables, dtype=np.int32), len(at))),
                 pa.array(codes.ravel()), pa.array(sketches.tolist(), pa.binary())], ["node", "t", "code", "sketch"],
            )


def _signs_near(batches: Iterator[pa.RecordBatch], most: float) -> Iterator[pa.RecordBatch]:
    """The rows of each piece of work that have a partner whose signs differ in at most so many places."""
    for run in runs(batches, 4):
        i, j = (int(run.column(c)[0].as_py()) for c in (2, 3))
        side = run.column(4).to_numpy()
        words = np.frombuffer(b"".join(run.column(6).to_pylist()), np.uint64).reshape(run.num_rows, -1)
        keep = np.zeros(run.num_rows, bool)
        for at in range(0, run.num_rows, 256):
            differ = np.bitwise_count(words[at : at + 256, None] ^ words[None]).sum(2)
            near = differ <= most
            near &= side[at : at + 256, None] != side[None] if i != j else True
            near[np.arange(len(near)), at + np.arange(len(near))] = False
            keep[at : at + 256] |= near.any(1)
        kept = run.filter(pa.array(keep))
        yield pa.RecordBatch.from_arrays(kept.columns[:6], ["t", "code", "i", "j", "side", "node"])


def _linked(batches: Iterator[pa.RecordBatch], bits: int, tables: int, cosine: float, kind: type) -> Iterator[pa.RecordBatch]:
    hashes = Hashes(bits, tables)
    out: list[np.ndarray] = []
    for run in runs(batches, 4):
        if run.num_rows < 2:
            continue
        t, _, i, j = (int(run.column(c)[0].as_py()) for c in range(4))
        side, node, weight = (run.column(c).to_numpy() for c in (4, 5, 6))
        raw = run.column(7).to_pylist()
        lengths = np.array([len(x) for x in raw])
        for length in np.unique(lengths).tolist():
            at = np.flatnonzero(lengths == length)
            unit = units([raw[k] for k in at.tolist()], kind)
            near = unit @ unit.T >= cosine
            near &= side[at][:, None] != side[at][None, :] if i != j else True
            a, b = np.nonzero(np.triu(near, 1))
            if not len(a):
                continue
            used = np.unique(np.concatenate([a, b]))
            place = np.searchsorted(used, a), np.searchsorted(used, b)
            codes = hashes.codes(unit[used])[:, :t]
            own, mass = node[at][used], weight[at][used]
            links = np.zeros(len(used), np.int64)
            for s in range(0, len(a), 1 << 16):
                x, y = place[0][s : s + (1 << 16)], place[1][s : s + (1 << 16)]
                new = (codes[x] != codes[y]).all(1)
                np.add.at(links, x[new], mass[y[new]])
                np.add.at(links, y[new], mass[x[new]])
            root = roots(len(used), *place)
            out.append(np.stack([own, links, own[root]], axis=1))
        if sum(map(len, out)) > 10_000:
            yield _answer(out)
            out = []
    if out:
        yield _answer(out)


def _answer(rows: list[np.ndarray]) -> pa.RecordBatch:
    table = np.concatenate(rows)
    return pa.RecordBatch.from_arrays(
        [pa.array(np.ascontiguousarray(table[:, c])) for c in range(3)], ["node", "links", "root"]
    )


def near_vectors(vectors: DataFrame, cosine: float = 0.95) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of `vectors` (vec_id, embedding)."""
    kind = np.float32 if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else np.float64
    packed = vectors.select("vec_id", "embedding").mapInArrow(partial(_packed, kind=kind), "vec_id long, v binary")
    rows = stage(packed)
    valid = rows.where("v is not null and vec_id is not null")
    classes = stage(valid.groupBy("v").agg(F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("n")))
    bits, tables = plan(classes.count(), cosine)
    filed = stage(
        classes.select("node", "v").mapInArrow(
            partial(_hashed, bits=bits, tables=tables, kind=kind), "node long, t int, code long, sketch binary"
        )
    )
    sizes = stage(filed.groupBy("t", "code").agg(F.count(F.lit(1)).alias("m")).where("m > 1"))
    parts = F.ceil(F.col("m") / BLOCK).cast("int")
    filed = filed.join(small(sizes), ["t", "code"]).withColumn("g", parts)
    filed = filed.withColumn("side", F.pmod(F.xxhash64("node"), F.col("g")).cast("int"))
    # With every block of its bucket a row makes one piece of work.
    work = filed.select("t", "code", "side", "node", "sketch", F.explode(F.sequence(F.lit(0), F.col("g") - 1)).alias("o"))
    work = work.select(
        "t", "code", F.least("side", "o").alias("i"), F.greatest("side", "o").alias("j"), "side", "node", "sketch"
    )
    keys = ["t", "code", "i", "j"]
    apart = math.acos(cosine) / math.pi
    most = bits * tables * apart + DEVIATIONS * math.sqrt(bits * tables * apart * (1 - apart))
    work = work.select(*keys, "side", "node", "sketch").repartition(*keys).sortWithinPartitions(*keys)
    work = stage(work.mapInArrow(partial(_signs_near, most=most), "t int, code long, i int, j int, side int, node long"))
    work = work.join(classes.select("node", "n", "v"), "node")
    work = work.select(*keys, "side", "node", "n", "v").repartition(*keys).sortWithinPartitions(*keys)
    found = stage(
        work.mapInArrow(
            partial(_linked, bits=bits, tables=tables, cosine=cosine, kind=kind), "node long, links long, root long"
        )
    )
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    group = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")).where("a <> b"))
    known = classes.join(links, "node", "left").join(group, "node", "left")
    known = known.select(
        F.col("v").alias("same"),
        (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
        F.coalesce("component", "node").alias("component_id"),
    )
    own = rows.withColumn("same", F.when(F.col("vec_id").isNotNull(), F.col("v")))
    joined = own.join(known, "same", "left")
    return joined.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op2_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP2_SQL = """
WITH RECURSIVE v AS MATERIALIZED (
  SELECT vec_id, e, sqrt(list_sum([x * x for x in e])) AS norm
  FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
        WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0)
  WHERE list_sum([abs(x) for x in e]) > 0),
links AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.95),
reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings
  UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT e.vec_id, coalesce(l.n, 0) AS n_links, r.component_id, r.component_id = e.vec_id AS kept
FROM embeddings e
JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) r ON r.a = e.vec_id
LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) l ON l.a = e.vec_id
"""
