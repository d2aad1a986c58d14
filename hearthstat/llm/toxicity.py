"""Toxicity by nearest labelled examples: exact TF-IDF cosine through a block-max inverted index.

Examples are a bounded sample of the labelled documents (EXAMPLES of each class, those
with the smallest hashes of their ids), weighted back to the classes' sizes. The terms
are all words of the examples; none is left out. A text's weight for one is
(1 + log tf) * idf * relevance: document frequencies are counted over all documents, and
the relevance says how far the term's rates in the two classes lie apart, 1 for the most
of words, so that a few telling words weigh up against many others while copies of an
example stay near it whatever their words.

Example vectors go into blocks of similar ones; for every term the index holds each
block's highest weight. A text's terms bound the cosine that a block can reach, so after
the blocks with the highest bounds only those are read that can still hold one of the K
nearest: the result is exact, ties going to the smaller id.

Neighbours vote with the inverse square of their distance. The votes are turned into
scores by the isotonic curve that the examples' own votes (each without itself) give, so
that a score is a share of toxic documents; beyond the examples' votes the curve runs on
to 0 at no vote and to 1 at all. A text without any term has the share that such
examples have. Neighbours and their cosines are returned as evidence.

A null or empty text has no terms; rows with a null id or label teach nothing; without
examples of both classes, the score is the share of toxic ones, or 0 without any.
Output columns replace input columns of the same name. The model, as large as the
examples' texts, passes through the driver and is broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearthstat.llm.decontam import WORDS
from hearthstat.llm.staging import small, stage
from hearthstat.llm.texts import signed, slices, words

#: The most examples of a class.
EXAMPLES = 2000
K = 15
#: Examples of a block, and blocks that are read to begin with.
BLOCK, PROBED = 64, 4
#: Examples that hold a term at least for it to be a column, and cosines that are worked on at once.
FREQUENT, CELLS = 64, 1 << 20
#: Neighbours nearer than this vote as if this far; votes start from PRIOR votes for the overall share.
NEAREST, PRIOR = 0.05, 1.0


def _terms_of(data: np.ndarray, offsets: np.ndarray, vocabulary: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text, term, count), sorted, for the words that are terms."""
    _, _, hashes, first = words(data, offsets, WORDS)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    if not len(vocabulary):
        return doc[:0], doc[:0], doc[:0]
    at = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
    found = vocabulary[at] == hashes
    pairs, counts = np.unique(doc[found] * len(vocabulary) + at[found], return_counts=True)
    return pairs // len(vocabulary), pairs % len(vocabulary), counts


def _distinct_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        toxic = batch.column(0).to_numpy(zero_copy_only=False)
        for begin, _, data, offsets in slices(batch.column(1)):
            _, _, hashes, first = words(data, offsets, WORDS)
            own = [np.unique(hashes[a:b]) for a, b in zip(first[:-1].tolist(), first[1:].tolist())]
            label = np.repeat(toxic[begin : begin + len(own)], [len(x) for x in own])
            term = np.concatenate([*own, np.zeros(0, np.uint64)])
            yield pa.RecordBatch.from_arrays(
                [pa.array(label, pa.int32()), pa.array(signed(term))], ["toxic", "term"]
            )


def _frequencies(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    """In how many of a task's texts each term occurs."""
    vocabulary = shared.value
    total = np.zeros(len(vocabulary), np.int64)
    for batch in batches:
        for _, _, data, offsets in slices(batch.column(0)):
            total += np.bincount(_terms_of(data, offsets, vocabulary)[1], minlength=len(vocabulary))
    yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["n"])


@dataclass(frozen=True)
class Terms:
    vocabulary: np.ndarray  # sorted hashes
    weights: np.ndarray

    def vectors(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Terms and unit weights of each text."""
        doc, term, count = _terms_of(data, offsets, self.vocabulary)
        weight = (1 + np.log(count)) * self.weights[term]
        bounds = np.searchsorted(doc, np.arange(len(offsets)))
        out = []
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            norm = np.sqrt((weight[a:b] ** 2).sum())
            out.append((term[a:b], weight[a:b] / norm) if norm > 0 else (term[:0], weight[:0]))
        return out


def _runs(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The numbers of runs that start at `first` and are `n` long, one after the other."""
    ends = np.cumsum(n)
    return np.repeat(first - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)


class BlockMax:
    """An inverted index over unit vectors in blocks, with each frequent term's highest weight in each block.

    Terms of many examples have their weights as columns of a matrix, as most blocks hold
    them; the others have lists of rows, which are short.
    """

    def __init__(self, ids: list[int], vectors: list[tuple], n_terms: int):
        # Like next to like: by the heaviest terms, of which the first weighs most.
        order = sorted(range(len(ids)), key=lambda i: vectors[i][0][np.argsort(-vectors[i][1], kind="stable")[:4]].tolist())
        self.ids = np.array([ids[i] for i in order], np.int64)
        self.blocks = -(-len(order) // BLOCK)
        row = np.repeat(np.arange(len(order), dtype=np.int32), [len(vectors[i][0]) for i in order])
        term = np.concatenate([*(vectors[i][0] for i in order), np.zeros(0, np.int64)]).astype(np.int64)
        weight = np.concatenate([*(vectors[i][1] for i in order), np.zeros(0)])
        size = np.bincount(term, minlength=n_terms)
        frequent = np.flatnonzero(size > max(FREQUENT, len(order) // 16))
        self.column = np.full(n_terms, -1)
        self.column[frequent] = np.arange(len(frequent))
        dense = self.column[term] >= 0
        self.matrix = np.zeros((self.blocks * BLOCK, len(frequent)))
        self.matrix[row[dense], self.column[term[dense]]] = weight[dense]
        self.most = self.matrix.reshape(self.blocks, BLOCK, len(frequent)).max(1).T if self.blocks else np.zeros((0, 0))
        row, term, weight = row[~dense], term[~dense], weight[~dense]
        by = np.argsort(term, kind="stable")
        self.row, self.weight = row[by], weight[by]
        self.first = np.searchsorted(term[by], np.arange(n_terms + 1))
        self.order = np.array(order, dtype=np.int64)

    def nearest(self, vectors: list[tuple], k: int, without: list[int | None] | None = None) -> list[tuple]:
        """For each vector the rows and cosines of its k nearest examples, apart from the id `without`; only cosines over 0 count."""
        if not self.blocks:
            return [(np.zeros(0, np.int64), np.zeros(0))] * len(vectors)
        out: list[tuple] = []
        step = max(1, CELLS // (self.blocks * BLOCK))
        for at in range(0, len(vectors), step):
            out += self._some(vectors[at : at + step], k, without[at : at + step] if without else None)
        return out

    def _some(self, vectors: list[tuple], k: int, without: list[int | None] | None) -> list[tuple]:
        """The blocks of the highest bounds are read first; then, at once, all others whose bound reaches the k-th cosine found."""
        n, wide = len(vectors), self.blocks * BLOCK
        doc = np.repeat(np.arange(n), [len(t) for t, _ in vectors])
        term = np.concatenate([t for t, _ in vectors])
        weight = np.concatenate([w for _, w in vectors])
        column = self.column[term]
        asked = np.zeros((n, self.matrix.shape[1]))
        asked[doc[column >= 0], column[column >= 0]] = weight[column >= 0]
        # Rows of rare terms are few and read at once.
        rare = column < 0
        sizes = self.first[term[rare] + 1] - self.first[term[rare]]
        at = _runs(self.first[term[rare]], sizes)
        cells = np.repeat(doc[rare] * wide, sizes) + self.row[at]
        scores = np.bincount(cells, self.weight[at] * np.repeat(weight[rare], sizes), n * wide)
        scores = scores.reshape(n, self.blocks, BLOCK)
        bound = asked @ self.most + scores.max(2)
        unread = bound > 0
        found = np.full((n, wide), -1.0)
        taken = np.full((n, 1), -np.inf)
        for first in (True, False):
            blocks = unread & (bound >= taken - 1e-9)
            if first and self.blocks > PROBED:
                near = np.argpartition(-bound, PROBED, axis=1)[:, :PROBED]
                probed = np.zeros_like(blocks)
                np.put_along_axis(probed, near, True, axis=1)
                blocks &= probed
            for b in np.flatnonzero(blocks.any(0)).tolist():
                rows = np.flatnonzero(blocks[:, b])
                own = slice(b * BLOCK, (b + 1) * BLOCK)
                found[rows, own] = np.round(scores[rows, b] + asked[rows] @ self.matrix[own].T, 12)
            unread &= ~blocks
            if first:
                for i, other in enumerate(without or []):
                    found[i, np.flatnonzero(self.ids == other)] = -1.0
                if wide > k:
                    taken = np.partition(found, -k, axis=1)[:, -k, None]
                taken = np.where(taken > 0, taken, -np.inf)
        for i, other in enumerate(without or []):
            found[i, np.flatnonzero(self.ids == other)] = -1.0
        out = []
        last = np.partition(found, -k, axis=1)[:, -k] if wide > k else np.full(n, -1.0)
        for i in range(n):
            rows = np.flatnonzero((found[i] > 0) & (found[i] >= last[i]))
            top = rows[np.lexsort((self.ids[rows], -found[i, rows]))][:k]
            out.append((top, found[i, top]))
        return out


@dataclass(frozen=True)
class Model:
    terms: Terms
    index: BlockMax | None
    labels: np.ndarray  # by row of the index
    masses: np.ndarray
    share: float  # of toxic documents
    bare: float  # of toxic documents among those without a term
    curve: tuple[np.ndarray, np.ndarray]  # votes and the scores that they stand for

    def votes(self, vectors: list[tuple], without: list[int | None] | None = None) -> list[tuple[float, list[int], list[float]]]:
        """For each vector the vote, the nearest examples' ids and their cosines."""
        unit = PRIOR * self.masses.mean() if len(self.masses) else PRIOR
        out = []
        for rows, cosines in self.index.nearest(vectors, K, without):
            force = self.masses[rows] / np.maximum(1 - cosines, NEAREST) ** 2
            vote = (force @ self.labels[rows] + unit * self.share) / (force.sum() + unit)
            out.append((float(vote), self.index.ids[rows].tolist(), cosines.tolist()))
        return out

    def score(self, vote: float) -> float:
        x, y = self.curve
        return float(np.interp(vote, [0.0, *x, 1.0], [0.0, *y, 1.0])) if len(x) else vote


def isotonic(votes: np.ndarray, labels: np.ndarray, masses: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The non-decreasing curve of least squares through (vote, label), by pooling neighbours that fall."""
    order = np.argsort(votes, kind="stable")
    pools: list[list[float]] = []  # mean, mass, lowest and highest vote
    for v, y, m in zip(votes[order].tolist(), labels[order].tolist(), masses[order].tolist()):
        pools.append([y, m, v, v])
        while len(pools) > 1 and (pools[-2][0] >= pools[-1][0] or pools[-2][3] == pools[-1][2]):
            y2, m2, _, high = pools.pop()
            y1, m1, low, _ = pools.pop()
            pools.append([(y1 * m1 + y2 * m2) / (m1 + m2), m1 + m2, low, high])
    x = np.array([v for p in pools for v in (p[2], p[3])])
    return x, np.array([p[0] for p in pools for _ in (0, 1)])


def _vectors(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for begin, end, data, offsets in slices(batch.column(2)):
            own = shared.value.vectors(data, offsets)
            part = batch.slice(begin, end - begin)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array([t.astype(np.int64).tobytes() for t, _ in own], pa.binary()),
                 pa.array([w.tobytes() for _, w in own], pa.binary())],
                ["doc_id", "toxic", "terms", "weights"],
            )


def _votes(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        model: Model = shared.value
        ids, terms, weights = (batch.column(i).to_pylist() for i in range(3))
        vectors = [(np.frombuffer(t, np.int64), np.frombuffer(w)) for t, w in zip(terms, weights)]
        votes = [vote for vote, _, _ in model.votes(vectors, without=ids)] if ids else []
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(votes, pa.float64())], ["doc_id", "vote"])


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    """From `labels` (doc_id, toxic) and the texts of `docs` (doc_id, text), which also give document frequencies."""
    spark = docs.sparkSession
    labels = labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    labels = stage(labels)
    sizes = {r[0]: r[1] for r in labels.groupBy("toxic").count().collect()}
    by_hash = (F.xxhash64("doc_id"), F.col("doc_id"))
    picked = [labels.where(F.col("toxic") == y).orderBy(*by_hash).limit(EXAMPLES) for y in (0, 1)]
    picked = stage(picked[0].unionByName(picked[1]))
    examples = docs.select("doc_id", "text").join(small(picked), "doc_id")
    examples = stage(examples.select("doc_id", F.col("toxic").cast("int").alias("toxic"), "text").dropDuplicates(["doc_id"]))
    taken = {r[0]: r[1] for r in examples.groupBy("toxic").count().collect()}
    mass = {y: sizes[y] / n for y, n in taken.items()}
    total = sum(mass[y] * n for y, n in taken.items())
    share = mass.get(1, 0.0) * taken.get(1, 0) / total if total else 0.0

    n1, n0 = taken.get(1, 0), taken.get(0, 0)
    vocabulary, weights = np.zeros(0, np.uint64), np.zeros(0)
    if n1 and n0:
        held = examples.select("toxic", "text").mapInArrow(_distinct_words, "toxic int, term long")
        counts = held.groupBy("term").agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b")).toArrow()
        hashes = counts.column("term").to_numpy().view(np.uint64)
        order = np.argsort(hashes)
        vocabulary = hashes[order]
        apart = relevance(*(counts.column(c).to_numpy()[order] for c in "ab"), n1, n0)
        found = _frequency(docs, vocabulary)
        weights = (np.log((1 + docs.count()) / (1 + found)) + 1) * apart
    terms = Terms(vocabulary, weights)

    rows = examples.mapInArrow(
        partial(_vectors, shared=spark.sparkContext.broadcast(terms)),
        "doc_id long, toxic int, terms binary, weights binary",
    )
    rows = stage(rows)
    bare = {r[0]: r[1] for r in rows.where("length(terms) = 0").groupBy("toxic").count().collect()}
    bare_total = sum(mass[y] * n for y, n in bare.items())
    bare_share = mass.get(1, 0.0) * bare.get(1, 0) / bare_total if bare_total else share
    kept = rows.where("length(terms) > 0").orderBy("doc_id").collect()
    vectors = [(np.frombuffer(r["terms"], np.int64), np.frombuffer(r["weights"])) for r in kept]
    index = BlockMax([r["doc_id"] for r in kept], vectors, len(vocabulary))
    by_row = [kept[i]["toxic"] for i in index.order.tolist()]
    labels_by_row = np.array(by_row, float)
    masses = np.array([mass[y] for y in by_row], float)
    model = Model(terms, index, labels_by_row, masses, share, bare_share, (np.zeros(0), np.zeros(0)))
    if not kept:
        return model
    asked = rows.where("length(terms) > 0").select("doc_id", "terms", "weights").repartition(32, "doc_id")
    voted = asked.mapInArrow(partial(_votes, shared=spark.sparkContext.broadcast(model)), "doc_id long, vote double")
    votes = {r[0]: r[1] for r in voted.collect()}
    curve = isotonic(np.array([votes[i] for i in index.ids.tolist()]), labels_by_row, masses)
    return Model(terms, index, labels_by_row, masses, share, bare_share, curve)


def _frequency(docs: DataFrame, vocabulary: np.ndarray) -> np.ndarray:
    """How many documents hold each term; tasks' counts are added up in a tree."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    counted = docs.select("text").mapInArrow(partial(_frequencies, shared=shared), "n binary")
    return counted.rdd.map(lambda r: np.frombuffer(r["n"], np.int64)).treeReduce(np.add, 3)


def relevance(a: np.ndarray, b: np.ndarray, n1: int, n0: int) -> np.ndarray:
    """How far a term's rates in the two classes lie apart: the root of chi squared, corrected for small counts, at least 1."""
    n, held = float(n1 + n0), a + b
    apart = np.maximum(np.abs(a * float(n0) - b * float(n1)) - n / 2, 0)
    return np.maximum(apart * np.sqrt(n / (held * np.maximum(n - held, 1.0) * n1 * n0)), 1.0)


def _judged(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        model: Model = shared.value
        names = batch.schema.names
        for begin, end, data, offsets in slices(batch.column(names.index("text"))):
            part = batch.slice(begin, end - begin)
            scores, ids, cosines = [], [], []
            for vote, near, cos in model.votes(model.terms.vectors(data, offsets)):
                scores.append(model.bare if not near else model.score(vote))
                ids.append(near)
                cosines.append(cos)
            out = {n: part.column(n) for n in names}
            out["score"] = pa.array(scores, pa.float64())
            out["evidence"] = pa.array(ids, pa.list_(pa.int64()))
            out["cosines"] = pa.array(cosines, pa.list_(pa.float64()))
            yield pa.RecordBatch.from_pydict(out)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """`docs` with score (0 to 1), evidence (ids of the nearest examples), cosines and predicted (0 or 1)."""
    docs = docs.drop("score", "evidence", "cosines", "predicted")
    schema = T.StructType(list(docs.schema)).add("score", "double")
    schema = schema.add("evidence", T.ArrayType(T.LongType())).add("cosines", T.ArrayType(T.DoubleType()))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    out = docs.mapInArrow(partial(_judged, shared=shared), schema)
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op9_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0, F.lit(False))
    model = learn(docs, labels.where(~out))
    return score(docs.withColumn("held_out", out), model).drop("text")
