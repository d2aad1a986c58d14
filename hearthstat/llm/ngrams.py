"""An interpolated modified Kneser-Ney model over the bytes of trusted text, counted and joined in shards.

An n-gram is up to ORDER bytes packed into a whole number, so counts are exact and no
text is folded: all scripts, digits and capitals stay apart. A text stands between zero
bytes. The model is a staged table of n-grams with their shares and back-off weights; it
grows with the trusted text and never comes to the driver or into one task.

Texts fall into two folds by a hash of their contents, and the texts of a fold are scored
by what the other fold's trusted texts teach. So no text is scored by itself or by a
copy of itself, and trusted and other texts have values on one scale.

Texts are scored in chunks of about CHUNK bytes of one fold, compressed and shuffled
once. A chunk asks for its distinct n-grams of all orders, a shard at a time, and each
shard joins what all chunks ask of it with its counts; both shares grow only with CHUNK,
as there is a shard for every CHUNK of text. The answers meet the chunk's texts, block
by block, and a document's logarithms are added up. A frequent n-gram is asked for once
a chunk, and within the model each context has at most 256 followers, so there are no
hot keys.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthstat.llm.staging import clean, stage
from hearthstat.llm.texts import slices

ORDER = 6
#: Bytes of text in a chunk, and in a block of it that is worked on at once.
CHUNK, BLOCK = 48 << 20, 1 << 20
#: The least discount; something has to be left for what was not seen.
LEAST = 0.1
#: N-grams that a task holds before it sends its counts.
HELD = 1 << 20
#: A key is fold, order and n-gram; keys are dealt to shards by their remainder of a prime.
FOLD, LENGTH, PRIME = 56, 48, 1_000_003


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram that ends at each byte of each text and at its end mark; the texts' first places."""
    n = np.diff(offsets) + 1
    place = np.concatenate([[0], np.cumsum(n)])
    symbols = np.zeros(place[-1], np.uint64)
    keep = np.ones(place[-1], bool)
    keep[place[1:] - 1] = False
    symbols[keep] = data
    out = symbols.copy()
    for back in range(1, ORDER):
        out[back:] |= symbols[:-back] << np.uint64(8 * back)
    # A text's first n-grams reach into the text before.
    for age in range(min(ORDER - 1, n.max(initial=0))):
        out[place[:-1][n > age] + age] &= np.uint64(_mask(age + 1))
    return out, place


def _mask(order: int) -> int:
    return (1 << 8 * order) - 1


def key(fold: int, order: int, gram: np.ndarray) -> np.ndarray:
    return gram | np.uint64(fold << FOLD | order << LENGTH)


def _parted(x: np.ndarray) -> np.ndarray:
    """Which of sorted numbers differ from the one before. (`np.unique` hashes, which takes ten times as long and more memory.)"""
    new = np.ones(len(x), bool)
    np.not_equal(x[1:], x[:-1], out=new[1:])
    return new


def _distinct(parts: list[np.ndarray]) -> np.ndarray:
    """All different numbers, sorted."""
    x = np.sort(np.concatenate([np.zeros(0, np.uint64), *parts]))
    return x[_parted(x)]


def _numbered(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All different numbers, sorted, and where among them each one is."""
    order = np.argsort(x)
    ordered = x[order]
    new = _parted(ordered)
    at = np.empty(len(x), np.int64)
    at[order] = np.cumsum(new) - 1
    return ordered[new], at


def _rows(keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), pa.array(n.astype(np.int64))], ["key", "n"])


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, at = _numbered(np.concatenate([k for k, _ in parts]))
    return keys, np.bincount(at, np.concatenate([n for _, n in parts]), len(keys)).astype(np.int64)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The task's n-grams of the highest order, by fold."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    for batch in batches:
        folds = batch.column(0).to_numpy()
        for begin, end, data, offsets in slices(batch.column(1), BLOCK):
            own, place = grams(data, offsets)
            own = own | (np.repeat(folds[begin:end].astype(np.uint64), np.diff(place)) << np.uint64(FOLD))
            held.append(np.unique(own, return_counts=True))
            if sum(len(k) for k, _ in held) > 2 * HELD:
                held = [_merged(held)]
                if len(held[0][0]) > HELD:
                    yield _rows(*held[0])
                    held = []
    if held:
        yield _rows(*_merged(held))


def discounts(k: list[int]) -> list[float]:
    """Of what was seen once, twice and more often, from how many n-grams were seen 1 to 4 times."""
    y = k[0] / (k[0] + 2 * k[1]) if k[0] else 0.0
    return [min(max(c - (c + 1) * y * k[c] / k[c - 1], LEAST), float(c)) if k[c - 1] else max(y, LEAST) for c in (1, 2, 3)]


def _of_fold(values: list[list[float]], i: int) -> Column:
    return F.when(F.shiftright("key", FOLD) == 0, values[0][i]).otherwise(values[1][i])


def train(texts: DataFrame) -> DataFrame:
    """(key, share, weight) from the texts (fold 0 or 1, text without empty ones).

    The probability of an n-gram's last byte is its share plus the weight of its context
    times the probability after the context without its first byte. A row's share is that
    of its n-gram, its weight is what it leaves as a context; either may be 0.
    """
    spark = texts.sparkSession
    counts = texts.select("fold", "text").mapInArrow(_counted, "key long, n long")
    table = stage(counts.groupBy("key").agg(F.sum("n").alias("n")))
    clean(spark)
    found = None
    for order in range(ORDER, 0, -1):
        fold, gram = F.shiftright("key", FOLD), F.col("key").bitwiseAND(_mask(order))
        kinds = table.groupBy(fold.alias("fold")).agg(*[F.count_if(F.col("n") == k).alias(f"k{k}") for k in (1, 2, 3, 4)])
        seen = {r["fold"]: [r[f"k{k}"] for k in (1, 2, 3, 4)] for r in kinds.collect()}
        off = [discounts(seen.get(f, [0] * 4)) for f in (0, 1)]
        discount = F.when(F.col("n") == 1, _of_fold(off, 0)).when(F.col("n") == 2, _of_fold(off, 1)).otherwise(_of_fold(off, 2))
        prefix = F.shiftleft(fold, FOLD)
        rows = table.select(
            prefix.bitwiseOR(F.lit(order - 1 << LENGTH)).bitwiseOR(F.shiftright(gram, 8)).alias("context"),
            F.col("key").bitwiseOR(F.lit(order << LENGTH)).alias("key"),
            "n",
            discount.alias("off"),
        )
        # At most 256 followers each, so a context's rows are a short list.
        groups = rows.groupBy("context").agg(
            F.sum("n").alias("total"), F.sum("off").alias("left"), F.collect_list(F.struct("key", "n", "off")).alias("own")
        )
        own = F.transform("own", lambda x: F.struct(
            x["key"].alias("key"), ((x["n"] - x["off"]) / F.col("total")).alias("share"), F.lit(0.0).alias("weight")
        ))
        context = F.struct(F.col("context").alias("key"), F.lit(0.0).alias("share"), (F.col("left") / F.col("total")).alias("weight"))
        level = groups.select(F.inline(F.concat(own, F.array(context))))
        found = level if found is None else found.unionByName(level)
        # One order down, an n-gram counts once for each byte seen before it.
        if order > 1:
            shorter = prefix.bitwiseOR(F.col("key").bitwiseAND(_mask(order - 1))).alias("key")
            table = stage(table.select(shorter).groupBy("key").agg(F.count(F.lit(1)).alias("n")))
    model = found.groupBy("key").agg(F.sum("share").cast("float").alias("share"), F.sum("weight").cast("float").alias("weight"))
    model = stage(model)
    clean(spark)
    return model


def _packed(x: np.ndarray) -> bytes:
    return zstandard.compress(x.tobytes(), 1)


def _unpacked(blob: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(blob), kind)


def _packed_keys(keys: np.ndarray) -> bytes:
    """Sorted keys by their distances, byte by byte of these, of which the higher ones are mostly 0."""
    return _packed(np.ascontiguousarray(np.diff(keys, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T))


def _unpacked_keys(blob: bytes) -> np.ndarray:
    bytes_of = _unpacked(blob, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(bytes_of.T).view(np.uint64).ravel(), dtype=np.uint64)


def _chunked(batches: Iterator[pa.RecordBatch], chunks: int) -> Iterator[pa.RecordBatch]:
    """Texts of each chunk together, compressed: (chunk, keys and lengths, bytes)."""
    for batch in batches:
        ids, folds = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        for begin, end, data, offsets in slices(batch.column(2), 16 * BLOCK):
            chunk = ids[begin:end] % chunks * 2 + folds[begin:end]
            order = np.argsort(chunk, kind="stable")
            numbers, cuts = np.unique(chunk[order], return_index=True)
            out: list[list] = [[], [], [], []]
            for c, rows in zip(numbers.tolist(), np.split(order, cuts[1:])):
                text = b"".join(data[offsets[r] : offsets[r + 1]].tobytes() for r in rows.tolist())
                own = ids[begin:end][rows], np.diff(offsets)[rows], zstandard.compress(text, 3)
                for column, x in zip(out, (c, own[0].tobytes(), own[1].tobytes(), own[2])):
                    column.append(x)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[0], pa.int64()), *(pa.array(x, pa.binary()) for x in out[1:])], ["chunk", "ids", "lengths", "texts"]
            )


def _pieces(table: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """A chunk's texts, some at a time: ids, bytes, offsets."""
    for ids, lengths, texts in zip(*(table.column(c) for c in ("ids", "lengths", "texts"))):
        data = np.frombuffer(zstandard.decompress(texts.as_py()), np.uint8)
        own = np.concatenate([[0], np.cumsum(np.frombuffer(lengths.as_py(), np.int64))])
        ids = np.frombuffer(ids.as_py(), np.int64)
        at = 0
        while at < len(ids):
            end = max(int(np.searchsorted(own, own[at] + BLOCK, side="right")) - 1, at + 1)
            yield ids[at:end], data[own[at] : own[end]], own[at : end + 1] - own[at]
            at = end


def _asked(number: int, table: pa.Table, shards: int) -> pa.Table:
    """A chunk's distinct n-grams of all orders, by shard."""
    held: list[np.ndarray] = []
    for _, data, offsets in _pieces(table):
        held.append(_distinct([grams(data, offsets)[0]]))
        if sum(map(len, held)) > 2 * max(HELD, len(held[0])):
            held = [_distinct(held)]
    gram = _distinct(held)
    fold, keys = number % 2, []
    for order in range(ORDER, -1, -1):
        # Shorter ones are ends of longer ones, and contexts their starts, which are ends too but for texts' first bytes.
        keys.append(key(fold, order, gram))
        gram = _distinct([gram & np.uint64(_mask(max(order - 1, 0))), gram >> np.uint64(8)]) if order else gram
    # Lower orders have lower keys. A stable sort by shard leaves those of a shard in their order.
    keys = np.concatenate(keys[::-1])
    shard = (keys % np.uint64(PRIME) % np.uint64(shards)).astype(np.int32 if shards > 1 << 15 else np.int16)
    order = np.argsort(shard, kind="stable")
    numbers, cuts = np.unique(shard[order], return_index=True)
    own = list(zip(numbers.tolist(), np.split(keys[order], cuts[1:])))
    return pa.table({
        "chunk": pa.array([number] * len(own), pa.int64()),
        "shard": pa.array([s for s, _ in own], pa.int64()),
        "keys": pa.array([_packed_keys(k) for _, k in own], pa.binary()),
    })


def _answered(asked: pa.Table, model: pa.Table) -> pa.Table:
    """What a shard knows of the n-grams that chunks ask for; unknown ones are left out."""
    model = model.sort_by("key")
    known = model.column("key").to_numpy().astype(np.uint64)
    values = [model.column(c).to_numpy() for c in ("share", "weight")]
    out: list[list] = [[], [], [], []]
    for chunk, blob in zip(asked.column("chunk").to_pylist(), asked.column("keys")):
        keys = _unpacked_keys(blob.as_py())
        at = np.minimum(np.searchsorted(known, keys), max(len(known) - 1, 0))
        there = known[at] == keys if len(known) else np.zeros(len(keys), bool)
        found = chunk, _packed_keys(keys[there]), *(_packed(v[at[there]]) for v in values)
        for column, x in zip(out, found):
            column.append(x)
    return pa.table([pa.array(out[0], pa.int64()), *(pa.array(x, pa.binary()) for x in out[1:])], ["chunk", "keys", "shares", "weights"])


class Lookup:
    """Shares and weights of a fold's n-grams, by key."""

    def __init__(self, keys: np.ndarray, shares: np.ndarray, weights: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.shares, self.weights = keys[order], shares[order], weights[order]

    def _at(self, keys: np.ndarray, values: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(keys))
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, values[at], 0.0)

    def logs(self, gram: np.ndarray, fold: int) -> np.ndarray:
        """The logarithm of the probability of each (sorted) n-gram's last byte after the others."""
        return np.log(self._p(gram, fold, ORDER))

    def _p(self, gram: np.ndarray, fold: int, order: int) -> np.ndarray:
        if not order:
            return np.full(len(gram), 1 / 256)
        # Shorter ones are fewer, and sorted ones are found faster.
        shorter, at = _numbered(gram & np.uint64(_mask(order - 1)))
        p = self._p(shorter, fold, order - 1)[at]
        weight = self._at(key(fold, order - 1, gram >> np.uint64(8)), self.weights)
        # A context that was never seen leaves everything to the shorter one.
        return np.where(weight > 0, self._at(key(fold, order, gram), self.shares) + weight * p, p)


def _judged(number: int, texts: pa.Table, answers: pa.Table) -> pa.Table:
    fold = number % 2
    parts = [(_unpacked_keys(k.as_py()), _unpacked(s.as_py(), np.float32), _unpacked(w.as_py(), np.float32))
             for k, s, w in zip(*(answers.column(c) for c in ("keys", "shares", "weights")))]
    none = (np.zeros(0, np.uint64), np.zeros(0, np.float32), np.zeros(0, np.float32))
    lookup = Lookup(*(np.concatenate([p[i] for p in [none, *parts]]) for i in range(3)))
    ids, logs = [np.zeros(0, np.int64)], [np.zeros(0)]
    for own, data, offsets in _pieces(texts):
        gram, place = grams(data, offsets)
        distinct, at = _numbered(gram)
        sums = np.concatenate([[0.0], np.cumsum(lookup.logs(distinct, fold)[at])])
        ids.append(own)
        logs.append(sums[place[1:]] - sums[place[:-1]])
    return pa.table({"_key": pa.array(np.concatenate(ids)), "log_p": pa.array(np.concatenate(logs))})


def score(texts: DataFrame, model: DataFrame, size: int) -> DataFrame:
    """(_key, log_p) of the texts (_key long, fold 0 or 1, text without empty ones) that hold about `size` bytes.

    A text of a fold is scored by the keys of the model's same fold number.
    """
    chunks = max(1, -(-size // (2 * CHUNK)))
    shards = max(16, 2 * chunks)
    packed = texts.select("_key", F.col("fold").cast("long"), "text").mapInArrow(
        partial(_chunked, chunks=chunks), "chunk long, ids binary, lengths binary, texts binary"
    )

    def ask(number: tuple, table: pa.Table) -> pa.Table:
        return _asked(number[0].as_py(), table, shards)

    def answer(number: tuple, asked: pa.Table, own: pa.Table) -> pa.Table:
        return _answered(asked, own)

    def judge(number: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        return _judged(number[0].as_py(), table, answers)

    asked = packed.groupBy("chunk").applyInArrow(ask, "chunk long, shard long, keys binary")
    known = model.withColumn("shard", F.col("key") % PRIME % shards)
    answers = asked.groupBy("shard").cogroup(known.groupBy("shard")).applyInArrow(
        answer, "chunk long, keys binary, shares binary, weights binary"
    )
    return packed.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(judge, "_key long, log_p double")
