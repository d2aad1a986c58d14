"""Reversible line dedup: exact reference counts of lines, with a cuckoo filter for each shard of them.

A line's key is the line without white space at its ends, A-Z lower-cased. The
state is two tables in the shared folder:

- counts: for each key (as 128 bits) the number of documents that hold it. It is
  exact, so documents can be added to it and taken out again.
- filters: for each shard of keys, a cuckoo filter of the keys that at least
  `min_docs` documents hold, and the few other keys that the filter mistakes for
  one of them. A filter with its exceptions therefore answers exactly.

Where all filters together are small (FILTER_BYTES), they are broadcast and documents
are rewritten in one pass, without a shuffle of text. Otherwise documents are dealt into
chunks of about CHUNK_BYTES; a chunk sends its distinct keys to their shards, whose
filters answer which of them go, and rewrites its texts by the answers. So a line that
very many documents hold is asked for once a chunk, and no filter leaves its shard.
Adding or removing documents puts in or takes out those keys whose count crosses
`min_docs`; shards that this makes too large are parted into twice as many.

A null text has one empty line and stays null; an empty line is never dropped;
a text whose lines all go becomes empty. Repeated rows count as documents of
their own. Output columns replace input columns of the same name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearthstat.llm.staging import stage
from hearthstat.llm.texts import mix, slices

WHITE = b" \t\n\x0b\x0c\r"
SLOTS = 4
#: Keys of one shard on average when a state is made.
SHARD_KEYS = 250_000
#: The most bytes of filters and exceptions that are broadcast, and bytes of text in a chunk otherwise.
FILTER_BYTES, CHUNK_BYTES = 64 << 20, 32 << 20
#: Bytes of text that are cut into lines at once; a batch of Spark's may hold much more.
PIECE_BYTES = 1 << 20

COUNTS = "shard int, k1 long, k2 long, n long"
FILTERS = "shard int, buckets int, slots binary, exceptions binary"


class Cuckoo:
    """A cuckoo filter of 16-bit fingerprints, four to a bucket, over 64-bit hashes."""

    def __init__(self, buckets: int, slots: bytes | None = None):
        self.mask = np.uint64(buckets - 1)
        self.table = (
            np.zeros((buckets, SLOTS), np.uint16) if slots is None
            else np.frombuffer(slots, np.uint16).reshape(buckets, SLOTS).copy()
        )

    def places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Fingerprint and the two buckets of each hash."""
        prints = (keys >> np.uint64(48)) | np.uint64(1)
        first = keys & self.mask
        return prints.astype(np.uint16), first, first ^ (mix(prints) & self.mask)

    def holds(self, keys: np.ndarray) -> np.ndarray:
        prints, a, b = self.places(keys)
        return (self.table[a] == prints[:, None]).any(1) | (self.table[b] == prints[:, None]).any(1)

    def add(self, keys: np.ndarray) -> bool:
        """False if a key found no room; the filter must then be made anew, larger."""
        for p, a, b in zip(*(x.tolist() for x in self.places(keys))):
            for at in (a, b):
                free = np.flatnonzero(self.table[at] == 0)
                if len(free):
                    self.table[at, free[0]] = p
                    break
            else:
                at = a
                for kick in range(500):
                    slot = kick % SLOTS
                    p, self.table[at, slot] = int(self.table[at, slot]), p
                    at = at ^ int(mix(np.array([p], np.uint64))[0] & self.mask)
                    free = np.flatnonzero(self.table[at] == 0)
                    if len(free):
                        self.table[at, free[0]] = p
                        break
                else:
                    return False
        return True

    def remove(self, keys: np.ndarray) -> None:
        for p, a, b in zip(*(x.tolist() for x in self.places(keys))):
            for at in (a, b):
                found = np.flatnonzero(self.table[at] == p)
                if len(found):
                    self.table[at, found[0]] = 0
                    break


@dataclass(frozen=True)
class State:
    """Written tables; `change` returns a new one and leaves this one as it is."""

    counts: DataFrame
    filters: DataFrame
    shards: int
    min_docs: int
    min_chars: int


def _line_keys(text: bytes) -> list[bytes]:
    return [line.strip(WHITE) for line in text.lower().split(b"\n")]


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows with about PIECE_BYTES of text at a time, as lists of lines take several times the text's memory."""
    for batch in batches:
        for begin, end, *_ in slices(batch.column(batch.schema.get_field_index("text")), PIECE_BYTES):
            yield batch.slice(begin, end - begin)


def _texts(column: pa.Array) -> Iterator[bytes]:
    """UTF-8 bytes of each text."""
    for x in column.cast(pa.binary()):
        yield x.as_py() or b""


def _long_enough(key: bytes, least: int) -> bool:
    return len(key) >= least and (least <= 1 or len(key.decode()) >= least)


def _distinct_keys(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    for batch in _pieces(batches):
        digests = []
        for text in _texts(batch.column(0)):
            digests += [xxhash.xxh3_128_digest(k) for k in set(_line_keys(text)) if k and _long_enough(k, least)]
        pairs = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.ascontiguousarray(pairs[:, i])) for i in (0, 1)], ["k1", "k2"]
        )


def line_counts(docs: DataFrame, min_chars: int = 1) -> DataFrame:
    """(k1, k2, n): in how many documents a line occurs."""
    keys = docs.select("text").mapInArrow(partial(_distinct_keys, least=min_chars), "k1 long, k2 long")
    return keys.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n"))


def _shard_filter(
    key: tuple, rows: pd.DataFrame, held: pd.DataFrame, buckets: int, min_docs: int
) -> pd.DataFrame:
    """One shard's filter after its counts went from `before` to `n`."""
    keys = rows["k1"].to_numpy(np.int64).view(np.uint64)
    was, now = rows["before"].to_numpy() >= min_docs, rows["n"].to_numpy() >= min_docs
    if len(held) and int(held["buckets"][0]) == buckets:
        cuckoo = Cuckoo(buckets, held["slots"][0])
        cuckoo.remove(keys[was & ~now])
        fits = cuckoo.add(keys[now & ~was])
    else:
        cuckoo = Cuckoo(buckets)
        fits = cuckoo.add(keys[now])
    while not fits:
        cuckoo = Cuckoo(2 * len(cuckoo.table))
        fits = cuckoo.add(keys[now])
    stays = (rows["n"].to_numpy() > 0) & ~now
    mistaken = rows[stays][cuckoo.holds(keys[stays])]
    pairs = mistaken[["k1", "k2"]].to_numpy(np.int64)
    return pd.DataFrame(
        {"shard": [key[0]], "buckets": [len(cuckoo.table)], "slots": [cuckoo.table.tobytes()],
         "exceptions": [pairs.tobytes()]}
    )


def change(state: State, docs: DataFrame, sign: int = 1) -> State:
    """The state after adding (1) or taking out (-1) documents."""
    state = _parted(state)
    delta = line_counts(docs, state.min_chars).select(
        F.pmod(F.col("k2"), F.lit(state.shards)).cast("int").alias("shard"), "k1", "k2", (F.col("n") * sign).alias("n")
    )
    both = state.counts.withColumn("before", F.col("n")).unionByName(delta.withColumn("before", F.lit(0).cast("long")))
    merged = stage(both.groupBy("shard", "k1", "k2").agg(F.sum("n").alias("n"), F.sum("before").alias("before")))
    per_shard = merged.groupBy("shard").agg(F.count_if(F.col("n") >= state.min_docs).alias("m"))
    row = per_shard.agg(F.max("m")).first()
    buckets = 1 << max(4, int(np.ceil(np.log2((row[0] or 0) / (SLOTS * 0.8) + 1))))
    filters = stage(
        merged.groupBy("shard").cogroup(state.filters.groupBy("shard")).applyInPandas(
            partial(_fill, buckets=buckets, min_docs=state.min_docs), FILTERS
        )
    )
    counts = merged.where("n > 0").select("shard", "k1", "k2", "n")
    return State(counts, filters, state.shards, state.min_docs, state.min_chars)


def _parted(state: State) -> State:
    """The same with twice as many shards as long as these hold too many keys on average; filters are then made anew."""
    shards, keys = state.shards, state.counts.count()
    while keys > 2 * SHARD_KEYS * shards:
        shards *= 2
    if shards == state.shards:
        return state
    counts = state.counts.withColumn("shard", F.pmod(F.col("k2"), F.lit(shards)).cast("int"))
    return State(counts, state.filters.limit(0), shards, state.min_docs, state.min_chars)


def _fill(key: tuple, rows: pd.DataFrame, held: pd.DataFrame, buckets: int, min_docs: int) -> pd.DataFrame:
    if not len(rows):
        return held
    return _shard_filter(key, rows, held, buckets, min_docs)


def build(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, shards: int | None = None) -> State:
    """The state of a corpus; `shards` defaults to its lines over SHARD_KEYS, counted approximately."""
    spark = docs.sparkSession
    if shards is None:
        lines = docs.select(F.size(F.split("text", "\n")).alias("n")).agg(F.sum("n")).first()[0] or 0
        shards = max(8, lines // SHARD_KEYS + 1)
    empty = State(
        spark.createDataFrame([], COUNTS), spark.createDataFrame([], FILTERS), shards, min_docs, min_chars
    )
    return change(empty, docs, 1)


def _keys_of(batch: pa.RecordBatch) -> tuple[list[bytes], list[list[bytes]], bytes, np.ndarray]:
    """Texts, their lines, the digests of the lines' keys, and the latter as pairs of numbers."""
    raw = list(_texts(batch.column(batch.schema.get_field_index("text"))))
    lines = [text.split(b"\n") for text in raw]
    digests = b"".join(xxhash.xxh3_128_digest(line.lower().strip(WHITE)) for doc in lines for line in doc)
    return raw, lines, digests, np.frombuffer(digests, np.int64).reshape(-1, 2)


def _held(cuckoo: Cuckoo, exceptions: set[bytes], digests: bytes, keys: np.ndarray) -> np.ndarray:
    """Which of the digests, of whose first halves `keys` are made, the filter holds and not by mistake."""
    found = cuckoo.holds(np.ascontiguousarray(keys).view(np.uint64))
    found[found] = [digests[16 * i : 16 * i + 16] not in exceptions for i in np.flatnonzero(found).tolist()]
    return found


def _exceptions(blob: bytes) -> set[bytes]:
    return {blob[i : i + 16] for i in range(0, len(blob), 16)}


def _rewritten(batch: pa.RecordBatch, raw: list[bytes], lines: list[list[bytes]], gone: np.ndarray, least: int) -> dict:
    """The batch's columns without the lines marked, but for lines too short to have a key."""
    first = np.cumsum([0, *map(len, lines)])
    for a, doc in zip(first.tolist(), lines):
        for j in np.flatnonzero(gone[a : a + len(doc)]).tolist():
            key = doc[j].lower().strip(WHITE)
            gone[a + j] = bool(key) and _long_enough(key, least)
    n_dropped = np.add.reduceat(gone, first[:-1], dtype=np.int64) if len(lines) else np.zeros(0, np.int64)
    kept = [
        b"\n".join(line for line, g in zip(doc, gone[a : a + len(doc)].tolist()) if not g) if d else text
        for a, doc, text, d in zip(first.tolist(), lines, raw, n_dropped.tolist())
    ]
    null = batch.column(batch.schema.get_field_index("text")).is_null().to_pylist()
    rest = {name: batch.column(name) for name in batch.schema.names if name not in ("text", "_chunk")}
    return rest | {
        "text": pa.array([None if x else t for t, x in zip(kept, null)], pa.binary()).cast(pa.string()),
        "n_lines": pa.array(np.diff(first), pa.int64()), "n_dropped": pa.array(n_dropped),
    }


def _drop(batches: Iterator[pa.RecordBatch], blocks, shards: int, least: int) -> Iterator[pa.RecordBatch]:
    """Take out the lines that the broadcast filters hold."""
    held = None
    for batch in _pieces(batches):
        if held is None:
            held = {s: (Cuckoo(n, slots), _exceptions(more)) for s, n, slots, more in blocks.value}
        raw, lines, digests, pairs = _keys_of(batch)
        shard = np.mod(pairs[:, 1], shards)
        gone = np.zeros(len(pairs), bool)
        for s, (cuckoo, exceptions) in held.items():
            at = np.flatnonzero(shard == s)
            own = b"".join(digests[16 * i : 16 * i + 16] for i in at.tolist())
            gone[at] = _held(cuckoo, exceptions, own, pairs[at, 0])
        yield pa.RecordBatch.from_pydict(_rewritten(batch, raw, lines, gone, least))


def _asked(number: int, table: pa.Table, shards: int) -> pa.Table:
    """A chunk's distinct keys, by shard."""
    distinct = {digests[i : i + 16] for batch in _pieces(table.to_batches()) for digests in [_keys_of(batch)[2]] for i in range(0, len(digests), 16)}
    by_shard: dict[int, list[bytes]] = {}
    for key in sorted(distinct):
        by_shard.setdefault(int.from_bytes(key[8:], "little", signed=True) % shards, []).append(key)
    return pa.table({
        "_chunk": pa.array([number] * len(by_shard), pa.int64()),
        "shard": pa.array(list(by_shard), pa.int32()),
        "keys": pa.array([b"".join(k) for k in by_shard.values()], pa.binary()),
    })


def _answered(asked: pa.Table, filters: pa.Table) -> pa.Table:
    """Those of the asked keys that go."""
    chunks, out = [], []
    for row in filters.to_pylist():
        cuckoo, exceptions = Cuckoo(row["buckets"], row["slots"]), _exceptions(row["exceptions"])
        for chunk, keys in zip(asked.column("_chunk").to_pylist(), asked.column("keys").to_pylist()):
            gone = _held(cuckoo, exceptions, keys, np.frombuffer(keys, np.int64).reshape(-1, 2)[:, 0])
            chunks.append(chunk)
            out.append(b"".join(keys[16 * i : 16 * i + 16] for i in np.flatnonzero(gone).tolist()))
    return pa.table({"_chunk": pa.array(chunks, pa.int64()), "keys": pa.array(out, pa.binary())})


def _judged(table: pa.Table, answers: pa.Table, least: int) -> pa.Table:
    keys = set().union(*(_exceptions(k) for k in answers.column("keys").to_pylist()))
    out = []
    for batch in _pieces(table.to_batches()):
        raw, lines, digests, pairs = _keys_of(batch)
        gone = np.array([digests[i : i + 16] in keys for i in range(0, len(digests), 16)], bool)
        out.append(pa.RecordBatch.from_pydict(_rewritten(batch, raw, lines, gone, least)))
    return pa.Table.from_batches(out)


def _by_shards(state: State, docs: DataFrame, schema: T.StructType) -> DataFrame:
    """Documents rewritten with the filters left in their shards."""
    shards, least = state.shards, state.min_chars
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks = max(1, -(-size // CHUNK_BYTES))
    # Written, so that a row is in the same chunk when it asks and when it is judged.
    rows = stage(docs.withColumn("_chunk", F.pmod(F.monotonically_increasing_id(), F.lit(chunks))))

    def ask(number: tuple, table: pa.Table) -> pa.Table:
        return _asked(number[0].as_py(), table, shards)

    def answer(number: tuple, asked: pa.Table, filters: pa.Table) -> pa.Table:
        return _answered(asked, filters)

    def judge(number: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        return _judged(table, answers, least)

    asked = rows.groupBy("_chunk").applyInArrow(ask, "_chunk long, shard int, keys binary")
    answers = asked.groupBy("shard").cogroup(state.filters.groupBy("shard")).applyInArrow(answer, "_chunk long, keys binary")
    return rows.groupBy("_chunk").cogroup(answers.groupBy("_chunk")).applyInArrow(judge, schema)


def apply(state: State, docs: DataFrame) -> DataFrame:
    """The documents without the lines that `min_docs` documents of the state hold, and n_lines, n_dropped."""
    size = state.filters.agg(F.sum(F.length("slots") + F.length("exceptions") + 64)).first()[0] or 0
    docs = docs.drop("n_lines", "n_dropped", "_chunk")
    names = docs.columns
    schema = T.StructType([f for f in docs.schema if f.name != "text"])
    schema = schema.add("text", "string").add("n_lines", "long").add("n_dropped", "long")
    if size > FILTER_BYTES:
        return _by_shards(state, docs, schema).select(*names, "n_lines", "n_dropped")
    blocks = [(r[0], r[1], bytes(r[2]), bytes(r[3])) for r in state.filters.collect()]
    step = partial(_drop, blocks=docs.sparkSession.sparkContext.broadcast(blocks), shards=state.shards, least=state.min_chars)
    return docs.mapInArrow(step, schema).select(*names, "n_lines", "n_dropped")


def dedup_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """`docs` without lines that at least `min_docs` of its documents hold."""
    return apply(build(docs, min_docs, min_chars), docs)


def op8_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs).select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256")
    )


OP8_SQL = r"""
WITH lines AS (
  SELECT doc_id, rid, unnest(parts) AS line, generate_subscripts(parts, 1) AS i
  FROM (SELECT doc_id, row_number() OVER () AS rid, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)),
keyed AS (
  SELECT *, translate(trim(line, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
common AS (SELECT k FROM keyed WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT rid) >= 10)
SELECT doc_id, count(*) AS n_lines, count(c.k) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE c.k IS NULL), '')) AS kept_sha256
FROM keyed LEFT JOIN common c ON keyed.k = c.k
GROUP BY rid, doc_id
"""
