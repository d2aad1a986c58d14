"""Quartile bucket digests of texts, and their likeness to one another.

Every window of five bytes of a text gives the triplets that start with its first byte;
each triplet is hashed, with its shape, into one of 128 buckets. A bucket's place among
the quartiles of the text's own counts takes two bits, so a digest says nothing of how
often a triplet occurs, but which ones are frequent. Before the buckets stands the
length, on a scale where a step is a tenth. Equal texts have equal digests.

Two digests differ by the steps between their buckets' quartiles and their lengths' (at
most LENGTH_STEPS). The likeness is 1 less the share of that in the most by which digests
of such quartiles could differ. So it runs from 0 to 1 for short texts, which fill few
buckets, as for long ones.

A null text is an empty one. Texts of fewer than three bytes have no triplets, and their
digest is that of their length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearthstat.llm.staging import stage
from hearthstat.llm.texts import CHUNK, seeds, slices

BUCKETS = 128
#: The second and third byte of a triplet, counted from its first.
SHAPES = ((1, 2), (1, 3), (2, 3), (1, 4), (2, 4), (3, 4))
STEP = np.log(1.1)
LENGTH_STEPS = 12

#: A bucket number for each byte at each place, as tables for bytes.translate; a triplet's are combined by exclusive or.
_TABLES = (seeds(12 * 256, 12) >> np.uint64(57)).astype(np.uint8).reshape(12, 256)
_FIRST, _SECOND = ({gap: t.tobytes() for gap, t in zip((1, 2, 3), _TABLES[i : i + 3])} for i in (0, 3))
_THIRD = {shape: t.tobytes() for shape, t in zip(SHAPES, _TABLES[6:])}


def _places(data: bytes, table: bytes) -> np.ndarray:
    return np.frombuffer(data.translate(table), np.uint8)


def counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Triplets in each bucket, a row for each text.

    All are counted, text by text; then those that run over a text's end are taken off.
    """
    rows = len(offsets) - 1
    total = np.zeros(rows * BUCKETS, dtype=np.int64)
    for a in range(0, len(data), CHUNK):
        part = data[a : a + CHUNK + 4].tobytes()
        inside = np.clip(offsets - a, 0, CHUNK)
        base = np.repeat(np.arange(rows) * BUCKETS, np.diff(inside))
        for gap in (1, 2, 3):
            pair = _places(part, _FIRST[gap])[:-gap] ^ _places(part, _SECOND[gap])[gap:]
            for third in range(gap + 1, 5):
                n = min(len(base), len(part) - third)
                if n <= 0:
                    continue
                bucket = base[:n] + (pair[:n] ^ _places(part, _THIRD[gap, third])[third : third + n])
                total += np.bincount(bucket, minlength=len(total))
                over = (offsets[1:, None] - a - np.arange(1, third + 1))[np.diff(offsets)[:, None] >= np.arange(1, third + 1)]
                over = over[(over >= 0) & (over < n)]
                total -= np.bincount(bucket[over], minlength=len(total))
    return total.reshape(rows, BUCKETS)


def digests(texts: pa.Array) -> np.ndarray:
    """A row of bytes for each text: the length's, and 32 of four buckets each."""
    out = [np.zeros((0, 1 + BUCKETS // 4), np.uint8)]
    for _, _, data, offsets in slices(texts):
        n = counts(data, offsets)
        limits = np.sort(n, axis=1)[:, [BUCKETS // 4 - 1, BUCKETS // 2 - 1, BUCKETS * 3 // 4 - 1]]
        place = (n[:, :, None] > limits[:, None, :]).sum(2).astype(np.uint8).reshape(len(n), -1, 4)
        packed = place[:, :, 0] << 6 | place[:, :, 1] << 4 | place[:, :, 2] << 2 | place[:, :, 3]
        length = np.minimum(np.rint(np.log1p(np.diff(offsets)) / STEP), 255).astype(np.uint8)
        out.append(np.concatenate([length[:, None], packed], axis=1))
    return np.concatenate(out)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of each row of digests to that of the other: 1 if they are equal, 0 if nothing agrees."""
    places = [np.stack([x[:, 1:] >> s & 3 for s in (6, 4, 2, 0)], axis=2).astype(np.int16) for x in (a, b)]
    differ = np.abs(places[0] - places[1]).sum((1, 2))
    most = np.maximum(*places).sum((1, 2)) + LENGTH_STEPS
    steps = np.abs(a[:, 0].astype(np.int16) - b[:, 0])
    return 1 - (differ + np.minimum(steps, LENGTH_STEPS)) / most


def read(fingerprints: list[str]) -> np.ndarray:
    """Digests from their hexadecimal form."""
    return np.frombuffer(bytes.fromhex("".join(fingerprints)), np.uint8).reshape(-1, 1 + BUCKETS // 4)


def written(digest: np.ndarray) -> list[str]:
    width = 2 * digest.shape[1]
    text = digest.tobytes().hex()
    return [text[i : i + width] for i in range(0, len(text), width)]


def _fingerprinted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = batch.schema.get_field_index("text")
        columns = {name: batch.column(name) for name in batch.schema.names}
        yield pa.RecordBatch.from_pydict(columns | {"fingerprint": pa.array(written(digests(batch.column(at))), pa.string())})


def fingerprint(docs: DataFrame) -> DataFrame:
    """`docs` with the digest of its column text; a column `fingerprint` that it has is replaced."""
    docs = docs.drop("fingerprint")
    return docs.mapInArrow(_fingerprinted, T.StructType(list(docs.schema)).add("fingerprint", "string"))


RESULT = (
    "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
)
#: Rows of a partition that have a neighbour in another one come with their text: FIRST, LAST.
FIRST, LAST = 1, 2
_EDGES = "edge int, part int, text string"


def _compared(ids: list, texts: list[str], own: np.ndarray, following: list[str], theirs: np.ndarray) -> dict[str, pa.Array]:
    """The result's columns for texts and those that follow them."""
    cut = [len(t) // 4 for t in texts]
    edited = [t[: len(t) - k] + f[:k] for t, f, k in zip(texts, following, cut)]
    digest = digests(pa.array(edited, pa.large_string()))
    return {
        "doc_id": ids,
        "n_chars": pa.array(map(len, texts), pa.int64()),
        "edited_sha256": pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()),
        "fingerprint": pa.array(written(own), pa.string()),
        "edited_fingerprint": pa.array(written(digest), pa.string()),
        "near_edited": pa.array(likeness(own, digest)),
        "near_next": pa.array(likeness(own, theirs)),
    }


def _edge(kind: int, part: int, row: tuple, like: pa.Schema) -> pa.RecordBatch:
    values = {"doc_id": row[0], "edge": kind, "part": part, "text": row[1]}
    return pa.RecordBatch.from_pylist([values], schema=like)


def _in_order(batches: Iterator[pa.RecordBatch], like: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Sorted rows, each with its successor; the first and the last also as edges."""
    part, held = TaskContext.get().partitionId(), None
    for batch in batches:
        ids, column = batch.column(0), batch.column(1)
        for start, end, _, _ in slices(column):
            texts = [t or "" for t in column.slice(start, end - start).to_pylist()]
            known = ids.slice(start, end - start).to_pylist()
            own = digests(pa.array(texts, pa.large_string()))
            if held is None:
                yield _edge(FIRST, part, (known[0], texts[0]), like)
            else:
                known, texts = [held[0], *known], [held[1], *texts]
                own = np.concatenate([held[2], own])
            held = known[-1], texts[-1], own[-1:]
            if len(texts) > 1:
                done = _compared(known[:-1], texts[:-1], own[:-1], texts[1:], own[1:])
                n = len(texts) - 1
                blank = {"edge": [0] * n, "part": [part] * n, "text": [None] * n}
                yield pa.RecordBatch.from_pydict(done | blank, schema=like)
    if held is not None:
        yield _edge(LAST, part, held, like)


def _across(batches: Iterator[pa.RecordBatch], like: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The last rows of partitions with the first ones of the next."""
    for batch in batches:
        ids, texts, following = (batch.column(i).to_pylist() for i in range(3))
        for i in range(len(ids)):  # one by one: whole texts stand on both sides
            own, theirs = (digests(pa.array([x[i]], pa.large_string())) for x in (texts, following))
            yield pa.RecordBatch.from_pydict(_compared([ids[i]], [texts[i]], own, [following[i]], theirs), schema=like)


def against_next(docs: DataFrame) -> DataFrame:
    """Each document compared with an edited copy and with the next document.

    The copy's last quarter (rounded down to code points) is replaced by as much of the
    next document's beginning. The next one is that with the next larger doc_id; nulls
    come first, rows that repeat an id in the order of a hash of their texts, and after the
    last row comes the first, which may be the row itself. Columns: doc_id and RESULT.

    Texts are shuffled once, into ranges of ids that split even a repeated id. A
    partition's last row meets the next partition's first one in a join of these edges;
    the driver only learns which partitions have rows.
    """
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("doc_id", kind), *T._parse_datatype_string(RESULT).fields])
    both = T.StructType([*schema.fields, *T._parse_datatype_string(_EDGES).fields])
    order = [F.col("doc_id").asc_nulls_first(), F.col("_hash").asc(), F.col("_row").asc()]
    rows = docs.select(
        "doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("_hash"), F.monotonically_increasing_id().alias("_row")
    )
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    done = stage(rows.mapInArrow(partial(_in_order, like=_arrow(both)), both))
    first = done.where(f"edge = {FIRST}").select("part", F.col("text").alias("following"))
    last = done.where(f"edge = {LAST}").select("doc_id", "part", "text")
    parts = sorted(r["part"] for r in first.select("part").collect())
    turn = spark.createDataFrame(list(zip(parts, parts[1:] + parts[:1])), "part int, next int")
    meet = last.join(turn, "part").join(first.withColumnRenamed("part", "next"), "next").select("doc_id", "text", "following")
    across = meet.mapInArrow(partial(_across, like=_arrow(schema)), schema)
    return done.where("edge = 0").select(*schema.names).unionByName(across)


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def op12_fingerprints(spark, sf_dir: str) -> DataFrame:
    return against_next(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
