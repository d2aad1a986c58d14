"""Near-duplicate texts: b-bit minhash signatures, a multi-index Hamming join, and a check on the full sets.

A text's set is its distinct shingles of `words` consecutive words (A-Z lower-cased),
or all its words as one shingle if it has fewer. Its signature is 24 minima of 16
bits. Two signatures are near if at most 11 of the 24 differ; a pair of sets with
similarity 0.85 misses that with odds of 6e-5, and less the more alike they are.

The join finds all near pairs without comparing all: the 24 parts lie in 6 chunks of
4. If at most 11 parts differ, then by the pigeonhole at most one does in some chunk
(two in each would make 12). So every text is filed under each chunk with each one of
its parts left out, 24 keys, and near texts share a key.

Texts with equal sets are one node from the start. Sharing a key is a candidate link
only; what links is 100 * intersection >= percent * union on the full sets. As only the
components are asked for, candidates are taken in rounds, so that a key with very many
texts never turns into all its pairs:

1. each text is compared with two of its key: the smallest id, and the text that shares
   the most keys with others (the original of a family of copies), which is linear;
2. the linked are joined into components; a key whose texts are all in one is done;
3. the texts of the other keys, with those that they share such keys with, make groups.
   In each group the signature of every text outside its largest component is compared
   with those of all the group's texts, block by block inside tasks, and so are sketches
   of 128 further minima, which near sets miss with odds of 4e-6. Only texts with
   a near one in another component go on. Their full sets are compared in the same blocks
   by tasks that only return who is connected to whom. Any link between two components
   is found, as one of its texts is outside. So texts that share a template, and with it
   keys, but are not near, cost a few bytes each and never meet in full.

Nulls: a null or wordless text has an empty set and links with nothing; a row without
an id keeps its set size and gets a null component. Rows that repeat an id are one
text with the union of ids; if their texts differ, each is a node under that id.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthstat.llm.components import components
from hearthstat.llm.staging import roots, runs, small, stage
from hearthstat.llm.texts import M64, WHITE, mix, seeds, signed, slices, word_table, words

WORDS = word_table(WHITE)
CHUNKS, PARTS, BITS = 6, 4, 16
#: Parts in which near signatures may differ; guaranteed by one error in some chunk.
NEAR = CHUNKS * 2 - 1
#: Texts of a block in the last round, and shingles compared at once.
BLOCK, SHARED = 256, 4096
#: Minima of 8 bits of a text's sketch, and standard deviations by which two near sets' may agree less than expected.
SKETCH, DEVIATIONS = 128, 4.5

_FACTORS = seeds(CHUNKS * PARTS, 2) | np.uint64(1)
_SHIFTS = seeds(CHUNKS * PARTS, 3)
_SIGNATURE = [f"s{i}" for i in range(CHUNKS)]
ROW = "doc_id long, n_shingles long, c1 long, c2 long, " + ", ".join(f"{s} long" for s in _SIGNATURE)


def shingles(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles, and the index of each text's first one."""
    _, _, hashes, first = words(data, offsets, WORDS)
    n = np.diff(first)
    counts = np.where(n >= size, n - size + 1, (n > 0).astype(n.dtype))
    place = np.concatenate([[0], np.cumsum(counts)])
    at = np.repeat(first[:-1] - place[:-1], counts) + np.arange(place[-1])
    # The hash of a shingle depends on its words, their order and number.
    padded = np.concatenate([hashes, np.zeros(size, np.uint64)])
    length = np.repeat(np.minimum(n, size), counts)
    out = mix(length.astype(np.uint64))
    for i, factor in enumerate(seeds(size, 4) | np.uint64(1)):
        out += np.where(i < length, padded[at + i] * factor, np.uint64(0))
    return mix(out), place


def _distinct(hashes: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same with each text's hashes sorted and distinct."""
    sets = [np.unique(hashes[a:b]) for a, b in zip(place[:-1].tolist(), place[1:].tolist())]
    sizes = np.array([len(s) for s in sets], np.int64)
    return np.concatenate([*sets, np.zeros(0, np.uint64)]), np.concatenate([[0], np.cumsum(sizes)])


def signatures(hashes: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Rows of CHUNKS numbers, each with PARTS minima of BITS bits; zeros for an empty set."""
    full = np.flatnonzero(np.diff(place))
    out = np.zeros((len(place) - 1, CHUNKS), np.uint64)
    if len(full):
        for i in range(CHUNKS * PARTS):
            x = hashes * _FACTORS[i] + _SHIFTS[i]
            x = (x ^ (x >> np.uint64(32))) * _FACTORS[i - 1]
            low = mix(np.minimum.reduceat(x, place[full])) >> np.uint64(64 - BITS)
            out[full, i // PARTS] |= low << np.uint64(BITS * (i % PARTS))
    return out


def sketches(hashes: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Rows of SKETCH minima of 8 bits."""
    full = np.flatnonzero(np.diff(place))
    out = np.zeros((len(place) - 1, SKETCH), np.uint8)
    if len(full):
        for i, (factor, shift) in enumerate(zip(seeds(SKETCH, 6) | np.uint64(1), seeds(SKETCH, 7))):
            x = hashes * factor + shift
            out[full, i] = mix(np.minimum.reduceat(x ^ (x >> np.uint64(32)), place[full])) >> np.uint64(56)
    return out


def _signed_rows(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for begin, end, data, offsets in slices(batch.column(1)):
            hashes, place = _distinct(*shingles(data, offsets, size))
            sums = [np.concatenate([[np.uint64(0)], np.cumsum(mix(hashes + s), dtype=np.uint64)]) for s in seeds(2, 5)]
            digest = [s[place[1:]] - s[place[:-1]] for s in sums]
            numbers = [np.diff(place), *(signed(d) for d in digest)]
            numbers += [signed(np.ascontiguousarray(c)) for c in signatures(hashes, place).T]
            ids = batch.column(0).slice(begin, end - begin)
            yield pa.RecordBatch.from_arrays(
                [ids, *(pa.array(x) for x in numbers)], ["doc_id", "n_shingles", "c1", "c2", *_SIGNATURE]
            )


def _sets(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for begin, end, data, offsets in slices(batch.column(1)):
            hashes, place = _distinct(*shingles(data, offsets, size))
            sets = pa.ListArray.from_arrays(pa.array(place, pa.int32()), pa.array(signed(hashes)))
            own = pa.array([x.tobytes() for x in sketches(hashes, place)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, end - begin), sets, own], ["node", "shingles", "sketch"])


def _keys(nodes: DataFrame) -> DataFrame:
    """Each node under its 24 keys: a chunk with one part left out."""
    lane = (1 << BITS) - 1
    masks = [~(lane << BITS * j) & M64 for j in range(PARTS)]
    masks = [m if m < 1 << 63 else m - M64 - 1 for m in masks]
    entries = [
        F.struct(F.lit(c * PARTS + j).alias("v"), F.col(s).bitwiseAND(F.lit(m)).alias("k"))
        for c, s in enumerate(_SIGNATURE)
        for j, m in enumerate(masks)
    ]
    return nodes.select("node", F.explode(F.array(*entries)).alias("e")).select("node", "e.v", "e.k")


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those pairs whose full sets are near enough."""
    a = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    b = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    both = pairs.join(a, "a").join(b, "b")
    common = F.size(F.array_intersect("x", "y"))
    union = F.size("x") + F.size("y") - common
    return both.where(common * 100 >= union * percent).select("a", "b")


def _compared(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Who is connected by links between the two sides of each piece of work."""
    for run in runs(batches, 3):
        side, node = run.column(3).to_numpy(), run.column(4).to_numpy()
        place = run.column(5).offsets.to_numpy()
        shingle = run.column(5).values.to_numpy()[place[0] : place[-1]]
        size, row = np.diff(place), np.repeat(np.arange(len(node)), np.diff(place))
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        if not len(left) or not len(right):
            continue
        at = np.zeros(len(node), np.int64)
        at[left], at[right] = np.arange(len(left)), np.arange(len(right))
        # Only shingles of both sides can be common.
        known = np.intersect1d(shingle[side[row] == 0], shingle[side[row] == 1])
        column = np.minimum(np.searchsorted(known, shingle), max(len(known) - 1, 0))
        both = known[column] == shingle if len(known) else np.zeros(len(shingle), bool)
        row, column = row[both], column[both]
        by = np.argsort(column, kind="stable")
        row, column = row[by], column[by]
        common = np.zeros((len(left), len(right)), np.float32)
        for start in range(0, len(known), SHARED):
            a, b = np.searchsorted(column, (start, start + SHARED))
            x = np.zeros((len(left), SHARED), np.float32)
            y = np.zeros((len(right), SHARED), np.float32)
            own, which = row[a:b], column[a:b] - start
            first = side[own] == 0
            x[at[own[first]], which[first]] = 1
            y[at[own[~first]], which[~first]] = 1
            common += x @ y.T
        common = common.astype(np.int64)
        union = size[left][:, None] + size[right][None, :] - common
        a, b = np.nonzero(common * 100 >= union * percent)
        a, b = left[a], right[b]
        root = roots(len(node), a, b)
        used = np.flatnonzero(root != np.arange(len(node)))
        yield pa.RecordBatch.from_arrays([pa.array(node[used]), pa.array(node[root[used]])], ["a", "b"])


def _near(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """The texts of each piece of work that have a near signature in another component on the other side."""
    for run in runs(batches, 3):
        side, node, component = (run.column(c).to_numpy() for c in (3, 4, 5))
        parts = np.stack([run.column(c).to_numpy() for c in range(6, 6 + CHUNKS)], axis=1).astype(np.int64).view(np.uint16)
        sketch = np.frombuffer(b"".join(run.column(6 + CHUNKS).to_pylist()), np.uint8).reshape(len(node), SKETCH)
        share = percent / 100
        least = SKETCH * share - DEVIATIONS * (SKETCH * share * (1 - share)) ** 0.5
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        keep = np.zeros(len(node), bool)
        for at in range(0, len(right), BLOCK):
            some = right[at : at + BLOCK]
            differ = (parts[left][:, None, :] != parts[some][None, :, :]).sum(2)
            a, b = np.nonzero((differ <= NEAR) & (component[left][:, None] != component[some][None, :]))
            for at_pair in range(0, len(a), 1 << 16):
                x, y = left[a[at_pair : at_pair + (1 << 16)]], some[b[at_pair : at_pair + (1 << 16)]]
                alike = (sketch[x] == sketch[y]).sum(1) >= least
                keep[x[alike]] = keep[y[alike]] = True
        kept = run.filter(pa.array(keep))
        yield pa.RecordBatch.from_arrays(kept.columns[:5], ["s", "i", "j", "side", "node"])


def _near_work(work: DataFrame, placed: DataFrame, nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of the work (s, i, j, side, node) what signatures and sketches leave to be compared in full."""
    keys = ["s", "i", "j"]
    known = placed.select("node", "component").distinct().join(nodes.select("node", *_SIGNATURE), "node")
    known = known.join(sets.select("node", "sketch"), "node")
    asked = work.join(known, "node").select(*keys, "side", "node", "component", *_SIGNATURE, "sketch")
    asked = asked.repartition(*keys).sortWithinPartitions(*keys)
    kind = dict(work.dtypes)
    return asked.mapInArrow(partial(_near, percent=percent), ", ".join(f"{c} {kind[c]}" for c in (*keys, "side", "node"))).distinct()


def _rest(filed: DataFrame, group: DataFrame, known: DataFrame, sets: DataFrame, percent: int) -> DataFrame | None:
    """Further links, between components that share a key; None if no key has several."""
    own = stage(filed.join(group, "node", "left").withColumn("component", F.coalesce("component", "node")))
    mixed = own.groupBy("v", "k").agg(F.min("component").alias("m0"), F.max("component").alias("m1"))
    mixed = stage(own.join(mixed.where("m0 <> m1").select("v", "k"), ["v", "k"]).select("node", "first", "component"))
    if not mixed.limit(1).count():
        return None
    together = components(mixed.select(F.col("node").alias("a"), F.col("first").alias("b")))
    nodes = mixed.select("node", "component").distinct().join(
        together.select("node", F.col("component").alias("s")), "node"
    )
    nodes = stage(nodes)
    sizes = nodes.groupBy("s", "component").agg(F.count(F.lit(1)).alias("n"))
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    groups = stage(
        sizes.groupBy("s").agg(F.max_by("component", "n").alias("main"), F.max("n").alias("most"), F.sum("n").alias("n"))
    ).select("s", "main", blocks(F.col("n") - F.col("most")).alias("gx"), blocks(F.col("n")).alias("gy"))
    placed = nodes.join(groups, "s")
    mine = lambda g: F.pmod(F.xxhash64("node"), F.col(g)).cast("int")
    every = lambda g: F.explode(F.sequence(F.lit(0), F.col(g) - 1))
    outside = placed.where("component <> main")
    work = outside.select("s", mine("gx").alias("i"), every("gy").alias("j"), F.lit(0).alias("side"), "node")
    work = work.unionByName(
        placed.select("s", every("gx").alias("i"), mine("gy").alias("j"), F.lit(1).alias("side"), "node")
    )
    keys = ["s", "i", "j"]
    work = stage(_near_work(work, placed, known, sets, percent))
    work = work.join(sets, "node").select(*keys, "side", "node", "shingles").repartition(*keys)
    work = work.sortWithinPartitions(*keys)
    return stage(work.mapInArrow(partial(_compared, percent=percent), "a long, b long"))


def near_duplicates(docs: DataFrame, percent: int = 80, size: int = 5) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of `docs` (doc_id, text).

    `percent` is at least 80: below it the signatures would miss links.
    """
    if percent < 80:
        raise ValueError("signatures are made for a similarity of 0.8 and more")
    docs = docs.select("doc_id", "text")
    rows = stage(docs.mapInArrow(partial(_signed_rows, size=size), ROW))
    same = ["n_shingles", "c1", "c2"]
    nodes = stage(
        rows.where("n_shingles > 0 and doc_id is not null")
        .groupBy(*same)
        .agg(F.min("doc_id").alias("node"), *(F.min(s).alias(s) for s in _SIGNATURE))
    )
    keys = _keys(nodes)
    shared = keys.groupBy("v", "k").agg(F.count(F.lit(1)).alias("m"), F.min("node").alias("first")).where("m > 1")
    filed = stage(keys.join(stage(shared), ["v", "k"]))
    company = stage(filed.groupBy("node").agg(F.sum("m").alias("company")))
    hub = filed.join(company, "node").groupBy("v", "k").agg(F.max_by("node", "company").alias("hub"))
    other = F.explode(F.array("first", "hub")).alias("other")
    tried = stage(
        filed.join(stage(hub), ["v", "k"]).select("node", other).where("node <> other")
        .select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()
    )
    wanted = small(stage(company.select(F.col("node").alias("doc_id"))))
    # An id of several rows has a set for each.
    sets = stage(docs.join(wanted, "doc_id").mapInArrow(partial(_sets, size=size), "node long, shingles array<long>, sketch binary"))
    links = stage(_linked(tried, sets, percent).distinct())
    group = components(links)
    more = _rest(filed, group, nodes, sets, percent)
    if more is not None:
        # Only whole components are still to be joined.
        ends = more
        for end in ("a", "b"):
            own = group.select(F.col("node").alias(end), F.col("component").alias("c"))
            ends = ends.join(own, end, "left").withColumn(end, F.coalesce("c", end)).drop("c")
        wider = components(ends).select(F.col("node").alias("component"), F.col("component").alias("w"))
        joined = group.join(wider, "component", "left").select("node", F.coalesce("w", "component").alias("component"))
        alone = wider.select(F.col("component").alias("node"), F.col("w").alias("component"))
        group = joined.unionByName(alone.join(group, "node", "left_anti"))

    found = nodes.select(*same, "node").join(group, "node", "left")
    found = found.select(*same, F.coalesce("component", "node").alias("component_id"))
    joined = rows.select("doc_id", *same).join(found, same, "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    component = F.when(F.col("doc_id").isNotNull(), component)
    return joined.select("doc_id", "n_shingles", component.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False))
    )


def op3_minhash_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), percent=85)


OP3_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS MATERIALIZED (
  SELECT a, b FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * c >= 85 * (x.n + y.n - c)),
both_ways AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION SELECT reach.a, e.b FROM reach JOIN both_ways e ON reach.b = e.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, r.component_id, r.component_id = d.doc_id AS kept
FROM documents d LEFT JOIN n USING (doc_id)
JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) r USING (doc_id)
"""
