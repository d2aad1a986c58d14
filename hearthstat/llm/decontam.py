"""Benchmark decontamination: an FM-index for each shard of training texts, searched for the benchmark's windows.

A window is `size` consecutive words of an item, or the whole of a shorter item.
Items go to the tasks in blocks of at most BLOCK_WORDS words (or one item), usually one
block. Further ones are searched for in passes of their own, one after the other, each
over a staged table of the documents with the words hit so far; so the driver and the
tasks hold one block at a time, however large the benchmark is. A shard is the few megabytes of a task's rows that are
in memory anyway: its words become symbols, where all words that no item of the
block has are one separator, as no window can reach over them; for the same reason
stretches shorter than the shortest window are left out. Windows are searched
backwards through the index all at once, their places found from sampled suffix
positions, and overlapping places merged into spans of the text.

Words are compared by 64-bit hashes. A null text has no words; items without words
have no windows; an item id that several rows share is one item, and items without
an id are found but not listed. Output columns replace input columns of the same name.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearthstat.llm.fmindex import FMIndex
from hearthstat.llm.staging import stage
from hearthstat.llm.texts import slices, word_table, words

#: All but digits, letters and what lies beyond ASCII separates words.
WORDS = word_table([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
WORDS[ord("A") : ord("Z") + 1] = True  # lower-cased before they are cut
#: Words of the benchmark broadcast at once.
BLOCK_WORDS = 1_000_000

ADDED = "n_words long, n_hit long, items array<long>, spans array<struct<start:int,end:int>>"
#: What a pass leaves to the next one: stretches of words hit, and items.
SO_FAR = "_hit array<struct<a:int,b:int>>, _items array<long>"


def blocks(benchmark: DataFrame) -> Iterator[tuple[list, list[np.ndarray]]]:
    """Item ids and word hashes, at most BLOCK_WORDS words (or one item) at a time."""
    ids, hashes, room = [], [], BLOCK_WORDS
    for row in benchmark.select("item_id", "text").toLocalIterator():
        for _, _, data, offsets in slices(pa.array([row[1]], pa.string())):
            own = words(data, offsets, WORDS)[2]
            if len(own) > room and ids:
                yield ids, hashes
                ids, hashes, room = [], [], BLOCK_WORDS
            if len(own):
                ids.append(row[0])
                hashes.append(own)
                room -= len(own)
    if ids:
        yield ids, hashes


class Windows:
    """The distinct windows of a block of items, as rows of symbols, and the items that each comes from."""

    def __init__(self, ids: list, hashes: list[np.ndarray], size: int):
        self.vocabulary = np.unique(np.concatenate(hashes))
        rows, owners = [], []
        for i, own in enumerate(hashes):
            symbols = (np.searchsorted(self.vocabulary, own) + 1).astype(np.int32)
            if len(symbols) < size:
                symbols = np.concatenate([np.full(size - len(symbols), -1, np.int32), symbols])
            windows = np.lib.stride_tricks.sliding_window_view(symbols, size)
            rows.append(windows)
            owners.append(np.full(len(windows), i))
        self.rows, which = np.unique(np.concatenate(rows), axis=0, return_inverse=True)
        self.lengths = (self.rows > 0).sum(1)
        which, owners = which.ravel(), np.concatenate(owners)
        order = np.argsort(which, kind="stable")
        self.owners = owners[order]
        self.first = np.searchsorted(which[order], np.arange(len(self.rows) + 1))
        self.ids = ids

    def symbols(self, hashes: np.ndarray) -> np.ndarray:
        """1 and up; 0 for a word that no item has."""
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at + 1, 0).astype(np.int32)

    def find(self, hashes: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first word, window) of every occurrence among the words of a shard; `doc`: whose word it is."""
        symbols = self.symbols(hashes)
        begins = np.ones(len(symbols), bool)
        begins[1:] = (symbols[1:] == 0) | (symbols[:-1] == 0) | (doc[1:] != doc[:-1])
        run = np.cumsum(begins) - 1
        kept = (symbols > 0) & (np.bincount(run)[run] >= self.lengths.min()) if len(run) else begins
        at = np.flatnonzero(kept)
        if not len(at):
            return at, at
        starts = np.flatnonzero(begins[at])
        word = np.insert(at, starts, -1)
        text = np.insert(symbols[at], starts, 0)
        index = FMIndex(np.append(text, 0), len(self.vocabulary))
        low, high = index.search(self.rows)
        n = np.maximum(high - low, 0)
        window = np.repeat(np.arange(len(n)), n)
        ranks = np.arange(len(window)) - np.repeat(np.cumsum(n) - n, n) + low[window]
        return word[index.locate(ranks)], window


def _spread(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... within each of consecutive groups."""
    return np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)


def _edges(hit: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last words of the stretches that are hit."""
    same = doc[1:] == doc[:-1]
    before = np.concatenate([[False], hit[:-1] & same])[: len(hit)]
    after = np.concatenate([hit[1:] & same, [False]])[-len(hit) :] if len(hit) else before
    return np.flatnonzero(hit & ~before), np.flatnonzero(hit & ~after)


class Found:
    """The words of a slice's texts, which of them are hit, and by which items."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.offsets = offsets
        self.starts, self.ends, self.hashes, self.first = words(data, offsets, WORDS)
        self.doc = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))
        self.change = np.zeros(len(self.starts) + 1, np.int64)
        self.items: list[set] = [set() for _ in range(len(offsets) - 1)]

    def recall(self, hit: list, items: list) -> None:
        """What earlier passes have found."""
        for d, (own, known) in enumerate(zip(hit, items)):
            self.items[d].update(known or ())
            for stretch in own or ():
                self.change[self.first[d] + stretch["a"]] += 1
                self.change[self.first[d] + stretch["b"]] -= 1

    def search(self, block: Windows) -> None:
        word, window = block.find(self.hashes, self.doc)
        np.add.at(self.change, word, 1)
        np.add.at(self.change, word + block.lengths[window], -1)
        n = block.first[window + 1] - block.first[window]
        owner = block.owners[np.repeat(block.first[window], n) + _spread(n)]
        pairs = np.unique(np.repeat(self.doc[word], n) * len(block.ids) + owner)
        for d, i in zip((pairs // len(block.ids)).tolist(), (pairs % len(block.ids)).tolist()):
            if block.ids[i] is not None:
                self.items[d].add(block.ids[i])

    @property
    def hit(self) -> np.ndarray:
        return np.cumsum(self.change)[:-1] > 0

    def stretches(self) -> list[list[dict]]:
        """Per text, from and to which of its words it is hit."""
        out: list[list[dict]] = [[] for _ in self.items]
        for a, b in zip(*(x.tolist() for x in _edges(self.hit, self.doc))):
            d = int(self.doc[a])
            out[d].append({"a": a - int(self.first[d]), "b": b + 1 - int(self.first[d])})
        return out

    def spans(self) -> dict[int, list[tuple[int, int]]]:
        """By text, the hit stretches in bytes."""
        spans: dict[int, list[tuple[int, int]]] = {}
        edge, after = _edges(self.hit, self.doc)
        for d, a, b in zip(self.doc[edge].tolist(), self.starts[edge].tolist(), self.ends[after].tolist()):
            base = int(self.offsets[d])
            spans.setdefault(d, []).append((a - base, b - base))
        return spans


def _scan(batches: Iterator[pa.RecordBatch], shared, size: int, cut: bool, last: bool) -> Iterator[pa.RecordBatch]:
    windows = None
    for batch in batches:
        if windows is None and shared is not None:
            windows = Windows(*shared.value, size)
        names = batch.schema.names
        for begin, end, data, offsets in slices(batch.column(names.index("text"))):
            part = batch.slice(begin, end - begin)
            found = Found(data, offsets)
            if "_hit" in names:
                found.recall(*(part.column(names.index(c)).to_pylist() for c in ("_hit", "_items")))
            if windows is not None:
                found.search(windows)
            out = {name: part.column(i) for i, name in enumerate(names) if name not in ("_hit", "_items")}
            items = pa.array([sorted(x) for x in found.items], pa.list_(pa.int64()))
            if not last:
                out["_hit"] = pa.array(found.stretches(), pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])))
                out["_items"] = items
                yield pa.RecordBatch.from_pydict(out)
                continue
            total = np.concatenate([[0], np.cumsum(found.hit)])
            points: list[list] = [[] for _ in found.items]
            if spans := found.spans():
                texts = out["text"].to_pylist() if cut else None
                for d, own in spans.items():
                    raw = data[offsets[d] : offsets[d + 1]]
                    chars = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
                    points[d] = [{"start": int(chars[a]), "end": int(chars[b])} for a, b in own]
                    if cut:
                        bounds = [0, *(x for s in own for x in s), len(raw)]
                        kept = [raw[a:b].tobytes() for a, b in zip(bounds[0::2], bounds[1::2])]
                        texts[d] = b"".join(kept).decode()
                if cut:
                    out["text"] = pa.array(texts, pa.string())
            out["n_words"] = pa.array(np.diff(found.first), pa.int64())
            out["n_hit"], out["items"] = pa.array(np.diff(total[found.first]), pa.int64()), items
            out["spans"] = pa.array(
                points, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            )
            yield pa.RecordBatch.from_pydict(out)


def scan(docs: DataFrame, benchmark: DataFrame, size: int = 10, cut: bool = False) -> DataFrame:
    """`docs` with n_words, n_hit, items (ids whose windows occur) and spans (code points, end exclusive).

    With `cut`, the spans are taken out of the text. `item_id` must be an integer.
    """
    added, so_far = T._parse_datatype_string(ADDED), T._parse_datatype_string(SO_FAR)
    docs = docs.drop(*added.names, *so_far.names)
    columns = list(docs.schema)

    def search(rows: DataFrame, block: tuple | None, last: bool) -> DataFrame:
        shared = None if block is None else docs.sparkSession.sparkContext.broadcast(block)
        step = partial(_scan, shared=shared, size=size, cut=cut, last=last)
        return rows.mapInArrow(step, T.StructType([*columns, *(added if last else so_far)]))

    waiting = None
    for block in blocks(benchmark):
        if waiting is not None:
            docs = stage(search(docs, waiting, False))
        waiting = block
    return search(docs, waiting, True)


def op5_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    names = F.array_sort(F.transform("items", lambda i: i.cast("string")))
    return scan(docs, benchmark).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


_CUT = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP5_SQL = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, {_CUT} AS w FROM documents),
b AS (SELECT item_id, {_CUT} AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, l, array_to_string(w[i:i + l - 1], ' ') AS g
  FROM (SELECT item_id, w, least(10, len(w)) AS l, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i
        FROM b WHERE len(w) > 0)),
dw AS (
  SELECT rid, i, l, array_to_string(w[i:i + l - 1], ' ') AS g
  FROM (SELECT rid, w, l, unnest(range(1, len(w) - l + 2)) AS i
        FROM d, (SELECT DISTINCT l FROM bw) WHERE len(w) >= l)),
hits AS MATERIALIZED (SELECT rid, i, dw.l, item_id FROM dw JOIN bw ON dw.l = bw.l AND dw.g = bw.g),
hit AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + l)) AS p FROM hits) GROUP BY rid),
its AS (SELECT rid, count(DISTINCT item_id) AS n_items,
               sha256(string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR)) AS items_sha256
        FROM hits GROUP BY rid)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (rid) LEFT JOIN its USING (rid)
"""
