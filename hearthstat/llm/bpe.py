"""Byte-level BPE encoding and decoding by a fixed table of ranks.

A text is cut into pre-tokens by the pattern; each is encoded by itself. Two
tiers: a minimal perfect hash over the vocabulary resolves a pre-token that is a
token as a whole; any other is merged pair by pair, with the pairs in a heap over
a linked list of its bytes, so that even a pre-token of a megabyte takes
n log n steps. Each distinct pre-token of a slice of rows is resolved once, and
merged ones are remembered up to a fixed number.

A null text has no tokens, like an empty one. Special tokens are not known: their
strings are ordinary text. The vocabulary (some 50,000 entries) is broadcast.
Output columns replace input columns of the same name.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Iterable, Iterator
from functools import cache, partial
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearthstat.llm.texts import mix, slices

#: The largest vocabulary that is broadcast, in entries.
MAX_VOCABULARY = 1_000_000
#: Merged pre-tokens that a task remembers, in each of two generations.
REMEMBERED = 100_000


def read_ranks(path: str) -> list[bytes]:
    """Tokens in order of their ids, from lines of base64 and rank."""
    with open(path, "rb") as lines:
        ranks = {int(b): base64.b64decode(a) for a, b in map(bytes.split, lines)}
    if sorted(ranks) != list(range(len(ranks))):
        raise ValueError("ranks must be 0, 1, 2, ...")
    if len(ranks) > MAX_VOCABULARY:
        raise ValueError(f"more than {MAX_VOCABULARY} tokens")
    return [ranks[i] for i in range(len(ranks))]


class PerfectHash:
    """A minimal perfect hash of distinct byte strings: hash and displace.

    Keys fall into buckets; from the largest on, a bucket gets the first seed that
    sends its keys to free slots. Buckets of one key name their slot outright, as
    a negative number.
    """

    def __init__(self, keys: list[bytes]):
        self.n = len(keys)
        self.buckets = max(1, self.n // 2)
        hashes = self.hashes(keys)
        owner = (hashes % np.uint64(self.buckets)).astype(np.int64)
        members: list[list[int]] = [[] for _ in range(self.buckets)]
        for i, b in enumerate(owner.tolist()):
            members[b].append(i)
        self.seeds = np.zeros(self.buckets, np.int64)
        self.key_at = np.full(self.n, -1, np.int64)
        free: Iterator[int] | None = None
        for b in sorted(range(self.buckets), key=lambda x: -len(members[x])):
            own = members[b]
            if not own:
                break
            if len(own) == 1:
                free = free or iter(np.flatnonzero(self.key_at < 0).tolist())
                at = next(free)
                self.seeds[b] = -at - 1
                self.key_at[at] = own[0]
                continue
            first = 0
            while True:
                tried = np.arange(first, first + 64)
                slots = np.sort(self._slots(hashes[own][None, :], tried[:, None]), axis=1)
                good = (slots[:, 1:] != slots[:, :-1]).all(1) & (self.key_at[slots] < 0).all(1)
                if good.any():
                    break
                first += 64
            seed = int(tried[good][0])
            self.seeds[b] = seed
            self.key_at[self._slots(hashes[own], np.full(len(own), seed))] = own

    @staticmethod
    def hashes(keys: Iterable[bytes]) -> np.ndarray:
        return np.array([xxhash.xxh3_64_intdigest(k) for k in keys], dtype=np.uint64)

    def _slots(self, hashes: np.ndarray, seeds: np.ndarray) -> np.ndarray:
        spread = mix(hashes ^ mix(seeds.astype(np.uint64) + np.uint64(1)))
        return (spread % np.uint64(self.n)).astype(np.int64)

    def find(self, keys: list[bytes]) -> np.ndarray:
        """For each string the only key that it can be equal to."""
        if not self.n:
            return np.full(len(keys), -1)
        hashes = self.hashes(keys)
        seeds = self.seeds[(hashes % np.uint64(self.buckets)).astype(np.int64)]
        slots = np.where(seeds < 0, -seeds - 1, self._slots(hashes, np.maximum(seeds, 0)))
        return self.key_at[slots]


def plain_pattern(pattern: str) -> str:
    """The pattern with its Unicode classes written out as ranges below U+10000, for the faster standard `re`."""
    out, inside, i = [], False, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            end = pattern.index("}", i) + 1 if pattern[i + 1] in "pP" else i + 2
            name, i = pattern[i:end], end
            if name[1] in "pPsS":
                negated = name[1] in "PS"
                if negated and inside:
                    raise ValueError(f"{name} in a class")
                ranges = _ranges(name[0] + name[1].lower() + name[2:])
                out.append(ranges if inside else f"[{'^' * negated}{ranges}]")
            else:
                out.append(name)
            continue
        inside = c == "[" or inside and c != "]"
        out.append(c)
        i += 1
    return "".join(out)


@cache
def _ranges(name: str) -> str:
    """The characters of a Unicode class below U+10000, as the inside of a character class."""
    every = "".join(map(chr, range(0xD800))) + "".join(map(chr, range(0xE000, 0x10000)))
    found = regex.findall(f"{name}+", every)
    return "".join(f"\\u{ord(x[0]):04x}-\\u{ord(x[-1]):04x}" for x in found)


def byte_pairs(ranks: dict[bytes, int]) -> list[int]:
    """The rank of each pair of bytes, by 256 * first + second; -1 if it is no token."""
    return [ranks.get(bytes((a, b)), -1) for a in range(256) for b in range(256)]


def merge(piece: bytes, ranks: dict[bytes, int], pairs: list[int]) -> list[int]:
    """The ids of one pre-token: always the leftmost of the lowest-ranked adjacent pairs is merged."""
    n = len(piece)
    after = list(range(1, n + 1))  # where the token that starts here ends; 0 once it is merged away
    before = list(range(-1, n))
    rank = ranks.get
    # A heap entry is one number: rank, start and end of the merged pair.
    bits = n.bit_length()
    low = (1 << bits) - 1
    heap = [
        ((r << bits | i) << bits) | i + 2
        for i, (x, y) in enumerate(zip(piece, piece[1:]))
        if (r := pairs[x << 8 | y]) >= 0
    ]
    heapify(heap)
    while heap:
        entry = heappop(heap)
        c, a = entry & low, entry >> bits & low
        b = after[a]
        if not b or b >= n or after[b] != c:
            continue
        after[a], after[b] = c, 0
        if c < n:
            before[c] = a
            e = after[c]
            if (r := rank(piece[a:e])) is not None:
                heappush(heap, ((r << bits | a) << bits) | e)
        if (p := before[a]) >= 0 and (r := rank(piece[p:c])) is not None:
            heappush(heap, ((r << bits | p) << bits) | c)
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : after[i]]])
        i = after[i]
    return ids


class Encoder:
    def __init__(self, tokens: list[bytes], pattern: str, table: PerfectHash):
        self.tokens, self.table = tokens, table
        self.cut_any = regex.compile(pattern).findall
        self.cut_plain = re.compile(plain_pattern(pattern)).findall
        self.beyond = re.compile("[\U00010000-\U0010ffff]").search
        self.ranks = {t: i for i, t in enumerate(tokens)}
        self.pairs = byte_pairs(self.ranks)
        # Two generations: when the young one is full it becomes the old one.
        self.young: dict[str, tuple[int, ...]] = {}
        self.old: dict[str, tuple[int, ...]] = {}

    def cut(self, text: str) -> list[str]:
        return self.cut_any(text) if self.beyond(text) else self.cut_plain(text)

    def merged(self, name: str, piece: bytes) -> tuple[int, ...]:
        ids = self.young.get(name)
        if ids is None:
            ids = self.old.get(name) or tuple(merge(piece, self.ranks, self.pairs))
            if len(self.young) >= REMEMBERED:
                self.young, self.old = {}, self.young
            self.young[name] = ids
        return ids

    def known(self, pieces: set[str]) -> dict[str, tuple[int, ...]]:
        """The ids of each pre-token."""
        names = list(pieces)
        raw = [p.encode() for p in names]
        out = {}
        for name, piece, i in zip(names, raw, self.table.find(raw).tolist()):
            if i >= 0 and self.tokens[i] == piece:
                out[name] = (i,)
            else:
                out[name] = self.merged(name, piece)
        return out

    def encode(self, texts: list[str]) -> list[array]:
        cut = [self.cut(t) for t in texts]
        known = self.known(set().union(*cut))
        return [array("I", chain.from_iterable(map(known.__getitem__, pieces))) for pieces in cut]

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


def _packed(values: list[bytes]) -> pa.Array:
    return pa.array(values, pa.binary())


def _tokenized(batches: Iterator[pa.RecordBatch], shared, decoded: bool) -> Iterator[pa.RecordBatch]:
    encoder = None
    for batch in batches:
        encoder = encoder or Encoder(*shared.value)
        where = batch.schema.get_field_index("text")
        for start, end, _, _ in slices(batch.column(where)):
            part = batch.slice(start, end - start)
            ids = encoder.encode([t or "" for t in part.column(where).to_pylist()])
            out = {name: part.column(name) for name in part.schema.names}
            out["n_tokens"] = pa.array([len(x) for x in ids], pa.int64())
            out["ids"] = _packed([x.tobytes() for x in ids])
            if decoded:
                out["decoded"] = _packed([encoder.decode(x) for x in ids])
            yield pa.RecordBatch.from_pydict(out)


def encode(docs: DataFrame, tokens: list[bytes], pattern: str, decoded: bool = False) -> DataFrame:
    """`docs` with n_tokens, ids (little-endian unsigned 32-bit integers) and, if asked for, the decoded bytes."""
    spark = docs.sparkSession
    docs = docs.drop("n_tokens", "ids", "decoded")
    shared = spark.sparkContext.broadcast((tokens, pattern, PerfectHash(tokens)))
    schema = T.StructType(list(docs.schema)).add("n_tokens", "long").add("ids", "binary")
    if decoded:
        schema = schema.add("decoded", "binary")
    return docs.mapInArrow(partial(_tokenized, shared=shared, decoded=decoded), schema)


def _decoded(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        tokens = shared.value
        ids = batch.column(batch.schema.get_field_index("ids")).to_pylist()
        text = [b"".join(tokens[i] for i in np.frombuffer(x, "<u4").tolist()) if x else b"" for x in ids]
        yield pa.RecordBatch.from_pydict({n: batch.column(n) for n in batch.schema.names} | {"decoded": _packed(text)})


def decode(rows: DataFrame, tokens: list[bytes]) -> DataFrame:
    """`rows` with the bytes that their packed ids stand for; null ids stand for none."""
    rows = rows.drop("decoded")
    shared = rows.sparkSession.sparkContext.broadcast(tokens)
    return rows.mapInArrow(partial(_decoded, shared=shared), T.StructType(list(rows.schema)).add("decoded", "binary"))


def multi_ranks() -> tuple[list[bytes], str]:
    """The vocabulary and pattern of the registered query."""
    import public_tokenizers

    return read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), public_tokenizers.PATTERN


def op10_byte_bpe(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return encode(docs, *multi_ranks(), decoded=True).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )
