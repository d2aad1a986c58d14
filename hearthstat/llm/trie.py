"""The prefix trie of conversations, with members, leaves and savings of every node.

A turn is known by a 128-bit digest of its role and text, so texts are read once and
never shuffled. Conversations, as sequences of digests, are dealt into ranges of their
sorted order, ties by id, which splits even a conversation that very many ids share. A
task cuts its range into shards of SHARD_TURNS turns. In each, turns get numbers from the
shard's own dictionary and the sequences go into a ternary search tree, medians first, so
that siblings form balanced trees. A walk over the nodes, children before parents, adds
up members, leaves and savings.

The members of a node are neighbours in sorted order. A node on neither the first nor the
last sequence of its shard therefore has all its members there, and is done. The others,
two paths a shard, go on as open records; those of a run of neighbouring shards are
merged, which closes all but the run's own two paths, first within tasks, then over
groups of GROUP tasks, until none is open. What an open node still owes to those done
before it (its smallest member, as their parent) is joined by its key.

Ids that end at an open node are kept apart in rows of ENDS ids, and one task hashes
those of a node in order, a row at a time. A single conversation must fit a task, like a
single text; nothing else is gathered whole.

Rows without a conv_id belong to no conversation and are left out; a null role or text
is an empty one. Turns of a conversation that share a number are ordered by their
digests, and repeated rows are repeated turns. An empty table has no nodes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import partial

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearthstat.llm.staging import small, stage

#: Turns that a shard's tree holds; a longer conversation is a shard of its own.
SHARD_TURNS = 100_000
#: Tasks whose open records are merged at once.
GROUP = 1024
#: Ids in a row of those that end at an open node.
ENDS = 1000
DIGEST = 16

DONE, OPEN, TAIL = 0, 1, 2
RESULT = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long"
_ROW = f"{RESULT}, ends_sha256 string, kind int, key binary, parent binary, words long, place long, at int, first boolean, last boolean"
_ARROW = pa.schema([
    *[(n, pa.int64()) for n in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")],
    ("ends_sha256", pa.string()), ("kind", pa.int32()), ("key", pa.binary()), ("parent", pa.binary()), ("words", pa.int64()),
    ("place", pa.int64()), ("at", pa.int32()), ("first", pa.bool_()), ("last", pa.bool_()),
])


class Tree:
    """A ternary search tree. Each node is a prefix; node 0 is the root, and children come after parents."""

    def __init__(self):
        self.turn, self.low, self.same, self.high = [-1], [0], [0], [0]  # 0 is no node
        self.parent, self.depth, self.words = [0], [0], [0]

    def _add(self, turn: int, parent: int, words: int) -> int:
        self.turn.append(turn)
        for links in (self.low, self.same, self.high):
            links.append(0)
        self.parent.append(parent)
        self.depth.append(self.depth[parent] + 1)
        self.words.append(words)
        return len(self.turn) - 1

    def insert(self, turns: list[int], words: list[int]) -> int:
        """The node of the sequence; words has the length of each turn."""
        node = 0
        for turn, n in zip(turns, words):
            parent, links, node = node, self.same, node
            while (found := links[node]) and self.turn[found] != turn:
                node, links = found, self.low if turn < self.turn[found] else self.high
            if not found:
                links[node] = found = self._add(turn, parent, n)
            node = found
        return node


def medians(n: int) -> Iterator[int]:
    """0 to n - 1, the median first, then those of both halves, and so on."""
    waiting = [(0, n)]
    for a, b in waiting:
        if a < b:
            middle = (a + b) // 2
            yield middle
            waiting += [(a, middle), (middle + 1, b)]


@dataclass
class Open:
    """What is known of a node that may go on in other shards: a record, or several merged.

    `children`, `leaves` and `saved` count what closed children brought.
    """

    key: bytes
    parent: bytes | None
    depth: int
    words: int
    members: int
    least: int
    children: int
    leaves: int
    saved: int
    place: int
    first: bool
    last: bool


@dataclass
class Rows:
    """Rows of the result and of what goes on, column by column."""

    columns: dict[str, list] = field(default_factory=lambda: {n: [] for n in _ARROW.names})

    def add(self, **values) -> None:
        for name, column in self.columns.items():
            column.append(values.get(name))

    def add_open(self, x: Open) -> None:
        self.add(kind=OPEN, key=x.key, parent=x.parent, depth=x.depth, words=x.words, n_convs=x.members, conv_id=x.least,
                 n_children=x.children, n_leaves=x.leaves, saved_tokens=x.saved, place=x.place, first=x.first, last=x.last)

    def batch(self) -> pa.RecordBatch:
        done = pa.RecordBatch.from_pydict(self.columns, schema=_ARROW)
        self.__init__()
        return done


def _joined(ids: list[int]) -> str:
    return ",".join(map(str, ids))


NO_ENDS = hashlib.sha256(b"").hexdigest()


def shard(rows: list[tuple[int, bytes, list[int]]], place: tuple[int, int], out: Rows) -> list[Open]:
    """One shard's sorted rows (id, path of digests, words of each turn): closed nodes go out, open ones are returned."""
    paths: list[bytes] = []
    ids: list[list[int]] = []
    lengths: list[list[int]] = []
    for conv, path, words in rows:
        if not paths or paths[-1] != path:
            paths.append(path)
            ids.append([])
            lengths.append(words)
        ids[-1].append(conv)
    turns = [[p[i : i + DIGEST] for i in range(0, len(p), DIGEST)] for p in paths]
    number = {k: i for i, k in enumerate(sorted({k for t in turns for k in t}))}
    tree = Tree()
    ends: dict[int, int] = {}
    for i in medians(len(paths)):
        ends[tree.insert([number[k] for k in turns[i]], lengths[i])] = i
    n = len(tree.turn)
    node_of = {i: node for node, i in ends.items()}
    edge = [set(), set()]
    key: dict[int, bytes] = {}
    for side, i in zip(edge, (0, len(paths) - 1)):
        node = node_of[i]
        while True:
            side.add(node)
            key[node] = hashlib.md5(paths[i][: tree.depth[node] * DIGEST]).digest()
            if not node:
                break
            node = tree.parent[node]

    members, children, leaves, saved = [0] * n, [0] * n, [0] * n, [0] * n
    least: list[int | None] = [None] * n
    for node in range(n - 1, -1, -1):
        if node in ends:
            own = ids[ends[node]]
            members[node] += len(own)
            least[node] = own[0] if least[node] is None else min(least[node], own[0])
        closed = node not in key
        if closed:
            leaves[node] += not children[node]
            saved[node] += (members[node] - 1) * tree.words[node]
        if node:
            up = tree.parent[node]
            members[up] += members[node]
            least[up] = least[node] if least[up] is None else min(least[up], least[node])
            if closed:
                children[up] += 1
                leaves[up] += leaves[node]
                saved[up] += saved[node]

    for node in range(n):
        own = ids[ends[node]] if node in ends else []
        if node in key:
            for at in range(0, len(own), ENDS):
                out.add(kind=TAIL, key=key[node], place=place[0], at=place[1] + at // ENDS, ends_sha256=_joined(own[at : at + ENDS]))
            continue
        up = tree.parent[node]
        out.add(kind=DONE, conv_id=least[node], depth=tree.depth[node], n_convs=members[node], n_children=children[node],
                n_leaves=leaves[node], saved_tokens=saved[node], parent=key.get(up), parent_conv_id=None if up in key else least[up],
                ends_sha256=hashlib.sha256(_joined(own).encode()).hexdigest() if own else NO_ENDS)
    return [
        Open(key[node], key[tree.parent[node]] if node else None, tree.depth[node], tree.words[node], members[node], least[node],
             children[node], leaves[node], saved[node], place[1], node in edge[0], node in edge[1])
        for node in sorted(key)
    ]


def merge(records: list[Open], out: Rows, place: int, final: bool = False) -> list[Open]:
    """The open records of neighbouring shards: nodes that close go out, those of the run's own edges are returned."""
    if not records:
        return []
    start, end = min(r.place for r in records), max(r.place for r in records)
    nodes: dict[bytes, Open] = {}
    for r in records:
        x = nodes.setdefault(r.key, Open(r.key, r.parent, r.depth, r.words, 0, r.least, 0, 0, 0, place, False, False))
        x.members += r.members
        x.least = min(x.least, r.least)
        x.children += r.children
        x.leaves += r.leaves
        x.saved += r.saved
        x.first |= not final and r.first and r.place == start
        x.last |= not final and r.last and r.place == end
    remaining = []
    for x in sorted(nodes.values(), key=lambda x: -x.depth):
        if x.first or x.last:
            remaining.append(x)
            continue
        x.leaves += not x.children
        x.saved += (x.members - 1) * x.words
        up = nodes.get(x.parent)
        if up:
            up.children += 1
            up.leaves += x.leaves
            up.saved += x.saved
        waits = up and (up.first or up.last)
        out.add(kind=DONE, key=x.key, parent=x.parent if waits else None, conv_id=x.least, depth=x.depth, n_convs=x.members,
                n_children=x.children, n_leaves=x.leaves, saved_tokens=x.saved, parent_conv_id=up.least if up and not waits else None)
    return remaining


def _sharded(batches: Iterator[pa.RecordBatch], turns: int) -> Iterator[pa.RecordBatch]:
    part = TaskContext.get().partitionId()
    out, opened, held, n, number = Rows(), [], [], 0, 0
    for batch in batches:
        for row in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if held and n + len(row[2]) > turns:
                opened += shard(held, (part, number), out)
                number += 1 + len(held) // ENDS
                yield out.batch()
                held, n = [], 0
                if len(opened) > turns:
                    opened = merge(opened, out, number - 1)
            held.append(row)
            n += len(row[2]) + 1
    if held:
        opened += shard(held, (part, number), out)
    for x in merge(opened, out, part):
        out.add_open(x)
    yield out.batch()


def _merging(group: int, final: bool) -> Callable[[pa.Table], pa.Table]:
    def merged(table: pa.Table) -> pa.Table:
        out = Rows()
        records = [
            Open(r["key"], r["parent"], r["depth"], r["words"], r["n_convs"], r["conv_id"], r["n_children"], r["n_leaves"],
                 r["saved_tokens"], r["place"], r["first"], r["last"])
            for r in table.to_pylist()
        ]
        for x in merge(records, out, records[0].place // group, final):
            out.add_open(x)
        return pa.Table.from_batches([out.batch()])

    return merged


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, sha256) of the sorted rows of ids of each key."""
    key, sha = None, None
    for batch in batches:
        done: list[tuple] = []
        for k, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if k != key:
                if sha:
                    done.append((key, sha.hexdigest()))
                key, sha = k, hashlib.sha256(text.encode())
            else:
                sha.update(b"," + text.encode())
        yield _shas(done)
    yield _shas([(key, sha.hexdigest())] if sha else [])


def _shas(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"key": pa.array([r[0] for r in rows], pa.binary()), "sha": pa.array([r[1] for r in rows], pa.string())})


def prefix_trie(sequences: DataFrame) -> DataFrame:
    """The nodes of sequences (conv_id, turns array<struct<key binary, words>>), one row for each conv_id.

    Columns: RESULT and ends_sha256; a node is known by conv_id, its smallest member, and depth.
    """
    paths = sequences.select(
        "conv_id",
        F.unhex(F.array_join(F.transform("turns", lambda t: F.hex(t["key"])), "")).alias("path"),
        F.transform("turns", lambda t: t["words"].cast("long")).alias("words"),
    )
    dealt = paths.repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id")
    rows = stage(dealt.mapInArrow(partial(_sharded, turns=SHARD_TURNS), _ROW))
    done = rows.where(f"kind = {DONE}")
    opened = rows.where(f"kind = {OPEN}")
    merged = []
    while True:
        final = opened.where("depth = 0").count() <= GROUP
        run = F.lit(0) if final else F.floor(F.col("place") / GROUP)
        level = stage(opened.groupBy(run.alias("run")).applyInArrow(_merging(GROUP, final), _ROW))
        merged.append(level.where(f"kind = {DONE}"))
        if final:
            break
        opened = level.where(f"kind = {OPEN}")

    # Nodes that closed in a merge have a key: by it they get their ends, and their children's parent.
    own = done.where("key is not null")
    for level in merged:
        own = own.unionByName(level)
    tails = rows.where(f"kind = {TAIL}").repartition("key").sortWithinPartitions("key", "place", "at").select("key", "ends_sha256")
    own = own.drop("ends_sha256").join(tails.mapInArrow(_hashed, "key binary, sha string"), "key", "left")
    own = stage(own.withColumn("ends_sha256", F.coalesce("sha", F.lit(NO_ENDS))).select(*rows.columns))
    nodes = done.where("key is null").unionByName(own)
    names = [f.strip().split()[0] for f in RESULT.split(",")] + ["ends_sha256"]
    parents = small(own.select(F.col("key").alias("parent"), F.col("conv_id").alias("_parent")))
    waiting = nodes.where("parent is not null").join(parents, "parent", "left").withColumn("parent_conv_id", F.col("_parent"))
    return nodes.where("parent is null").select(*names).unionByName(waiting.select(*names))


def spread(conversations: DataFrame, together: Column) -> DataFrame:
    """(together, conv_id, turns): each conversation's turns in order, shuffled once, by `together`, a function of conv_id."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.where("conv_id is not null").select(
        together.alias("together"),
        "conv_id",
        F.struct(
            "turn",
            F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"))).alias("key"),
            F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).alias("words"),
        ).alias("turn"),
    )
    turns = F.sort_array(F.collect_list("turn")).alias("turns")
    return rows.repartition("together").groupBy("together", "conv_id").agg(turns)


def rebuilt(conversations: DataFrame, heads: Callable[[Column], Column], every: int = 20, most: int = 3) -> DataFrame:
    """(conv_id, turns): the first turns of a conversation replaced by those of the last one with an id divisible by `every`.

    `heads` says how many turns, at most `most`, from an id. The conversations that share
    a source are in one partition already, so a window over their few rows suffices.
    """
    c = F.col("conv_id")
    rows = spread(conversations.select("conv_id", "turn", "role", "text"), c - c % every)
    head = F.when(c == F.col("together"), F.slice("turns", 1, most))
    rows = rows.withColumn("head", F.max(head).over(Window.partitionBy("together"))).withColumn("h", heads(c).cast("int"))
    taken = F.when(F.col("head").isNotNull(), F.slice("head", F.lit(1), F.col("h"))).otherwise(F.slice("turns", 1, 0))
    own = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(0)))
    return rows.select("conv_id", F.concat(taken, own).alias("turns"))


def op13_prefix_trie(spark, sf_dir: str) -> DataFrame:
    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return prefix_trie(rebuilt(conversations, lambda c: F.crc32(c.cast("string").cast("binary")) % 4))


#: crc32 bit by bit: a character of the decimal id is a step, then eight shifts (-1).
OP13_SQL = r"""
WITH ordered AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS i
  FROM conversations WHERE conv_id IS NOT NULL
), ids AS (
  SELECT DISTINCT conv_id, conv_id - conv_id % 20 AS base,
    xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(conv_id::VARCHAR, ''),
      lambda c: list_concat([ascii(c)::BIGINT], [-1, -1, -1, -1, -1, -1, -1, -1]::BIGINT[])))),
      lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END), 4294967295::BIGINT) % 4 AS h
  FROM ordered
), turns AS (
  SELECT ids.conv_id, o.i, o.role, o.text FROM ids JOIN ordered o ON o.conv_id = ids.base AND o.i <= ids.h
  UNION ALL
  SELECT ids.conv_id, o.i + 1000000, o.role, o.text FROM ids JOIN ordered o ON o.conv_id = ids.conv_id AND o.i > ids.h
), whole AS (
  SELECT ids.conv_id, coalesce(list(md5(length(role) || ':' || role || text) ORDER BY i) FILTER (i IS NOT NULL), []) AS path,
    coalesce(list(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) ORDER BY i) FILTER (i IS NOT NULL), []) AS words
  FROM ids LEFT JOIN turns ON turns.conv_id = ids.conv_id GROUP BY ids.conv_id
), prefixes AS (
  SELECT conv_id, d AS depth, path[1:d] AS prefix, d = len(path) AS ends, CASE WHEN d = 0 THEN 0 ELSE words[d] END AS words
  FROM whole, unnest(range(len(path) + 1)) AS t(d)
), nodes AS (
  SELECT prefix, depth, min(conv_id) AS conv_id, count(*) AS n_convs, min(words) AS words,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
  FROM prefixes GROUP BY prefix, depth
), counted AS (
  SELECT n.*, p.conv_id AS parent_conv_id, (SELECT count(*) FROM nodes c WHERE c.depth = n.depth + 1 AND c.prefix[1:n.depth] = n.prefix) AS n_children
  FROM nodes n LEFT JOIN nodes p ON n.depth > 0 AND p.depth = n.depth - 1 AND p.prefix = n.prefix[1:n.depth - 1]
), sums AS (
  SELECT c.prefix[1:a] AS prefix, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((n_convs - 1) * words) AS saved_tokens
  FROM counted c, unnest(range(c.depth + 1)) AS t(a) GROUP BY 1
)
SELECT conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens, ends_sha256
FROM counted JOIN sums USING (prefix)
"""
