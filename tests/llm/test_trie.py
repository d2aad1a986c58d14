import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from hearthstat.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string, kind int, n_convs string"


def plain_paths(rows):
    """Rebuilt conversations, in the order that the module's docstring gives."""

    def key(t):
        return hashlib.md5(f"{len(t[1] or '')}:{t[1] or ''}{t[2] or ''}".encode()).digest()

    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn, role, text))
    for c, turns in own.items():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, key(t)))
        own[c] = [(role or "", text or "") for _, role, text in turns]
    own = dict(own)
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20 if c >= 0 else -(abs(c) % 20))
        out[c] = own.get(base, [])[:h] + turns[h:]
    return out


def brute(paths):
    nodes = defaultdict(list)
    for c, path in paths.items():
        for d in range(len(path) + 1):
            nodes[tuple(path[:d])].append(c)
    children = defaultdict(list)
    for p in nodes:
        if p:
            children[p[:-1]].append(p)
    leaves, saved = defaultdict(int), defaultdict(int)
    for p in sorted(nodes, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        leaves[p] += not children[p]
        saved[p] += (len(nodes[p]) - 1) * words
        if p:
            leaves[p[:-1]] += leaves[p]
            saved[p[:-1]] += saved[p]
    out = []
    for p, members in nodes.items():
        ends = sorted(c for c in members if len(paths[c]) == len(p))
        sha = hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()
        up = min(nodes[p[:-1]]) if p else None
        out.append((min(members), len(p), up, len(members), len(children[p]), leaves[p], saved[p], sha))
    return sorted(out, key=repr)


def answers(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def conversations(rnd, n):
    """Turns from few texts, so that prefixes are shared; some long, some equal."""
    rows = []
    for c in rnd.sample(range(-40, 4 * n), n):
        path = [0] * rnd.randrange(4) if c % 3 else [1, 2, 3, 4, 5]
        path += [rnd.randrange(3) for _ in range(rnd.randrange(5))]
        rows += [(c, i, "user" if i % 2 else "bot", f"text {t} of\tit" * (1 + t)) for i, t in enumerate(path)]
    return rows


@pytest.mark.parametrize("turns, group", [(1, 2), (9, 2), (60, 1024), (100_000, 1024)])
def test_against_plain_python(spark, monkeypatch, turns, group):
    monkeypatch.setattr(trie, "SHARD_TURNS", turns)
    monkeypatch.setattr(trie, "GROUP", group)
    monkeypatch.setattr(trie, "ENDS", 3)
    rows = conversations(random.Random(turns), 150)
    rows += [(9001, None, "user", "first of all"), (9001, 1, None, None), (9001, 1, "user", ""), (9001, 1, "user", "b")]
    rows += [(9002, 0, "a", "bc"), (9003, 0, "ab", "c"), (9002, 0, "a", "bc"), (None, 0, "user", "nobody")]
    df = spark.createDataFrame([(*r, 5, "mine") for r in rows], SCHEMA).repartition(6)
    got = trie.prefix_trie(trie.rebuilt(df, lambda c: trie.F.crc32(c.cast("string").cast("binary")) % 4))
    assert answers(got) == brute(plain_paths(rows))


def test_many_equal_conversations_over_many_partitions(spark, monkeypatch):
    monkeypatch.setattr(trie, "SHARD_TURNS", 64)
    monkeypatch.setattr(trie, "ENDS", 7)
    rows = [(c, i, "user", f"turn {i}") for c in range(600) for i in range(3)]
    rows += [(c, i, "user", f"turn {i if i < 2 else c}") for c in range(600, 640) for i in range(4)]
    df = spark.createDataFrame([(*r, 5, "mine") for r in rows], SCHEMA)
    turns = trie.spread(df, trie.F.col("conv_id")).select("conv_id", "turns")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = answers(trie.prefix_trie(turns))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    paths = defaultdict(list)
    for c, _, role, text in rows:
        paths[c].append((role, text))
    assert got == brute(paths)


def test_empty_table_and_turnless_conversations(spark):
    heads = lambda c: trie.F.lit(3)
    none = trie.prefix_trie(trie.rebuilt(spark.createDataFrame([], SCHEMA), heads))
    assert none.collect() == []
    df = spark.createDataFrame([(21, 0, "user", "a b", 1, ""), (22, 0, "user", "c", 1, "")], SCHEMA)
    (root,) = trie.prefix_trie(trie.rebuilt(df, heads)).collect()
    assert tuple(root) == (21, 0, None, 2, 0, 1, 0, hashlib.sha256(b"21,22").hexdigest())


def test_long_conversation(spark):
    rows = [(1, i, "user", f"t {i}") for i in range(5000)] + [(2, i, "user", f"t {i}") for i in range(4999)]
    turns = trie.spread(spark.createDataFrame([(*r, 5, "") for r in rows], SCHEMA), trie.F.col("conv_id"))
    got = {(r["conv_id"], r["depth"]): r for r in trie.prefix_trie(turns.select("conv_id", "turns")).collect()}
    assert len(got) == 5001
    assert got[1, 0]["saved_tokens"] == 2 * 4999 and got[1, 0]["n_leaves"] == 1 and got[1, 5000]["n_convs"] == 1


def test_median_insertion_balances_siblings():
    tree = trie.Tree()
    for i in trie.medians(1023):
        tree.insert([i], [1])
    def height(node):
        return 0 if not node else 1 + max(height(tree.low[node]), height(tree.high[node]))
    assert height(tree.same[0]) == 10
    assert sorted(trie.medians(50)) == list(range(50))
