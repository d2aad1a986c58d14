import random

import numpy as np
import pytest

from hearthstat.llm import lines
from hearthstat.llm.lines import Cuckoo
from hearthstat.llm.texts import mix
from tests.llm import docs


def brute(texts, min_docs, corpus=None):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    counts = {}
    for t in texts if corpus is None else corpus:
        for k in {key(x) for x in (t or "").split("\n")}:
            counts[k] = counts.get(k, 0) + 1
    common = {k for k, n in counts.items() if k and n >= min_docs}
    out = []
    for t in texts:
        own = (t or "").split("\n")
        kept = [x for x in own if key(x) not in common]
        out.append((t if t is None else "\n".join(kept), len(own), len(own) - len(kept)))
    return out


def sample(seed=1, n=120):
    rnd = random.Random(seed)
    pool = [f" Line {i} É\t" if i % 3 else f"line {i} É" for i in range(40)]
    return ["\n".join(rnd.choice(pool + [""]) for _ in range(rnd.randrange(9))) for _ in range(n)] + ["", None, "\n\n"]


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def rows(df):
    return [(r["text"], r["n_lines"], r["n_dropped"]) for r in df.orderBy("doc_id").collect()]


def test_against_plain_python(spark):
    texts = sample()
    assert rows(lines.dedup_lines(frame(spark, texts), min_docs=10)) == brute(texts, 10)


@pytest.mark.parametrize("chunk", [500, 32 << 20])
def test_filters_too_large_to_broadcast(spark, monkeypatch, chunk):
    monkeypatch.setattr(lines, "FILTER_BYTES", 1)
    monkeypatch.setattr(lines, "CHUNK_BYTES", chunk)
    texts = sample(2)
    assert rows(lines.dedup_lines(frame(spark, texts), min_docs=10)) == brute(texts, 10)
    odd = docs.odd(spark, "n_lines")
    got = {(r["doc_id"], r["text"], r["n_lines"], r["n_dropped"]) for r in lines.dedup_lines(odd, 2).collect()}
    monkeypatch.setattr(lines, "FILTER_BYTES", 64 << 20)
    assert got == {(r["doc_id"], r["text"], r["n_lines"], r["n_dropped"]) for r in lines.dedup_lines(odd, 2).collect()}
    monkeypatch.setattr(lines, "FILTER_BYTES", 1)
    assert lines.dedup_lines(docs.empty(spark)).count() == 0


def test_shards_are_parted_when_documents_come(spark, monkeypatch):
    first, second = sample(5, 40), sample(6, 90)
    state = lines.build(frame(spark, first), min_docs=12)
    monkeypatch.setattr(lines, "SHARD_KEYS", max(1, state.counts.count() // (5 * state.shards)))
    both = lines.change(state, frame(spark, second))
    assert both.shards >= 2 * state.shards
    assert rows(lines.apply(both, frame(spark, first))) == brute(first, 12, first + second)
    back = lines.change(both, frame(spark, second), -1)
    assert rows(lines.apply(back, frame(spark, first))) == brute(first, 12)


def test_documents_come_and_go(spark):
    first, second = sample(3, 60), sample(4, 90)
    state = lines.build(frame(spark, first), min_docs=12)
    both = lines.change(state, frame(spark, second))
    assert rows(lines.apply(both, frame(spark, first))) == brute(first, 12, first + second)
    back = lines.change(both, frame(spark, second), -1)
    assert rows(lines.apply(back, frame(spark, first))) == brute(first, 12)
    assert sorted(back.counts.collect()) == sorted(state.counts.collect())


def test_line_length(spark):
    df = frame(spark, ["ab\nabc"] * 3)
    assert rows(lines.dedup_lines(df, min_docs=3, min_chars=3)) == [("ab", 2, 1)] * 3


def test_cuckoo_filter_forgets_what_is_removed():
    keys = mix(np.arange(3000, dtype=np.uint64))
    cuckoo = Cuckoo(1024)
    assert cuckoo.add(keys) and cuckoo.holds(keys).all()
    cuckoo.remove(keys[:1500])
    assert cuckoo.holds(keys[1500:]).all() and cuckoo.holds(keys[:1500]).mean() < 0.01
    assert not Cuckoo(16).add(keys)


@pytest.mark.parametrize("extra", ["", "n_lines"])
def test_odd_rows(spark, extra):
    df = docs.odd(spark, extra)
    out = lines.dedup_lines(df, min_docs=2).orderBy("doc_id", "text").collect()
    texts = [r["text"] for r in df.orderBy("doc_id", "text").collect()]
    expected = brute(texts, 2)
    assert sorted(map(repr, ((r["text"], r["n_lines"], r["n_dropped"]) for r in out))) == sorted(map(repr, expected))
    assert lines.dedup_lines(docs.empty(spark)).count() == 0


def test_long_texts_of_a_batch_are_cut_a_few_at_a_time(monkeypatch):
    """Lists of lines take several times the memory of the text, of which a batch may hold very much."""
    import pyarrow as pa

    text = "some line\n" * 20_000 + "end"
    batch = pa.RecordBatch.from_pydict({"text": pa.array([text, None, "", text, "x", text] * 10)})
    rows, keys_of = [], lines._keys_of
    monkeypatch.setattr(lines, "_keys_of", lambda part: rows.append(part.num_rows) or keys_of(part))
    blocks = type("Blocks", (), {"value": []})
    out = list(lines._drop(iter([batch]), blocks, 8, 1))
    assert pa.Table.from_batches(out).column("text").to_pylist() == batch.column("text").to_pylist()
    assert sum(rows) == 60 and max(rows) < 20
