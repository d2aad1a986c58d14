import random
import re

import numpy as np
import pytest

from hearthstat.llm import decontam
from hearthstat.llm.fmindex import FMIndex
from tests.llm import docs

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def brute(text, items, size=10):
    """Words, hit words and items by looking everywhere."""
    own = [(m[0], m.start(), m.end()) for m in WORD.finditer((text or "").translate(LOWER))]
    hit, found = set(), set()
    for item, passage in items:
        w = WORD.findall((passage or "").translate(LOWER))
        n = min(size, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            for j in range(len(own) - n + 1):
                if [x[0] for x in own[j : j + n]] == w[i : i + n]:
                    hit |= set(range(j, j + n))
                    found.add(item)
    spans = []
    for k in sorted(hit):
        if k - 1 in hit:
            spans[-1] = (spans[-1][0], own[k][2])
        else:
            spans.append((own[k][1], own[k][2]))
    return len(own), len(hit), sorted(i for i in found if i is not None), spans


def answers(df):
    return {
        r["doc_id"]: (r["n_words"], r["n_hit"], r["items"], [(s["start"], s["end"]) for s in r["spans"]])
        for r in df.collect()
    }


def corpus(seed=1):
    rnd = random.Random(seed)
    items = [(i, " ".join(docs.words(rnd, rnd.randrange(0, 30), 60))) for i in range(25)] + [(None, "null id item"), (99, None)]
    texts = []
    for _ in range(60):
        w = docs.words(rnd, rnd.randrange(60), 60)
        for _ in range(rnd.randrange(3)):
            passage = (rnd.choice(items)[1] or "").split()
            at = rnd.randrange(len(w) + 1)
            w[at:at] = passage[: rnd.randrange(len(passage) + 1)] if rnd.random() < 0.5 else passage
        texts.append(rnd.choice([" ", ", ", " É "]).join(w).title())
    return items, [*texts, None, "", "Null. ID, item! w1"]


def frames(spark, items, texts):
    return (
        spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"),
        spark.createDataFrame(items, "item_id long, text string"),
    )


@pytest.mark.parametrize("block", [1_000_000, 40])
def test_against_plain_python(spark, monkeypatch, block):
    monkeypatch.setattr(decontam, "BLOCK_WORDS", block)
    items, texts = corpus()
    df, benchmark = frames(spark, items, texts)
    assert answers(decontam.scan(df, benchmark)) == {i: brute(t, items) for i, t in enumerate(texts)}


def test_cut_takes_out_the_spans(spark):
    items, texts = corpus(2)
    df, benchmark = frames(spark, items, texts)
    for r in decontam.scan(df, benchmark, cut=True).collect():
        text = texts[r["doc_id"]]
        for a, b in reversed(brute(text, items)[3]):
            text = text[:a] + text[b:]
        assert r["text"] == text


def test_odd_rows(spark):
    items = [(1, "three four five"), (2, "lorem ipsum dolor sit amet"), (2, "漢字")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    for extra in ("", "n_hit"):
        for r in decontam.scan(docs.odd(spark, extra), benchmark).collect():
            if len(r["text"] or "") < 1000:
                assert (r["n_words"], r["n_hit"], r["items"]) == brute(r["text"], items)[:3]
            elif r["doc_id"] == 4:
                assert r["n_hit"] == r["n_words"] == 30_000 and len(r["spans"]) == 1
    assert decontam.scan(docs.empty(spark), benchmark).count() == 0
    assert {r["n_hit"] for r in decontam.scan(docs.odd(spark), benchmark.limit(0)).collect()} == {0}


def test_index_finds_all_and_only():
    rnd = np.random.default_rng(5)
    for symbols in (1, 3, 40):
        text = rnd.integers(0, symbols + 1, 700)
        text[0] = text[-1] = 0
        index = FMIndex(text.astype(np.int32), symbols)
        patterns = np.full((60, 5), -1, np.int32)
        for row in patterns:
            n = rnd.integers(1, 6)
            row[5 - n :] = rnd.integers(1, symbols + 1, n)
        low, high = index.search(patterns)
        for row, a, b in zip(patterns, low.tolist(), high.tolist()):
            own = row[row > 0]
            there = [i for i in range(len(text) - len(own) + 1) if (text[i : i + len(own)] == own).all()]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == there
