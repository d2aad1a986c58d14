import random

import numpy as np
import pytest

from hearthstat.llm import toxicity
from tests.llm import docs


def vectors(rnd, n, terms=30):
    out = []
    for _ in range(n):
        own = np.sort(rnd.choice(terms, rnd.integers(1, 6), replace=False))
        w = rnd.random(len(own)) + 0.1
        out.append((own, w / np.sqrt((w * w).sum())))
    return out


@pytest.mark.parametrize("block, frequent, cells", [(4, 1000, 1 << 20), (64, 64, 1 << 20), (4, 20, 900), (16, 0, 1)])
def test_nearest_are_exact(monkeypatch, block, frequent, cells):
    for name, value in (("BLOCK", block), ("FREQUENT", frequent), ("CELLS", cells)):
        monkeypatch.setattr(toxicity, name, value)
    rnd = np.random.default_rng(block)
    examples = vectors(rnd, 300)
    examples += examples[:40]  # ties
    index = toxicity.BlockMax(list(range(len(examples))), examples, 30)
    dense = np.zeros((len(examples), 30))
    for i, (t, w) in enumerate(examples):
        dense[i, t] = w
    asked = [*vectors(rnd, 60), (np.zeros(0, np.int64), np.zeros(0))]
    every = np.zeros((len(asked), 30))
    for i, (t, w) in enumerate(asked):
        every[i, t] = w
    scores = np.round(dense @ every.T, 12).T
    for without in (None, scores.argmax(1).tolist()):
        for i, (rows, cosines) in enumerate(index.nearest(asked, 15, without)):
            other = None if without is None else without[i]
            order = [j for j in np.lexsort((np.arange(len(examples)), -scores[i])) if scores[i, j] > 0 and j != other][:15]
            assert cosines == pytest.approx(scores[i, order], abs=1e-9)
            assert index.ids[rows].tolist() == [int(j) for j in order]


def test_isotonic_curve():
    votes = np.array([0.1, 0.2, 0.2, 0.3, 0.4, 0.5])
    labels = np.array([0, 1, 0, 0, 1, 1.0])
    x, y = toxicity.isotonic(votes, labels, np.ones(6))
    assert (np.diff(x) >= 0).all() and (np.diff(y) >= 0).all()
    assert np.interp([0.1, 0.25, 0.5], x, y) == pytest.approx([0, 1 / 3, 1])


def corpus(spark, n=900, seed=1):
    rnd = random.Random(seed)
    bad = ["vile", "rotten", "filth", "scumm"]
    rows, labels = [], []
    for i in range(n):
        toxic = i % 6 == 0
        w = docs.words(rnd, rnd.randrange(20, 60), 4000)
        if toxic:
            for _ in range(rnd.randrange(2, 5)):
                w[rnd.randrange(len(w))] = rnd.choice(bad)
        rows.append((i, " ".join(w).capitalize() + "."))
        if i % 3:
            continue
        labels.append((i, int(toxic)))
    return (
        spark.createDataFrame(rows, "doc_id long, text string"),
        spark.createDataFrame([*labels, (None, 1), (1, None), (10**6, 1)], "doc_id long, toxic int"),
    )


def test_toxic_texts_are_found(spark):
    df, labels = corpus(spark)
    out = toxicity.score(df, toxicity.learn(df, labels)).collect()
    assert all(r["predicted"] == int(r["doc_id"] % 6 == 0) for r in out)
    assert all(0 <= r["score"] <= 1 and len(r["evidence"]) == len(r["cosines"]) for r in out)
    assert all(r["evidence"] and r["evidence"][0] % 6 == 0 for r in out if r["predicted"])


def test_near_copies_of_examples_with_words_of_their_own_are_found(spark):
    """Each toxic example has insults that no other text has; no term is too rare to count."""
    rnd = random.Random(3)
    rows, labels = [], []
    for i in range(400):
        w = docs.words(rnd, rnd.randrange(30, 60), 3000)
        if i >= 300:
            w[rnd.randrange(len(w))] = f"insult{i}"
        rows.append((i, " ".join(w)))
        labels.append((i, int(i >= 300)))
        if i % 3 == 0 or i >= 300:
            near = list(w)
            near[rnd.randrange(len(w))] = "changed"
            rows.append((1000 + i, " ".join(near)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = toxicity.score(df, toxicity.learn(df, spark.createDataFrame(labels, "doc_id long, toxic int"))).collect()
    got = {r["doc_id"]: r for r in out}
    assert all(got[1000 + i]["predicted"] == 1 for i in range(300, 400))
    assert all(got[1000 + i]["predicted"] == 0 for i in range(0, 300, 3))
    assert all(got[1000 + i]["evidence"][0] == i for i in (*range(0, 300, 3), *range(300, 400)))


def test_cosines_from_texts_equal_plain_python(spark):
    """All words of the examples, frequencies over all documents."""
    df, labels = corpus(spark, 150)
    model = toxicity.learn(df, labels)
    rows = {r["doc_id"]: r["text"].lower().rstrip(".").split() for r in df.collect()}
    known = {r["doc_id"]: r["toxic"] for r in labels.dropna().collect() if r["doc_id"] in rows}
    vocabulary = sorted({w for i in known for w in rows[i]})
    holds = {w: [sum(w in rows[i] for i, t in known.items() if t == y) for y in (1, 0)] for w in vocabulary}
    n1 = sum(known.values())
    n0 = len(known) - n1
    weight = {}
    for w, (a, b) in holds.items():
        n = n1 + n0
        apart = max(abs(a * n0 - b * n1) - n / 2, 0)
        z = apart * (n / ((a + b) * max(n - a - b, 1) * n1 * n0)) ** 0.5
        weight[w] = (np.log((1 + len(rows)) / (1 + sum(w in x for x in rows.values()))) + 1) * max(z, 1)

    def vector(text):
        v = {w: (1 + np.log(text.count(w))) * weight[w] for w in set(text) if w in weight}
        size = sum(x * x for x in v.values()) ** 0.5
        return {w: x / size for w, x in v.items()}

    examples = {i: vector(rows[i]) for i in known}
    for r in toxicity.score(df, model).collect():
        own = vector(rows[r["doc_id"]])
        cosines = {i: sum(x * e.get(w, 0.0) for w, x in own.items()) for i, e in examples.items()}
        best = sorted((-round(c, 12), i) for i, c in cosines.items() if c > 0)[:15]
        assert r["cosines"] == pytest.approx([-c for c, _ in best], abs=1e-9)
        assert [i for i, c in zip(r["evidence"], r["cosines"]) if c > 0.5] == [i for c, i in best if -c > 0.5]


def test_labels_of_held_out_rows_change_nothing(spark):
    df, labels = corpus(spark, 300)
    one = toxicity.score(df, toxicity.learn(df, labels)).select("doc_id", "score").collect()
    again = toxicity.score(df.repartition(7), toxicity.learn(df.repartition(5), labels.repartition(3)))
    assert sorted(one) == sorted(again.select("doc_id", "score").collect())


def test_odd_rows(spark):
    df, labels = corpus(spark, 300)
    model = toxicity.learn(df, labels)
    out = toxicity.score(docs.odd(spark, "score"), model).collect()
    assert len(out) == 12 and {r["score"] for r in out} == {model.bare}
    assert toxicity.score(docs.empty(spark), model).count() == 0
    for some, share in ((labels.limit(0), 0.0), (labels.where("toxic = 0"), 0.0), (labels.where("toxic = 1"), 1.0)):
        assert {r["score"] for r in toxicity.score(df.limit(5), toxicity.learn(df, some)).collect()} == {share}
