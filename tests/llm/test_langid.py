import numpy as np
import pytest

from hearthstat.llm import langid
from tests.llm import docs


def test_codewords_are_apart():
    for n in (2, 3, 4, 5, 9, 40):
        code = langid.codewords(n).astype(int)
        assert len({tuple(r) for r in code}) == n and set(np.unique(code)) == {-1, 1}
        distance = (code.shape[1] - code @ code.T) // 2
        np.fill_diagonal(distance, 10**6)
        assert distance.min() >= (1 if n == 2 else 2 if n < 5 else code.shape[1] // 5)


def test_decoding_takes_the_nearest_codeword():
    code = langid.codewords(4)
    bits = code.shape[1]
    model = langid.Model(list("abcd"), code, np.zeros((1, bits)), np.ones(bits), np.full(bits, 1 / bits))
    margins = code.astype(float)
    margins[:, 0] *= -1  # one classifier is wrong
    assert langid.losses(model, margins).argmin(1).tolist() == [0, 1, 2, 3]


def test_counts_give_the_weights(spark):
    """The weights from Spark against naive Bayes in numpy."""
    rows = [("x", "aab aab"), ("y", "bba"), ("z", "cc ca"), ("x", "Éa"), (None, "abc")]
    model = langid.learn(spark.createDataFrame(rows, "lang string, text string"))
    assert model.langs == ["x", "y", "z"]
    counts = np.zeros((3, langid.BUCKETS))
    for lang, text in rows[:4]:
        grams = langid.trigrams(np.frombuffer(f" {text.lower()} ".encode(), np.uint8))
        np.add.at(counts["xyz".index(lang)], grams[grams >= 0], 1)
    p = (counts + langid.SMOOTH) / (counts.sum(1, keepdims=True) + langid.SMOOTH * langid.BUCKETS)
    seen = np.flatnonzero(counts.sum(0))
    for bit in range(model.code.shape[1]):
        side = model.code[:, bit] > 0
        expected = np.log(p[side].mean(0) / p[~side].mean(0))
        assert model.weights[seen, bit] == pytest.approx(expected[seen])


def test_held_out_accuracy(spark, sf_dir):
    out = langid.op1_language_id(spark, sf_dir)
    truth = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang")
    rows = out.join(truth, "doc_id").where("held_out and lang is not null").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) / len(rows) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_odd_rows(spark):
    df = docs.odd(spark, "score")
    model = langid.learn(df)
    out = langid.predict(df, model).collect()
    assert len(out) == 12
    for r in out:
        if not r["text"] or r["doc_id"] == 8:
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
        else:
            assert r["lang_pred"] in {"en", "la", "xx"} and 0 < r["score"] <= 1
    assert langid.predict(docs.empty(spark), model).count() == 0
    nothing = langid.learn(docs.empty(spark))
    assert {(r["lang_pred"], r["score"]) for r in langid.predict(df, nothing).collect()} == {("und", 0.0)}
    one = langid.learn(df.where("lang = 'en'"))
    assert {r["lang_pred"] for r in langid.predict(df, one).collect()} == {"en", "und"}
