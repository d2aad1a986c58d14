import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from hearthstat.llm import ngrams, quality
from tests.llm import docs

TEXTS = ["The cat sat on the mat.\nIt was a cat.", "A dog ran to the cat!", "the the the end", "Éa ñ 12, 34", "x" * 40]
MORE = ["cat é", "a", "the cat ran", "\x01\x02 漢字"]


def kneser_ney(texts):
    """p(bytes) by the textbook recursion over dictionaries."""
    n = ngrams.ORDER
    rows = [[0] * (n - 1) + list(t.encode()) + [0] for t in texts]
    counts = {n: Counter(tuple(r[i - n + 1 : i + 1]) for r in rows for i in range(n - 1, len(r)))}
    for k in range(n - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    off, totals, left = {}, {}, {}
    for k in range(1, n + 1):
        kinds = Counter(counts[k].values())
        off[k] = ngrams.discounts([kinds[i] for i in (1, 2, 3, 4)])
        totals[k], left[k] = Counter(), Counter()
        for g, c in counts[k].items():
            totals[k][g[:-1]] += c
            left[k][g[:-1]] += off[k][min(c, 3) - 1]

    def p(gram):
        k = len(gram)
        if not k:
            return 1 / 256
        total = totals[k].get(gram[:-1], 0)
        if not total:
            return p(gram[1:])
        c = counts[k].get(gram, 0)
        own = (c - off[k][min(c, 3) - 1]) / total if c else 0.0
        return own + left[k][gram[:-1]] / total * p(gram[1:])

    return p


def log_p(p, text):
    n = ngrams.ORDER
    row = [0] * (n - 1) + list(text.encode()) + [0]
    return sum(math.log(p(tuple(row[i - n + 1 : i + 1]))) for i in range(n - 1, len(row)))


@pytest.mark.parametrize("chunk, block, held", [(48 << 20, 1 << 20, 1 << 21), (60, 16, 8)])
def test_against_the_recursion(spark, monkeypatch, chunk, block, held):
    for name, value in (("CHUNK", chunk), ("BLOCK", block), ("HELD", held)):
        monkeypatch.setattr(ngrams, name, value)
    taught = spark.createDataFrame([(i % 2, t) for i, t in enumerate(TEXTS)], "fold long, text string").repartition(3)
    model = ngrams.train(taught)
    rows = [(i, f, t) for i, (f, t) in enumerate((f, t) for t in TEXTS + MORE for f in (0, 1))]
    df = spark.createDataFrame(rows, "_key long, fold int, text string").repartition(4)
    got = {r["_key"]: r["log_p"] for r in ngrams.score(df, model, sum(len(t.encode()) for *_, t in rows)).collect()}
    assert len(got) == len(rows)
    models = [kneser_ney(TEXTS[f::2]) for f in (0, 1)]
    for i, f, t in rows:
        assert got[i] == pytest.approx(log_p(models[f], t), rel=1e-5), (f, t)


def test_probabilities_after_a_context_sum_to_one(spark):
    model = ngrams.train(spark.createDataFrame([(0, t) for t in TEXTS], "fold long, text string")).toPandas()
    lookup = ngrams.Lookup(model["key"].to_numpy().astype(np.uint64), model["share"].to_numpy(), model["weight"].to_numpy())
    for context in (b"e cat", b"\0\0\0\0\0", b"zzzzz", b"xxxxx", b"\0\0the"):
        gram = np.uint64(int.from_bytes(context, "big")) << np.uint64(8) | np.arange(256, dtype=np.uint64)
        assert np.exp(lookup.logs(gram, 0)).sum() == pytest.approx(1, rel=1e-5)


def test_a_fold_without_texts_knows_nothing(spark):
    model = ngrams.train(spark.createDataFrame([(0, t) for t in TEXTS], "fold long, text string"))
    df = spark.createDataFrame([(1, 1, "The"), (2, 0, "The")], "_key long, fold long, text string")
    got = {r["_key"]: r["log_p"] for r in ngrams.score(df, model, 6).collect()}
    assert got[1] == pytest.approx(-4 * math.log(256)) and got[2] > got[1]


def test_keys_survive_packing():
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 57, 5000).astype(np.uint64))
    assert (ngrams._unpacked_keys(ngrams._packed_keys(keys)) == keys).all()
    assert len(ngrams._unpacked_keys(ngrams._packed_keys(keys[:0]))) == 0


def test_documents_are_shuffled_once_and_frequent_ngrams_are_no_hot_keys(spark):
    """Texts of one letter: all n-grams alike, asked for once a chunk."""
    df = spark.range(500).select(F.col("id").alias("_key"), (F.col("id") % 2).alias("fold"), F.lit("a" * 300).alias("text"))
    model = ngrams.train(df.limit(40))
    assert model.count() < 70
    scores = ngrams.score(df, model, 150_000)
    rows = scores.collect()
    assert len(rows) == 500 and len({round(r["log_p"], 6) for r in rows}) <= 2
    plan = scores._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("Range (0, 500") == 1 and "ReusedExchange" in plan


def sentences(rnd, n, words):
    """Each word is followed by one of three."""
    at, out = rnd.randrange(len(words)), []
    for _ in range(n):
        out.append(words[at])
        at = (at * 7 + rnd.randrange(3)) % len(words)
    return out


def salad(spark, seed):
    rnd = random.Random(seed)
    words = ["".join(rnd.choice("aeioulnrst") for _ in range(6)) for _ in range(300)]
    texts = [sentences(rnd, 150, words) for _ in range(260)]
    rows = [(i, "en", " ".join(t)) for i, t in enumerate(texts)]
    rows += [(1000 + i, "en", " ".join(rnd.sample(t, len(t)))) for i, t in enumerate(texts[200:])]
    return spark.createDataFrame(rows, "doc_id long, lang string, text string")


def test_shuffled_words_are_junk(spark):
    df = salad(spark, 1)
    out = {r["doc_id"]: r["keep"] for r in quality.classify(df, df.where("doc_id < 200")).collect()}
    held_out = np.mean([out[i] for i in range(200, 260)])
    shuffled = np.mean([out[i] for i in range(1000, 1060)])
    assert held_out > 0.95 and shuffled < 0.05


def test_few_trusted_texts_of_a_language(spark):
    """No number of trusted texts switches the filter: junk goes, unlabelled clean text stays."""
    rnd = random.Random(4)
    rows, trusted = [], []
    for lang, letters, n in (("en", "aeioulnrst", 90), ("xx", "йцукенгшщз", 4), ("yy", "αβγδεζηθικ", 0)):
        words = ["".join(rnd.choice(letters) for _ in range(5)) for _ in range(60)]
        for i in range(n + 30):
            rows.append((len(rows), lang, " ".join(sentences(rnd, 150, words))))
            trusted += [len(rows) - 1] if i < n else []
        rows.append((len(rows) + 1000, lang, "### $$$ %%% 123 &&& @@@ !!! " * 30))
    df = spark.createDataFrame([(i - 1000 if i >= 1000 else i, lang, t) for i, lang, t in rows], "doc_id long, lang string, text string")
    ids = spark.createDataFrame([(i,) for i in trusted], "doc_id long")
    for own in (ids, ids.where("doc_id < 20")):
        known = {"en", "xx"} if own is ids else {"en"}
        out = quality.classify(df, own).collect()
        for r in out:
            junk = rows[r["doc_id"]][2].startswith("#")
            assert not (junk and r["keep"]) or r["lang"] not in known
            assert r["keep"] or junk or r["lang"] == "en"
        assert np.mean([r["keep"] for r in out if not rows[r["doc_id"]][2].startswith("#")]) > 0.95


def test_shorter_ngrams_are_looked_up_once_a_block(spark, monkeypatch):
    """Not again for each longer one that ends with them."""
    model = ngrams.train(spark.createDataFrame([(0, t) for t in TEXTS], "fold long, text string")).toPandas()
    lookup = ngrams.Lookup(model["key"].to_numpy().astype(np.uint64), model["share"].to_numpy(), model["weight"].to_numpy())
    sought, at = [], ngrams.Lookup._at
    monkeypatch.setattr(ngrams.Lookup, "_at", lambda self, keys, values: sought.append(len(keys)) or at(self, keys, values))
    gram = np.unique(np.random.default_rng(1).choice(np.frombuffer(b"abcd", np.uint8), (4000, 8)), axis=0)
    gram[:, :2] = 0
    gram = np.unique(np.ascontiguousarray(gram[:, ::-1]).view("<u8").ravel())
    assert np.isfinite(lookup.logs(gram, 0)).all()
    assert sorted(sought) == sorted(2 * [len(np.unique(gram & np.uint64((1 << 8 * k) - 1))) for k in range(1, 7)])
