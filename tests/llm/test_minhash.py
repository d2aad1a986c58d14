import random
import re

import numpy as np
import pytest

from hearthstat.llm import minhash
from tests.llm import docs

LOWER = {c: c + 32 for c in range(65, 91)}


def sets(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", (text or "").translate(LOWER)) if x]
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()


def brute(texts, percent):
    own = [sets(t) for t in texts]
    links = {
        (i, j)
        for i in range(len(own)) for j in range(i)
        if own[i] and own[j] and 100 * len(own[i] & own[j]) >= percent * len(own[i] | own[j])
    }
    root = docs.components(len(texts), links)
    return {i: (len(s), r, r == i) for i, (s, r) in enumerate(zip(own, root))}


def answers(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in df.collect()}


def family(rnd, size, edits, n=200):
    """Copies of a text with some words changed, similarities around the threshold."""
    base = docs.words(rnd, n)
    out = []
    for _ in range(size):
        w = list(base)
        for _ in range(rnd.randrange(edits + 1)):
            w[rnd.randrange(n)] = f"x{rnd.randrange(10**6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("percent", [80, 85])
def test_against_plain_python(spark, percent, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 16)
    rnd = random.Random(percent)
    texts = [" ".join(docs.words(rnd, rnd.randrange(1, 60))) for _ in range(80)]
    for edits in (1, 3, 5, 8):
        texts += family(rnd, 60, edits)
    texts += ["Short one", "short ONE", "", None, " \t", "one", texts[100], texts[100]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert answers(minhash.near_duplicates(df, percent)) == brute(texts, percent)


def test_near_signatures_share_a_key():
    """The pigeonhole: any two signatures that differ in at most NEAR parts agree in all but one of some chunk."""
    rnd = np.random.default_rng(1)
    n = minhash.CHUNKS * minhash.PARTS
    for _ in range(2000):
        differs = np.zeros(n, int)
        differs[rnd.choice(n, minhash.NEAR, replace=False)] = 1
        assert differs.reshape(minhash.CHUNKS, minhash.PARTS).sum(1).min() <= 1


def test_texts_of_a_template_do_not_meet_in_full(spark, monkeypatch):
    """Half of each text is common: they share keys, but signatures tell them apart."""
    monkeypatch.setattr(minhash, "BLOCK", 64)
    rnd = random.Random(11)
    common = docs.words(rnd, 60)
    texts = [" ".join([*common, *docs.words(rnd, 60, 10**6)]) for _ in range(400)]
    texts += family(rnd, 25, 14) + family(rnd, 25, 9)
    met = []
    plain = minhash._near_work

    def counted(work, *rest):
        out = plain(work, *rest).cache()
        met.append((work.count(), out.select("node").distinct().count()))
        return out

    monkeypatch.setattr(minhash, "_near_work", counted)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert answers(minhash.near_duplicates(df, 85)) == brute(texts, 85)
    ((asked, left),) = met
    assert asked > 800 and left <= 50


def test_signature_is_an_estimate():
    rnd = np.random.default_rng(2)
    errors = []
    for _ in range(300):
        common, a, b = (rnd.integers(0, 2**63, k).astype(np.uint64) for k in (170, 15, 15))
        hashes = np.concatenate([common, a, common, b])
        sig = minhash.signatures(hashes, np.array([0, 185, 370])).view(np.uint16).reshape(2, -1)
        errors.append((sig[0] != sig[1]).mean())
    assert abs(np.mean(errors) - 0.15) < 0.02


def test_odd_rows(spark):
    out = minhash.near_duplicates(docs.odd(spark, "n_shingles"), 85).collect()
    assert len(out) == 12
    by = {r["doc_id"]: r for r in out if r["doc_id"] is not None}
    assert by[5]["component_id"] == 1 and not by[5]["kept"] and by[1]["kept"]
    assert by[2]["n_shingles"] == by[3]["n_shingles"] == 0 and by[2]["kept"] and by[3]["component_id"] == 3
    assert [r["component_id"] for r in out if r["doc_id"] is None] == [None, None]
    assert by[4]["n_shingles"] == 5 and by[7]["n_shingles"] == 1
    assert minhash.near_duplicates(docs.empty(spark)).count() == 0
    with pytest.raises(ValueError):
        minhash.near_duplicates(docs.empty(spark), percent=50)
