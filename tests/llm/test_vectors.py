import numpy as np
import pytest

from hearthstat.llm import vectors
from tests.llm import docs


def brute(rows, cosine=0.95):
    ok = [v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v in rows]
    links, n = set(), [0] * len(rows)
    for i, (_, a) in enumerate(rows):
        for j, (_, b) in enumerate(rows[:i]):
            if ok[i] and ok[j] and len(a) == len(b):
                a64, b64 = np.array(a, np.float32).astype(float), np.array(b, np.float32).astype(float)
                if a64 @ b64 / np.sqrt((a64 @ a64) * (b64 @ b64)) >= cosine:
                    links.add((i, j))
                    n[i] += 1
                    n[j] += 1
    root = docs.components(len(rows), links)
    return {k: (n[i], rows[root[i]][0], root[i] == i) for i, (k, _) in enumerate(rows)}


def answers(df):
    return {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in df.collect()}


@pytest.mark.parametrize("block", [16, 1024])
def test_against_plain_python(spark, monkeypatch, block):
    monkeypatch.setattr(vectors, "BLOCK", block)
    rnd = np.random.default_rng(block)
    rows = [(i, rnd.normal(size=16).tolist()) for i in range(150)]
    centre = rnd.normal(size=16)
    rows += [(200 + i, (centre + rnd.normal(size=16) * 0.17).tolist()) for i in range(120)]
    rows += [(400 + i, (centre * (1 + i)).tolist()) for i in range(3)] + [(500 + i, rows[7][1]) for i in range(40)]
    rows += [(600, None), (601, []), (602, [0.0] * 16), (603, [None] * 16), (604, [float("nan")] * 16)]
    rows += [(605, [float("inf")] + [1.0] * 15), (606, [1.0, 2.0]), (607, [2.0, 4.0]), (608, [-0.0] * 15 + [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert answers(vectors.near_vectors(df)) == brute(rows)


def test_odd_rows(spark):
    v = [1.0, 0.5]
    rows = [(None, v, 1), (None, None, None), (1, v, None), (1, v, None), (2, v, 3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, n_links int")
    out = sorted(map(repr, vectors.near_vectors(df).collect()))
    assert len(out) == 5 and sum("vec_id=None, n_links=0, component_id=None, kept=False" in r for r in out) == 2
    assert sum("vec_id=1, n_links=2, component_id=1, kept=True" in r for r in out) == 2
    assert vectors.near_vectors(df.limit(0)).count() == 0


def test_tables_reach_the_odds():
    for n in (10, 10_000, 10**9):
        bits, tables = vectors.plan(n, 0.95)
        agree = 1 - np.arccos(0.95) / np.pi
        assert (1 - agree**bits) ** tables <= vectors.MISS


def test_planes_are_normal():
    x = vectors.planes(64, 8, 30)
    assert abs(x.mean()) < 0.03 and abs(x.std() - 1) < 0.03


def test_recall_against_all_pairs(spark, sf_dir):
    """The larger table's vectors with neighbours planted around the limit, against all cosines."""
    folder = sf_dir.replace("sf0.001", "sf0.1")
    x = np.array([r[0] for r in spark.read.parquet(f"{folder}/embeddings.parquet").select("embedding").collect()])
    x /= np.sqrt((x * x).sum(1, keepdims=True))
    rnd = np.random.default_rng(4)
    turned = rnd.normal(size=(1200, x.shape[1]))
    turned -= (turned * x[:1200]).sum(1, keepdims=True) * x[:1200]
    turned /= np.sqrt((turned * turned).sum(1, keepdims=True))
    angle = np.arccos(rnd.uniform(0.945, 0.97, (1200, 1)))
    x = np.concatenate([x, x[:1200] * np.cos(angle) + turned * np.sin(angle)]).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    unit = x.astype(float)
    unit /= np.sqrt((unit * unit).sum(1, keepdims=True))
    want = (unit @ unit.T >= 0.95).sum(1) - 1
    got = {r["vec_id"]: r["n_links"] for r in vectors.near_vectors(df).collect()}
    assert sum(got.values()) >= 0.998 * want.sum() > 1500
    assert all(got[i] <= n for i, n in enumerate(want.tolist()))
