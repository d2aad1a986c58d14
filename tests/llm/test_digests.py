import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from hearthstat.llm import digests
from tests.llm import docs


def plain_digest(text):
    """The same digest, triplet by triplet."""
    b = (text or "").encode()
    n = [0] * digests.BUCKETS
    for second, third in digests.SHAPES:
        for i in range(len(b) - third):
            n[digests._FIRST[second][b[i]] ^ digests._SECOND[second][b[i + second]] ^ digests._THIRD[second, third][b[i + third]]] += 1
    limits = [sorted(n)[i] for i in (31, 63, 95)]
    place = [sum(c > q for q in limits) for c in n]
    packed = bytes(sum(p << s for p, s in zip(place[i : i + 4], (6, 4, 2, 0))) for i in range(0, 128, 4))
    return (bytes([min(round(float(np.log1p(len(b)) / digests.STEP)), 255)]) + packed).hex()


def plain_likeness(a, b):
    places = [[x >> s & 3 for x in bytes.fromhex(f)[1:] for s in (6, 4, 2, 0)] for f in (a, b)]
    differ = sum(abs(x - y) for x, y in zip(*places)) + min(abs(int(a[:2], 16) - int(b[:2], 16)), 12)
    return 1 - differ / (sum(map(max, *places)) + 12)


def brute(rows):
    """Rows in the order of their ids, each with the next one."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    out = []
    for (k, text), (_, after) in zip(rows, rows[1:] + rows[:1]):
        text, after = text or "", after or ""
        cut = len(text) // 4
        edited = text[: len(text) - cut] + after[:cut]
        own, new, other = map(plain_digest, (text, edited, after))
        out.append((k, len(text), hashlib.sha256(edited.encode()).hexdigest(), own, new,
                    round(plain_likeness(own, new), 12), round(plain_likeness(own, other), 12)))
    return out


def answers(df):
    got = [(*r[:5], round(r[5], 12), round(r[6], 12)) for r in df.collect()]
    return sorted(got, key=lambda r: (r[0] is not None, r[0] or 0, r[1:]))


def texts(rnd, n):
    return [" ".join(docs.words(rnd, rnd.randrange(60), 300)) for _ in range(n)]


@pytest.mark.parametrize("chunk", [7, 400, 1 << 21])
def test_against_plain_python(spark, monkeypatch, chunk):
    monkeypatch.setattr(digests, "CHUNK", chunk)
    rnd = random.Random(chunk)
    rows = list(zip(rnd.sample(range(-50, 400), 120), texts(rnd, 120)))
    rows += [(500, None), (501, ""), (502, "a"), (503, "ab"), (504, "abc"), (505, "漢字😀é"), (None, "no id"), (506, "x" * 5000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS n_chars", "'mine' AS fingerprint", "0 AS edge")
    assert answers(digests.against_next(df.repartition(5))) == sorted(brute(rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1:]))


def test_tasks_cut_within_texts(monkeypatch):
    rnd = random.Random(2)
    column = pa.array([*texts(rnd, 30), None, "", "é" * 999])
    whole = digests.digests(column)
    monkeypatch.setattr(digests, "CHUNK", 5)
    assert digests.written(digests.digests(column)) == digests.written(whole) == [plain_digest(t) for t in column.to_pylist()]


def test_odd_rows_repeats_and_empty_tables(spark):
    got = digests.against_next(docs.odd(spark, "near_next")).collect()
    assert len(got) == 12
    same = [r for r in got if r["doc_id"] == 9]
    assert len(same) == 2 and same[0]["fingerprint"] == same[1]["fingerprint"]
    assert {r["near_next"] for r in same} == {1.0, min(r["near_next"] for r in same)}
    none = digests.against_next(docs.empty(spark))
    assert none.collect() == []
    assert none.columns == ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def test_one_document_is_its_own_next(spark):
    (row,) = digests.against_next(spark.createDataFrame([(4, "abcdefgh")], "doc_id long, text string")).collect()
    assert row["edited_sha256"] == hashlib.sha256(b"abcdefab").hexdigest()
    assert row["near_next"] == 1.0 and 0 < row["near_edited"] < 1


def test_an_id_that_many_rows_share_is_split(spark):
    rows = [(7, f"text {i % 3} of many") for i in range(3000)] + [(i, "other") for i in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    got = digests.against_next(df).collect()
    assert len(got) == 3003
    assert sum(r["doc_id"] == 7 and r["near_next"] == 1.0 for r in got) == 2997


def test_likeness_tells_edited_copies_from_others(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = digests.against_next(df).toPandas()
    assert got[["near_edited", "near_next"]].stack().between(0, 1).all()
    assert (got["near_edited"] > got["near_next"]).mean() > 0.97
    assert got["near_edited"].median() > 0.75 > got["near_next"].median() + 0.15


def test_fingerprint_column(spark):
    df = docs.odd(spark, "fingerprint")
    got = {(r["doc_id"], r["text"]): r["fingerprint"] for r in digests.fingerprint(df).collect()}
    assert all(f == plain_digest(t) for (_, t), f in got.items())
    a, b = digests.read([got[1, "One two three four five six seven."]]), digests.read([got[3, ""]])
    assert digests.likeness(a, a) == 1 and digests.likeness(a, b) < 0.05
