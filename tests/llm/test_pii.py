import hashlib
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from hearthstat.llm import pii
from tests.llm import docs


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base(text):
    """The contract's expressions, as they stand."""
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    forms = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m[0].split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(digits(m)) <= 19 and luhn(digits(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(digits(m)) <= 15),
    ]
    return [(kind, *m.span()) for kind, pattern, ok in forms for m in re.finditer(pattern, text or "") if ok(m)]


def known(row):
    return [(s["kind"], s["s"], s["e"]) for s in row["spans"] if s["kind"] != "id"]


def test_known_forms_on_random_texts(spark):
    rnd = random.Random(1)
    texts = ["".join(rnd.choice("a1.9@-_ 0+%(é\n") for _ in range(rnd.randrange(70))) for _ in range(3000)]
    texts += ["4111 1111 1111 1111", "4111-1111 1111--1111", "+1 (555) 010-9999, x@y.z.", "1.2.3.4.5.6.7.8", "a@b@c.d", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pii.find(df).collect():
        assert known(r) == base(texts[r["doc_id"]]), texts[r["doc_id"]]


def test_long_texts(spark):
    texts = ["1 " * 20_000, "a@" + "b." * 20_000 + "c", "9" * 30_000, "a" * 30_000, "1.2.3.4." * 2000, "+1 " * 5000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pii.find(df).collect():
        assert known(r) == base(texts[r["doc_id"]])


def test_query_digests(spark, sf_dir):
    text = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in pii.op4_pii(spark, sf_dir).collect():
        own = base(text[r["doc_id"]])
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in own)
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(x[0] == k for x in own) for k in pii.KINDS]
        assert r["spans"].startswith(joined)


def brute_confidence(edges, rounds=pii.ROUNDS):
    """The same scores by loops; edges: (pattern, value, seed)."""
    of = {}
    seeds = {}
    for p, v, s in edges:
        of.setdefault(p, set()).add(v)
        seeds[v] = max(seeds.get(v, 0.0), float(s))
    of = {p: v for p, v in of.items() if len(v) >= pii.SUPPORT}
    trust = dict(seeds)
    for turn in range(rounds):
        score = {p: sum(trust[v] for v in vs) / (len(vs) + pii.FEW) for p, vs in of.items()}
        if turn < rounds - 1:
            for v in seeds:
                doubt = 1.0
                for p, vs in of.items():
                    if v in vs:
                        doubt *= 1 - min(score[p], 0.999999)
                trust[v] = max(seeds[v], 1 - doubt)
    return {p: c for p, c in score.items() if c >= pii.CONFIDENT}


def test_bootstrapping_against_loops(spark):
    rnd = random.Random(2)
    edges = [(f"p{rnd.randrange(30)}", f"v{rnd.randrange(150)}", rnd.random() < 0.6) for _ in range(1500)]
    df = spark.createDataFrame(edges, "pattern string, value string, seed boolean")
    got = {r["pattern"]: r["confidence"] for r in pii.confident_patterns(df).collect()}
    expected = brute_confidence(edges)
    assert got.keys() == expected.keys() and expected
    assert all(got[p] == pytest.approx(expected[p]) for p in got)


def spans(df):
    return {r["doc_id"]: [(s["kind"], s["s"], s["e"]) for s in r["spans"]] for r in pii.find(df).collect()}


def test_contexts_find_unseen_identifiers(spark):
    texts = [f"Call him. His phone: +1 (555) 010-{i:04d} please" for i in range(20)]
    texts += ["His phone: 0049/555-0199x", "His phone: 555-0199", "The year 20240 was good", "phones 555-0199"]
    texts += [f"write to the address bob{'abcdefghijklmnopqrst'[i]}@example.org soon" for i in range(20)]
    texts += ["write to the address bobzz(at)xorg", "our home address is 12 Street"]
    out = spans(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert all(len(out[i]) == 1 for i in (*range(20), *range(24, 44)))
    assert out[20] == [("id", 11, 25)] and out[21] == [("id", 11, 19)]
    assert out[22] == out[23] == out[45] == []
    assert out[44] == [("id", 21, 34)]


def test_values_of_other_contexts_teach_further_ones(spark):
    """Words of any length are contexts; what a trusted context holds makes another one trusted."""
    word = "account" * 9
    texts = [f"{word}: x{i}@example.org, done" for i in range(30)]
    texts += [f"{word}: key#{i}" for i in range(10)]
    texts += [f"token key#{i} ok" for i in range(10)] + ["token key#99 ok", "other key#98 ok"]
    out = spans(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert all(out[30 + i] == [("id", 65, 70)] for i in range(10))
    assert out[50] == [("id", 6, 12)] and out[51] == []


def test_a_slot_that_mostly_holds_other_things_finds_nothing(spark):
    texts = [f"call 10.0.0.{i} now" for i in range(10)] + [f"call 7{i}x now" for i in range(40)]
    out = spans(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert all(len(out[i]) == (i < 10) for i in range(50))


def test_many_mentions_in_one_text_are_linear(spark):
    """200,000 mentions and as many known forms, in seconds."""
    texts = ["id 12345678 " * 200_000, "a@b.c " * 100_000, "10.0.0.1 x9 " * 60_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    start = time.perf_counter()
    got = {r["doc_id"]: r["n"] for r in pii.find(df).select("doc_id", F.size("spans").alias("n")).collect()}
    assert got[0] == 0 and got[1] == 100_000 and got[2] >= 60_000
    assert time.perf_counter() - start < 120


def test_hostile_tokens(spark):
    texts = ["a-" * 30_000, "(" * 30_000 + "a1", "a" * 50_000 + "1", "-" * 40_000, "a." * 30_000 + "9" + "." * 30_000]
    out = pii.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert len(out) == 5


def test_odd_rows(spark):
    df = docs.odd(spark, "spans")
    out = pii.find(df).collect()
    assert len(out) == 12 and [r["spans"] for r in out if r["doc_id"] in (2, 3)] == [[], []]
    assert pii.find(docs.empty(spark)).count() == 0


def test_no_python_in_the_plan(spark, sf_dir):
    plan = pii.op4_pii(spark, sf_dir).select(F.count("*"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_contexts_at_starts_and_after_other_mentions(spark):
    texts = [f"ssn 1234567{i:02d} host 10.0.12.{i} done" for i in range(20)]
    texts += [f"mail bob{i:04d}@x.org acct 98765{i:02d}" for i in range(20)]
    texts += ["mail 555012345 acct 9876599", "ssn 123456789 host 2001-0199x done"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r["doc_id"]: [(s["kind"], s["s"], s["e"]) for s in r["spans"]] for r in pii.find(df).collect()}
    assert out[40] == [("id", 5, 14)]
    assert out[41] == [("id", 19, 29)]
