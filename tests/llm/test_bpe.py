import random

import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from hearthstat.llm import bpe
from tests.llm import docs


@pytest.fixture(scope="module")
def known():
    tokens, pattern = bpe.multi_ranks()
    theirs = tiktoken.Encoding(
        "test", pat_str=pattern, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={}
    )
    return bpe.Encoder(tokens, pattern, bpe.PerfectHash(tokens)), theirs, tokens, pattern


@settings(max_examples=300, deadline=None)
@given(text=st.text(st.characters(exclude_categories=["Cs"]), max_size=80))
def test_as_tiktoken(known, text):
    ours, theirs = known[:2]
    (ids,) = ours.encode([text])
    assert list(ids) == theirs.encode_ordinary(text)
    assert ours.decode(ids) == text.encode()


def test_long_pretokens(known):
    ours, theirs = known[:2]
    rnd = random.Random(1)
    texts = ["a" * 3000, " " * 2000 + "x", "\n" * 999, "".join(rnd.choice("éßñab") for _ in range(4000))]
    assert [list(x) for x in ours.encode(texts)] == [theirs.encode_ordinary(t) for t in texts]
    assert len(ours.encode(["ab" * 100_000])[0]) > 1


def test_perfect_hash_is_minimal(known):
    tokens = known[2]
    table = known[0].table
    assert table.find(tokens).tolist() == list(range(len(tokens)))
    assert sorted(table.key_at.tolist()) == list(range(len(tokens)))
    assert bpe.PerfectHash([]).find([b"x"]).tolist() == [-1]


@pytest.mark.parametrize("extra", ["", "ids"])
def test_odd_rows(spark, known, extra):
    theirs, tokens, pattern = known[1:]
    out = bpe.encode(docs.odd(spark, extra), tokens, pattern, decoded=True)
    for r in bpe.decode(out.withColumnRenamed("decoded", "first"), tokens).collect():
        ids = theirs.encode_ordinary(r["text"] or "")
        assert r["n_tokens"] == len(ids)
        assert bytes(r["ids"]) == b"".join(i.to_bytes(4, "little") for i in ids)
        assert bytes(r["first"]) == bytes(r["decoded"]) == (r["text"] or "").encode()
    assert bpe.encode(docs.empty(spark), tokens, pattern).count() == 0
