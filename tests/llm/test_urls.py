import pytest

from hearthstat.llm import urls
from hearthstat.llm.urls import Rule

CASES = [
    ("http://Example.ORG/es/1", "example.org", "/es/1", "example.org/es/", "block"),
    ("https://a.example.org/en/1984?x#y", "a.example.org", "/en/1984", "example.org/en/1", "block"),
    ("https://a.example.org/en/2", "a.example.org", "/en/2", "org/", "allow"),
    ("http://notexample.org/es/1", "notexample.org", "/es/1", "org/", "allow"),
    ("x://b.com/fr/", "b.com", "/fr/", "com/fr/", "allow"),
    ("x://b.com/DE/", "b.com", "/DE/", None, "allow"),
    ("x://com/de/q", "com", "/de/q", "com/de/", "block"),
    ("x://b.com/de", "b.com", "/de", None, "allow"),
    ("x://www.spam-farm.net/a", "www.spam-farm.net", "/a", None, "block"),
    ("x://spam-farm.org/a", "spam-farm.org", "/a", "org/", "allow"),
    ("x://big-casino.net/", "big-casino.net", "/", None, "block"),
    ("x://mycasinos.net/", "mycasinos.net", "/", None, "allow"),
    ("x://a.org?q=/es/", "a.org", "", None, "allow"),
    ("x://a.org:80/x", "a.org:80", "/x", None, "allow"),
    ("no scheme.org/es/", "", "", None, "allow"),
    ("", "", "", None, "allow"),
    (None, "", "", None, "allow"),
    ("://", "", "", None, "allow"),
    ("x://b.com/de/" + "y" * 100_000, "b.com", "/de/" + "y" * 100_000, "com/de/", "block"),
]


@pytest.mark.parametrize("limit", [0, 50_000])
def test_cases(spark, monkeypatch, limit):
    monkeypatch.setattr(urls, "BROADCAST_RULES", limit)
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "page_id long, url string")
    out = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judge(df).collect()}
    assert out == {i: c[1:] for i, c in enumerate(CASES)}


def test_notation():
    assert Rule.host_path("example.org/en/1", "block").tokens() == ["en", "example", "org"]
    assert Rule.block("^spam-farm.").tokens() == ["farm", "spam"]
    assert Rule.block("free*win/x^").tokens() == ["x"]
    assert Rule.block("abc").tokens() == []


def test_rule_without_tokens_is_tried_everywhere(spark):
    df = spark.createDataFrame([(1, "x://a.b/zabcz"), (2, "x://a.b/z")], "page_id long, url string")
    out = urls.judge(df, [], [Rule.block("abc")]).orderBy("page_id").collect()
    assert [(r["pattern"], r["verdict"]) for r in out] == [("abc", "block"), (None, "allow")]


def test_odd_rows(spark):
    rows = [(1, "x://a.com/de/", "mine"), (1, "x://a.com/de/", "mine"), (None, None, None), (None, "x://a.com/de/", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, host string")
    out = urls.judge(df).collect()
    assert sorted((str(r["page_id"]), r["host"], r["verdict"]) for r in out) == [
        ("1", "a.com", "block"), ("1", "a.com", "block"), ("None", "", "allow"), ("None", "a.com", "block")
    ]
    assert urls.judge(df.limit(0)).count() == 0
    assert {r["verdict"] for r in urls.judge(df, [], [], "block").collect()} == {"block"}
