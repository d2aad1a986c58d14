import math

import pytest
from pyspark.sql import functions as F

from hearthstat.functions import semantics as S


def agg(df, *cols):
    return tuple(df.agg(*cols).first())


def test_strict_aggregates_are_unknown_when_an_input_is(spark):
    full = spark.createDataFrame([(1.0,), (2.0,)], "x double")
    holes = spark.createDataFrame([(1.0,), (None,), (3.0,)], "x double")
    for f, known, kept in ((S.sum_of, 3.0, 4.0), (S.mean_of, 1.5, 2.0), (S.max_of, 2.0, 3.0)):
        assert agg(full, f("x")) == (known,)
        assert agg(holes, f("x")) == (None,)
        assert agg(holes, f("x", na_rm=True)) == (kept,)


def test_sum_of_nothing_is_zero_and_mean_of_nothing_is_missing(spark):
    empty = spark.createDataFrame([], "x double")
    assert agg(empty, S.sum_of("x"), S.sum_of("x", na_rm=True), S.mean_of("x", na_rm=True)) == (0.0, 0.0, None)
    nulls = spark.createDataFrame([(None,)], "x double")
    assert agg(nulls, S.sum_of("x", na_rm=True), S.sum_of("x")) == (0.0, None)


def test_distinct_count_takes_missing_as_a_value(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",), (None,), (None,)], "x string")
    assert agg(df, S.n_distinct("x"), S.n_distinct("x", strict_count=True)) == (3, 2)
    assert agg(df, S.n_distinct("x", approx=True)) == (3,)
    assert agg(df.limit(0), S.n_distinct("x")) == (0,)


def test_weighted_mean(spark):
    df = spark.createDataFrame([(True, 10.0, 1), (False, 40.0, 2)], "f boolean, x double, w int")
    assert agg(df, S.weighted_mean("x", "w")) == (30.0,)
    holes = df.union(spark.createDataFrame([(None, 1.0, None)], df.schema))
    assert agg(holes, S.weighted_mean("x", "w")) == (None,)
    weightless = spark.createDataFrame([(1.0, 0)], "x double, w int")
    assert agg(weightless, S.weighted_mean("x", "w")) == (None,)


def one(spark, c, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()], F.lit(0).alias("__z"))
    return df.select(c).first()[0]


def test_if_else_is_unknown_on_unknown(spark):
    df = spark.createDataFrame([(1,), (2,), (None,)], "x int")
    got = [r[0] for r in df.select(S.if_else(F.col("x") == 1, F.lit("a"), F.lit("b"))).collect()]
    assert got == ["a", "b", None]


def test_text_rules(spark):
    df = spark.createDataFrame([("SEATTLE, WA",), ("TACOMA",), (None,)], "x string")
    assert [r[0] for r in df.select(S.has_text("x", "SEATTLE")).collect()] == [True, False, False]
    key = S.text_key("a", "b")
    pasted = S.text_key("a", "b", paste_missing=True)
    parts = spark.createDataFrame([("000010", "0020"), (None, "1"), (None, None)], "a string, b string")
    assert [tuple(r) for r in parts.select(key, pasted).collect()] == [
        ("000010-0020", "000010-0020"),
        (None, "NA-1"),
        (None, "NA-NA"),
    ]
    assert one(spark, S.slice_text("s", 0, 6), s="123456789012345") == "123456"
    assert one(spark, S.slice_text("s", 7, 10), s="123456789012345") == "7890"
    assert one(spark, S.split_parcel_key("s", 14), s="123456789012345") == "123456-78901234"


def test_numeric_keeps_numbers_and_drops_words(spark):
    df = spark.createDataFrame([("12", 3), ("n/a", 4), (None, None)], "t string, i int")
    assert [tuple(r) for r in df.select(S.numeric(df, "t"), S.numeric(df, "i")).collect()] == [
        (12.0, 3),
        (None, 4),
        (None, None),
    ]


def test_ratio(spark):
    df = spark.createDataFrame([(1, 4), (0, 0), (3, 0), (-3, 0), (None, 1)], "a int, b int")
    assert [r[0] for r in df.select(S.ratio("a", "b")).collect()] == [0.25, None, math.inf, -math.inf, None]


def test_packed_order_sorts_like_its_parts(spark):
    rows = [(a, b, c) for a in (-5, 0, 12000) for b in (0, 999_999_999_999) for c in (0, 7, 9_999_999_999)]
    df = spark.createDataFrame(rows, "a int, b long, c long")
    key = S.packed_order([(F.col("a"), 5), (F.col("b"), 12)], [(F.col("c"), 10)])
    assert [tuple(r) for r in df.orderBy(key).collect()] == sorted(rows)


@pytest.mark.parametrize("value", [100_000, -1])
def test_packed_order_refuses_what_does_not_fit(spark, value):
    key = S.packed_order([(F.col("a"), 5)], [(F.col("a"), 6)])
    assert spark.createDataFrame([(99_999,), (None,)], "a int").select(key).count() == 2
    with pytest.raises(Exception, match="digits"):
        spark.createDataFrame([(value,)], "a int").select(key).collect()
