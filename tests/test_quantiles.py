import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from hearthstat.operators.quantiles import grouped_median, grouped_quantile


def expanded(values, weights, p):
    return float(np.quantile(np.repeat(values, weights), p, method="linear"))


def test_weighted_median_interpolates(spark):
    df = spark.createDataFrame([(10.0, 1), (20.0, 1), (30.0, 2)], "x double, w int")
    assert grouped_quantile(df, [], {"q": "x"}, 0.5, "w").first()["q"] == 25.0


def test_zero_weights_are_ignored(spark):
    df = spark.createDataFrame([(1.0, 0), (10.0, 1), (20.0, 0), (30.0, 1), (99.0, 0)], "x double, w int")
    assert grouped_quantile(df, [], {"q": "x"}, 0.5, "w").first()["q"] == 20.0
    assert grouped_quantile(df, [], {"q": "x"}, 0.0, "w").first()["q"] == 10.0
    assert grouped_quantile(df, [], {"q": "x"}, 1.0, "w").first()["q"] == 30.0


def test_missing_values(spark):
    rows = [("a", 1.0, 1), ("a", None, 1), ("b", 4.0, 1), ("c", None, 1), ("d", 5.0, 0), ("e", 6.0, None)]
    df = spark.createDataFrame(rows, "g string, x double, w int")
    strict = {r["g"]: r["q"] for r in grouped_median(df, ["g"], {"q": "x"}).collect()}
    assert strict == {"a": None, "b": 4.0, "c": None, "d": 5.0, "e": 6.0}
    loose = {r["g"]: r["q"] for r in grouped_quantile(df, ["g"], {"q": "x"}, 0.5, "w", na_rm=True).collect()}
    assert loose == {"a": 1.0, "b": 4.0, "c": None, "d": None, "e": None}


def test_null_key_is_a_group_and_measures_share_a_pass(spark):
    rows = [(None, 1.0, 10.0), (None, 3.0, -10.0), ("a", 5.0, 0.0)]
    df = spark.createDataFrame(rows, "g string, x double, y double")
    got = {r["g"]: (r["mx"], r["my"]) for r in grouped_median(df, ["g"], {"mx": "x", "my": "y"}).collect()}
    assert got == {None: (2.0, 0.0), "a": (5.0, 0.0)}


def test_fractional_weights(spark):
    # Total weight 4: rank 1 + 3/2 lies halfway between ranks 2 and 3.
    df = spark.createDataFrame([(1.0, 0.5), (2.0, 1.5), (3.0, 2.0)], "x double, w double")
    assert grouped_quantile(df, [], {"q": "x"}, 0.5, "w").first()["q"] == 2.5
    tenth = spark.createDataFrame([(float(i), 0.1) for i in range(30)], "x double, w double")
    assert grouped_quantile(tenth, [], {"q": "x"}, 1.0, "w").first()["q"] == 29.0


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    rows=st.lists(
        st.tuples(
            st.integers(0, 2),
            st.floats(-1e9, 1e9, allow_nan=False).map(lambda v: v + 0.0),
            st.integers(1, 5),
        ),
        min_size=1,
        max_size=40,
    ),
    p=st.sampled_from([0.0, 0.1, 0.25, 0.5, 0.9, 1.0]),
)
def test_equals_quantile_of_the_expanded_rows(spark, rows, p):
    df = spark.createDataFrame(rows, "g int, x double, w int")
    got = {r["g"]: r["q"] for r in grouped_quantile(df, ["g"], {"q": "x"}, p, "w").collect()}
    for g in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == g]
        want = expanded([r[1] for r in mine], [r[2] for r in mine], p)
        assert math.isclose(got[g], want, rel_tol=1e-9, abs_tol=1e-6)


def test_one_group_with_a_third_of_all_rows(spark):
    from pyspark.sql import functions as F

    df = spark.range(30_000).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 500 + 1).alias("g"),
        (F.col("id") * 7919 % 10_007 / 16).alias("x"),
        (F.col("id") * 31 % 7).alias("w"),
    )
    got = {r["g"]: r["q"] for r in grouped_quantile(df, ["g"], {"q": "x"}, 0.5, "w").collect()}
    coarse = grouped_quantile(df, ["g"], {"q": "x"}, 0.5, "w", bars=1).collect()
    assert {r["g"]: r["q"] for r in coarse} == got
    pdf = df.toPandas()
    assert len(got) == pdf["g"].nunique()
    for g, part in pdf.groupby("g"):
        assert got[g] == pytest.approx(expanded(part["x"], part["w"], 0.5), rel=1e-12)
