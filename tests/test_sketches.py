import pytest
from pyspark.sql import functions as F

from hearthstat.operators import sketches as K
from hearthstat.sources import writers


@pytest.fixture(scope="module")
def rents(spark):
    return spark.range(60_000).select(
        (F.col("id") % 5 + 2000).alias("year"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 4).cast("string")).alias("kind"),
        F.when(F.col("id") % 7 > 0, (F.col("id") * 7919 % 60_013).cast("double")).alias("rent"),
        (F.col("id") * F.col("id") % 3001).alias("owner"),
        F.when(F.col("id") % 11 > 0, F.col("id") % 13).alias("part"),
    )


def test_quantiles_of_merged_years_are_within_the_stated_rank_error(spark, rents, tmp_path):
    stored = writers.stage(K.sketches(rents, ["year", "kind"], {"rents": "rent"}, k=400), str(tmp_path / "s"), ["year"])
    assert stored.count() == 25
    merged = K.merged(stored, ["kind"], ["rents"])
    for p in (0.1, 0.5, 0.99):
        for row in merged.select("kind", "n", K.quantile_of("rents", p).alias("q")).collect():
            values = rents.filter(F.col("kind") == row["kind"])
            assert row["n"] == values.count()
            below = values.select(F.avg((F.col("rent") < row["q"]).cast("double"))).first()[0]
            assert abs(below - p) <= K.rank_error(400) + 1e-4


def test_small_groups_are_exact_and_empty_ones_null(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("a", float("nan")), ("a", 2.0), ("b", None)], "g string, v double")
    got = {r["g"]: r["q"] for r in K.sketches(df, ["g"], {"v": "v"}).select("g", K.quantile_of("v").alias("q")).collect()}
    assert got == {"a": 2.0, "b": None}
    assert K.sketches(df.limit(0), ["g"], {"v": "v"}).collect() == []


def test_union_of_years_counts_distinct_within_its_error(spark, rents, tmp_path):
    stored = writers.stage(K.sketches(rents, ["year"], distinct={"owners": ["owner"], "pairs": ["owner", "part"]}), str(tmp_path / "d"))
    both = K.merged(stored, [], distinct=["owners", "pairs"]).select(K.distinct_of("owners").alias("o"), K.distinct_of("pairs").alias("p")).first()
    owners, pairs = rents.select("owner").distinct().count(), rents.select("owner", "part").distinct().count()
    assert both["o"] == pytest.approx(owners, rel=4 * K.distinct_error())
    assert both["p"] == pytest.approx(pairs, rel=4 * K.distinct_error())
    one = {r["year"]: r["o"] for r in stored.select("year", K.distinct_of("owners").alias("o")).collect()}
    exact = {r["year"]: r["n"] for r in rents.groupBy("year").agg(F.countDistinct("owner").alias("n")).collect()}
    assert all(one[y] == pytest.approx(n, rel=4 * K.distinct_error()) for y, n in exact.items())
    assert sum(one.values()) > 2 * both["o"]


def test_a_missing_value_counts_as_one(spark):
    df = spark.createDataFrame([(1, None), (1, None), (1, 2), (1, 3), (None, 3)], "a int, b int")
    got = K.sketches(df, [], distinct={"a": ["a"], "ab": ["a", "b"]}).select(K.distinct_of("a").alias("a"), K.distinct_of("ab").alias("ab")).first()
    assert tuple(got) == (2, 4)
