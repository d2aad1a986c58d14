import pytest
from pyspark.sql import functions as F

from hearthstat.operators import series as R

# Published figures (fixed values): year, owner type, owners, units, indexes.
OWNERS = [
    (2015, "Large property manager", 333, 57307, 100.0, 100.0),
    (2015, "Midsized property manager", 3093, 63270, 100.0, 100.0),
    (2015, "Mom-and-pop", 24768, 35063, 100.0, 100.0),
    (2015, "Small property manager", 1360, 4259, 100.0, 100.0),
    (2020, "Large property manager", 336, 73548, 128.340342366552, 100.900900900901),
    (2020, "Midsized property manager", 3127, 77223, 122.053105737316, 101.099256385386),
    (2020, "Mom-and-pop", 24524, 33816, 96.4435444770841, 99.0148578811369),
    (2020, "Small property manager", 1918, 5806, 136.323080535337, 141.029411764706),
    (2021, "Large property manager", 344, 77945, 136.013052506675, 103.303303303303),
    (2021, "Midsized property manager", 3120, 76298, 120.591117433223, 100.872938894277),
    (2021, "Mom-and-pop", 24618, 33909, 96.7087813364515, 99.3943798449613),
    (2021, "Small property manager", 2035, 5984, 140.502465367457, 149.632352941176),
]


@pytest.fixture(scope="module")
def owners(spark):
    return spark.createDataFrame([o[:4] for o in OWNERS], "year int, owner_type string, owners long, units long")


def test_index_reproduces_published_figures(owners):
    indexed = R.index_to_base(owners, {"u": "units", "o": "owners"}, ["owner_type"])
    got = {(r["year"], r["owner_type"]): (r["u"], r["o"]) for r in indexed.collect()}
    for year, kind, _, _, units, count in OWNERS:
        assert got[year, kind] == pytest.approx((units, count), rel=1e-12)
    assert owners.filter("year = 2020").agg(F.sum("units")).first()[0] == 190_393


def test_index_to_a_given_period(owners):
    indexed = R.index_to_base(owners, {"u": "units"}, ["owner_type"], base=2020)
    got = {(r["year"], r["owner_type"]): r["u"] for r in indexed.collect()}
    assert got[2020, "Mom-and-pop"] == 100.0
    assert got[2015, "Mom-and-pop"] == pytest.approx(35063 / 33816 * 100)
    absent = R.index_to_base(owners, {"u": "units"}, ["owner_type"], base=1990)
    assert {r["u"] for r in absent.collect()} == {None}


def test_index_over_a_zero_or_missing_base(spark):
    df = spark.createDataFrame(
        [("a", 1, 0.0), ("a", 2, 5.0), ("a", 3, -5.0), ("b", 1, None), ("b", 2, 5.0)], "g string, year int, x double"
    )
    got = R.index_to_base(df, {"i": "x"}, ["g"]).orderBy("g", "year").collect()
    assert [r["i"] for r in got] == [None, float("inf"), float("-inf"), None, None]


def test_longer_and_wider_are_inverse(owners):
    long = R.longer(owners, ["owners", "units"], "what")
    assert long.count() == 2 * len(OWNERS)
    back = R.wider(long, ["year", "owner_type"], "what", ["owners", "units"], F.first("value"))
    assert sorted((r["year"], r["owner_type"], r["owners"], r["units"]) for r in back.collect()) == [
        o[:2] + (float(o[2]), float(o[3])) for o in OWNERS
    ]


def test_stack_rows_pads_missing_columns(spark):
    a = spark.createDataFrame([(1, "x")], "n int, s string")
    b = spark.createDataFrame([(True, 2)], "f boolean, n int")
    got = R.stack_rows(a, b)
    assert got.columns == ["n", "s", "f"]
    assert sorted(map(tuple, got.collect()), key=repr) == [(1, "x", None), (2, None, True)]


def test_arrange_puts_missing_last(spark):
    df = spark.createDataFrame([(None,), (2,), (1,)], "x int")
    assert [r[0] for r in R.arrange(df, "x").collect()] == [1, 2, None]


def test_column_selection(owners):
    assert R.columns_between(owners, "owner_type", "units") == ["owner_type", "owners", "units"]
    assert R.columns_containing(owners, "OWNER") == ["owner_type", "owners"]


def test_rows_are_numbered_in_order_over_partitions(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 613).alias("k"), F.col("id"))
    got = R.numbered(df.repartition(6), [F.desc("k"), F.asc("id")], "number", start=0).collect()
    want = sorted(df.collect(), key=lambda r: (-r["k"], r["id"]))
    assert [(r["k"], r["id"]) for r in sorted(got, key=lambda r: r["number"])] == [tuple(r) for r in want]
    assert sorted(r["number"] for r in got) == list(range(5000))


def test_rows_that_are_all_alike_are_numbered_in_several_ranges(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = R.numbered(spark.range(4000).select(F.lit("same").alias("k")), [F.col("k")])
        parts = got.groupBy(F.spark_partition_id()).count().collect()
        assert sorted(r["row"] for r in got.collect()) == list(range(1, 4001))
        assert len(parts) > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert R.numbered(spark.range(0), [F.col("id")]).collect() == []
