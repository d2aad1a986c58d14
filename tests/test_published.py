"""What must hold within the published result tables, all rows of them, by column position.

PUBLISHED_DIR names a folder with T0.csv, T1.csv and so on; without it the tests are skipped.
"""

import os

import pytest
from pyspark.sql import functions as F

from hearthstat.functions import semantics as S
from hearthstat.operators.series import index_to_base
from hearthstat.sources.readers import read_table_csv

FOLDER = os.environ.get("PUBLISHED_DIR", "")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="PUBLISHED_DIR is not set")


def published(spark, name, *columns):
    df = read_table_csv(spark, os.path.join(FOLDER, name))
    return df.toDF(*[columns[i] if i < len(columns) else f"c{i}" for i in range(len(df.columns))])


def same(df, got, want, rel=1e-9):
    rows = df.select(F.col(got).cast("double").alias("got"), F.col(want).cast("double").alias("want")).collect()
    assert rows
    for r in rows:
        assert r["got"] == (r["want"] if r["want"] is None else pytest.approx(r["want"], rel=rel))


@pytest.mark.parametrize("name", ["T0.csv", "T1.csv"])
def test_market_indexes(spark, name):
    df = published(spark, name, "year", "value", "estimate", "index")
    same(index_to_base(df, {"own": "value"}, ["estimate"]), "own", "index")
    assert df.count() == 33


@pytest.mark.parametrize("statistic, measure", [("HH Income", "income"), ("Housing Cost", "cost")])
def test_tenure_indexes(spark, statistic, measure):
    df = published(spark, "T2.csv", "year", "ownership", "income", "cost", "statistic", "index")
    assert df.count() == 64
    part = df.filter(F.col("statistic").contains(statistic))
    same(index_to_base(part, {"own": measure}, ["ownership"]), "own", "index")


def test_renter_indexes(spark):
    df = published(spark, "T3.csv", "building_size", "year", "households", "index")
    assert df.count() == 80
    same(index_to_base(df, {"own": "households"}, ["building_size"]), "own", "index")


def test_net_units(spark):
    """Net is added less removed, but in one row (of permits without a year); a site has a permit at least."""
    df = published(spark, "T4.csv", "building_size", "year", "removed", "added", "net", "permits", "sites")
    assert df.count() == 92
    other = df.filter("not added - removed <=> net").collect()
    assert [(r["building_size"], r["year"]) for r in other] == [("Single family", None)]
    assert df.filter("sites > permits").count() == 0


def test_ownership_indexes(spark):
    df = published(spark, "T5.csv", "year", "owner_type", "owners", "units", "unit_index", "owner_index")
    assert df.count() == 28
    own = index_to_base(df, {"u": "units", "o": "owners"}, ["owner_type"])
    same(own, "u", "unit_index")
    same(own, "o", "owner_index")


def test_rents_by_size(spark):
    df = published(spark, "T7.csv", "building_size", "year", "cost", "source")
    assert df.count() == 90 and df.filter("cost <= 0 or cost is null").count() == 0
    assert df.groupBy("building_size", "year", "source").count().filter("count > 1").count() == 0


def test_flow_ratios(spark):
    df = published(spark, "T10.csv", "building_size", "property_type", "entrance", "exit", "stable", "ratio")
    assert df.count() == 14
    same(df.withColumn("own", S.ratio("exit", "entrance")), "own", "ratio")
