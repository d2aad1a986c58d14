import gzip
import math
import os
import shutil
from datetime import date

import pytest
from pyspark.sql import functions as F

from hearthstat import bindings
from hearthstat.operators.regress import Factor, formula_ols
from hearthstat.sources import readers, schemas, writers


def test_csv_binds_by_header_and_keeps_leading_zeros(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text(
        'Minor,"Unused, column",Major,NbrLivingUnits,YrBuilt,Condition\n'
        '0005,x,000012,2,1950,n/a\n"0010","a, ""b""",000300,,1960,3\n'
    )
    df = readers.read_csv(spark, str(path), schemas.RESIDENTIAL)
    assert df.columns == ["Major", "Minor", "NbrLivingUnits", "YrBuilt", "Condition"]
    assert [tuple(r) for r in df.collect()] == [("000012", "0005", 2, 1950, None), ("000300", "0010", None, 1960, 3)]


def test_gzipped_csv(spark, tmp_path):
    path = tmp_path / "a.csv.gz"
    with gzip.open(path, "wt") as f:
        f.write('DWELTYPE,tr_type\n"Accessory Dwelling, Attached",Accessory Dwelling\nNone,\n')
    rows = [tuple(r) for r in readers.read_csv(spark, str(path), schemas.PERMIT_RECODE).collect()]
    assert rows == [("Accessory Dwelling, Attached", "Accessory Dwelling"), ("None", None)]


def test_every_schema_parses(spark):
    for name in dir(schemas):
        text = getattr(schemas, name)
        if name.isupper() and isinstance(text, str):
            assert spark.createDataFrame([], text).columns


def test_fixed_tables(spark):
    recode = schemas.permit_types(spark)
    assert recode.count() == 21 and recode.filter("tr_type = ''").count() == 7
    poverty = {r["year"]: r["threshold"] for r in schemas.poverty_thresholds(spark, -15).collect()}
    assert len(poverty) == 12 and poverty[1995] == 17552 and poverty[2006] == 21811


def test_fixed_width(spark, tmp_path):
    path = tmp_path / "micro.dat"
    #               YEAR HHWT     P NN RNT
    path.write_text("2020000123455xx050\n2021000200001 y   \n20zz        2     \n")
    layout = [
        ("YEAR", 1, 4, "int"),
        ("HHWT", 5, 8, "double"),
        ("PERNUM", 13, 1, "int"),
        ("NOTE", 14, 2, "string"),
        ("RENT", 16, 3, "int"),
    ]
    df = readers.read_fixed_width(spark, str(path), layout, scale={"HHWT": 2})
    assert [tuple(r) for r in df.collect()] == [
        (2020, 123.45, 5, "xx", 50),
        (2021, 200.0, 1, "y", None),
        (None, None, 2, None, None),
    ]


def test_result_table_roundtrip(spark, tmp_path):
    df = spark.createDataFrame([("a", None, math.inf), (None, 2, 1.5)], "building_size string, units int, x double")
    out = str(tmp_path / "t")
    writers.write_csv(df.coalesce(1), out)
    text = "".join(p.read_text() for p in (tmp_path / "t").glob("part-*"))
    assert text.splitlines()[0] == "Building size,Units,x" and "a,NA,Infinity" in text
    back = readers.read_table_csv(spark, out, "building_size string, units int, x double")
    assert sorted(map(tuple, back.collect()), key=repr) == sorted(map(tuple, df.collect()), key=repr)


def test_result_table_drops_row_numbers(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text('"","Year","Ratio"\n"1",2015,NA\n"2",NA,Inf\n')
    df = readers.read_table_csv(spark, str(path))
    assert df.columns == ["Year", "Ratio"]
    assert df.collect()[0]["Ratio"] is None and df.collect()[1]["Year"] is None


def test_stage_cuts_and_partitions(spark, tmp_path):
    df = spark.range(10).withColumn("year", (F.col("id") % 2 + 2019).cast("int"))
    staged = writers.stage(df, str(tmp_path / "s"), ["year"])
    assert staged.filter("year = 2020").count() == 5
    assert "PartitionFilters: [isnotnull(year" in staged.filter("year = 2020")._jdf.queryExecution().executedPlan().toString()
    assert readers.read_parquet(spark, str(tmp_path / "s"), "id long").count() == 10


def test_model_is_written_as_its_coefficients(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 4.0), ("b", 8.0)], "g string, y double")
    writers.write_model(spark, formula_ols(df, "y", Factor("g"), []), str(tmp_path / "m"))
    got = {r["term"]: r["estimate"] for r in spark.read.parquet(str(tmp_path / "m")).collect()}
    assert got == pytest.approx({"g:a": 2.0, "g:b": 6.0})


class FakeReader:
    """Records the options a JDBC read would use; no database is available to tests."""

    def __init__(self):
        self.seen = {}

    def format(self, name):
        self.seen["format"] = name
        return self

    def option(self, key, value):
        self.seen[key] = value
        return self

    def options(self, **kv):
        self.seen.update(kv)
        return self

    def load(self):
        return self.seen


def test_query_options():
    class Session:
        read = FakeReader()

    seen = readers.read_query(Session, "jdbc:x", "SELECT 1", "id", (0, 99), 8, user="u")
    assert seen == {
        "format": "jdbc", "url": "jdbc:x", "dbtable": "(SELECT 1) q", "partitionColumn": "id",
        "lowerBound": 0, "upperBound": 99, "numPartitions": 8, "user": "u",
    }
    with pytest.raises(ValueError):
        readers.read_query(Session, "jdbc:x", "SELECT 1", "id")


def test_dates_survive(spark, tmp_path):
    path = tmp_path / "l.csv"
    path.write_text(
        "parcel_num,seen_on,listed_on,removed_on,price_numeric,beds,baths,sqft,listing_unit_level_id\n"
        "000001-0002,2020-01-05,,2020-02-01,1200,1,1.5,,u1\n"
    )
    row = readers.read_csv(spark, str(path), schemas.LISTINGS).first()
    assert row["seen_on"] == date(2020, 1, 5) and row["listed_on"] is None and row["baths"] == 1.5


# The published headings of the tables that are written, by output column.
PUBLISHED = {
    "Q16": (["building_size", "year", "households", "household_index"],
            ["Building size", "Year", "Households", "Households (100 = base)"]),
    "Q17": (["building_size", "year", "units_removed", "units_added", "net_units", "permits", "sites"],
            ["Building size", "Year", "Gross dwelling units removed", "Gross dwelling units added",
             "Net dwelling units", "Total permits", "Total development sites"]),
    "Q20": (["year", "owner_type", "owners", "units", "unit_index", "owner_index"],
            ["Year", "Owner type", "Owners", "Units", "Indexed unit count", "Indexed owner count"]),
    "Q22": (["building_size", "year", "housing_cost", "data_source"],
            ["Building size", "Year", "Housing cost", "Data source"]),
    "Q23": (["unregistered_units", "parcels", "registered_parcels", "listed_units", "registered_units",
             "unregistered_parcels"],
            ["Unregistered units", "Parcels", "Registered parcels", "Listed unit count", "Registered units",
             "Unregistered parcels"]),
    "Q24": (["owner_type", "bedrooms", "median_rent"], ["Owner type", "Bedrooms", "Median annual rental costs"]),
    "Q7": (["parcel_num", "year", "bedrooms", "baths", "building_size", "property_type", "owner_names",
            "owner_residence", "owner_occupied", "geo_id", "year_built", "is_company", "portfolio_parcels",
            "portfolio_buildings", "portfolio_units", "owner_type", "listing_count", "unit_count", "annual_rent",
            "square_feet"],
           ["Parcel number", "Year", "Bedrooms", "Baths", "Building size", "Property type", "Owner names",
            "Owner residence", "Owner occupied", "Census tract", "Year structure built", "Owner is company",
            "Owner portfolio: parcels", "Owner portfolio: buildings", "Owner portfolio: units", "Owner type",
            "Listing count", "Unit count", "Annual rental costs", "Square feet"]),
}


@pytest.mark.parametrize("table", PUBLISHED)
def test_headings(spark, table):
    from hearthstat.sources.writers import with_headings

    columns, headings = PUBLISHED[table]
    assert with_headings(spark.createDataFrame([], ", ".join(f"{c} string" for c in columns))).columns == headings


def test_files_of_a_folder_must_agree_on_columns(spark, tmp_path):
    for name, text in (("a.csv", "x,y\n1,2\n"), ("b.csv", "y,x\n3,4\n")):
        (tmp_path / name).write_text(text)
    with pytest.raises(Exception):
        read_csv_rows = readers.read_csv(spark, str(tmp_path), "x int, y int").collect()
        assert not read_csv_rows


def test_row_numbers_follow_the_tables_order(spark, tmp_path):
    """The published shape: a nameless first column that counts the rows, then the headings."""
    df = spark.range(300).select(
        F.concat(F.lit('size, "'), F.lpad(F.col("id").cast("string"), 3, "0"), F.lit('"')).alias("building_size"),
        (F.col("id") * 7 % 11).cast("int").alias("year"),
        F.when(F.col("id") % 3 > 0, F.col("id")).alias("units"),
    ).orderBy(F.desc("building_size"))
    path = str(tmp_path / "t.csv")
    writers.write_csv(df, path, row_numbers=True)
    lines = [line for f in sorted((tmp_path / "t.csv").glob("part*")) for line in f.read_text().splitlines()]
    assert lines[0] == ",Building size,Year,Units"
    assert lines[1] == '1,"size, ""299""",3,299' and lines[3] == '3,"size, ""297""",0,NA'
    body = [line for line in lines if not line.startswith(",")]
    assert [int(line.split(",")[0]) for line in body] == list(range(1, 301))
    back = readers.read_table_csv(spark, path)
    assert back.columns == ["Building size", "Year", "Units"]
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    writers.write_csv(df.limit(0), str(tmp_path / "none.csv"), row_numbers=True)
    assert readers.read_table_csv(spark, str(tmp_path / "none.csv"), "a int, b string, c int, d int").count() == 0


def rental_like(spark, n=4000, years=(2000, 2001, 2002)):
    year = F.element_at(F.array(*map(F.lit, years)), (F.col("id") % len(years) + 1).cast("int"))
    parcel = F.when(F.col("id") % 3 == 0, F.lit("hot")).when(F.col("id") % 50 > 0, F.concat(F.lit("p"), F.col("id") % 90))
    return spark.range(n).select(parcel.alias("parcel_num"), year.alias("year"), F.col("id").alias("rent"))


def test_bucketed_table_is_grouped_without_a_shuffle(spark, tmp_path):
    df = rental_like(spark)
    staged = writers.stage_bucketed(df, "staged_rent", "parcel_num", "year", 4, str(tmp_path / "rent"))
    assert staged.columns == df.columns and staged.exceptAll(df).count() == 0 and staged.count() == df.count()
    by_parcel = staged.groupBy("parcel_num").agg(F.sum("rent"))
    joined = staged.join(staged.groupBy("parcel_num").agg(F.max("rent").alias("most")), "parcel_num")
    for plan in (by_parcel, joined.hint("merge")):
        assert "Exchange" not in plan._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" in df.groupBy("parcel_num").agg(F.sum("rent"))._jdf.queryExecution().executedPlan().toString()
    spark.sql("DROP TABLE staged_rent")


def test_one_year_of_a_staged_table_is_replaced(spark, tmp_path):
    df = rental_like(spark)
    writers.stage_bucketed(df, "staged_year", "parcel_num", "year", 4, str(tmp_path / "rent"))
    new = rental_like(spark, 200, (2001, 2005)).withColumn("rent", -F.col("rent"))
    mode = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    writers.replace_partitions(new, "staged_year")
    assert spark.conf.get("spark.sql.sources.partitionOverwriteMode") == mode
    want = df.filter("year <> 2001").unionByName(new)
    got = spark.table("staged_year").select(*df.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert "Exchange" not in got.groupBy("parcel_num").count()._jdf.queryExecution().executedPlan().toString()
    spark.sql("DROP TABLE staged_year")


def test_analyses_share_one_staged_table(spark, sf_dir, tmp_path):
    shutil.copytree(sf_dir, tmp_path / "sf")
    folder = str(tmp_path / "sf")
    staged = bindings.staged_rental(spark, folder)
    plain = bindings.rental(spark, folder)
    assert staged.columns == plain.columns and staged.schema.simpleString() == plain.schema.simpleString()
    assert staged.exceptAll(plain).count() == 0 and staged.count() == plain.count()
    again = bindings.staged_rental(spark, folder)
    assert again.inputFiles() and sorted(again.inputFiles()) == sorted(staged.inputFiles())
    orders = tmp_path / "sf" / "orders.parquet"
    os.utime(orders, (1, 1))
    assert set(bindings.staged_rental(spark, folder).inputFiles()).isdisjoint(staged.inputFiles())
