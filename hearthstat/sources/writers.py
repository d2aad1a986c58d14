"""Writing staged tables, result tables and fitted models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.regress import Fit
from ..operators.series import numbered

# Published column headings.
HEADINGS = {
    "year": "Year",
    "ownership": "Ownership",
    "building_size": "Building size",
    "property_type": "Property type",
    "bedrooms": "Bedrooms",
    "baths": "Baths",
    "households": "Households",
    "household_index": "Households (100 = base)",
    "estimate": "Estimate",
    "statistic": "Statistic",
    "median_hh_income": "Median HH Income",
    "median_housing_cost": "Median Housing Cost",
    "housing_cost": "Housing cost",
    "data_source": "Data source",
    "units_removed": "Gross dwelling units removed",
    "units_added": "Gross dwelling units added",
    "net_units": "Net dwelling units",
    "permits": "Total permits",
    "sites": "Total development sites",
    "owner_type": "Owner type",
    "owners": "Owners",
    "units": "Units",
    "unit_index": "Indexed unit count",
    "owner_index": "Indexed owner count",
    "mean_rent": "Mean rent",
    "mean_sqft": "Mean sqrft",
    "listings": "Listings",
    "parcels": "Parcels",
    "parcel_num": "Parcel number",
    "registered_units": "Registered units",
    "registered_parcels": "Registered parcels",
    "unregistered_units": "Unregistered units",
    "unregistered_parcels": "Unregistered parcels",
    "entrance": "Entrance",
    "exit": "Exit",
    "stable": "Stable",
    "exit_to_entrance": "Exit to entrance ratio",
    "coverage": "Coverage",
    "portfolio": "Owner properties",
    "listed_units": "Listed unit count",
    "change": "Change",
    "gross_change": "Gross change",
    "median_rent": "Median annual rental costs",
    "hh_income": "HH Income",
    "housing_share": "Housing share of HH income",
    "burden": "Burden",
    "building_type": "Building type",
    "owner_names": "Owner names",
    "owner_residence": "Owner residence",
    "owner_occupied": "Owner occupied",
    "is_company": "Owner is company",
    "geo_id": "Census tract",
    "year_built": "Year structure built",
    "portfolio_parcels": "Owner portfolio: parcels",
    "portfolio_buildings": "Owner portfolio: buildings",
    "portfolio_units": "Owner portfolio: units",
    "listing_count": "Listing count",
    "unit_count": "Unit count",
    "annual_rent": "Annual rental costs",
    "square_feet": "Square feet",
}


def with_headings(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed({c: HEADINGS[c] for c in df.columns if c in HEADINGS})


def stage(df: DataFrame, path: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write a table as Parquet and return it as read back, with its lineage cut."""
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return df.sparkSession.read.parquet(path)


def stage_bucketed(
    df: DataFrame,
    table: str,
    by: str,
    partition_by: str,
    buckets: int | None = None,
    path: str | None = None,
    dealt: bool = False,
) -> DataFrame:
    """Publish a table in buckets of ``by`` within partitions, so that grouping and joining on it need no shuffle.

    The catalog keeps the layout under the name ``table``; files lie in ``path``, or in the
    warehouse. Rows are rebalanced by bucket first, which writes few files and still parts
    the rows of a hot key over several; with ``dealt`` the rows already lie by the hash of
    ``by`` (see ``joins.by_key``) and do not move again. Returns the table as read back.
    """
    spark = df.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    writer = (df if dealt else df.hint("rebalance", buckets, by)).write.mode("overwrite").partitionBy(partition_by).bucketBy(buckets, by)
    if path:
        writer = writer.option("path", path)
    writer.saveAsTable(table)
    return spark.table(table).select(*df.columns)


def replace_partitions(df: DataFrame, table: str) -> None:
    """Put ``df`` in the place of those partitions of a staged table that it has rows for; the others stay."""
    spark = df.sparkSession
    mode = "spark.sql.sources.partitionOverwriteMode"
    before = spark.conf.get(mode)
    spark.conf.set(mode, "dynamic")
    try:
        df.select(*spark.table(table).columns).write.mode("overwrite").insertInto(table)
    finally:
        spark.conf.set(mode, before)
    spark.catalog.refreshTable(table)


def write_csv(df: DataFrame, path: str, headings: bool = True, row_numbers: bool = False) -> None:
    """Result table as CSV with 'NA' for missing values.

    ``row_numbers`` puts a nameless column before the others, which counts the rows from 1
    in the table's order.
    """
    out = with_headings(df) if headings else df
    if row_numbers:
        out = numbered(out, name="__row")
        out = out.select(F.col("__row").cast("string").alias(""), *[F.col(f"`{c}`") for c in out.columns[:-1]])
    out.write.mode("overwrite").csv(path, header=True, nullValue="NA", emptyValue="", escape='"')


def write_model(spark: SparkSession, fit: Fit | DataFrame, path: str) -> None:
    """Coefficient table of a fitted model as Parquet."""
    table = fit.table(spark) if isinstance(fit, Fit) else fit
    table.write.mode("overwrite").parquet(path)
