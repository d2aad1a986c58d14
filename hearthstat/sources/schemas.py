"""Explicit schemas of the raw inputs, and the small fixed tables.

Schemas are never inferred: parcel key parts would lose their leading zeros.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

HOUSEHOLDS = (
    "YEAR int, HHWT int, PERNUM int, OWNERSHP int, OWNERSHPD int, RENT double, MORTAMT1 double, "
    "OWNCOST double, HHINCOME double, UNITSSTR int, MIGPUMA1 int"
)
PERMITS = (
    "RECORDNUMBER string, DEVSITE_ID string, X double, Y double, NEIGHBORHOOD string, APTYPE string, "
    "DWELTYPE string, DEMO int, NEW int, NET_UNITS int, YEAR_FINAL int"
)
PERMIT_RECODE = "DWELTYPE string, tr_type string"
APARTMENTS = (
    "Major string, Minor string, NbrBldgs int, NbrStories int, NbrUnits int, AvgUnitSize double, "
    "YrBuilt int, BldgQuality int"
)
RESIDENTIAL = "Major string, Minor string, NbrLivingUnits int, YrBuilt int, Condition int"
CONDOS = "Major string, Minor string, NbrBedrooms int, Grade int"
PARCELS = "Major string, Minor string, PropType string"
PROPERTIES = (
    "parcel_num string, nbr_bldgs int, units_count int, prop_type string, geo_id string, year_built string"
)
OWNERS = (
    "parcel_num string, owner_names string, mail_last_line string, mail_county string, corp_flag boolean"
)
RESIDENCY = "parcel_num_standardized string"
LISTINGS = (
    "parcel_num string, seen_on date, listed_on date, removed_on date, price_numeric double, "
    "beds double, baths double, sqft double, listing_unit_level_id string"
)
REGISTRY = "RECORD_ID string, RECORD_STATUS string, PARCEL_NBR string, Registed_Units string"
OWNERSHIP_RECORDS = "owner_type string, n_units int, roll_yr int"

# Dwelling type -> broad type; an empty text is a type left out.
PERMIT_TYPES = {
    "Accessory Dwelling, Attached": "Accessory Dwelling",
    "Apartment": "Apartment",
    "Detached Single-Family": "Single-Family",
    "Townhouse": "Single-Family",
    "Accessory Dwelling, Detached": "Accessory Dwelling",
    "Rowhouse": "Single-Family",
    "Multifamily Ground Level Townhouse": "Multifamily",
    "Small Efficiency Dwelling": "",
    "Not Reviewed": "",
    "Accessory Caretaker": "Accessory Dwelling",
    "Accessory Live/Work": "Accessory Dwelling",
    "Congregate Housing": "",
    "None": "",
    "Assisted Living": "",
    "Multifamily Non-Ground Level Dwelling": "Multifamily",
    "No Dwelling Units": "",
    "Cottage": "Single-Family",
    "Multifamily Ground Level Apartment": "Multifamily",
    "Multifamily Other": "Multifamily",
    "Multifamily Ground Level Tandem Dwelling": "Multifamily",
    "Demolition Only": "",
}

# Federal poverty threshold, two adults and two children.
POVERTY_THRESHOLDS = {
    2021: 21811,
    2020: 20244,
    2019: 20578,
    2018: 19642,
    2017: 19740,
    2016: 19318,
    2015: 19078,
    2014: 19055,
    2013: 18751,
    2012: 18480,
    2011: 18106,
    2010: 17552,
}


def _values(spark: SparkSession, rows: list[tuple], columns: str) -> DataFrame:
    """Literal rows. Unlike a parallelised list, Spark knows their size and broadcasts them."""
    literals = ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in r) + ")" for r in rows)
    return spark.sql(f"SELECT * FROM VALUES {literals} AS t({columns})")


def permit_types(spark: SparkSession) -> DataFrame:
    return _values(spark, list(PERMIT_TYPES.items()), "DWELTYPE, tr_type")


def poverty_thresholds(spark: SparkSession, year_shift: int = 0) -> DataFrame:
    """Threshold by year; ``year_shift`` moves the series for data of other years."""
    rows = [(year + year_shift, amount) for year, amount in POVERTY_THRESHOLDS.items()]
    return _values(spark, rows, "year, threshold")
