"""Raw tables to clean tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import classify as C
from ..functions import semantics as S
from ..operators.joins import by_key, natural_join, with_group_totals
from ..operators.series import stack_rows

# Permit classes that change the housing stock.
PERMIT_CLASSES = ["Construction Permit", "Demolition Permit", "Phased Project Permit"]
# Tenure detail codes of owners with and without a loan and of renters.
TENURE_DETAIL = [11, 13, 20, 22]
# The monthly payments taken for real, and the survey's code of the origin area.
RENTS, MORTGAGES = (115, 8887), (115, 10000)
ORIGIN = 11600


# ---------------------------------------------------------------- households


def _paying_households(people: DataFrame) -> DataFrame:
    """One row per household that pays either rent or a mortgage, with its cost.

    The source's year stays beside the numeric ``year``, as ``survey_year``: the two
    names would otherwise differ in case only.
    """
    rent, mortgage = S.numeric(people, "RENT"), S.numeric(people, "MORTAMT1")
    pays_one = ((rent == 0) & (mortgage != 0)) | ((rent != 0) & (mortgage == 0))
    people = people.withColumnRenamed("YEAR", "survey_year")
    kept = people.filter(
        F.col("OWNERSHPD").isin(TENURE_DETAIL)
        & (F.col("PERNUM") == 1)
        & (rent.between(*RENTS) | mortgage.between(*MORTGAGES))
        & pays_one
    )
    cost = C.own_cost("OWNCOST")
    return kept.withColumns(
        {
            "OWNCOST": cost,
            "housing_cost": (rent + cost) * 12,
            "ownership": C.tenure("OWNERSHP"),
            "year": S.numeric(people, "survey_year"),
        }
    ).withColumnRenamed("HHINCOME", "hh_income")


def household_conform(people: DataFrame) -> DataFrame:
    """Household table with building size, housing share of income and burden."""
    return (
        _paying_households(people)
        .withColumn("building_size", C.size_from_structure_code(S.numeric(people, "UNITSSTR")))
        .filter((F.col("housing_cost") > 0) & (F.col("hh_income") > 0))
        .withColumn("housing_share", F.try_divide("housing_cost", "hh_income"))
        .withColumn("burden", C.burden("housing_share"))
    )


def outmover_conform(people: DataFrame, origin: int = ORIGIN) -> DataFrame:
    """Households that moved away from the ``origin`` area."""
    return _paying_households(people.filter(F.col("MIGPUMA1") == origin))


# ------------------------------------------------------------------- permits


def permit_conform(permits: DataFrame, recode: DataFrame) -> DataFrame:
    """Permits that change the housing stock, by broad dwelling type and size."""
    return (
        natural_join(permits, recode, "inner")
        .filter(F.col("APTYPE").isin(PERMIT_CLASSES) & (F.col("tr_type") != ""))
        .select(
            F.col("RECORDNUMBER").alias("record_number"),
            F.col("DEVSITE_ID").alias("site_id"),
            F.col("X").alias("x"),
            F.col("Y").alias("y"),
            F.col("NEIGHBORHOOD").alias("neighborhood"),
            F.col("APTYPE").alias("permit_class"),
            F.col("tr_type").alias("building_type"),
            F.col("DEMO").alias("demolished"),
            F.col("NEW").alias("added"),
            F.col("NET_UNITS").alias("net_units"),
            C.size_from_units("NEW").alias("building_size"),
            F.col("YEAR_FINAL").alias("year"),
        )
    )


# ------------------------------------------------------------------ tax roll


def tax_roll(
    apartments: DataFrame,
    residential: DataFrame,
    condos: DataFrame,
    parcels: DataFrame,
    paste_missing: bool = False,
    keep_units: bool = False,
) -> DataFrame:
    """Buildings with a known property type: parcel_num, building_size, property_type, condo."""
    parcel = S.text_key("Major", "Minor", paste_missing=paste_missing).alias("parcel_num")
    buildings = stack_rows(
        apartments.select(parcel, F.col("NbrUnits").alias("units_count")),
        residential.select(parcel, F.col("NbrLivingUnits").alias("units_count")),
    )
    typed = natural_join(buildings, parcels.select(parcel, "PropType"), "inner")
    every = stack_rows(typed, condos.select(parcel, F.lit(True).alias("condo")))
    return (
        every.withColumn("property_type", C.property_type("PropType", "units_count", "condo"))
        .filter(F.col("property_type").isNotNull())
        .select(
            "parcel_num",
            C.size_from_units("units_count").alias("building_size"),
            "property_type",
            "condo",
            *(["units_count"] if keep_units else []),
        )
    )


# -------------------------------------------------------------------- owners


def owner_portfolio(
    owners: DataFrame,
    properties: DataFrame,
    residency: DataFrame,
    precedence: str = "code",
    paste_missing: bool = False,
) -> DataFrame:
    """One row per owner and parcel, with portfolio totals and the owner type.

    Both lookups are by parcel, so properties and residency are joined first and
    the owner rows, of which a parcel may have very many, move once. Owners
    without a name form one group.
    """
    occupied = residency.select(
        S.split_parcel_key("parcel_num_standardized", 10, paste_missing).alias("parcel_num"),
        F.lit(True).alias("owner_occupied"),
    )
    held = natural_join(properties, occupied, "left")
    rows = natural_join(
        owners.withColumn("owner_residence", C.owner_residence("mail_last_line", "mail_county")),
        held,
        "inner",
        reshuffle=True,
    ).withColumn("owner_occupied", F.col("owner_occupied").isNotNull())
    rows = with_group_totals(
        rows.select(
            "parcel_num", "owner_residence", "owner_occupied", "prop_type", "owner_names",
            "geo_id", "year_built", F.col("corp_flag").alias("is_company"), "nbr_bldgs", "units_count",
        ),
        key="owner_names",
        totals={
            "portfolio_parcels": S.n_rows().cast("double"),
            "portfolio_buildings": S.sum_of("nbr_bldgs").cast("double"),
            "portfolio_units": S.sum_of("units_count").cast("double"),
        },
    )
    return rows.drop("nbr_bldgs", "units_count").withColumn(
        "owner_type",
        C.owner_type(
            "portfolio_parcels", "portfolio_buildings", "portfolio_units", "is_company", precedence
        ),
    )


def ownership_records(records: DataFrame) -> DataFrame:
    """Ownership time series with display labels for the owner type."""
    return records.withColumnsRenamed({"n_units": "units", "roll_yr": "year"}).withColumn(
        "owner_type", C.owner_type_label("owner_type")
    )


# ------------------------------------------------------------------ listings


def listing_dedupe(listings: DataFrame, order_by: Column | None = None) -> DataFrame:
    """One row per parcel, year and unit: repeat listings of a unit combined.

    First and last follow ``order_by``. By default it is the listing ``date``,
    and among those of a day the price, then the other dates, so that the result
    does not depend on row order. One number (see ``packed_order``) saves the
    sort that this default takes. Prices are monthly, ``list_rent`` is annual.
    """
    by_date = F.struct("date", "price_numeric", "removed_on", "seen_on", "listed_on")
    dated = listings.withColumn("date", F.coalesce("listed_on", "removed_on", "seen_on")).withColumn(
        "year", F.year("date")
    )
    return (
        dated.filter(F.col("year").isNotNull())
        .withColumn("__order", by_date if order_by is None else order_by)
        .groupBy("parcel_num", "year", "listing_unit_level_id")
        .agg(
            S.n_rows().alias("n_listings"),
            F.max_by("listed_on", "__order").alias("seen_on"),
            F.max_by("price_numeric", "__order").alias("last_price"),
            F.min_by("price_numeric", "__order").alias("first_price"),
            S.mean_of("price_numeric", na_rm=True).alias("mean_price"),
            S.max_of("beds").alias("beds"),
            S.max_of("baths").alias("baths"),
            S.max_of("sqft").alias("sqft"),
        )
        .select(
            "parcel_num",
            "year",
            "listing_unit_level_id",
            "n_listings",
            "seen_on",
            (F.col("last_price") * 12).alias("list_rent"),
            "first_price",
            "mean_price",
            "beds",
            "baths",
            "sqft",
        )
    )


RENTAL_KEYS = [
    "parcel_num", "year", "bedrooms", "baths", "building_size", "property_type", "owner_names",
    "owner_residence", "owner_occupied", "geo_id", "year_built", "is_company", "portfolio_parcels",
    "portfolio_buildings", "portfolio_units", "owner_type",
]
RENTAL_COLUMNS = [*RENTAL_KEYS, "listing_count", "unit_count", "annual_rent", "square_feet"]
OWNER_ATTRIBUTES = [
    "owner_names", "owner_residence", "owner_occupied", "geo_id", "year_built", "is_company",
    "portfolio_parcels", "portfolio_buildings", "portfolio_units", "owner_type",
]


def rental_data(
    rentals: DataFrame,
    roll: DataFrame,
    owners: DataFrame,
    min_year: int = 2019,
    max_monthly_rent: float = 10000,
    dedupe_dims: bool = False,
) -> DataFrame:
    """Rents by parcel, year, apartment type and owner.

    A parcel with several roll or owner rows repeats each of its listings once
    per pair of them; the listing count keeps those repeats (``dedupe_dims``
    drops them). Everything is combined per parcel *before* the joins: units
    to apartment types, roll and owner rows to distinct attributes with a
    repeat count. The joins then meet a handful of rows per parcel and no
    aggregation follows. Units are distinct within parcel and year, so their
    distinct count is a row count, and repeats cancel out of the means.
    """
    kept = rentals.filter(
        (F.col("list_rent") > 0)
        & (F.col("list_rent") / 12 <= max_monthly_rent)
        & F.col("beds").isNotNull()
        & (F.col("year") >= min_year)
    )
    apartment_types = (
        kept.withColumn("bedrooms", C.bedrooms("beds"))
        .groupBy("parcel_num", "year", "bedrooms", "baths")
        .agg(
            F.sum("n_listings").alias("__listings"),
            S.n_rows().alias("unit_count"),
            F.avg("list_rent").alias("annual_rent"),
            F.avg("sqft").alias("square_feet"),
        )
    )

    def repeats(df: DataFrame, attributes: list[str], name: str) -> DataFrame:
        n = F.lit(1).cast("long") if dedupe_dims else S.n_rows()
        return df.groupBy("parcel_num", *attributes).agg(n.alias(name))

    roll_types = repeats(
        roll.filter(F.col("property_type").isNotNull()), ["building_size", "property_type"], "__roll"
    )
    holders = repeats(owners.filter(F.col("geo_id").isNotNull()), OWNER_ATTRIBUTES, "__owner")
    # Inner joins: an unmatched listing has no property type or tract and is left out anyway.
    # The parcels' attributes are joined first, so that apartment types, the largest side, move once.
    # A parcel may have very many holders, hence the fresh shuffle.
    joined = by_key(apartment_types, natural_join(holders, roll_types), "parcel_num")
    return joined.select(
        *RENTAL_KEYS,
        (F.col("__listings") * F.col("__roll") * F.col("__owner")).alias("listing_count"),
        "unit_count",
        "annual_rent",
        "square_feet",
    )


# ------------------------------------------------------------------ registry


def registry_reconcile(
    registry: DataFrame, rental: DataFrame, after_year: int = 2020, paste_missing: bool = False
) -> DataFrame:
    """Active registrations against listed parcels, both sides kept."""
    listed = (
        rental.filter(F.col("year") > after_year)
        .groupBy("parcel_num")
        .agg(S.sum_of("unit_count", na_rm=True).alias("listed_units"))
    )
    active = registry.filter(F.col("RECORD_STATUS") == "Active Registration").select(
        F.col("RECORD_ID").alias("record_id"),
        S.split_parcel_key("PARCEL_NBR", 14, paste_missing).alias("parcel_num"),
        S.numeric(registry, "Registed_Units").alias("registered_units"),
    )
    return natural_join(active, listed, "full")
