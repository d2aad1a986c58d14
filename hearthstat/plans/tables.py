"""Summary tables. Each returns one small published table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import classify as C
from ..functions import semantics as S
from ..operators.joins import natural_join
from ..operators import sketches as K
from ..operators.quantiles import grouped_median, grouped_quantile
from ..operators.series import (
    arrange,
    columns_between,
    columns_containing,
    index_to_base,
    longer,
    stack_rows,
    wider,
)
from .conform import PERMIT_CLASSES

# Fixed value: name of the renters' series.
MEDIAN_RENT = "Median annual rental costs"

# ---------------------------------------------------------------- households


def household_count(households: DataFrame, year: int = 2020) -> DataFrame:
    """Weighted number of households in a year, to hold against the census."""
    return households.filter(F.col("year") == year).agg(S.sum_of("HHWT").alias("n"))


def _indexed_estimates(by_year: DataFrame, series: dict[str, tuple[Column, Column]], order: list[str]) -> DataFrame:
    """A row for each year and series (value, and whether the year has it), rents first, each indexed to its first year.

    All series are taken from a year's row at once, so the table under it is computed once.
    """
    rows = F.array(
        *[
            F.when(has, F.struct(F.lit(name).alias("estimate"), value.cast("double").alias("value")))
            for name, (value, has) in series.items()
        ]
    )
    stacked = by_year.select("year", F.inline(F.filter(rows, lambda r: r.isNotNull())))
    indexed = index_to_base(stacked, {"value2": "value"}, ["estimate"])
    return arrange(indexed, F.col("estimate") != MEDIAN_RENT, "year", C.rank_of("estimate", order))


def market_index(households: DataFrame, min_year: int = 2010) -> DataFrame:
    """Households, median income and median rent by year, indexed. Medians are unweighted.

    Conformed households always have a cost and an income, so the NULLs left
    out of the rent median are the owners; both medians and the count share one pass.
    """
    recent = households.filter(F.col("year") >= min_year)
    medians = grouped_median(
        recent.withColumn("rent", F.when(F.col("ownership") == "Rent", F.col("housing_cost"))),
        ["year"],
        {"rent": "rent", "HH Income": "hh_income"},
        na_rm=True,
        totals={"Households": F.col("HHWT")},
    )
    always = F.lit(True)
    series = {
        MEDIAN_RENT: (F.col("rent"), F.col("rent").isNotNull()),
        "Households": (F.col("Households"), always),
        "HH Income": (F.col("HH Income"), always),
    }
    return _indexed_estimates(medians, series, ["Households", "HH Income"])


def near_poverty(
    households: DataFrame, poverty: DataFrame, factor: float = 1.5, min_year: int = 2010
) -> DataFrame:
    """Households and those with income below ``factor`` times the poverty threshold, indexed."""
    poor = f"Households with income < {factor:g} times poverty threshold"
    recent = households.filter(F.col("year") >= min_year)
    # The threshold table is a dozen literal rows, which Spark broadcasts by itself.
    with_line = natural_join(recent, poverty, "left", on=["year"])
    lined = F.col("threshold").isNotNull()
    is_poor = lined & (F.col("hh_income") < F.col("threshold") * factor)
    by_year = grouped_median(
        with_line.withColumn("rent", F.when(F.col("ownership") == "Rent", F.col("housing_cost"))),
        ["year"],
        {"rent": "rent"},
        na_rm=True,
        totals={
            "Households": F.col("HHWT"),
            "poor": F.when(is_poor, F.col("HHWT")).otherwise(0),
            "lined": lined.cast("int"),
        },
    )
    known = F.coalesce(F.col("lined") > 0, F.lit(False))
    series = {
        MEDIAN_RENT: (F.col("rent"), F.col("rent").isNotNull()),
        "Households": (F.col("Households"), known),
        poor: (F.col("poor"), known),
    }
    return _indexed_estimates(by_year, series, ["Households", poor])


def tenure_medians(households: DataFrame, max_share: float = 0.8, weight: str = "HHWT") -> DataFrame:
    """Weighted median income and cost by tenure and year, indexed, in long form."""
    medians = grouped_quantile(
        households.filter(F.col("housing_share") < max_share),
        ["year", "ownership"],
        {"median_hh_income": "hh_income", "median_housing_cost": "housing_cost"},
        p=0.5,
        weight=weight,
        na_rm=True,
    )
    names = {
        "Median HH Income Index": "median_hh_income",
        "Median Housing Cost Index": "median_housing_cost",
    }
    indexed = index_to_base(medians, names, ["ownership"])
    return arrange(longer(indexed, list(names), "statistic"), "ownership", "year", "statistic")


def sample_sizes(
    households: DataFrame, year: int = 2020, max_cost: float = 50000, codes: tuple[int, ...] = (1, 2)
) -> DataFrame:
    """Sample households by building size, one column per tenure code."""
    kept = households.filter((F.col("housing_cost") < max_cost) & (F.col("year") == year))
    table = wider(kept, ["building_size"], "OWNERSHP", list(codes), S.n_rows())
    return table.withColumnsRenamed({str(c): f"ownershp_{c}" for c in codes})


def renters_by_size(households: DataFrame, base_year: int | None = None) -> DataFrame:
    """Renter households by building size and year, indexed to the first (or a given) year."""
    counts = (
        households.filter(F.col("ownership") == "Rent")
        .groupBy("building_size", "year")
        .agg(S.sum_of("HHWT").alias("households"))
    )
    indexed = index_to_base(
        counts, {"household_index": "households"}, ["building_size"], base=base_year
    )
    return arrange(indexed, "year", C.rank_of("building_size", C.BUILDING_SIZES))


def renters_by_year(renters: DataFrame) -> DataFrame:
    """Yearly total of the table above."""
    return renters.groupBy("year").agg(S.sum_of("households").alias("renters"))


def year_filter(df: DataFrame, years: tuple[int, ...] = (2010, 2020)) -> DataFrame:
    return df.filter(F.col("year").isin(*years))


# ------------------------------------------------------------------- permits


def permits_by_size(permits: DataFrame) -> DataFrame:
    """Units removed, added and net, permits and sites by building size and year."""
    return (
        permits.filter(F.col("permit_class").isin(PERMIT_CLASSES))
        .groupBy("building_size", "year")
        .agg(
            S.sum_of("demolished", na_rm=True).alias("units_removed"),
            S.sum_of("added", na_rm=True).alias("units_added"),
            S.sum_of("net_units", na_rm=True).alias("net_units"),
            S.n_distinct("record_number").alias("permits"),
            S.n_distinct("site_id").alias("sites"),
        )
    )


def net_units(by_size_year: DataFrame, below: int = 10000) -> DataFrame:
    """Net unit series without outliers."""
    return by_size_year.filter(F.col("net_units") < below).select("building_size", "year", "net_units")


def gross_change(by_size_year: DataFrame) -> DataFrame:
    """Units added and demolished by building size over all years."""
    gross = by_size_year.withColumnsRenamed(
        {"units_added": "Gross dwelling units added", "units_removed": "Gross dwelling units removed"}
    )
    columns = columns_containing(gross, "Gross")
    names = {"Gross dwelling units added": "Additions", "Gross dwelling units removed": "Demolitions"}
    return (
        longer(gross.select("building_size", *columns), columns, "change")
        .replace(names, subset=["change"])
        .groupBy("building_size", "change")
        .agg(S.sum_of("value", na_rm=True).alias("gross_change"))
    )


# ----------------------------------------------------------------- ownership


def ownership_index(records: DataFrame, base_year: int | None = None) -> DataFrame:
    """Owners and units by owner type and year, indexed to the first (or a given) year."""
    counts = (
        records.filter(
            F.col("owner_type").isNotNull() & (F.col("owner_type") != C.OTHER) & F.col("year").isNotNull()
        )
        .groupBy("year", "owner_type")
        .agg(S.n_rows().alias("owners"), S.sum_of("units", na_rm=True).alias("units"))
    )
    indexes = {"unit_index": "units", "owner_index": "owners"}
    return arrange(index_to_base(counts, indexes, ["owner_type"], base=base_year), "year", "owner_type")


def owner_base_years(table: DataFrame, years: tuple[int, ...] = (2015, 2021)) -> DataFrame:
    """Owners and units by owner type in two years, the year as text."""
    return (
        table.filter(F.col("year").isin(*years))
        .select(*columns_between(table, "year", "units"))
        .withColumn("year", F.col("year").cast("string"))
    )


def unit_check(ownership: DataFrame, renters: DataFrame, year: int = 2020) -> DataFrame:
    """Units in the ownership records beside renter households, for one year."""
    owned = ownership.filter(F.col("year") == year).agg(S.sum_of("units").alias("n"))
    rented = renters.filter(F.col("year") == year).agg(S.sum_of("households").alias("n"))
    return owned.select(F.lit("Ownership records").alias("source"), F.col("n").alias("units")).unionByName(
        rented.select(F.lit("Renter households").alias("source"), F.col("n").alias("units"))
    )


def owners_by_type(rental: DataFrame) -> DataFrame:
    return rental.groupBy("owner_type").agg(S.n_distinct("owner_names").alias("owners"))


def owners_by_type_property(rental: DataFrame) -> DataFrame:
    return rental.groupBy("owner_type", "property_type").agg(S.n_distinct("owner_names").alias("owners"))


def null_owner_audit(rental: DataFrame) -> DataFrame:
    """Rows whose owner fits no type, with the inputs of the classification."""
    return rental.filter(F.col("owner_type").isNull()).select(
        "owner_type", "is_company", "portfolio_parcels", "portfolio_buildings", "portfolio_units"
    )


# --------------------------------------------------------------------- rents


def listing_coverage(rentals: DataFrame, roll: DataFrame) -> DataFrame:
    """Share of roll rows with a listing, and listings, by property type.

    Defined on the row-level join of roll and listings, where a parcel counts
    once per pair. Listings without a roll row have no property type and drop
    out. Both sides are combined per parcel first, so no pairs are formed.
    """
    listed = rentals.groupBy("parcel_num").agg(
        S.n_rows().alias("__rows"), F.sum("n_listings").alias("__listings")
    )
    parcels = (
        roll.filter(F.col("property_type").isNotNull())
        .groupBy("parcel_num", "property_type")
        .agg(S.n_rows().alias("__repeats"))
    )
    rows = natural_join(parcels, listed, "left").select(
        "property_type",
        (F.col("__repeats") * F.coalesce("__rows", F.lit(1))).alias("pairs"),
        (F.col("__repeats") * F.coalesce("__rows", F.lit(0))).alias("covered"),
        (F.col("__repeats") * F.coalesce("__listings", F.lit(0))).alias("listings"),
    )
    return rows.groupBy("property_type").agg(
        F.try_divide(F.sum("covered").cast("double"), F.sum("pairs").cast("double")).alias("coverage"),
        F.sum("listings").alias("listings"),
    )


def rent_by_size(
    households: DataFrame,
    rental: DataFrame,
    split_year: int = 2021,
    max_share: float = 0.8,
    sources: tuple[str, str] = ("US Census IPUMS", "Rental listings"),
) -> DataFrame:
    """Mean rent by building size and year: survey households, then listings from ``split_year``."""
    survey = (
        households.filter((F.col("ownership") == "Rent") & (F.col("housing_share") < max_share))
        .groupBy("building_size", "year")
        .agg(S.weighted_mean("housing_cost", "HHWT").alias("housing_cost"))
        .withColumn("data_source", F.lit(sources[0]))
    )
    listed = (
        rental.filter((F.col("year") >= split_year) & F.col("building_size").isNotNull())
        .groupBy("building_size", "year")
        .agg(S.mean_of("annual_rent", na_rm=True).alias("housing_cost"))
        .withColumn("data_source", F.lit(sources[1]))
    )
    return stack_rows(listed, survey)


def median_rent_by(rental: DataFrame, key: str) -> DataFrame:
    """Median annual rent by ``key`` and bedrooms, one to three bedrooms."""
    # The group filter comes first: it is on the keys, so the medians are the same.
    kept = rental.filter(F.col("bedrooms").isin("1 BR", "2 BR", "3 BR") & F.col(key).isNotNull())
    return grouped_median(kept, [key, "bedrooms"], {"median_rent": "annual_rent"})


def frequency(rental: DataFrame) -> DataFrame:
    """Mean rent and size, listings, units and parcels by property type and bedrooms."""
    return rental.groupBy("property_type", "bedrooms").agg(
        S.mean_of("annual_rent").alias("mean_rent"),
        S.mean_of("square_feet", na_rm=True).alias("mean_sqft"),
        S.sum_of("listing_count").alias("listings"),
        S.sum_of("unit_count").alias("units"),
        S.n_distinct("parcel_num").alias("parcels"),
    )


def rental_sketches(rental: DataFrame, by: list[str]) -> DataFrame:
    """Sketches by year and ``by`` for later tables: rents, parcels, and parcels with their owners."""
    return K.sketches(
        rental, ["year", *by], {"rents": "annual_rent"},
        {"parcels": ["parcel_num"], "owners": ["owner_names"]},
    )


def rent_from_sketches(rental: DataFrame) -> DataFrame:
    """Rents by bedrooms from yearly sketches, held against the exact ranks.

    ``within_error`` says whether the merged sketch's median has a rank within its stated
    error: the share of rents below it is at most a half plus that, of those up to it at
    least a half less that.
    """
    stored = rental_sketches(rental, ["bedrooms"])
    medians = K.merged(stored, ["bedrooms"], ["rents"]).select("bedrooms", K.quantile_of("rents").alias("__median"))
    placed = natural_join(rental.select("bedrooms", "annual_rent"), medians, "left")
    return (
        placed.groupBy("bedrooms")
        .agg(
            S.n_rows().alias("records"),
            F.avg((F.col("annual_rent") < F.col("__median")).cast("double")).alias("__below"),
            F.avg((F.col("annual_rent") <= F.col("__median")).cast("double")).alias("__upto"),
        )
        .select(
            "bedrooms",
            "records",
            ((F.col("__below") <= 0.5 + K.rank_error()) & (F.col("__upto") >= 0.5 - K.rank_error())).alias("within_error"),
        )
    )


def parcels_from_sketches(rental: DataFrame) -> DataFrame:
    """Distinct parcels by property type from yearly sketches, held against the exact count.

    ``within_error`` says whether the union of the years' sketches is within four standard errors.
    """
    stored = rental_sketches(rental, ["property_type"])
    union = K.merged(stored, ["property_type"], distinct=["parcels"])
    exact = rental.groupBy("property_type").agg(S.n_distinct("parcel_num").alias("parcels"))
    return natural_join(exact, union.select("property_type", K.distinct_of("parcels").alias("__estimate"))).select(
        "property_type",
        "parcels",
        (F.abs(F.col("__estimate") - F.col("parcels")) <= 4 * K.distinct_error() * F.col("parcels")).alias("within_error"),
    )


def rent_by_portfolio(rental: DataFrame) -> DataFrame:
    """Mean rent, listings, units and parcels by the number of parcels owned."""
    return rental.groupBy(C.portfolio_bucket("portfolio_parcels").alias("portfolio")).agg(
        S.mean_of("annual_rent").alias("mean_rent"),
        S.sum_of("listing_count").alias("listings"),
        S.sum_of("unit_count").alias("units"),
        S.n_distinct("parcel_num").alias("parcels"),
    )


# ------------------------------------------------------------------ registry


def registry_compliance(reconciled: DataFrame, strict_count: bool = False) -> DataFrame:
    """Registered and listed parcels and units, and the gap, in one pass."""
    registered = F.col("registered_units")
    listed_only = reconciled.agg(
        S.n_distinct("parcel_num", strict_count).alias("parcels"),
        S.n_distinct("record_id", strict_count).alias("registered_parcels"),
        S.sum_of("listed_units", na_rm=True).alias("listed_units"),
        S.sum_of("registered_units", na_rm=True).alias("registered_units"),
        F.sum(F.when(registered.isNull(), F.col("listed_units"))).alias("__sum"),
        F.max(registered.isNull() & F.col("listed_units").isNull()).alias("__unknown"),
    )
    return listed_only.select(
        F.when(~F.coalesce("__unknown", F.lit(False)), F.coalesce("__sum", F.lit(0))).alias(
            "unregistered_units"
        ),
        "parcels",
        "registered_parcels",
        "listed_units",
        "registered_units",
        (F.col("parcels") - F.col("registered_parcels")).alias("unregistered_parcels"),
    )


def roll_flows(before: DataFrame, after: DataFrame) -> DataFrame:
    """Units entering, leaving and staying between two rolls, by size and property type.

    A parcel is matched within its size and type; one that changes class leaves
    the old and enters the new. The rolls are stacked and combined by key, which
    needs one shuffle with map-side combine where a full join needs two sorts.
    """
    keys = ["parcel_num", "building_size", "property_type"]
    units = F.coalesce("units_count", F.lit(0))
    both = stack_rows(before.select(*keys, units.alias("u0")), after.select(*keys, units.alias("u1")))
    matched = both.groupBy(*keys).agg(F.sum("u0").alias("u0"), F.sum("u1").alias("u1"))
    return (
        matched.groupBy("building_size", "property_type")
        .agg(
            S.sum_of(F.when(F.col("u0").isNull(), F.col("u1")), na_rm=True).alias("entrance"),
            S.sum_of(F.when(F.col("u1").isNull(), F.col("u0")), na_rm=True).alias("exit"),
            S.sum_of(F.when(F.col("u0").isNotNull(), F.col("u1")), na_rm=True).alias("stable"),
        )
        .withColumn("exit_to_entrance", S.ratio("exit", "entrance"))
    )
