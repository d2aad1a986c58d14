"""Regressions of annual rent on owner and building attributes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import classify as C
from ..operators.regress import Factor, Fit, Poly, Term, formula_ols, group_mean_ols

BEDROOMS = Factor("bedrooms", C.BEDROOMS)
BUILDING_SIZE = Factor("building_size", C.BUILDING_SIZES)
OWNER_TYPE = Factor("owner_type", C.OWNER_TYPES)
TRACT = Factor("geo_id", absorb=True)


def complete_cases(rental: DataFrame) -> DataFrame:
    """Rental rows with all covariates; the year built is made a number."""
    return rental.dropna(subset=["bedrooms", "building_size", "baths", "year_built"]).withColumn(
        "year_built", F.col("year_built").cast("string").try_cast("int")
    )


def _curve(name: str, degree: int) -> Term:
    """A covariate, or its orthogonal polynomials from the second degree on."""
    return name if degree == 1 else Poly(name, degree)


def owner_type_means(rental: DataFrame) -> DataFrame:
    return group_mean_ols(complete_cases(rental), "annual_rent", "owner_type", levels=C.OWNER_TYPES)


def owner_type_model(rental: DataFrame, degree: int = 1) -> Fit:
    """``degree`` above 1 gives year and year built as polynomials, which the published formula only seems to."""
    return formula_ols(
        complete_cases(rental),
        "annual_rent",
        OWNER_TYPE,
        [_curve("year", degree), BEDROOMS, "baths", TRACT, BUILDING_SIZE, _curve("year_built", degree)],
    )


def residence_means(rental: DataFrame) -> DataFrame:
    return group_mean_ols(complete_cases(rental), "annual_rent", "owner_residence")


def residence_model(rental: DataFrame, degree: int = 1) -> Fit:
    return formula_ols(
        complete_cases(rental),
        "annual_rent",
        Factor("owner_residence"),
        [BEDROOMS, "baths", TRACT, BUILDING_SIZE, _curve("year_built", degree)],
    )


def occupancy_means(rental: DataFrame) -> DataFrame:
    return group_mean_ols(complete_cases(rental), "annual_rent", "owner_occupied")


def occupancy_model(rental: DataFrame, degree: int = 1) -> Fit:
    return formula_ols(
        complete_cases(rental),
        "annual_rent",
        Factor("owner_occupied"),
        [BEDROOMS, "baths", TRACT, BUILDING_SIZE, _curve("year_built", degree)],
    )


def survey_size_means(households: DataFrame, max_share: float = 0.8) -> DataFrame:
    """Survey renters by building size, unweighted."""
    renters = households.filter((F.col("ownership") == "Rent") & (F.col("housing_share") < max_share))
    return group_mean_ols(
        renters.withColumnRenamed("housing_cost", "annual_rent"), "annual_rent", "building_size",
        levels=C.BUILDING_SIZES,
    )


def listing_size_means(rental: DataFrame) -> DataFrame:
    return group_mean_ols(complete_cases(rental), "annual_rent", "building_size", levels=C.BUILDING_SIZES)


def listing_size_model(rental: DataFrame, degree: int = 1) -> Fit:
    return formula_ols(
        complete_cases(rental),
        "annual_rent",
        BUILDING_SIZE,
        [BEDROOMS, "baths", TRACT, _curve("year_built", degree)],
    )
