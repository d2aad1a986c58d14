"""Domain classifiers as CASE expressions, with their level order.

Labels are strings. ``rank_of(label, LEVELS)`` gives the position in the level
order, for sorting and for choosing a regression's reference level.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .semantics import as_col, has_text, if_else

# Labels in level order.
BUILDING_SIZES = ["Single family", "2 - 4 units", "5 - 19 units", "20 - 49 units", "50 + units"]
BEDROOMS = ["Studio", "1 BR", "2 BR", "3 BR", "4 BR", "5+ BR"]
OWNER_TYPES = [
    "Large property manager",
    "Midsized property manager",
    "Small property manager",
    "Mom-and-pop",
]
OTHER = "Other"
# Owner type spelling in the ownership records -> label.
OWNER_TYPE_SPELLINGS = {
    "mom and pop": "Mom-and-pop",
    "small property manager": "Small property manager",
    "midsized property manager": "Midsized property manager",
    "large property manager": "Large property manager",
}


def rank_of(label: Column | str, levels: list[str]) -> Column:
    """Position of a label among its levels from 0; NULL when it is none of them."""
    label = as_col(label)
    out = F.when(label == levels[0], 0)
    for i, level in enumerate(levels[1:], start=1):
        out = out.when(label == level, i)
    return out


# ------------------------------------------------------------ building, unit


def size_from_units(units: Column | str) -> Column:
    u = as_col(units)
    single, two, five, twenty, fifty = BUILDING_SIZES
    return (
        F.when(u <= 1, single)
        .when(u.between(2, 4), two)
        .when(u.between(5, 19), five)
        .when(u.between(20, 49), twenty)
        .when(u >= 50, fifty)
    )


def size_from_structure_code(code: Column | str) -> Column:
    """Census units-in-structure code (10 is the largest class) to building size."""
    u = as_col(code)
    single, two, five, twenty, fifty = BUILDING_SIZES
    return (
        F.when(u <= 4, single)
        .when(u.between(5, 6), two)
        .when(u.between(7, 8), five)
        .when(u == 9, twenty)
        .when(u == 10, fifty)
    )


def property_type(prop_type: Column | str, units: Column | str, condo: Column | str) -> Column:
    p, u, condo = as_col(prop_type), as_col(units), as_col(condo)
    return (
        F.when(p == "C", "Commercial multi-unit")
        .when((p == "R") & (u == 1), "Single-family")
        .when((p == "R") & (u > 1), "Small multi-unit")
        .when(condo, "Residential condominium")
    )


def bedrooms(beds: Column | str) -> Column:
    """Whole bedroom counts to labels; 0.5, negative or NULL match nothing."""
    b = as_col(beds)
    out = F.when(b == 0, BEDROOMS[0])
    for n in range(1, 5):
        out = out.when(b == n, BEDROOMS[n])
    return out.when(b >= 5, BEDROOMS[5])


# ------------------------------------------------------------------ household


def own_cost(c: Column | str) -> Column:
    """Owner cost with the not-applicable code 99999 read as zero."""
    c = as_col(c)
    return if_else(c == 99999, F.lit(0), c)


def tenure(code: Column | str) -> Column:
    return if_else(as_col(code) == 1, F.lit("Own"), F.lit("Rent"))


def burden(share: Column | str) -> Column:
    return if_else(as_col(share) <= 0.3, F.lit("Not burdened"), F.lit("Burdened"))


# --------------------------------------------------------------------- owners


def owner_residence(last_line: Column | str, county: Column | str) -> Column:
    """Where the tax bill goes. A missing address counts as out of state."""
    return (
        F.when(has_text(last_line, "SEATTLE"), "Seattle")
        .when(has_text(county, "KING, WA"), "Seattle suburbs")
        .when(has_text(last_line, ", WA"), "Washington state")
        .otherwise("Not in WA")
    )


def owner_type(
    parcels: Column | str,
    buildings: Column | str,
    units: Column | str,
    is_company: Column | str,
    precedence: str = "code",
    keep_other: bool = False,
) -> Column:
    """Landlord class from portfolio totals.

    The published criteria and the rules actually applied disagree where an
    owner is both midsized and large. ``precedence='code'`` tests midsized
    first (from 3 parcels); ``'report'`` tests large first (midsized from 4).
    An unclassified owner is NULL, or 'Other' with ``keep_other``.
    """
    p, b, u, company = as_col(parcels), as_col(buildings), as_col(units), as_col(is_company)
    large, midsized, small, mom_pop = OWNER_TYPES
    modest = (p <= 3) & ((b <= 6) | b.isNull()) & (u <= 10)
    is_large = (p > 20) | (u > 50)
    out = F.when(modest & ~company, mom_pop).when(modest & company, small)
    if precedence == "code":
        out = out.when(p.between(3, 20) | u.between(11, 50), midsized).when(is_large, large)
    elif precedence == "report":
        out = out.when(is_large, large).when(p.between(4, 20) | u.between(11, 50), midsized)
    else:
        raise ValueError(f"precedence must be 'code' or 'report', not {precedence!r}")
    return out.otherwise(OTHER) if keep_other else out


def owner_type_label(c: Column | str) -> Column:
    """Spelling in the ownership records to label; anything else is 'Other'."""
    c = as_col(c)
    pairs = iter(OWNER_TYPE_SPELLINGS.items())
    spelling, label = next(pairs)
    out = F.when(c == spelling, label)
    for spelling, label in pairs:
        out = out.when(c == spelling, label)
    return out.otherwise(OTHER)


def portfolio_bucket(parcels: Column | str) -> Column:
    p = as_col(parcels)
    return F.when(p.isin(1, 2, 3, 4), p.cast("int").cast("string")).when(p >= 5, "5 or more")
