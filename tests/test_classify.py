import pytest
from pyspark.sql import functions as F

from hearthstat.functions import classify as C


def column(spark, rows, schema, c):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(c).collect()]


def test_size_from_units(spark):
    units = [-1, 0, 1, 2, 4, 5, 19, 20, 49, 50, 900, None]
    one, two, five, twenty, fifty = C.BUILDING_SIZES
    expected = [one, one, one, two, two, five, five, twenty, twenty, fifty, fifty, None]
    assert column(spark, [(u,) for u in units], "u int", C.size_from_units("u")) == expected
    assert column(spark, [(1.5,)], "u double", C.size_from_units("u")) == [None]


def test_size_from_structure_code(spark):
    codes = [0, 4, 5, 6, 7, 8, 9, 10, 11, None]
    one, two, five, twenty, fifty = C.BUILDING_SIZES
    expected = [one, one, two, two, five, five, twenty, fifty, None, None]
    assert column(spark, [(u,) for u in codes], "u int", C.size_from_structure_code("u")) == expected


def test_property_type(spark):
    rows = [
        ("C", 1, None),
        ("R", 1, None),
        ("R", 2, None),
        ("R", 0, None),
        ("R", None, None),
        ("K", 3, None),
        (None, None, True),
        (None, None, None),
    ]
    assert column(spark, rows, "p string, u int, c boolean", C.property_type("p", "u", "c")) == [
        "Commercial multi-unit",
        "Single-family",
        "Small multi-unit",
        None,
        None,
        None,
        "Residential condominium",
        None,
    ]


def test_bedrooms(spark):
    beds = [0.0, 0.5, 1.0, 4.0, 5.0, 7.0, -1.0, None]
    expected = ["Studio", None, "1 BR", "4 BR", "5+ BR", "5+ BR", None, None]
    assert column(spark, [(b,) for b in beds], "b double", C.bedrooms("b")) == expected


def test_household_codes(spark):
    assert column(spark, [(99999.0,), (10.0,), (None,)], "c double", C.own_cost("c")) == [0.0, 10.0, None]
    assert column(spark, [(1,), (2,), (0,), (None,)], "c int", C.tenure("c")) == ["Own", "Rent", "Rent", None]
    assert column(spark, [(0.3,), (0.31,), (None,)], "c double", C.burden("c")) == [
        "Not burdened",
        "Burdened",
        None,
    ]


def test_owner_residence(spark):
    rows = [
        ("SEATTLE, WA 98101", "KING, WA"),
        ("SEATTLE, WA 98101", None),
        ("BELLEVUE, WA", "KING, WA"),
        (None, "KING, WA"),
        ("SPOKANE, WA", "SPOKANE, WA"),
        ("SPOKANE, WA", None),
        ("PORTLAND, OR", "MULTNOMAH, OR"),
        (None, None),
    ]
    assert column(spark, rows, "l string, c string", C.owner_residence("l", "c")) == [
        "Seattle",
        "Seattle",
        "Seattle suburbs",
        "Seattle suburbs",
        "Washington state",
        "Washington state",
        "Not in WA",
        "Not in WA",
    ]


OWNERS = [
    # parcels, buildings, units, company -> by code, by report
    ((3.0, 6.0, 10.0, False), "Mom-and-pop", "Mom-and-pop"),
    ((1.0, None, 1.0, True), "Small property manager", "Small property manager"),
    ((3.0, None, 10.0, None), "Midsized property manager", None),
    ((2.0, 1.0, 10.0, None), None, None),
    ((2.0, 7.0, 10.0, False), None, None),
    ((3.0, 10.0, 11.0, False), "Midsized property manager", "Midsized property manager"),
    ((1.0, 1.0, 11.0, True), "Midsized property manager", "Midsized property manager"),
    ((20.0, 1.0, 51.0, True), "Midsized property manager", "Large property manager"),
    ((22.0, 1.0, 49.0, False), "Midsized property manager", "Large property manager"),
    ((21.0, 1.0, 5.0, False), "Large property manager", "Large property manager"),
    ((1.0, 1.0, 51.0, False), "Large property manager", "Large property manager"),
    ((2.0, 1.0, None, False), None, None),
    ((30.0, 1.0, None, False), "Large property manager", "Large property manager"),
]


@pytest.mark.parametrize("precedence, at", [("code", 1), ("report", 2)])
def test_owner_type(spark, precedence, at):
    rows = [o[0] for o in OWNERS]
    schema = "p double, b double, u double, c boolean"
    got = column(spark, rows, schema, C.owner_type("p", "b", "u", "c", precedence))
    assert got == [o[at] for o in OWNERS]
    kept = column(spark, rows, schema, C.owner_type("p", "b", "u", "c", precedence, keep_other=True))
    assert kept == [o[at] or "Other" for o in OWNERS]


def test_owner_type_rejects_unknown_precedence(spark):
    with pytest.raises(ValueError):
        C.owner_type("p", "b", "u", "c", "alphabetical")


def test_owner_type_label(spark):
    spellings = ["mom and pop", "large property manager", "trust", None]
    assert column(spark, [(s,) for s in spellings], "s string", C.owner_type_label("s")) == [
        "Mom-and-pop",
        "Large property manager",
        "Other",
        "Other",
    ]


def test_portfolio_bucket(spark):
    n = [1.0, 4.0, 5.0, 800.0, None]
    assert column(spark, [(x,) for x in n], "n double", C.portfolio_bucket("n")) == [
        "1",
        "4",
        "5 or more",
        "5 or more",
        None,
    ]


def test_rank_follows_level_order(spark):
    labels = list(reversed(C.BEDROOMS)) + ["Loft", None]
    assert column(spark, [(x,) for x in labels], "x string", C.rank_of(F.col("x"), C.BEDROOMS)) == [
        5, 4, 3, 2, 1, 0, None, None,
    ]
