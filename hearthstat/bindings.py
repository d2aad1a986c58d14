"""Raw housing tables derived from the star-schema test tables.

Each function reads whole tables and gives one of the library's raw inputs in
its documented shape. Missing values and odd codes are put in on purpose. All
amounts are whole numbers, so sums and means come out the same in any order.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.semantics import packed_order
from .operators.staging import shared_dir
from .plans import conform
from .sources.readers import read_parquet
from .sources.schemas import permit_types
from .sources.writers import stage_bucketed


SCHEMAS = {
    "lineitem": (
        "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, "
        "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
        "l_linestatus string, l_shipdate timestamp_ntz"
    ),
    "orders": (
        "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, "
        "o_orderdate timestamp_ntz, o_orderpriority string"
    ),
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "part": "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_parquet(spark, f"{sf_dir}/{name}.parquet", SCHEMAS[name])


def dashed(key: str) -> str:
    """Parcel number, six digits and four, of a whole-number key."""
    return f"concat(lpad({key} div 10000, 6, '0'), '-', lpad({key} % 10000, 4, '0'))"


# ---------------------------------------------------------------- raw inputs


def raw_households(spark: SparkSession, sf_dir: str) -> DataFrame:
    mortgage = "(l_partkey * 17 + l_suppkey) % 11000"
    return table(spark, sf_dir, "lineitem").selectExpr(
        "year(l_shipdate) AS YEAR",
        "int(l_quantity) - 1 AS HHWT",
        "l_linenumber AS PERNUM",
        "if(l_linestatus = 'F', 1, 2) AS OWNERSHP",
        """CASE WHEN l_linestatus = 'F' THEN if(l_returnflag = 'N', 12, 13)
            ELSE if(l_returnflag = 'N', 21, 22) END AS OWNERSHPD""",
        """CASE WHEN l_suppkey % 50 = 49 THEN NULL WHEN l_linestatus = 'F' THEN 0D
            ELSE double((l_partkey * 13 + l_linenumber * 7) % 9000) END AS RENT""",
        f"if(l_linestatus = 'F', double({mortgage}), 0D) AS MORTAMT1",
        f"if(l_linestatus = 'F', double({mortgage} + 200), 99999D) AS OWNCOST",
        """CASE WHEN l_partkey % 211 = 0 THEN 0D WHEN l_partkey % 223 = 0 THEN -500D
            ELSE double(floor(l_extendedprice)) END AS HHINCOME""",
        "int(l_partkey % 11 + 1) AS UNITSSTR",
        "if(l_suppkey % 5 = 0, 11600, 0) AS MIGPUMA1",
    )


def raw_permits(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey", "p_type")
    added = "if(l_returnflag <> 'R', int((l_partkey * l_linenumber) % 80), NULL)"
    gone = "if(l_returnflag = 'R', l_linenumber, 0)"
    return (
        table(spark, sf_dir, "lineitem")
        .join(part, F.col("l_partkey") == F.col("p_partkey"))
        .selectExpr(
            "string(l_orderkey) AS RECORDNUMBER",
            "string(nullif(l_suppkey, 0)) AS DEVSITE_ID",
            "l_tax AS X",
            "l_discount AS Y",
            "concat('N', l_suppkey % 13) AS NEIGHBORHOOD",
            """CASE WHEN l_returnflag = 'A' THEN 'Construction Permit'
                WHEN l_returnflag = 'R' THEN 'Demolition Permit'
                WHEN l_linestatus = 'O' THEN 'Phased Project Permit'
                ELSE 'Site Preparation' END AS APTYPE""",
            """CASE p_type WHEN 'ECONOMY' THEN 'Detached Single-Family' WHEN 'SMALL' THEN 'Townhouse'
                WHEN 'LARGE' THEN 'Apartment' WHEN 'MEDIUM' THEN 'Multifamily Other'
                WHEN 'PROMO' THEN 'Congregate Housing' ELSE 'Houseboat' END AS DWELTYPE""",
            f"{gone} AS DEMO",
            f"{added} AS NEW",
            f"{added} - {gone} AS NET_UNITS",
            "nullif(year(l_shipdate), 2001) AS YEAR_FINAL",
        )
    )


MAJOR_MINOR = ["lpad(p_partkey div 10000, 6, '0') AS Major", "lpad(p_partkey % 10000, 4, '0') AS Minor"]


def raw_apartments(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").filter("p_type IN ('LARGE', 'PROMO')")
    return part.selectExpr(*MAJOR_MINOR, "p_size * 2 AS NbrUnits")


def raw_residential(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Small houses, and some apartment parcels a second time."""
    part = table(spark, sf_dir, "part").filter(
        "p_type IN ('SMALL', 'MEDIUM', 'STANDARD') OR (p_type = 'PROMO' AND p_size <= 10)"
    )
    return part.selectExpr(*MAJOR_MINOR, "p_size % 5 AS NbrLivingUnits")


def raw_condos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One to three units per parcel."""
    part = table(spark, sf_dir, "part").filter("p_type = 'ECONOMY' OR (p_type = 'MEDIUM' AND p_size <= 7)")
    return part.selectExpr(*MAJOR_MINOR, "explode(sequence(1, p_size % 3 + 1)) AS Grade")


def raw_parcels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parcel types; the parcels of one brand are missing."""
    part = table(spark, sf_dir, "part").filter("p_brand <> 'Brand#13'")
    return part.selectExpr(
        *MAJOR_MINOR,
        """CASE WHEN p_size % 25 = 0 THEN NULL WHEN p_size % 25 = 1 THEN 'K'
            WHEN p_type IN ('LARGE', 'PROMO') THEN 'C' ELSE 'R' END AS PropType""",
    )


def raw_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").filter("p_brand <> 'Brand#7'")
    return part.selectExpr(
        f"{dashed('p_partkey')} AS parcel_num",
        "nullif(p_size % 9 + 1, 9) AS nbr_bldgs",
        "nullif(p_size, 49) AS units_count",
        "p_type AS prop_type",
        "if(p_size <> 50, concat('53033', lpad(p_size % 40, 4, '0')), NULL) AS geo_id",
        """CASE p_size WHEN 13 THEN 'unknown' WHEN 14 THEN NULL
            ELSE string(p_partkey % 120 + 1900) END AS year_built""",
    )


def raw_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An owner per parcel, and a co-owner for the parcels of one brand."""
    part = table(spark, sf_dir, "part")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nation = table(spark, sf_dir, "nation").select("n_nationkey")
    first = (
        part.join(customer, F.col("p_partkey") == F.col("c_custkey"), "left")
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left")
        .selectExpr(
            f"{dashed('p_partkey')} AS parcel_num",
            """if(p_partkey % 97 <> 0, concat('OWNER ', p_partkey div (p_partkey % 30 + 1)), NULL)
                AS owner_names""",
            """CASE WHEN n_nationkey < 5 THEN 'SEATTLE, WA 98101' WHEN n_nationkey < 10 THEN 'BELLEVUE, WA 98004'
                WHEN n_nationkey < 15 THEN 'SPOKANE, WA 99201'
                WHEN n_nationkey < 20 THEN 'PORTLAND, OR 97201' END AS mail_last_line""",
            """CASE WHEN n_nationkey < 10 THEN 'KING, WA' WHEN n_nationkey < 15 THEN 'SPOKANE, WA'
                WHEN n_nationkey < 20 THEN 'MULTNOMAH, OR' END AS mail_county""",
            """CASE WHEN int(substr(p_brand, 7, 2)) <= 8 THEN true
                WHEN int(substr(p_brand, 7, 2)) < 25 THEN false END AS corp_flag""",
        )
    )
    second = part.filter("p_brand = 'Brand#20'").selectExpr(
        f"{dashed('p_partkey')} AS parcel_num",
        "concat('TRUST ', p_size) AS owner_names",
        "string(NULL) AS mail_last_line",
        "'KING, WA' AS mail_county",
        "true AS corp_flag",
    )
    return first.unionByName(second)


def raw_residency(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").filter("p_type IN ('SMALL', 'STANDARD', 'LARGE') AND p_size <= 25")
    return part.selectExpr("lpad(p_partkey, 10, '0') AS parcel_num_standardized")


def raw_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings with the columns that settle the order of those on the same date."""
    kind = "(l_partkey + l_suppkey % 3)"
    return table(spark, sf_dir, "lineitem").selectExpr(
        f"if(l_quantity <> 47, {dashed('l_partkey')}, NULL) AS parcel_num",
        """if(l_linenumber = 7 AND l_returnflag = 'A' AND l_linestatus = 'F', NULL,
            date_add(date(l_shipdate), 10)) AS seen_on""",
        "if(l_linenumber = 7, NULL, date(l_shipdate)) AS listed_on",
        "if(l_linenumber = 7 AND l_returnflag = 'A', NULL, date_add(date(l_shipdate), 30)) AS removed_on",
        "if(l_quantity <> 48, double(floor(l_extendedprice / 10)), NULL) AS price_numeric",
        f"""CASE WHEN l_quantity = 46 THEN NULL WHEN l_partkey % 61 = 0 THEN 0.5D
            ELSE double({kind} % 7) END AS beds""",
        f"if(l_quantity <> 45, ({kind} % 4) * 0.5D + 1, NULL) AS baths",
        f"if(l_quantity <> 44, double(({kind} % 20) * 50 + 300), NULL) AS sqft",
        "concat('U', l_suppkey % 3) AS listing_unit_level_id",
        "l_orderkey",
        "l_linenumber",
        "l_suppkey",
        "bigint(round(l_extendedprice * 100)) AS cents",
    )


def listing_order() -> Column:
    return packed_order(
        [(F.unix_date("date"), 5), (F.col("l_orderkey"), 12), (F.col("l_linenumber"), 1)],
        [(F.col("l_suppkey"), 10), (F.col("cents"), 8)],
    )


def raw_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registrations; one market segment shares parcels in groups of ten."""
    parcel = "if(c_mktsegment = 'FURNITURE', c_custkey div 10, c_custkey)"
    return table(spark, sf_dir, "customer").selectExpr(
        "concat('REG-', c_custkey) AS RECORD_ID",
        "if(c_mktsegment = 'MACHINERY', 'Expired', 'Active Registration') AS RECORD_STATUS",
        f"if(c_nationkey <> 24, lpad({parcel}, 10, '0'), NULL) AS PARCEL_NBR",
        "if(c_nationkey = 23, 'n/a', string(c_custkey % 40)) AS Registed_Units",
    )


def raw_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(
        """CASE o_orderpriority WHEN '1-URGENT' THEN 'mom and pop' WHEN '2-HIGH' THEN 'small property manager'
            WHEN '3-MEDIUM' THEN 'midsized property manager'
            WHEN '4-NOT SPECIFIED' THEN 'large property manager' ELSE 'trust' END AS owner_type""",
        "nullif(int(o_custkey % 60), 59) AS n_units",
        "if(o_orderstatus = 'P', NULL, year(o_orderdate)) AS roll_yr",
    )


# -------------------------------------------------------------- clean tables

# The test tables end in 2001, so year limits are set for them.
RENTAL_FROM = 1997


def households(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conform.household_conform(raw_households(spark, sf_dir))


def permits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conform.permit_conform(raw_permits(spark, sf_dir), permit_types(spark))


def roll(spark: SparkSession, sf_dir: str, keep_units: bool = False) -> DataFrame:
    return conform.tax_roll(
        raw_apartments(spark, sf_dir),
        raw_residential(spark, sf_dir),
        raw_condos(spark, sf_dir),
        raw_parcels(spark, sf_dir),
        keep_units=keep_units,
    )


def roll_snapshot(spark: SparkSession, sf_dir: str, year: int) -> DataFrame:
    """Roll rows of the parcels with a listing in the year."""
    active = (
        table(spark, sf_dir, "lineitem")
        .filter(F.year("l_shipdate") == year)
        .select("l_partkey")
        .distinct()
        .selectExpr(f"{dashed('l_partkey')} AS parcel_num")
    )
    return roll(spark, sf_dir, keep_units=True).join(active, "parcel_num", "left_semi")


def owners(spark: SparkSession, sf_dir: str, precedence: str = "code") -> DataFrame:
    return conform.owner_portfolio(
        raw_owners(spark, sf_dir), raw_properties(spark, sf_dir), raw_residency(spark, sf_dir), precedence
    )


def rentals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conform.listing_dedupe(raw_listings(spark, sf_dir), listing_order())


def rental(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conform.rental_data(
        rentals(spark, sf_dir), roll(spark, sf_dir), owners(spark, sf_dir), min_year=RENTAL_FROM
    )


def _state(spark: SparkSession, sf_dir: str) -> str:
    """A name for the folder's tables as they are now: paths, sizes and times of change."""
    root = spark._jvm.org.apache.hadoop.fs.Path(sf_dir)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(root)
    state = sorted((str(f.getPath()), f.getLen(), f.getModificationTime()) for f in files)
    return hashlib.sha256(repr(state).encode()).hexdigest()[:16]


def staged_rental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rental data as the analyses read it: published once in buckets of parcels by year, then shared.

    It is staged again when a table of the folder has changed. Files lie in the shared
    folder, so every executor reads them.
    """
    name = f"rental_{_state(spark, sf_dir)}"
    if spark.catalog.tableExists(name):
        return spark.table(name).select(*conform.RENTAL_COLUMNS)
    path = f"{shared_dir(spark)}/{name}"
    return stage_bucketed(rental(spark, sf_dir), name, "parcel_num", "year", path=path, dealt=True)


def ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conform.ownership_records(raw_ownership(spark, sf_dir))


def reconciled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conform.registry_reconcile(raw_registry(spark, sf_dir), staged_rental(spark, sf_dir), after_year=1999)
