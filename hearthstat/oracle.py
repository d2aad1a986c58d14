"""The same tables written out as plain SQL, for checking against another engine.

Deliberately naive: joins are row by row, medians expand weights to rows, and
nothing is combined early. Each view names the views it needs.
"""

from __future__ import annotations

SIZES = """CASE WHEN {u} <= 1 THEN 'Single family' WHEN {u} BETWEEN 2 AND 4 THEN '2 - 4 units'
    WHEN {u} BETWEEN 5 AND 19 THEN '5 - 19 units' WHEN {u} BETWEEN 20 AND 49 THEN '20 - 49 units'
    WHEN {u} >= 50 THEN '50 + units' END"""

DIGITS = "lpad(CAST({k} AS VARCHAR), 10, '0')"
DASHED = f"substr({DIGITS}, 1, 6) || '-' || substr({DIGITS}, 7, 4)"


def _dashed(k: str) -> str:
    return DASHED.format(k=k)


# A small holding: few parcels, buildings and units.
MODEST = """(portfolio_parcels <= 3 AND (portfolio_buildings <= 6 OR portfolio_buildings IS NULL)
         AND portfolio_units <= 10)"""
SMALL_OWNERS = f"""CASE WHEN {MODEST} AND NOT is_company THEN 'Mom-and-pop'
    WHEN {MODEST} AND is_company THEN 'Small property manager'"""
LARGE_OWNERS = "WHEN portfolio_parcels > 20 OR portfolio_units > 50 THEN 'Large property manager'"
MIDSIZED = "WHEN portfolio_parcels BETWEEN {least} AND 20 OR portfolio_units BETWEEN 11 AND 50 THEN 'Midsized property manager'"
# The rules as applied and as reported, which differ in order and in one limit.
OWNER_TYPE_CODE = f"{SMALL_OWNERS} {MIDSIZED.format(least=3)} {LARGE_OWNERS} END"
OWNER_TYPE_REPORT = f"{SMALL_OWNERS} {LARGE_OWNERS} {MIDSIZED.format(least=4)} END"

OWNER_COLUMNS = """parcel_num, owner_residence, owner_occupied, prop_type, owner_names, geo_id,
    year_built, is_company, portfolio_parcels, portfolio_buildings, portfolio_units"""

def _rental(roll: str, owners: str) -> str:
    return f"""
        SELECT parcel_num, year, bedrooms, baths, building_size, property_type, owner_names, owner_residence,
            owner_occupied, geo_id, year_built, is_company, portfolio_parcels, portfolio_buildings,
            portfolio_units, owner_type, CAST(sum(n_listings) AS BIGINT) AS listing_count,
            count(DISTINCT listing_unit_level_id) + max(CASE WHEN listing_unit_level_id IS NULL THEN 1 ELSE 0 END)
                AS unit_count,
            avg(list_rent) AS annual_rent, avg(sqft) AS square_feet
        FROM (SELECT r.*, t.building_size, t.property_type, o.owner_names, o.owner_residence, o.owner_occupied, o.geo_id,
                o.year_built, o.is_company, o.portfolio_parcels, o.portfolio_buildings, o.portfolio_units, o.owner_type,
                CASE WHEN beds = 0 THEN 'Studio' WHEN beds = 1 THEN '1 BR' WHEN beds = 2 THEN '2 BR'
                    WHEN beds = 3 THEN '3 BR' WHEN beds = 4 THEN '4 BR' WHEN beds >= 5 THEN '5+ BR' END AS bedrooms
            FROM rentals r LEFT JOIN {roll} t ON r.parcel_num IS NOT DISTINCT FROM t.parcel_num
            LEFT JOIN {owners} o ON r.parcel_num IS NOT DISTINCT FROM o.parcel_num)
        WHERE list_rent > 0 AND list_rent / 12 <= 10000 AND beds IS NOT NULL AND property_type IS NOT NULL
            AND geo_id IS NOT NULL AND year >= 1997
        GROUP BY ALL"""


# name -> (views needed, body)
VIEWS: dict[str, tuple[list[str], str]] = {
    "raw_households": ([], """
        SELECT CAST(year(l_shipdate) AS INTEGER) AS "YEAR", CAST(l_quantity AS INTEGER) - 1 AS "HHWT",
            l_linenumber AS "PERNUM", CASE WHEN l_linestatus = 'F' THEN 1 ELSE 2 END AS "OWNERSHP",
            CASE WHEN l_linestatus = 'F' AND l_returnflag = 'N' THEN 12 WHEN l_linestatus = 'F' THEN 13
                WHEN l_returnflag = 'N' THEN 21 ELSE 22 END AS "OWNERSHPD",
            CASE WHEN l_suppkey % 50 = 49 THEN NULL WHEN l_linestatus = 'F' THEN CAST(0 AS DOUBLE)
                ELSE CAST((l_partkey * 13 + l_linenumber * 7) % 9000 AS DOUBLE) END AS "RENT",
            CASE WHEN l_linestatus = 'F' THEN CAST((l_partkey * 17 + l_suppkey) % 11000 AS DOUBLE)
                ELSE CAST(0 AS DOUBLE) END AS "MORTAMT1",
            CASE WHEN l_linestatus = 'F' THEN CAST((l_partkey * 17 + l_suppkey) % 11000 + 200 AS DOUBLE)
                ELSE CAST(99999 AS DOUBLE) END AS "OWNCOST",
            CASE WHEN l_partkey % 211 = 0 THEN CAST(0 AS DOUBLE) WHEN l_partkey % 223 = 0
                THEN CAST(-500 AS DOUBLE) ELSE floor(l_extendedprice) END AS "HHINCOME",
            CAST(1 + l_partkey % 11 AS INTEGER) AS "UNITSSTR",
            CASE WHEN l_suppkey % 5 = 0 THEN 11600 ELSE 0 END AS "MIGPUMA1"
        FROM lineitem"""),
    "paying": (["raw_households"], """
        SELECT "YEAR" AS survey_year, "YEAR" AS year, "HHWT", "PERNUM", "OWNERSHP", "OWNERSHPD", "RENT", "MORTAMT1",
            CASE WHEN "OWNCOST" = 99999 THEN 0 ELSE "OWNCOST" END AS "OWNCOST", "HHINCOME" AS hh_income,
            "UNITSSTR", "MIGPUMA1",
            ("RENT" + CASE WHEN "OWNCOST" = 99999 THEN 0 ELSE "OWNCOST" END) * 12 AS housing_cost,
            CASE WHEN "OWNERSHP" = 1 THEN 'Own' WHEN "OWNERSHP" <> 1 THEN 'Rent' END AS ownership
        FROM raw_households
        WHERE "OWNERSHPD" IN (11, 13, 20, 22) AND "PERNUM" = 1
            AND ("RENT" BETWEEN 115 AND 8887 OR "MORTAMT1" BETWEEN 115 AND 10000)
            AND (("RENT" = 0 AND "MORTAMT1" <> 0) OR ("RENT" <> 0 AND "MORTAMT1" = 0))"""),
    "households": (["paying"], """
        SELECT *, CASE WHEN "UNITSSTR" <= 4 THEN 'Single family'
                WHEN "UNITSSTR" BETWEEN 5 AND 6 THEN '2 - 4 units'
                WHEN "UNITSSTR" BETWEEN 7 AND 8 THEN '5 - 19 units'
                WHEN "UNITSSTR" = 9 THEN '20 - 49 units'
                WHEN "UNITSSTR" = 10 THEN '50 + units' END AS building_size,
            housing_cost / hh_income AS housing_share,
            CASE WHEN housing_cost / hh_income <= 0.3 THEN 'Not burdened' ELSE 'Burdened' END AS burden
        FROM paying WHERE housing_cost > 0 AND hh_income > 0"""),
    "recode": ([], """
        SELECT * FROM (VALUES ('Detached Single-Family', 'Single-Family'), ('Townhouse', 'Single-Family'),
            ('Apartment', 'Apartment'), ('Multifamily Other', 'Multifamily'), ('Congregate Housing', ''))
            t(dweltype, building_type)"""),
    "raw_permits": ([], """
        SELECT CAST(l_orderkey AS VARCHAR) AS record_number,
            CAST(nullif(l_suppkey, 0) AS VARCHAR) AS site_id, l_tax AS x, l_discount AS y,
            'N' || CAST(l_suppkey % 13 AS VARCHAR) AS neighborhood,
            CASE WHEN l_returnflag = 'A' THEN 'Construction Permit'
                WHEN l_returnflag = 'R' THEN 'Demolition Permit'
                WHEN l_linestatus = 'O' THEN 'Phased Project Permit' ELSE 'Site Preparation' END AS permit_class,
            CASE p_type WHEN 'ECONOMY' THEN 'Detached Single-Family' WHEN 'SMALL' THEN 'Townhouse'
                WHEN 'LARGE' THEN 'Apartment' WHEN 'MEDIUM' THEN 'Multifamily Other'
                WHEN 'PROMO' THEN 'Congregate Housing' ELSE 'Houseboat' END AS dweltype,
            CASE WHEN l_returnflag = 'R' THEN l_linenumber ELSE 0 END AS demolished,
            CASE WHEN l_returnflag <> 'R' THEN CAST((l_partkey * l_linenumber) % 80 AS INTEGER) END AS added,
            CAST(nullif(year(l_shipdate), 2001) AS INTEGER) AS year
        FROM lineitem JOIN part ON l_partkey = p_partkey"""),
    "permits": (["recode", "raw_permits"], f"""
        SELECT record_number, site_id, x, y, neighborhood, permit_class, building_type, demolished, added,
            added - demolished AS net_units, {SIZES.format(u="added")} AS building_size, year
        FROM raw_permits JOIN recode USING (dweltype)
        WHERE permit_class IN ('Construction Permit', 'Demolition Permit', 'Phased Project Permit')
            AND building_type <> ''"""),
    "buildings": ([], f"""
        SELECT {_dashed("p_partkey")} AS parcel_num, p_size * 2 AS units_count
        FROM part WHERE p_type IN ('LARGE', 'PROMO')
        UNION ALL
        SELECT {_dashed("p_partkey")}, p_size % 5
        FROM part WHERE p_type IN ('SMALL', 'MEDIUM', 'STANDARD') OR (p_type = 'PROMO' AND p_size <= 10)"""),
    "parcels": ([], f"""
        SELECT {_dashed("p_partkey")} AS parcel_num,
            CASE WHEN p_size % 25 = 0 THEN NULL WHEN p_size % 25 = 1 THEN 'K'
                WHEN p_type IN ('LARGE', 'PROMO') THEN 'C' ELSE 'R' END AS prop_code
        FROM part WHERE p_brand <> 'Brand#13'"""),
    "roll": (["buildings", "parcels"], f"""
        SELECT parcel_num, {SIZES.format(u="units_count")} AS building_size, property_type, condo, units_count
        FROM (
            SELECT parcel_num, units_count, CAST(NULL AS BOOLEAN) AS condo,
                CASE WHEN prop_code = 'C' THEN 'Commercial multi-unit'
                    WHEN prop_code = 'R' AND units_count = 1 THEN 'Single-family'
                    WHEN prop_code = 'R' AND units_count > 1 THEN 'Small multi-unit' END AS property_type
            FROM buildings JOIN parcels USING (parcel_num)
            UNION ALL
            SELECT {_dashed("p_partkey")}, NULL, TRUE, 'Residential condominium'
            FROM (SELECT p_partkey, unnest(range(1, 2 + p_size % 3)) AS copy FROM part
                  WHERE p_type = 'ECONOMY' OR (p_type = 'MEDIUM' AND p_size <= 7))
        ) WHERE property_type IS NOT NULL"""),
    "properties": ([], f"""
        SELECT {_dashed("p_partkey")} AS parcel_num, nullif(1 + p_size % 9, 9) AS nbr_bldgs,
            nullif(p_size, 49) AS units_count, p_type AS prop_type,
            CASE WHEN p_size <> 50 THEN '53033' || lpad(CAST(p_size % 40 AS VARCHAR), 4, '0') END AS geo_id,
            CASE WHEN p_size = 13 THEN 'unknown'
                WHEN p_size <> 14 THEN CAST(1900 + p_partkey % 120 AS VARCHAR) END AS year_built
        FROM part WHERE p_brand <> 'Brand#7'"""),
    "raw_owners": ([], f"""
        SELECT {_dashed("p_partkey")} AS parcel_num,
            CASE WHEN p_partkey % 97 <> 0
                THEN 'OWNER ' || CAST(p_partkey // (1 + p_partkey % 30) AS VARCHAR) END AS owner_names,
            CASE WHEN n_nationkey < 5 THEN 'SEATTLE, WA 98101' WHEN n_nationkey < 10 THEN 'BELLEVUE, WA 98004'
                WHEN n_nationkey < 15 THEN 'SPOKANE, WA 99201'
                WHEN n_nationkey < 20 THEN 'PORTLAND, OR 97201' END AS mail_last_line,
            CASE WHEN n_nationkey < 10 THEN 'KING, WA' WHEN n_nationkey < 15 THEN 'SPOKANE, WA'
                WHEN n_nationkey < 20 THEN 'MULTNOMAH, OR' END AS mail_county,
            CASE WHEN CAST(substr(p_brand, 7, 2) AS INTEGER) <= 8 THEN TRUE
                WHEN CAST(substr(p_brand, 7, 2) AS INTEGER) < 25 THEN FALSE END AS corp_flag
        FROM part LEFT JOIN customer ON p_partkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey
        UNION ALL
        SELECT {_dashed("p_partkey")}, 'TRUST ' || CAST(p_size AS VARCHAR), NULL, 'KING, WA', TRUE
        FROM part WHERE p_brand = 'Brand#20'"""),
    "residency": ([], f"""
        SELECT {_dashed("p_partkey")} AS parcel_num, TRUE AS lives_there
        FROM part WHERE p_type IN ('SMALL', 'STANDARD', 'LARGE') AND p_size <= 25"""),
    "holdings": (["raw_owners", "properties", "residency"], """
        SELECT o.parcel_num, p.prop_type, o.owner_names, p.geo_id, p.year_built, o.corp_flag AS is_company,
            p.nbr_bldgs, p.units_count, r.lives_there IS NOT NULL AS owner_occupied,
            CASE WHEN coalesce(o.mail_last_line LIKE '%SEATTLE%', FALSE) THEN 'Seattle'
                WHEN coalesce(o.mail_county LIKE '%KING, WA%', FALSE) THEN 'Seattle suburbs'
                WHEN coalesce(o.mail_last_line LIKE '%, WA%', FALSE) THEN 'Washington state'
                ELSE 'Not in WA' END AS owner_residence
        FROM raw_owners o JOIN properties p ON o.parcel_num IS NOT DISTINCT FROM p.parcel_num
        LEFT JOIN residency r ON o.parcel_num IS NOT DISTINCT FROM r.parcel_num"""),
    "portfolios": (["holdings"], """
        SELECT owner_names, CAST(count(*) AS DOUBLE) AS portfolio_parcels,
            CASE WHEN count(*) = count(nbr_bldgs) THEN CAST(sum(nbr_bldgs) AS DOUBLE) END AS portfolio_buildings,
            CASE WHEN count(*) = count(units_count) THEN CAST(sum(units_count) AS DOUBLE) END AS portfolio_units
        FROM holdings GROUP BY owner_names"""),
    "owner_rows": (["portfolios"], """
        SELECT h.*, portfolio_parcels, portfolio_buildings, portfolio_units
        FROM holdings h JOIN portfolios p ON h.owner_names IS NOT DISTINCT FROM p.owner_names"""),
    "owners": (["owner_rows"], f"SELECT {OWNER_COLUMNS}, {OWNER_TYPE_CODE} AS owner_type FROM owner_rows"),
    "owners_report": (
        ["owner_rows"],
        f"SELECT {OWNER_COLUMNS}, {OWNER_TYPE_REPORT} AS owner_type FROM owner_rows",
    ),
    "raw_listings": ([], f"""
        SELECT *, coalesce(listed_on, removed_on, seen_on) AS date FROM (
            SELECT CASE WHEN l_quantity <> 47 THEN {_dashed("l_partkey")} END AS parcel_num,
                CASE WHEN NOT (l_linenumber = 7 AND l_returnflag = 'A' AND l_linestatus = 'F')
                    THEN CAST(l_shipdate AS DATE) + 10 END AS seen_on,
                CASE WHEN l_linenumber <> 7 THEN CAST(l_shipdate AS DATE) END AS listed_on,
                CASE WHEN NOT (l_linenumber = 7 AND l_returnflag = 'A')
                    THEN CAST(l_shipdate AS DATE) + 30 END AS removed_on,
                CASE WHEN l_quantity <> 48 THEN floor(l_extendedprice / 10) END AS price,
                CASE WHEN l_quantity = 46 THEN NULL WHEN l_partkey % 61 = 0 THEN CAST(0.5 AS DOUBLE)
                    ELSE CAST((l_partkey + l_suppkey % 3) % 7 AS DOUBLE) END AS beds,
                CASE WHEN l_quantity <> 45
                    THEN 1 + CAST(0.5 AS DOUBLE) * ((l_partkey + l_suppkey % 3) % 4) END AS baths,
                CASE WHEN l_quantity <> 44
                    THEN CAST(300 + 50 * ((l_partkey + l_suppkey % 3) % 20) AS DOUBLE) END AS sqft,
                'U' || CAST(l_suppkey % 3 AS VARCHAR) AS listing_unit_level_id,
                l_orderkey, l_linenumber, l_suppkey, l_extendedprice
            FROM lineitem)"""),
    "ranked": (["raw_listings"], """
        SELECT *, CAST(year(date) AS INTEGER) AS year,
            row_number() OVER (PARTITION BY parcel_num, year(date), listing_unit_level_id
                ORDER BY date, l_orderkey, l_linenumber, l_suppkey, l_extendedprice) AS nth,
            row_number() OVER (PARTITION BY parcel_num, year(date), listing_unit_level_id
                ORDER BY date DESC, l_orderkey DESC, l_linenumber DESC, l_suppkey DESC,
                    l_extendedprice DESC) AS nth_last
        FROM raw_listings WHERE date IS NOT NULL"""),
    "rentals": (["ranked"], """
        SELECT parcel_num, year, listing_unit_level_id, count(*) AS n_listings,
            max(CASE WHEN nth_last = 1 THEN listed_on END) AS seen_on,
            max(CASE WHEN nth_last = 1 THEN price END) * 12 AS list_rent,
            max(CASE WHEN nth = 1 THEN price END) AS first_price, avg(price) AS mean_price,
            CASE WHEN count(*) = count(beds) THEN max(beds) END AS beds,
            CASE WHEN count(*) = count(baths) THEN max(baths) END AS baths,
            CASE WHEN count(*) = count(sqft) THEN max(sqft) END AS sqft
        FROM ranked GROUP BY parcel_num, year, listing_unit_level_id"""),
    "rental": (["rentals", "roll", "owners"], _rental("roll", "owners")),
    "rental_deduped": (["rentals", "roll", "owners"], _rental(
        "(SELECT DISTINCT parcel_num, building_size, property_type FROM roll)",
        "(SELECT DISTINCT * EXCLUDE (prop_type) FROM owners)",
    )),
    "complete": (["rental"], """
        SELECT * FROM rental WHERE bedrooms IS NOT NULL AND building_size IS NOT NULL
            AND baths IS NOT NULL AND year_built IS NOT NULL"""),
    "reconciled": (["rental"], f"""
        SELECT r.record_id, coalesce(r.parcel_num, a.parcel_num) AS parcel_num, r.registered_units, a.listed_units
        FROM (
            SELECT 'REG-' || CAST(c_custkey AS VARCHAR) AS record_id,
                CASE WHEN c_nationkey <> 24 THEN CASE WHEN c_mktsegment = 'FURNITURE'
                    THEN {_dashed("c_custkey // 10")} ELSE {_dashed("c_custkey")} END END AS parcel_num,
                CASE WHEN c_nationkey <> 23 THEN CAST(c_custkey % 40 AS DOUBLE) END AS registered_units
            FROM customer WHERE c_mktsegment <> 'MACHINERY') r
        FULL JOIN (
            SELECT parcel_num, CAST(sum(unit_count) AS BIGINT) AS listed_units FROM rental
            WHERE year > 1999 GROUP BY parcel_num) a ON r.parcel_num IS NOT DISTINCT FROM a.parcel_num"""),
    "ownership": ([], """
        SELECT CASE o_orderpriority WHEN '1-URGENT' THEN 'Mom-and-pop' WHEN '2-HIGH' THEN 'Small property manager'
                WHEN '3-MEDIUM' THEN 'Midsized property manager'
                WHEN '4-NOT SPECIFIED' THEN 'Large property manager' ELSE 'Other' END AS owner_type,
            CAST(nullif(o_custkey % 60, 59) AS INTEGER) AS units,
            CASE WHEN o_orderstatus <> 'P' THEN CAST(year(o_orderdate) AS INTEGER) END AS year
        FROM orders"""),
    "renters_by_size": (["households"], """
        SELECT building_size, year, households, CAST(households AS DOUBLE)
            / first_value(households) OVER (PARTITION BY building_size ORDER BY year) * 100 AS household_index
        FROM (SELECT building_size, year, CAST(sum("HHWT") AS BIGINT) AS households FROM households
            WHERE ownership = 'Rent' GROUP BY building_size, year)"""),
    "permits_by_size": (["permits"], """
        SELECT building_size, year, CAST(coalesce(sum(demolished), 0) AS BIGINT) AS units_removed,
            CAST(coalesce(sum(added), 0) AS BIGINT) AS units_added,
            CAST(coalesce(sum(net_units), 0) AS BIGINT) AS net_units,
            count(DISTINCT record_number) + max(CASE WHEN record_number IS NULL THEN 1 ELSE 0 END) AS permits,
            count(DISTINCT site_id) + max(CASE WHEN site_id IS NULL THEN 1 ELSE 0 END) AS sites
        FROM permits GROUP BY building_size, year"""),
    "ownership_index": (["ownership"], """
        SELECT year, owner_type, owners, units,
            CAST(units AS DOUBLE) / first_value(units) OVER w * 100 AS unit_index,
            CAST(owners AS DOUBLE) / first_value(owners) OVER w * 100 AS owner_index
        FROM (SELECT year, owner_type, count(*) AS owners, CAST(coalesce(sum(units), 0) AS BIGINT) AS units
            FROM ownership WHERE owner_type <> 'Other' AND year IS NOT NULL GROUP BY year, owner_type)
        WINDOW w AS (PARTITION BY owner_type ORDER BY year)"""),
    "renter_rents": (["households"], """
        SELECT year, median(housing_cost) AS value, 'Median annual rental costs' AS estimate
        FROM households WHERE ownership = 'Rent' AND year >= 1996 GROUP BY year"""),
    "poverty": ([], """
        SELECT * FROM (VALUES (2006, 21811), (2005, 20244), (2004, 20578), (2003, 19642), (2002, 19740),
            (2001, 19318), (2000, 19078), (1999, 19055), (1998, 18751), (1997, 18480), (1996, 18106),
            (1995, 17552)) t(year, threshold)"""),
    "snapshots": (["roll"], f"""
        SELECT r.*, y.year FROM roll r JOIN (
            SELECT DISTINCT {_dashed("l_partkey")} AS parcel_num, year(l_shipdate) AS year FROM lineitem
            WHERE year(l_shipdate) IN (1996, 2000)) y USING (parcel_num)"""),
}


def with_views(body: str, *needed: str) -> str:
    """``body`` after a WITH clause of the views it needs, in dependency order."""
    order: list[str] = []

    def visit(name: str) -> None:
        for dep in VIEWS[name][0]:
            visit(dep)
        if name not in order:
            order.append(name)

    for name in needed:
        visit(name)
    views = ",\n".join(f"{n} AS MATERIALIZED ({VIEWS[n][1]})" for n in order)
    return f"WITH {views}\n{body}" if views else body


INDEXED = """SELECT year, CAST(value AS DOUBLE) AS value, estimate,
    CAST(value AS DOUBLE) / first_value(value) OVER (PARTITION BY estimate ORDER BY year) * 100 AS value2
    FROM ({rows})"""

LEVELS = {
    "owner_type": ["Large property manager", "Midsized property manager", "Small property manager", "Mom-and-pop"],
    "bedrooms": ["Studio", "1 BR", "2 BR", "3 BR", "4 BR", "5+ BR"],
    "building_size": ["Single family", "2 - 4 units", "5 - 19 units", "20 - 49 units", "50 + units"],
}


def _model(first: str, terms: list[str]) -> str:
    """A regression by the sweep operator: one recursion step for each column of the cross-product."""
    numbers = [t for t in terms if t in ("year", "baths", "year_built")]
    every = [first, *terms]
    factors = [t for t in every if t not in numbers]
    lists = {t: "[" + ", ".join(f"'{v}'" for v in LEVELS[t]) + "]" for t in factors if t in LEVELS}
    number = lambda t: f"TRY_CAST({t} AS DOUBLE)"
    kept = [f"{t} IS NOT NULL" for t in ["annual_rent", *factors]] + [f"{number(t)} IS NOT NULL" for t in numbers]
    kept += [f"{t} IN {v}" for t, v in lists.items()]
    rank = " ".join(f"WHEN {every.index(t)} THEN list_position({v}, v)" for t, v in lists.items())
    rank = f"CASE t {rank} END, " if rank else ""
    named = "CASE t " + " ".join(f"WHEN {every.index(t)} THEN '{t}'" for t in factors) + " END"
    return f""",
        c AS MATERIALIZED (SELECT row_number() OVER () AS rid, CAST(annual_rent AS DOUBLE) AS y,
            {", ".join([f"CAST({t} AS VARCHAR) AS {t}" for t in factors] + [f"{number(t)} AS {t}" for t in numbers])}
            FROM complete WHERE {" AND ".join(kept)}),
        f AS ({" UNION ALL ".join(f"SELECT rid, {every.index(t)} AS t, {t} AS v FROM c" for t in factors)}),
        levels AS (SELECT t, v, row_number() OVER (PARTITION BY t ORDER BY {rank}v) AS o
            FROM (SELECT DISTINCT t, v FROM f)),
        cols AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY t, o) AS k FROM (
            SELECT t, o, v, {named} || ':' || v AS term, NULL AS mean FROM levels WHERE t = 0 OR o > 1
            UNION ALL {" UNION ALL ".join(f"SELECT {every.index(t)}, 1, NULL, '{t}', (SELECT avg({t}) FROM c)" for t in numbers)})),
        x AS MATERIALIZED (
            SELECT rid, k, CAST(1 AS DOUBLE) AS val FROM f JOIN cols ON f.t = cols.t AND f.v = cols.v
            UNION ALL {" UNION ALL ".join(f"SELECT rid, k, {t} - mean FROM c, cols WHERE term = '{t}'" for t in numbers)}
            UNION ALL SELECT rid, (SELECT max(k) + 1 FROM cols), y - (SELECT avg(y) FROM c) FROM c),
        products AS (SELECT a.k AS i, b.k AS j, sum(a.val * b.val) AS v FROM x a JOIN x b USING (rid) GROUP BY 1, 2),
        places AS (SELECT unnest(range(1, (SELECT max(k) + 2 FROM cols))) AS k),
        gram AS (SELECT a.k AS i, b.k AS j, coalesce(v, 0) AS v FROM places a CROSS JOIN places b
            LEFT JOIN products ON i = a.k AND j = b.k),
        sweep AS (
            SELECT CAST(0 AS BIGINT) AS step, i, j, v, max(CASE WHEN i = j THEN v END) OVER (PARTITION BY i) AS size
            FROM gram
            UNION ALL
            SELECT p, i, j, CASE WHEN d <= 1e-10 * least THEN v WHEN i = p AND j = p THEN -1 / d
                WHEN i = p OR j = p THEN v / d ELSE v - ci * rj / d END, size
            FROM (SELECT *, step + 1 AS p, max(CASE WHEN i = step + 1 AND j = step + 1 THEN v END) OVER () AS d,
                    max(CASE WHEN i = step + 1 AND j = step + 1 THEN size END) OVER () AS least,
                    max(CASE WHEN j = step + 1 THEN v END) OVER (PARTITION BY i) AS ci,
                    max(CASE WHEN i = step + 1 THEN v END) OVER (PARTITION BY j) AS rj
                FROM sweep WHERE step < (SELECT max(k) FROM cols))),
        done AS MATERIALIZED (SELECT i, j, v FROM sweep WHERE step = (SELECT max(k) FROM cols)),
        found AS MATERIALIZED (SELECT k, t, term, mean, b.v AS beta FROM cols
            JOIN done a ON a.i = k AND a.j = k AND a.v < 0 JOIN done b ON b.i = k AND b.j = (SELECT max(k) + 1 FROM cols)),
        fit AS (SELECT (SELECT count(*) FROM c) AS n, v / ((SELECT count(*) FROM c) - (SELECT count(*) FROM found)) AS s2
            FROM done WHERE i = j AND i = (SELECT max(k) + 1 FROM cols)),
        parts AS (SELECT k, k AS a, CAST(1 AS DOUBLE) AS w FROM found
            UNION ALL SELECT f.k, g.k, -g.mean FROM found f, found g WHERE f.t = 0 AND g.mean IS NOT NULL),
        est AS (SELECT p.k, sum(p.w * g.beta) AS b FROM parts p JOIN found g ON g.k = p.a GROUP BY 1),
        spread AS (SELECT p.k, sum(-p.w * q.w * d.v) AS v FROM parts p JOIN parts q ON p.k = q.k
            JOIN done d ON d.i = p.a AND d.j = q.a GROUP BY 1),
        result AS (SELECT term, b + CASE WHEN t = 0 THEN (SELECT avg(y) FROM c) ELSE 0 END AS estimate,
                sqrt(spread.v * s2) AS std_error, n
            FROM found JOIN est ON est.k = found.k JOIN spread ON spread.k = found.k CROSS JOIN fit)
        SELECT term, round(estimate, 2) AS estimate, round(std_error, 2) AS std_error,
            round(estimate - 1.959963984540054 * std_error, 2) AS ci_low,
            round(estimate + 1.959963984540054 * std_error, 2) AS ci_high, n FROM result"""


def _fitted(first: str, terms: list[str]) -> str:
    return with_views(_model(first, terms), "complete").replace("WITH ", "WITH RECURSIVE ", 1)


def _means(source: str, factor: str, y: str = "annual_rent", where: str = "TRUE") -> str:
    return f"""SELECT term, round(estimate, 4) AS estimate, round(sqrt(s2 / n), 4) AS std_error,
            round(estimate - 1.959963984540054 * sqrt(s2 / n), 4) AS ci_low,
            round(estimate + 1.959963984540054 * sqrt(s2 / n), 4) AS ci_high, n
        FROM (SELECT *, sum(ss) OVER () / (sum(n) OVER () - count(*) OVER ()) AS s2 FROM (
            SELECT CAST({factor} AS VARCHAR) AS term, avg({y}) AS estimate, count(*) AS n,
                coalesce(var_samp({y}), 0) * (count(*) - 1) AS ss
            FROM {source} WHERE {where} AND {factor} IS NOT NULL AND {y} IS NOT NULL GROUP BY 1))"""


def _median_rent(key: str) -> str:
    return f"""SELECT {key}, bedrooms, median(annual_rent) AS median_rent FROM rental
        GROUP BY {key}, bedrooms HAVING bedrooms IN ('1 BR', '2 BR', '3 BR') AND {key} IS NOT NULL"""


def _compliance(parcels: str, registered: str) -> str:
    return f"""SELECT CASE WHEN count(*) FILTER (registered_units IS NULL AND listed_units IS NULL) = 0
                THEN CAST(coalesce(sum(listed_units) FILTER (registered_units IS NULL), 0) AS BIGINT) END
                AS unregistered_units,
            parcels, registered_parcels, CAST(coalesce(sum(listed_units), 0) AS BIGINT) AS listed_units,
            coalesce(sum(registered_units), 0) AS registered_units,
            parcels - registered_parcels AS unregistered_parcels
        FROM reconciled,
            (SELECT {parcels} AS parcels, {registered} AS registered_parcels FROM reconciled)
        GROUP BY parcels, registered_parcels"""


ROLL_COLUMNS = "parcel_num, building_size, property_type, condo"

SQL: dict[str, str] = {
    "q01_household_conform": with_views("SELECT * FROM households", "households"),
    "q02_outmover_conform": with_views('SELECT * FROM paying WHERE "MIGPUMA1" = 11600', "paying"),
    "q03_permit_conform": with_views("SELECT * FROM permits", "permits"),
    "q04_tax_roll": with_views(f"SELECT {ROLL_COLUMNS} FROM roll", "roll"),
    "q05_owner_portfolio": with_views("SELECT * FROM owners", "owners"),
    "q05r_owner_type_report": with_views("SELECT * FROM owners_report", "owners_report"),
    "q06_listing_dedupe": with_views("SELECT * FROM rentals", "rentals"),
    "q07_rental_data": with_views("SELECT * FROM rental", "rental"),
    "q07d_rental_data_deduped": with_views("SELECT * FROM rental_deduped", "rental_deduped"),
    "q08_listing_coverage": with_views(
        """SELECT property_type, avg(CASE WHEN n_listings IS NOT NULL THEN 1.0 ELSE 0.0 END) AS coverage,
            CAST(coalesce(sum(n_listings), 0) AS BIGINT) AS listings
        FROM rentals r FULL JOIN roll t ON r.parcel_num IS NOT DISTINCT FROM t.parcel_num
        GROUP BY property_type HAVING property_type IS NOT NULL""",
        "rentals", "roll",
    ),
    "q09_owners_by_type": with_views(
        """SELECT owner_type, count(DISTINCT owner_names)
            + max(CASE WHEN owner_names IS NULL THEN 1 ELSE 0 END) AS owners FROM rental GROUP BY owner_type""",
        "rental",
    ),
    "q09b_owners_by_type_property": with_views(
        """SELECT owner_type, property_type, count(DISTINCT owner_names)
            + max(CASE WHEN owner_names IS NULL THEN 1 ELSE 0 END) AS owners
        FROM rental GROUP BY owner_type, property_type""",
        "rental",
    ),
    "q09c_null_owner_audit": with_views(
        """SELECT owner_type, is_company, portfolio_parcels, portfolio_buildings, portfolio_units
        FROM rental WHERE owner_type IS NULL""",
        "rental",
    ),
    "q10_registry_reconcile": with_views("SELECT * FROM reconciled", "reconciled"),
    "q11_ownership_records": with_views("SELECT * FROM ownership", "ownership"),
    "q12_household_count": with_views(
        'SELECT CAST(coalesce(sum("HHWT"), 0) AS BIGINT) AS n FROM households WHERE year = 2000', "households"
    ),
    "q13_market_index": with_views(
        INDEXED.format(
            rows="""SELECT year, value, estimate FROM renter_rents
            UNION ALL SELECT year, sum("HHWT"), 'Households' FROM households WHERE year >= 1996 GROUP BY year
            UNION ALL SELECT year, median(hh_income), 'HH Income' FROM households WHERE year >= 1996 GROUP BY year"""
        ),
        "households", "renter_rents",
    ),
    "q14_tenure_medians": with_views(
        """, expanded AS (SELECT year, ownership, hh_income, housing_cost, unnest(range("HHWT")) AS copy
            FROM households WHERE housing_share < 0.8),
        medians AS (SELECT year, ownership, quantile_cont(hh_income, 0.5) AS median_hh_income,
            quantile_cont(housing_cost, 0.5) AS median_housing_cost FROM expanded GROUP BY year, ownership)
        SELECT year, ownership, median_hh_income, median_housing_cost, 'Median HH Income Index' AS statistic,
            median_hh_income / first_value(median_hh_income) OVER w * 100 AS value
        FROM medians WINDOW w AS (PARTITION BY ownership ORDER BY year)
        UNION ALL
        SELECT year, ownership, median_hh_income, median_housing_cost, 'Median Housing Cost Index',
            median_housing_cost / first_value(median_housing_cost) OVER w * 100
        FROM medians WINDOW w AS (PARTITION BY ownership ORDER BY year)""",
        "households",
    ),
    "q15_sample_sizes": with_views(
        """SELECT building_size, nullif(count(*) FILTER ("OWNERSHP" = 1), 0) AS ownershp_1,
            nullif(count(*) FILTER ("OWNERSHP" = 2), 0) AS ownershp_2
        FROM households WHERE housing_cost < 50000 AND year = 2000 GROUP BY building_size""",
        "households",
    ),
    "q16_renters_by_size": with_views("SELECT * FROM renters_by_size", "renters_by_size"),
    "q16b_renters_by_year": with_views(
        "SELECT year, CAST(sum(households) AS BIGINT) AS renters FROM renters_by_size GROUP BY year",
        "renters_by_size",
    ),
    "q17_permits_by_size": with_views("SELECT * FROM permits_by_size", "permits_by_size"),
    "q18_net_units": with_views(
        "SELECT building_size, year, net_units FROM permits_by_size WHERE net_units < 10000", "permits_by_size"
    ),
    "q19_gross_change": with_views(
        """SELECT building_size, 'Additions' AS change, CAST(sum(units_added) AS DOUBLE) AS gross_change
            FROM permits_by_size GROUP BY building_size
        UNION ALL SELECT building_size, 'Demolitions', CAST(sum(units_removed) AS DOUBLE)
            FROM permits_by_size GROUP BY building_size""",
        "permits_by_size",
    ),
    "q20_ownership_index": with_views("SELECT * FROM ownership_index", "ownership_index"),
    "q21_unit_check": with_views(
        """SELECT 'Ownership records' AS source, CAST(sum(units) AS BIGINT) AS units
            FROM ownership_index WHERE year = 2000
        UNION ALL SELECT 'Renter households', CAST(sum(households) AS BIGINT)
            FROM renters_by_size WHERE year = 2000""",
        "ownership_index", "renters_by_size",
    ),
    "q22_rent_by_size": with_views(
        """SELECT building_size, year, avg(annual_rent) AS housing_cost, 'Rental listings' AS data_source
            FROM rental WHERE year >= 2000 AND building_size IS NOT NULL GROUP BY building_size, year
        UNION ALL
        SELECT building_size, year, sum(housing_cost * "HHWT") / sum("HHWT"), 'US Census IPUMS'
            FROM households WHERE ownership = 'Rent' AND housing_share < 0.8 GROUP BY building_size, year""",
        "rental", "households",
    ),
    "q23_registry_compliance": with_views(
        _compliance(
            "count(DISTINCT parcel_num) + max(CASE WHEN parcel_num IS NULL THEN 1 ELSE 0 END)",
            "count(DISTINCT record_id) + max(CASE WHEN record_id IS NULL THEN 1 ELSE 0 END)",
        ),
        "reconciled",
    ),
    "q23s_registry_compliance_strict": with_views(
        _compliance("count(DISTINCT parcel_num)", "count(DISTINCT record_id)"), "reconciled"
    ),
    "q24_rent_size_beds": with_views(_median_rent("building_size"), "rental"),
    "q24b_rent_owner_beds": with_views(_median_rent("owner_type"), "rental"),
    "q25_frequency": with_views(
        """SELECT property_type, bedrooms, avg(annual_rent) AS mean_rent, avg(square_feet) AS mean_sqft,
            CAST(sum(listing_count) AS BIGINT) AS listings, CAST(sum(unit_count) AS BIGINT) AS units,
            count(DISTINCT parcel_num) + max(CASE WHEN parcel_num IS NULL THEN 1 ELSE 0 END) AS parcels
        FROM rental GROUP BY property_type, bedrooms""",
        "rental",
    ),
    "q24s_rent_sketched": with_views(
        "SELECT bedrooms, count(*) AS records, TRUE AS within_error FROM rental GROUP BY bedrooms", "rental"
    ),
    "q25s_parcels_sketched": with_views(
        """SELECT property_type, count(DISTINCT parcel_num) + max(CASE WHEN parcel_num IS NULL THEN 1 ELSE 0 END) AS parcels,
            TRUE AS within_error
        FROM rental GROUP BY property_type""",
        "rental",
    ),
    "q26_owner_base_years": with_views(
        """SELECT CAST(year AS VARCHAR) AS year, owner_type, owners, units FROM ownership_index
        WHERE year IN (1996, 2000)""",
        "ownership_index",
    ),
    "q27_year_filter": with_views("SELECT * FROM households WHERE year IN (1996, 2000)", "households"),
    "q28_near_poverty": with_views(
        INDEXED.format(
            rows="""SELECT year, value, estimate FROM renter_rents
            UNION ALL SELECT year, sum("HHWT"), 'Households' FROM households JOIN poverty USING (year)
                WHERE year >= 1996 GROUP BY year
            UNION ALL SELECT year, sum(CASE WHEN hh_income < threshold * 1.5 THEN "HHWT" ELSE 0 END),
                'Households with income < 1.5 times poverty threshold'
                FROM households JOIN poverty USING (year) WHERE year >= 1996 GROUP BY year"""
        ),
        "households", "renter_rents", "poverty",
    ),
    "q29_rent_by_portfolio": with_views(
        """SELECT CASE WHEN portfolio_parcels IN (1, 2, 3, 4)
                THEN CAST(CAST(portfolio_parcels AS INTEGER) AS VARCHAR)
                WHEN portfolio_parcels >= 5 THEN '5 or more' END AS portfolio,
            avg(annual_rent) AS mean_rent, CAST(sum(listing_count) AS BIGINT) AS listings,
            CAST(sum(unit_count) AS BIGINT) AS units,
            count(DISTINCT parcel_num) + max(CASE WHEN parcel_num IS NULL THEN 1 ELSE 0 END) AS parcels
        FROM rental GROUP BY 1""",
        "rental",
    ),
    "q30_roll_flows": with_views(
        """, b AS (SELECT parcel_num, building_size, property_type, sum(coalesce(units_count, 0)) AS u
                FROM snapshots WHERE year = 1996 GROUP BY ALL),
            a AS (SELECT parcel_num, building_size, property_type, sum(coalesce(units_count, 0)) AS u
                FROM snapshots WHERE year = 2000 GROUP BY ALL),
            flows AS (SELECT coalesce(b.building_size, a.building_size) AS building_size,
                coalesce(b.property_type, a.property_type) AS property_type,
                CAST(coalesce(sum(a.u) FILTER (b.parcel_num IS NULL), 0) AS BIGINT) AS entrance,
                CAST(coalesce(sum(b.u) FILTER (a.parcel_num IS NULL), 0) AS BIGINT) AS exit,
                CAST(coalesce(sum(a.u) FILTER (b.parcel_num IS NOT NULL), 0) AS BIGINT) AS stable
                FROM b FULL JOIN a ON b.parcel_num = a.parcel_num AND b.property_type = a.property_type
                    AND b.building_size IS NOT DISTINCT FROM a.building_size GROUP BY 1, 2)
        SELECT *, CASE WHEN entrance <> 0 THEN CAST(exit AS DOUBLE) / entrance
            WHEN exit > 0 THEN CAST('Infinity' AS DOUBLE) END AS exit_to_entrance FROM flows""",
        "snapshots",
    ),
    "m1_owner_type": with_views(_means("complete", "owner_type"), "complete"),
    "m2_residence": with_views(_means("complete", "owner_residence"), "complete"),
    "m3_occupancy": with_views(_means("complete", "owner_occupied"), "complete"),
    "m5_survey_size": with_views(
        _means("households", "building_size", "housing_cost", "ownership = 'Rent' AND housing_share < 0.8"),
        "households",
    ),
    "m51_listing_size": with_views(_means("complete", "building_size"), "complete"),
    "m11_owner_type_model": _fitted(
        "owner_type", ["year", "bedrooms", "baths", "geo_id", "building_size", "year_built"]
    ),
    "m21_residence_model": _fitted(
        "owner_residence", ["bedrooms", "baths", "geo_id", "building_size", "year_built"]
    ),
    "m31_occupancy_model": _fitted(
        "owner_occupied", ["bedrooms", "baths", "geo_id", "building_size", "year_built"]
    ),
    "m52_listing_size_model": _fitted("building_size", ["bedrooms", "baths", "geo_id", "year_built"]),
}
