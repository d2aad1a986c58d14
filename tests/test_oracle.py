"""Every registered query against its SQL counterpart in DuckDB."""

import pytest

import __spark_entry__ as entry

from .compare import connect, differences

# The queries of the llm subpackage are compared by tests of their own.
QUERIES = {k: q for k, q in entry.queries().items() if not k.startswith(("op", "pipeline"))}
SQL = {k: q for k, q in entry.oracle_sql().items() if k in QUERIES}


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = connect(sf_dir)
    yield con
    con.close()


def test_every_query_has_an_oracle():
    assert set(SQL) == set(QUERIES)


MODELS = ["m11_owner_type_model", "m21_residence_model", "m31_occupancy_model", "m52_listing_size_model"]


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, sf_dir, duck, name):
    assert differences(QUERIES[name](spark, sf_dir), duck, SQL[name]) == []


@pytest.mark.parametrize("name", MODELS)
def test_model_against_numpy(spark, sf_dir, name):
    """Refit on a pulled copy of the small test tables with dense dummies."""
    import numpy as np

    from hearthstat import bindings
    from hearthstat.functions import classify as C
    from hearthstat.plans import models

    first, terms = {
        "m11_owner_type_model": ("owner_type", ["year", "bedrooms", "baths", "geo_id", "building_size", "year_built"]),
        "m21_residence_model": ("owner_residence", ["bedrooms", "baths", "geo_id", "building_size", "year_built"]),
        "m31_occupancy_model": ("owner_occupied", ["bedrooms", "baths", "geo_id", "building_size", "year_built"]),
        "m52_listing_size_model": ("building_size", ["bedrooms", "baths", "geo_id", "year_built"]),
    }[name]
    order = {"owner_type": C.OWNER_TYPES, "bedrooms": C.BEDROOMS, "building_size": C.BUILDING_SIZES}
    pdf = models.complete_cases(bindings.rental(spark, sf_dir)).select("annual_rent", first, *terms).toPandas().dropna()
    names, cols = [], []
    for t in [first, *terms]:
        if t in ("year", "baths", "year_built"):
            names.append(t)
            cols.append(pdf[t].to_numpy(float))
            continue
        values = pdf[t].astype(str).str.lower() if t == "owner_occupied" else pdf[t]
        seen = set(values)
        levels = [v for v in order[t] if v in seen] if t in order else sorted(seen)
        for v in levels if t == first else levels[1:]:
            names.append(f"{t}:{v}")
            cols.append((values == v).to_numpy(float))
    x, y = np.column_stack(cols), pdf["annual_rent"].to_numpy(float)
    beta, _, rank, _ = np.linalg.lstsq(x, y, rcond=None)
    model = getattr(models, name.partition("_")[2])
    got = {r["term"]: r for r in model(bindings.rental(spark, sf_dir)).table(spark).collect()}
    assert len(got) == rank
    kept = [i for i, n in enumerate(names) if n in got]
    own = x[:, kept]
    estimate = np.array([got[names[i]]["estimate"] for i in kept])
    fitted = x @ beta
    assert own @ estimate == pytest.approx(fitted, rel=1e-6)
    s2 = ((y - fitted) ** 2).sum() / (len(y) - rank)
    errors = np.sqrt(np.diag(np.linalg.inv(own.T @ own)) * s2)
    assert [got[names[i]]["std_error"] for i in kept] == pytest.approx(errors, rel=1e-5)
    if rank == len(names):
        assert estimate == pytest.approx(beta, rel=1e-5, abs=1e-2)
