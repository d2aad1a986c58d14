import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from hearthstat.operators import absorb, linear, regress
from hearthstat.operators.polynomials import Poly, orthogonal
from hearthstat.operators.regress import Factor, formula_ols, group_mean_ols


def ols(x, y):
    beta, *_ = np.linalg.lstsq(x, y, rcond=None)
    resid = y - x @ beta
    s2 = resid @ resid / (len(y) - x.shape[1])
    return beta, np.sqrt(np.diag(np.linalg.inv(x.T @ x)) * s2)


@pytest.fixture(scope="module")
def rents(spark):
    return spark.range(900).select(
        F.element_at(F.array(F.lit("low"), F.lit("mid"), F.lit("top")), (F.col("id") % 3 + 1).cast("int")).alias("g"),
        F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit("c"), F.lit("d")), (F.col("id") * 7 % 4 + 1).cast("int")).alias("h"),
        (F.col("id") * 13 % 23 + 2000).cast("double").alias("year"),
        (F.col("id") * 31 % 97 + 1900).cast("int").alias("built"),
        (F.col("id") * 7919 % 1009 + F.col("id") % 3 * 200 + F.col("id") * 13 % 23 * 5).cast("double").alias("y"),
    )


def dummies(pdf, col, levels):
    return np.column_stack([(pdf[col] == v).astype(float) for v in levels])


def test_group_means_equal_dummy_regression(rents):
    pdf = rents.toPandas()
    levels = ["low", "mid", "top"]
    beta, se = ols(dummies(pdf, "g", levels), pdf["y"].to_numpy())
    got = {r["term"]: r for r in group_mean_ols(rents, "y", "g").collect()}
    for v, b, s in zip(levels, beta, se):
        assert got[v]["estimate"] == pytest.approx(b, rel=1e-10)
        assert got[v]["std_error"] == pytest.approx(s, rel=1e-8)
        assert got[v]["ci_high"] - got[v]["ci_low"] == pytest.approx(2 * 1.959963984540054 * s, rel=1e-8)
        assert got[v]["n"] == 300


def test_group_of_one_and_missing_rows(spark):
    rows = [("a", 1.0), ("a", 3.0), ("b", 5.0), (None, 9.0), ("a", None)]
    got = {r["term"]: r for r in group_mean_ols(spark.createDataFrame(rows, "g string, y double"), "y", "g").collect()}
    assert got["a"]["estimate"] == 2.0 and got["b"]["estimate"] == 5.0
    assert got["b"]["std_error"] == pytest.approx(np.sqrt(2.0))


def test_formula_equals_numpy(rents):
    pdf = rents.toPandas()
    x = np.column_stack(
        [
            dummies(pdf, "g", ["top", "mid", "low"]),
            pdf["year"],
            dummies(pdf, "h", ["b", "c", "d"]),
            pdf["built"],
        ]
    )
    beta, se = ols(x, pdf["y"].to_numpy())
    fit = formula_ols(rents, "y", Factor("g", ["top", "mid", "low"]), ["year", Factor("h"), "built"])
    assert fit.terms == ["g:top", "g:mid", "g:low", "year", "h:b", "h:c", "h:d", "built"]
    assert fit.estimate == pytest.approx(beta, rel=1e-6)
    assert fit.std_error == pytest.approx(se, rel=1e-6)
    assert (fit.n, fit.df_residual, fit.aliased) == (900, 892, [])


def test_aliased_columns_drop_out_in_term_order(rents):
    df = rents.withColumn("twice", F.col("year") * 2).withColumn("const", F.lit(3.0)).withColumn("g2", F.col("g"))
    fit = formula_ols(df, "y", Factor("g"), ["year", "twice", "const", Factor("g2")])
    plain = formula_ols(df, "y", Factor("g"), ["year"])
    assert fit.aliased == ["twice", "const", "g2:mid", "g2:top"]
    assert fit.terms == plain.terms
    assert fit.estimate == pytest.approx(plain.estimate)
    assert fit.std_error == pytest.approx(plain.std_error)


def test_incomplete_rows_and_unknown_levels_are_left_out(rents, spark):
    extra = spark.createDataFrame(
        [("low", "a", None, 1950, 9e9), ("odd", "a", 2001.0, 1950, 9e9)], "g string, h string, year double, built int, y double"
    )
    factor = Factor("g", ["low", "mid", "top"])
    assert formula_ols(rents.unionByName(extra), "y", factor, ["year"]).estimate == pytest.approx(
        formula_ols(rents, "y", factor, ["year"]).estimate
    )


def test_table_keeps_first_terms(rents, spark):
    fit = formula_ols(rents, "y", Factor("g"), [Factor("h")])
    table = fit.table(spark, keep=3).collect()
    assert [r["term"] for r in table] == ["g:low", "g:mid", "g:top"]
    assert all(r["ci_low"] < r["estimate"] < r["ci_high"] for r in table)


def tract_rents(spark, n, tracts):
    """Rows in tracts of uneven size; covariates that vary, and some that are constant within tracts."""
    tract = F.pmod(F.col("id") * F.col("id") + F.col("id") % 11, F.lit(tracts))
    noise = (F.col("id") * 7919 % 1009).cast("double")
    return spark.range(n).select(
        F.concat(F.lit("t"), F.lpad(tract.cast("string"), 5, "0")).alias("tract"),
        F.element_at(F.array(*map(F.lit, "abc")), (F.col("id") * 31 % 3 + 1).cast("int")).alias("g"),
        F.element_at(F.array(*map(F.lit, "pqrs")), (F.col("id") * 17 % 4 + 1).cast("int")).alias("h"),
        (F.col("id") * 13 % 23 + 2000).cast("double").alias("year"),
        F.sqrt(tract.cast("double") + 1).alias("root"),
        ((tract * 37 % 101) / 3).alias("third"),
        F.log(tract * 53 % 97 + 2).alias("log"),
        (noise + tract * 13 % 29 * 40 + F.col("id") * 13 % 23 * 5).alias("y"),
    )


def both_ways(df, first, terms):
    """The table with the tracts listed, and with them absorbed."""
    spark = df.sparkSession
    tables = []
    for absorb in (False, True):
        own = [Factor("tract", absorb=absorb) if t == "tract" else t for t in terms]
        fit = formula_ols(df, "y", first, own)
        tables.append(({r["term"]: r for r in fit.table(spark).collect()}, fit))
    return tables


FORMULAS = {
    "plain": ["year", Factor("h"), "tract"],
    "constant after": ["year", "tract", "root", "third", Factor("h")],
    "constant before": ["root", "year", "tract", Factor("h")],
    "several before": ["root", "third", "year", "log", "tract", Factor("h"), "twice"],
}


@pytest.mark.parametrize("formula", FORMULAS)
def test_absorbed_factor_gives_the_same_table(spark, formula):
    df = tract_rents(spark, 4000, 29).withColumn("twice", F.col("root") * 2 + F.col("year"))
    (listed, plain), (absorbed, fit) = both_ways(df, Factor("g"), FORMULAS[formula])
    assert set(absorbed) == set(listed)
    for term, row in listed.items():
        assert absorbed[term]["estimate"] == pytest.approx(row["estimate"], rel=1e-6, abs=1e-5)
        assert absorbed[term]["std_error"] == pytest.approx(row["std_error"], rel=1e-6)
        assert absorbed[term]["n"] == row["n"]
    assert (fit.df_residual, fit.sigma2) == (plain.df_residual, pytest.approx(plain.sigma2))
    assert fit.terms == [t for t in plain.terms if not t.startswith("tract:")]


def test_first_factor_constant_within_tracts(spark):
    kind = F.element_at(F.array(*map(F.lit, "abc")), (F.substring("tract", 5, 2).cast("int") % 3 + 1).cast("int"))
    df = tract_rents(spark, 4000, 30).withColumn("g", kind)
    (listed, _), (absorbed, _) = both_ways(df, Factor("g"), ["year", "tract"])
    assert set(absorbed) == set(listed)
    for term, row in listed.items():
        assert absorbed[term]["estimate"] == pytest.approx(row["estimate"], rel=1e-6, abs=1e-5)
        assert absorbed[term]["std_error"] == pytest.approx(row["std_error"], rel=1e-6)


def test_five_thousand_levels(spark):
    """More levels than can be listed; against the within estimator and group means."""
    df = tract_rents(spark, 60_000, 5000)
    df = df.withColumn("tract", F.concat(F.lit("t"), F.lpad((F.col("year") * 7919 + F.hash("y", "h") % 5000).cast("long") % 5000, 5, "0")))
    fit = formula_ols(df, "y", Factor("g"), ["year", Factor("h"), Factor("tract", absorb=True), "third"])
    pdf = df.toPandas()
    cols = ["year", "third", "y"]
    for f, levels in (("g", "bc"), ("h", "qrs")):
        for v in levels:
            pdf[f"{f}:{v}"] = (pdf[f] == v).astype(float)
            cols.append(f"{f}:{v}")
    means = pdf.groupby("tract")[cols].transform("mean")
    names = [c for c in cols if c != "y"]
    x, y = (pdf[names] - means[names]).to_numpy(), (pdf["y"] - means["y"]).to_numpy()
    beta, *_ = np.linalg.lstsq(x, y, rcond=None)
    got = dict(zip(fit.terms, fit.estimate))
    assert got["year"] == pytest.approx(beta[0], rel=1e-6)
    assert got["third"] == pytest.approx(beta[1], rel=1e-6)
    table = {r["term"]: r for r in fit.table(spark).collect()}
    groups = pdf.groupby("tract")[cols].mean()
    level = groups["y"] - groups[names].to_numpy() @ beta
    assert len(table) == len(fit.terms) + len(groups) - 1
    for t in groups.index[[1, 7, -1]]:
        assert table[f"tract:{t}"]["estimate"] == pytest.approx(level[t] - level.iloc[0], rel=1e-6, abs=1e-6)


def test_dummies_that_differ_in_one_row_are_both_kept(spark):
    df = spark.range(200_000).select(
        F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("g"),
        (F.col("id") % 5 == 0).cast("double").alias("one"),
        ((F.col("id") % 5 == 0) & (F.col("id") != 40)).cast("double").alias("other"),
        (F.col("id") * 7919 % 1009).cast("double").alias("y"),
    )
    assert formula_ols(df, "y", Factor("g"), ["one", "other"]).aliased == []


def test_any_keep_gives_the_listed_tables_first_rows(spark):
    df = tract_rents(spark, 2000, 13)
    terms = ["root", "tract", "year", Factor("h")]
    fits = [formula_ols(df, "y", Factor("g"), [Factor(t, absorb=a) if t == "tract" else t for t in terms]) for a in (False, True)]
    every = fits[0].table(spark).count()
    for keep in (0, 1, 3, 4, 5, 9, 15, 16, 17, every, every + 5):
        want, got = (f.table(spark, keep=keep).collect() for f in fits)
        assert [r["term"] for r in got] == [r["term"] for r in want]
        assert [r["estimate"] for r in got] == pytest.approx([r["estimate"] for r in want], rel=1e-6, abs=1e-5)
        assert [r["ci_low"] for r in got] == pytest.approx([r["ci_low"] for r in want], rel=1e-6, abs=1e-5)


def test_first_factor_or_three_factors_are_not_absorbed(rents):
    with pytest.raises(ValueError):
        formula_ols(rents, "y", Factor("g", absorb=True), ["year"])
    with pytest.raises(ValueError):
        formula_ols(rents.withColumn("k", F.col("h")).withColumn("l", F.col("h")), "y", Factor("g"), [Factor(f, absorb=True) for f in "hkl"])


TWO = {
    "plain": ["year", "tract", Factor("h"), "agent"],
    "wide one last": ["agent", "year", "tract"],
    "constant before, between and after": ["root", "tract", "third", "fee", "year", "agent", "log", Factor("h")],
    "constant in both": ["year", "both", "agent", "fee", "tract", "root"],
}


def agents(df, n, parts=1):
    """A second factor; tract and agent fall into so many parts that never meet."""
    tract = F.substring("tract", 2, 5).cast("int")
    own = F.pmod(F.hash("y", "year", "h"), F.lit(n)) * parts + tract % parts
    df = df.withColumn("agent", F.concat(F.lit("a"), F.lpad(own.cast("string"), 5, "0")))
    return df.withColumn("fee", F.sqrt(own + F.lit(2.0))).withColumn("both", F.col("root") + F.col("fee") * 2)


@pytest.mark.parametrize("dense", [6000, 0])
@pytest.mark.parametrize("parts", [1, 3])
@pytest.mark.parametrize("formula", TWO)
def test_two_absorbed_factors_give_the_same_table(spark, monkeypatch, formula, parts, dense):
    monkeypatch.setattr(absorb, "DENSE", dense)
    df = agents(tract_rents(spark, 3000, 18), 7, parts).cache()
    listed, taken = (
        formula_ols(df, "y", Factor("g"), [Factor(t, absorb=a) if t in ("tract", "agent") else t for t in TWO[formula]])
        for a in (False, True)
    )
    want = {r["term"]: r for r in listed.table(spark).collect()}
    got = {r["term"]: r for r in taken.table(spark).collect()}
    assert set(got) == set(want)
    assert [r["term"] for r in taken.table(spark, keep=30).collect()] == [r["term"] for r in listed.table(spark, keep=30).collect()]
    for term, row in want.items():
        assert got[term]["estimate"] == pytest.approx(row["estimate"], rel=1e-5, abs=1e-4)
        if dense or not term.startswith(("tract:", "agent:")):
            assert got[term]["std_error"] == pytest.approx(row["std_error"], rel=1e-5)
        else:
            assert got[term]["std_error"] is None
    assert (taken.df_residual, taken.sigma2) == (listed.df_residual, pytest.approx(listed.sigma2))
    df.unpersist()


def test_five_thousand_levels_twice(spark):
    """More levels of both than can be listed, against the normal equations in plain numpy."""
    n, p = 60_000, 5000
    df = spark.range(n).select(
        F.concat(F.lit("t"), F.lpad((F.pmod(F.hash("id"), F.lit(p))).cast("string"), 5, "0")).alias("tract"),
        F.concat(F.lit("a"), F.lpad((F.pmod(F.hash(F.col("id") * 3 + 1), F.lit(p))).cast("string"), 5, "0")).alias("agent"),
        F.element_at(F.array(*map(F.lit, "abc")), (F.col("id") * 31 % 3 + 1).cast("int")).alias("g"),
        (F.col("id") * 13 % 23 + 2000).cast("double").alias("year"),
        (F.col("id") * 7919 % 1009).cast("double").alias("y"),
    )
    fit = formula_ols(df, "y", Factor("g"), ["year", Factor("tract", absorb=True), Factor("agent", absorb=True)])
    got = {r["term"]: r for r in fit.table(spark).collect()}
    pdf = df.toPandas()
    tracts, t = np.unique(pdf["tract"], return_inverse=True)
    names, a = np.unique(pdf["agent"], return_inverse=True)
    x = np.column_stack([(pdf["g"] == v).astype(float) for v in "abc"] + [pdf["year"] - pdf["year"].mean()])
    y = pdf["y"].to_numpy()
    # Tracts are eliminated, the rest is solved in full.
    rest = np.zeros((n, 4 + len(names) - 1))
    rest[:, :4] = x
    rows = np.flatnonzero(a > 0)
    rest[rows, 4 + a[rows] - 1] = 1.0
    size = np.bincount(t)
    def demeaned(v):
        sums = np.zeros((len(size), v.shape[1]))
        np.add.at(sums, t, v)
        return v - (sums / size[:, None])[t]
    columns = [1, 2, 3, *range(4, rest.shape[1])]  # the first of g's levels goes with the tracts' mean
    within, left = demeaned(rest[:, columns]), demeaned(y[:, None])[:, 0]
    inverse = np.linalg.inv(within.T @ within)
    beta = inverse @ (within.T @ left)
    residual = left - within @ beta
    sigma2 = residual @ residual / (n - len(size) - len(columns))
    assert fit.df_residual == n - len(size) - len(columns)
    error = np.sqrt(np.diag(inverse) * sigma2)
    assert got["year"]["estimate"] == pytest.approx(beta[2], rel=1e-6)
    assert got["year"]["std_error"] == pytest.approx(error[2], rel=1e-6)
    assert got["g:b"]["estimate"] - got["g:a"]["estimate"] == pytest.approx(beta[0], rel=1e-5)
    for i in (1, 77, len(names) - 1):
        assert got[f"agent:{names[i]}"]["estimate"] == pytest.approx(beta[3 + i - 1], rel=1e-5, abs=1e-6)
        assert got[f"agent:{names[i]}"]["std_error"] == pytest.approx(error[3 + i - 1], rel=1e-6)
    level = np.zeros(len(size))
    np.add.at(level, t, y - rest[:, columns] @ beta)
    level /= size
    for i in (1, 300, len(size) - 1):
        assert got[f"tract:{tracts[i]}"]["estimate"] == pytest.approx(level[i] - level[0], rel=1e-5, abs=1e-5)
    means = np.zeros((len(size), within.shape[1]))
    np.add.at(means, t, rest[:, columns])
    means /= size[:, None]
    between = means[1] - means[0]
    want = np.sqrt((1 / size[1] + 1 / size[0] + between @ inverse @ between) * sigma2)
    assert got[f"tract:{tracts[1]}"]["std_error"] == pytest.approx(want, rel=1e-5)


@pytest.mark.parametrize("degree", [1, 2, 3, 5])
def test_polynomials_equal_an_orthogonal_factorisation_of_powers(spark, degree):
    df = spark.range(500).select((F.col("id") * F.col("id") % 37 + 1990).cast("int").alias("year"))
    df = df.unionByName(spark.createDataFrame([(None,)], "year int"))
    fit = orthogonal(df, "year", degree)
    got = np.array(df.dropna().select("year", *[c.alias(f"p{i}") for i, c in enumerate(fit.columns(F.col("year")))]).collect())
    x = got[:, 0] - got[:, 0].mean()
    q = np.linalg.qr(np.vander(x, degree + 1, increasing=True))[0][:, 1:]
    q = q * np.sign((q * got[:, 1:]).sum(0))
    assert got[:, 1:] == pytest.approx(q, abs=1e-9)


def test_polynomial_terms(spark, rents):
    pdf = rents.toPandas()
    x = pdf["year"] - pdf["year"].mean()
    q = np.linalg.qr(np.vander(x, 4, increasing=True))[0][:, 1:]
    q = q * np.sign([q[:, j] @ x ** (j + 1) for j in range(3)])
    beta, se = ols(np.column_stack([dummies(pdf, "g", ["low", "mid", "top"]), q]), pdf["y"].to_numpy())
    fit = formula_ols(rents, "y", Factor("g"), [Poly("year", 3)])
    assert fit.terms[3:] == ["poly(year, 3)1", "poly(year, 3)2", "poly(year, 3)3"]
    assert fit.estimate == pytest.approx(beta, rel=1e-6)
    assert fit.std_error == pytest.approx(se, rel=1e-6)
    with pytest.raises(ValueError):
        orthogonal(rents.withColumn("two", F.col("built") % 2), "two", 2)
    with pytest.raises(ValueError):
        orthogonal(rents.limit(0), "year", 1)


def test_columns_that_differ_by_a_millionth_are_both_kept(spark):
    df = spark.range(3000).select(
        F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("g"),
        (F.col("id") * 7919 % 1009).cast("double").alias("one"),
        (F.col("id") * 104729 % 997).cast("double").alias("other"),
        (F.col("id") * 31 % 613).cast("double").alias("y"),
    ).withColumn("near", F.col("one") + F.col("other") * 1e-6).withColumn("same", F.col("one") + F.col("other") * 1e-9)
    fit = formula_ols(df.repartition(5), "y", Factor("g"), ["one", "near"])
    assert fit.aliased == []
    pdf = df.toPandas()
    beta, se = ols(np.column_stack([dummies(pdf, "g", "ab"), pdf["one"], pdf["near"]]), pdf["y"].to_numpy())
    assert fit.estimate == pytest.approx(beta, rel=1e-4)
    assert fit.std_error == pytest.approx(se, rel=1e-4)
    assert formula_ols(df, "y", Factor("g"), ["one", "same"]).aliased == ["same"]


def test_tree_of_triangles_equals_numpy(spark, monkeypatch):
    monkeypatch.setattr(linear, "BLOCK", 64)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(700, 6))
    x[:, 4] = x[:, 0] - x[:, 2]
    df = spark.createDataFrame([(v.tolist(),) for v in x], "a array<double>").repartition(7)
    factor = linear.triangle(df.select(array_to_vector("a").alias("v")), "v", 6)
    assert factor.T @ factor == pytest.approx(x.T @ x, abs=1e-9)
    kept, basis, r = linear.independent_columns(factor, 6)
    assert kept == [0, 1, 2, 3, 5]
    assert r.T @ r == pytest.approx((x.T @ x)[np.ix_(kept, kept)], abs=1e-9)
    none = linear.triangle(df.limit(0).select(array_to_vector("a").alias("v")), "v", 6)
    assert none.shape[1] == 6 and linear.independent_columns(none, 6)[0] == []


def test_many_terms_are_solved_from_cross_products(rents, monkeypatch):
    plain = formula_ols(rents, "y", Factor("g"), ["year", Factor("h")])
    monkeypatch.setattr(regress, "QR_TERMS", 2)
    fit = formula_ols(rents, "y", Factor("g"), ["year", Factor("h")])
    assert fit.estimate == pytest.approx(plain.estimate) and fit.std_error == pytest.approx(plain.std_error)


def test_group_means_read_the_table_once(rents):
    plan = group_mean_ols(rents, "y", "g")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Range (") == 1


def test_solving_many_terms_is_quick():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 1500))
    x[:, 700] = x[:, 3] + x[:, 5]
    fit = regress.solve_normal(x.T @ x, 3000, [f"x{i}" for i in range(1499)])
    assert fit.aliased == ["x700"]


def test_too_many_listed_levels_are_refused(rents, monkeypatch):
    monkeypatch.setattr(regress, "LISTED_TERMS", 5)
    with pytest.raises(ValueError):
        formula_ols(rents, "y", Factor("g"), [Factor("h")])
    assert formula_ols(rents, "y", Factor("g"), [Factor("h", absorb=True)]).effects.count() == 3


def test_group_means_in_order_of_levels(rents):
    got = [r["term"] for r in group_mean_ols(rents, "y", "g", levels=["top", "low", "mid"]).collect()]
    assert got == ["top", "low", "mid"]
    kept = group_mean_ols(rents, "y", "g", levels=["top", "low", "mid"], keep=2).collect()
    assert [r["term"] for r in kept] == ["top", "low"]


def test_models_with_polynomials_nest_the_published_ones(spark, sf_dir):
    from hearthstat import bindings
    from hearthstat.plans import models

    rental = bindings.rental(spark, sf_dir).cache()
    plain, curved = (models.listing_size_model(rental, degree=d) for d in (1, 2))
    assert "year_built" in plain.terms and "year_built" not in curved.terms
    assert [t for t in curved.terms if t.startswith("poly(")] == ["poly(year_built, 2)1", "poly(year_built, 2)2"]
    assert curved.df_residual == plain.df_residual - 1
    assert curved.sigma2 * curved.df_residual <= plain.sigma2 * plain.df_residual * (1 + 1e-9)
    rental.unpersist()
