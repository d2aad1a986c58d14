import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from hearthstat.functions import semantics as S
from hearthstat.operators import joins


def rows(df, *cols):
    return sorted([tuple(r) for r in df.select(*cols).collect()], key=repr)


@pytest.fixture(scope="module")
def sides(spark):
    left = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), (None, 4)], "k string, l int")
    right = spark.createDataFrame([("a", 10), (None, 20), ("z", 30)], "k string, r int")
    return left, right


def test_natural_join_uses_shared_columns_and_matches_missing_keys(sides):
    left, right = sides
    joined = joins.natural_join(left, right)
    assert joined.columns == ["k", "l", "r"]
    assert rows(joined, "k", "l", "r") == rows(
        left.sparkSession.createDataFrame([("a", 1, 10), ("a", 2, 10), (None, 4, 20)], "k string, l int, r int"),
        "k", "l", "r",
    )
    assert joins.natural_join(left, right, null_safe=False).count() == 2


def test_left_and_full(sides):
    left, right = sides
    assert joins.natural_join(left, right, "left").count() == 4
    full = joins.natural_join(left, right, "full")
    assert full.columns == ["k", "l", "r"]
    assert rows(full, "k", "l", "r") == sorted(
        [("a", 1, 10), ("a", 2, 10), ("b", 3, None), (None, 4, 20), ("z", None, 30)], key=repr
    )


def test_full_join_keeps_every_row_once_per_pair(spark):
    left = spark.range(200).select((F.col("id") % 17).alias("k"), F.col("id").alias("l"))
    right = spark.range(150).select((F.col("id") % 23).alias("k"), F.col("id").alias("r"))
    full = joins.natural_join(left, right, "full")
    native = left.join(right, "k", "full")
    assert rows(full, "k", "l", "r") == rows(native, "k", "l", "r")


def test_join_without_shared_columns_is_refused(spark):
    with pytest.raises(ValueError):
        joins.natural_join(spark.range(1), spark.range(1).toDF("x"))
    with pytest.raises(ValueError):
        joins.natural_join(spark.range(1), spark.range(1), "right")


SPLITTING = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "10k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10k",
    "spark.sql.shuffle.partitions": "8",
}


@pytest.fixture
def splitting(spark):
    """Adaptive execution with limits that small tables reach."""
    for k, v in SPLITTING.items():
        spark.conf.set(k, v)
    yield
    for k in SPLITTING:
        spark.conf.unset(k)
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def executed(df):
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


@pytest.mark.parametrize("how", ["inner", "left", "full"])
def test_reshuffled_join_equals_a_plain_join(spark, how):
    # A third of the left rows share a key, and another third have none.
    left = spark.range(900).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot"))
        .when(F.col("id") % 3 == 1, F.concat(F.lit("k"), F.col("id") % 40))
        .alias("k"),
        F.col("id").alias("l"),
    )
    right = spark.createDataFrame(
        [("hot", 1), ("hot", 2), (None, 3), ("k1", 4), ("k1", 5), ("absent", 6)], "k string, r int"
    )
    got = joins.natural_join(left, right, how, reshuffle=True)
    want = left.alias("a").join(right.alias("b"), F.expr("a.k <=> b.k"), how)
    assert got.columns == ["k", "l", "r"]
    assert rows(got, "k", "l", "r") == rows(want, F.coalesce("a.k", "b.k"), "l", "r")


def test_group_totals_equal_a_window(spark):
    df = spark.range(3000).select(
        F.concat(F.lit("p"), F.col("id").cast("string")).alias("parcel"),
        F.when(F.col("id") % 3 == 0, F.lit(None))
        .when(F.col("id") % 3 == 1, F.lit("big"))
        .otherwise((F.col("id") % 200).cast("string"))
        .alias("owner"),
        F.when(F.col("id") % 77 != 0, F.col("id") % 9).alias("units"),
    )
    got = joins.with_group_totals(df, "owner", {"n": S.n_rows(), "units_total": S.sum_of("units")})
    w = Window.partitionBy("owner")
    want = df.withColumn("n", F.count(F.lit(1)).over(w)).withColumn(
        "units_total",
        F.when(F.count("units").over(w) == F.count(F.lit(1)).over(w), F.sum("units").over(w)),
    )
    cols = ["parcel", "owner", "units", "n", "units_total"]
    assert got.columns == cols
    assert rows(got, *cols) == rows(want, *cols)


@pytest.mark.parametrize("owner", ["one", None])
def test_identical_rows_of_one_group_are_parted(spark, splitting, owner):
    """One owner, or none, with all rows on one parcel and alike: several tasks still share them.

    Sizes are what the shuffle wrote, and like rows compress well, hence the lower limits.
    """
    for k in ("skewJoin.skewedPartitionThresholdInBytes", "advisoryPartitionSizeInBytes"):
        spark.conf.set(f"spark.sql.adaptive.{k}", "200b")
    name = F.when(F.col("id") >= 50, F.lit(owner)).otherwise(F.col("id").cast("string"))
    df = spark.range(0, 60_000, 1, 8).select(F.lit("same").alias("parcel"), name.alias("owner"))
    got = joins.with_group_totals(df, "owner", {"n": S.n_rows()})
    where = got.where(F.col("owner").eqNullSafe(F.lit(owner))).groupBy(F.spark_partition_id()).count()
    sizes = [r["count"] for r in where.collect()]
    assert len(sizes) > 1 and sum(sizes) == 59_950
    got.collect()
    assert "skew=true" in executed(got)


@pytest.mark.parametrize("reshuffle", [True, False])
def test_fresh_shuffle_lets_a_hot_key_be_split_after_a_join(spark, splitting, reshuffle):
    """The second join on a key is split by adaptive execution only with ``reshuffle``."""
    key = F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id") % 1000).cast("string")
    left = spark.range(0, 60_000, 1, 8).select(key.alias("k"), F.col("id").alias("l"))
    small = spark.range(1000).select(F.col("id").cast("string").alias("k"), F.col("id").alias("a"))
    other = spark.range(1000).select(F.col("id").cast("string").alias("k"), (-F.col("id")).alias("b"))
    got = joins.natural_join(left, joins.natural_join(small, other), reshuffle=reshuffle)
    assert got.collect() and got.columns == ["k", "l", "a", "b"]
    assert ("skew=true" in executed(got)) == reshuffle
    assert got.count() == 60_000


def test_full_join_reads_each_side_once_and_parts_a_hot_key(spark):
    key = F.when(F.col("id") % 3 > 0, F.lit(None)).otherwise(F.col("id") % 500).cast("string")
    left = spark.range(0, 9000, 1, 3).select(key.alias("k"), F.lit("same").alias("l"))
    right = spark.range(600).select(F.col("id").cast("string").alias("k"), F.col("id").alias("r"))
    right = right.unionByName(right.limit(20)).unionByName(spark.createDataFrame([(None, -1)], "k string, r long"))
    for null_safe in (True, False):
        got = joins.natural_join(left, right, "full", null_safe=null_safe)
        same = "a.k <=> b.k" if null_safe else "a.k = b.k"
        want = left.alias("a").join(right.alias("b"), F.expr(same), "full")
        assert got.columns == ["k", "l", "r"]
        assert rows(got, "k", "l", "r") == rows(want, F.coalesce("a.k", "b.k"), "l", "r")
    plan = joins.natural_join(left, right, "full")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Range (0, 9000") == 1
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        hot = joins.natural_join(left, right, "full").filter("k IS NULL AND l = 'same'").groupBy(F.spark_partition_id()).count()
        sizes = [r["count"] for r in hot.collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert sum(sizes) == 6000 and len(sizes) >= 4 and max(sizes) <= 3000


def test_full_join_of_empty_sides(spark):
    left, right = spark.createDataFrame([("a", 1)], "k string, l int"), spark.createDataFrame([("b", 2)], "k string, r int")
    assert rows(joins.natural_join(left, right, "full"), "k", "l", "r") == rows(
        spark.createDataFrame([("a", 1, None), ("b", None, 2)], "k string, l int, r int"), "k", "l", "r"
    )
    assert joins.natural_join(left.limit(0), right, "full").collect()[0]["r"] == 2
    assert joins.natural_join(left, right.limit(0), "full").collect()[0]["l"] == 1
    two = left.withColumn("j", F.lit(None).cast("int"))
    assert joins.natural_join(two, two.select("k", "j", F.lit(9).alias("r")), "full").collect()[0].asDict() == {"k": "a", "l": 1, "j": None, "r": 9}


def test_join_by_key_lies_in_buckets_of_the_key(spark):
    """NULL matches NULL and not the text that it goes by; the other rows lie where a bucketed table has them."""
    key = F.when(F.col("id") % 7 == 0, F.lit(None)).when(F.col("id") % 7 == 1, F.lit("\0")).otherwise((F.col("id") % 50).cast("string"))
    left = spark.range(400).select(F.col("id").alias("l"), key.alias("k"))
    right = spark.range(60).select(key.alias("k"), F.col("id").alias("r"))
    want = left.alias("a").join(right.alias("b"), F.expr("a.k <=> b.k"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = joins.by_key(left, right, "k")
        assert got.columns == ["k", "l", "r"]
        assert rows(got, "k", "l", "r") == rows(want, "a.k", "l", "r")
        place = got.where("k IS NOT NULL").select(F.spark_partition_id().alias("p"), F.expr("pmod(hash(k), 4)").alias("b"))
        assert all(r["p"] == r["b"] for r in place.collect())
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_join_by_key_parts_a_hot_key(spark, splitting):
    key = F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id") % 1000).cast("string")
    left = spark.range(0, 60_000, 1, 8).select(key.alias("k"), F.col("id").alias("l"))
    small = spark.range(1000).select(F.col("id").cast("string").alias("k"), F.col("id").alias("a"))
    got = joins.by_key(left, joins.natural_join(small, small.select("k", (-F.col("a")).alias("b"))), "k")
    assert len(got.collect()) == 60_000
    assert "skew=true" in executed(got)
