import pytest
from pyspark.sql import functions as F

from recordforge.operators import infer, reports
from recordforge.operators.order import lay_out, previous_value, row_positions, running_sum


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of all rows in one group, and a run of equal order keys."""
    hot = F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise((F.col("id") % 7).cast("string"))
    return spark.range(6000).select("id", hot.alias("g"), F.when(F.col("id") < 2000, 0).otherwise(F.col("id")).alias("k")).repartition(7)


def test_positions(skewed):
    got = row_positions(skewed, ["id"]).toPandas()
    assert (got.id == got._pos).all()


def test_equal_keys_spread_over_partitions(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        laid = lay_out(spark.range(8000).select(F.lit(1).alias("same")).repartition(8), ["same"])
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert laid.groupBy("_part").count().agg(F.max("count")).first()[0] < 4000


def test_running_sum_per_group(skewed):
    got = running_sum(skewed, F.col("id"), ["k", "id"], ["g"]).toPandas().sort_values(["g", "k", "id"])
    assert (got.groupby("g").id.cumsum() == got.running).all()


def test_running_sum_of_the_whole_table(skewed):
    got = running_sum(skewed, F.lit(1), ["id"]).toPandas().sort_values("id")
    assert list(got.running) == list(range(1, 6001))


def test_previous_value_with_nulls(skewed):
    value = F.when(F.col("id") % 5 != 0, F.col("id"))
    got = previous_value(skewed.withColumn("v", value), F.col("v"), ["id"], ["g"]).toPandas().sort_values(["g", "id"])
    want = got.groupby("g").v.shift()
    assert (got.previous.fillna(-1) == want.fillna(-1)).all()


@pytest.mark.parametrize("n", [1, 2, 7, 1000])
def test_medians(spark, n):
    df = spark.range(n).select(F.lit("g").alias("g"), ((F.col("id") * 37) % 101).cast("double").alias("x"))
    got = reports.numeric_stats(df, "g", "x").first()
    values = sorted((i * 37) % 101 for i in range(n))
    assert got["median"] == (values[(n - 1) // 2] + values[n // 2]) / 2
    assert got["count"] == n and (n > 1 or got["stdev"] == 0)


def test_streaks_skip_successes(spark):
    rows = [(1, "a"), (2, None), (3, "a"), (4, "b"), (5, "a")]
    df = spark.createDataFrame([("r", i, e) for i, e in rows], "run string, i int, error string")
    got = infer.error_streaks(df, "error", ["i"], ["run"]).orderBy("streak").collect()
    assert [(r.error, r.length) for r in got] == [("a", 2), ("b", 1), ("a", 1)]


def test_cost_cap_keeps_the_crossing_unit(spark):
    df = spark.createDataFrame([(i, 2.0) for i in range(10)], "i int, cost double")
    assert sorted(r.i for r in infer.cost_cap(df, 5.0, "cost", ["i"]).collect()) == [0, 1, 2]
