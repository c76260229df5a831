import itertools
import math

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from recordforge.functions import rng
from recordforge.operators import fanout, units
from recordforge.operators.units import GenerationError


def items(spark, names):
    return spark.createDataFrame([(i, n) for i, n in enumerate(names)], "at int, id string")


def ids(df):
    return [r.unit_id for r in df.orderBy("_unit_pos").collect()]


@pytest.mark.parametrize("n,k", [(3, 3), (4, 2), (6, 3), (5, 1), (5, 4)])
def test_permutations_in_order(spark, n, k):
    names = [f"n{i}" for i in range(n)]
    made = units.permutations(items(spark, names), [f"p{i}" for i in range(k)], order_by=["at"])
    assert ids(made) == ["-".join(p) for p in itertools.permutations(names, k)]
    assert made.count() == math.perm(n, k)


def test_permutation_is_by_place_not_by_value(spark):
    same = units.permutations(items(spark, ["a", "a", "b"]), ["x", "y"], order_by=["at"])
    assert sorted(ids(same)) == ["a-a", "a-a", "a-b", "a-b", "b-a", "b-a"]
    with pytest.raises(GenerationError):
        units.assert_unique_ids(same)


def test_too_few_items(spark):
    with pytest.raises(GenerationError, match="Not enough items"):
        units.permutations(items(spark, ["a"]), ["x", "y"])


def test_names_are_made_safe_and_collide(spark):
    df = units.direct(items(spark, ["a b", "a_b", "c/d"]))
    assert sorted(r.unit_id for r in df.collect()) == ["a_b", "a_b", "c-d"]
    with pytest.raises(GenerationError, match="Duplicate"):
        units.assert_unique_ids(df)


@pytest.mark.parametrize("bad", [None, ""])
def test_item_without_a_name(spark, bad):
    with pytest.raises(PySparkException, match="without a name"):
        units.direct(items(spark, ["a", bad])).collect()


def test_name_falls_back_only_to_existing_columns(spark):
    df = spark.createDataFrame([(7, "x")], "id int, other string")
    assert units.direct(df, "title").first().unit_id == "7"
    with pytest.raises(GenerationError):
        units.permutations(df, ["p"], "title")
    empty = spark.createDataFrame([(None, "x")], "title string, id string")
    with pytest.raises(PySparkException):
        units.direct(empty, "title").collect()


def test_cross_product_order_sources_and_errors(spark):
    groups = {"as": items(spark, ["x", "y"]), "bs": items(spark, ["1", "2", "3"])}
    made = units.cross_product(groups, ["a", "b"], order_by={"as": ["at"], "bs": ["at"]})
    assert ids(made) == ["x-1", "x-2", "x-3", "y-1", "y-2", "y-3"]
    few = units.cross_product(groups, {"a": "bs", "b": "bs"}, order_by={"bs": ["at"]}, limit=2, max_units=3)
    assert ids(few) == ["1-1", "1-2", "2-1"]
    with pytest.raises(GenerationError, match="No group"):
        units.cross_product(groups, ["c"])


def test_repeat_once_changes_nothing(spark):
    df = units.direct(items(spark, ["a", "b"]))
    assert units.repeat(df, 1) is df


def test_many_repetitions_and_seeds(spark):
    df = units.repeat(units.direct(items(spark, ["start_at_5"])), 10_001)
    last = df.orderBy(F.desc("_repetition_id")).first()
    assert last.unit_id == "start_at_5__rep10000"
    assert last._repetition_seed == 1148893718 + 10_000


def test_interleaving_covers_all_items(spark):
    made = units.generate_units(items(spark, list("abcd")), "direct", repeat_count=3, max_units=6, order_by=["at"])
    assert ids(made) == [f"{x}__rep0000" for x in "abcd"] + ["a__rep0001", "b__rep0001"]
    perms = units.generate_units(items(spark, list("abc")), "permutation", ["p", "q"], repeat_count=2, max_units=8, order_by=["at"])
    assert ids(perms)[6:] == ["a-b__rep0001", "a-c__rep0001"]


@pytest.mark.parametrize("parts", [1, 4, 16])
def test_same_result_under_any_partitioning(spark, parts):
    base = spark.range(200).repartition(parts).select(F.col("id").cast("string").alias("unit_id"))
    made = units.repeat(base, 3).withColumn("u", rng.u01("_repetition_seed", "x"))
    total = made.agg(F.round(F.sum("u"), 9), F.countDistinct("unit_id")).first()
    assert total[1] == 600 and total[0] == pytest.approx(305.2, abs=25)
    assert made.filter("unit_id = '7__rep0002'").first().u == pytest.approx(
        spark.range(1).select(rng.u01(rng.hash_seed(F.lit("7")) + 2, "x")).first()[0]
    )


def test_seeds_are_not_correlated(spark):
    base = spark.range(4000).select(F.col("id").cast("string").alias("unit_id"))
    share = units.repeat(base, 2).agg(F.avg((rng.u01("_repetition_seed", "c") < 0.5).cast("int"))).first()[0]
    assert 0.47 < share < 0.53


def test_chunks(spark):
    made = units.assign_chunks(spark.range(1050).select(F.col("id").cast("string").alias("unit_id"), "id"), -1, ["id"])
    sizes = {r.chunk_name: r["count"] for r in made.groupBy("chunk_name").count().collect()}
    assert sizes["chunk_000"] == 100 and sizes["chunk_010"] == 50 and len(sizes) == 11


def test_fan_out_edges(spark):
    big = list(range(1001))
    rows = [("p", big, "keep"), ("none", None, "x"), ("empty", [], "y"), ("one", [5], "z")]
    df = spark.createDataFrame(rows, "unit_id string, xs array<int>, note string")
    kids = fanout.fan_out(df, "xs", "x")
    assert kids.count() == 1002
    assert kids.filter("x = 1000").first().unit_id == "p__fan1000"
    one = kids.filter("_fan_parent_id = 'one'").first()
    assert (one.unit_id, one._fan_index, one.note, one.xs) == ("one__fan000", 0, "z", [5])
    assert "xs" not in fanout.fan_out(df, "xs", "x", drop_array=True).columns
    back = kids.filter("_fan_parent_id = 'p'").groupBy("_fan_parent_id").agg(F.sort_array(F.collect_list("x"))).first()[1]
    assert back == big
    odd = spark.createDataFrame([("a", "[1,2]"), ("b", '"text"')], "unit_id string, j string").withColumn("v", F.parse_json("j"))
    assert sorted(r.unit_id for r in fanout.fan_out(odd, "v", "x").select("unit_id").collect()) == ["a__fan000", "a__fan001"]
