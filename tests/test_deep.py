"""Deep schemas: planning time, equality of the staged and the nested form, paths of odd numbers; products and joined names."""

import itertools
import json
import random
import time

import pytest
from pyspark.sql import functions as F

from recordforge.operators import schema_check, units
from recordforge.plans.deep_checks import _deep_schema


def test_deep_schemas_plan_fast(spark):
    df = spark.createDataFrame([("{}",)], "t string")
    schema_check.check_schema(df, {"type": "object"}, "t").collect()
    took = []
    for _ in range(3):
        start = time.perf_counter()
        checked = schema_check.check_schema(df, _deep_schema(), "t")
        checked._jdf.queryExecution().executedPlan()
        took.append(time.perf_counter() - start)
    assert min(took) < 6  # about two seconds on an idle machine; doubling per level took minutes


def random_schema(r: random.Random, depth: int) -> dict:
    kind = r.choice(["integer", "number", "boolean", "string", "enum", "array", "object", "object"] if depth else ["integer", "enum"])
    if kind == "enum":
        return {"enum": ["On", "Off"]}
    if kind == "array":
        return {"type": "array", "items": random_schema(r, depth - 1), "maxItems": 2}
    if kind == "object":
        names = r.sample("abcd", r.randint(1, 3))
        extra = r.choice([None, False, {"type": "integer"}])
        return {
            "type": "object", "properties": {n: random_schema(r, depth - 1) for n in names}, "required": r.sample("abcd", 1),
        } | ({} if extra is None else {"additionalProperties": extra})
    return {"type": kind} | ({"minimum": 3} if kind in ("integer", "number") else {})


def random_value(r: random.Random, depth: int):
    kind = r.randint(0, 8 if depth else 5)
    if kind < 6:
        return r.choice([5, "7", 2.0, 4.5, True, "false", None, "on", "shadow off | x", "word"])
    if kind == 6:
        return [random_value(r, depth - 1) for _ in range(r.randint(0, 3))]
    return {n: random_value(r, depth - 1) for n in r.sample("abcd", r.randint(0, 4))}


def test_staged_objects_equal_nested_ones(spark, monkeypatch):
    r = random.Random(4)
    spots = schema_check._spots
    for _ in range(5):
        schema = {"type": "object", "properties": {n: random_schema(r, 3) for n in "abc"}, "required": ["a"]}
        rows = [(i, json.dumps({n: random_value(r, 3) for n in r.sample("abcd", 3)})) for i in range(60)]
        df = spark.createDataFrame(rows, "i int, t string")

        def judged():
            made = schema_check.check_schema(df, schema, "t").withColumn("data", F.to_json("data"))
            return {
                x.i: (x.data and json.loads(x.data), sorted(map(tuple, x.errors)), sorted(map(tuple, x.coercions)), x.is_valid)
                for x in made.collect()
            }

        staged = judged()

        def only_top(s, defs):
            found = spots(s, defs)
            kept = [found[0], *[x._replace(kind="lambda") if x.kind == "object" else x for x in found[1:] if x.depth == 1]]
            kept = [x._replace(number=n, children=[]) for n, x in enumerate(kept)]
            return [kept[0]._replace(children=list(range(1, len(kept)))), *kept[1:]]

        monkeypatch.setattr(schema_check, "_spots", only_top)
        assert judged() == staged
        monkeypatch.setattr(schema_check, "_spots", spots)
        assert any(e for _, e, _, _ in staged.values()) and any(n for _, _, n, _ in staged.values())


def test_paths_of_odd_numbers(spark):
    rows = ['{"o": {"a": NaN}}', '{"x": [1, [2], {"q": 1}, {"z": {}, "y": -Infinity}]}', '{"k\\"[,": [Infinity, "NaN"], "o": {"a": "5"}}', "[NaN]"]
    schema = {"type": "object", "properties": {"o": {"type": "object", "properties": {"a": {"type": "number"}}}}}
    df = spark.createDataFrame(list(enumerate(rows)), "i int, t string")
    for repair in (False, True):
        got = [[e.path for e in r.errors] for r in schema_check.check_schema(df, schema, "t", repair=repair).orderBy("i").collect()]
        assert got[:3] == [["$.o.a"], ["$.x[3].y"], ['$.k"[,[0]']]
        assert got[3] == ["$"]


def test_own_columns_survive(spark):
    df = spark.createDataFrame([('{"a": "5"}', 1, 2, 3)], "t string, _root int, _F1 int, __s0 int")
    r = schema_check.check_schema(df, {"type": "object", "properties": {"a": {"type": "integer"}}}, "t").first()
    assert (r._root, r._F1, r["__s0"], r.is_valid) == (1, 2, 3, True)


def listed(spark, names):
    return spark.createDataFrame([(n,) for n in names], "id string")


def test_joined_names(spark):
    r = random.Random(8)
    ambiguous = 0
    made = [
        [sorted({"-".join(r.choice("ab") for _ in range(r.randint(1, 3))) for _ in range(r.randint(1, 4))}) for _ in range(r.randint(1, 3))]
        for _ in range(5)
    ]
    made += [[["a", "a-b"], ["b-c", "c"]], [["a-b", "a", "b", "b-b"]] * 2, [["x", "x-y"], ["y-z", "w"], ["v"]]]
    for lists in made:
        ids = ["-".join(c) for c in itertools.product(*lists)]
        placed = [units._indexed(listed(spark, x), ["id"], None, F.col("id"))[0] for x in lists]
        assert units.ambiguous_names(placed) == (len(set(ids)) < len(ids)), lists
        ambiguous += len(set(ids)) < len(ids)
    assert ambiguous


def test_generation_refuses_ids_that_clash(spark):
    with pytest.raises(units.GenerationError):
        units.generate_units(listed(spark, ["a-b", "a", "b", "b-b"]), "permutation", ["x", "y", "z"])
    clash = {"lefts": listed(spark, ["a", "a-b"]), "rights": listed(spark, ["b-c", "c"])}
    with pytest.raises(units.GenerationError):
        units.generate_units(clash, "cross_product", ["left", "right"])
    order = {"lefts": ["id"], "rights": ["id"]}
    assert units.generate_units(clash, "cross_product", ["left", "right"], max_units=2, order_by=order).count() == 2  # a-b-c, a-c
    fine = {"lefts": listed(spark, ["a-1", "b-2"]), "rights": listed(spark, ["x", "y-z"])}
    assert units.generate_units(fine, "cross_product", ["left", "right"]).count() == 4


@pytest.mark.parametrize("block", [4096, 3])
def test_products_in_nested_order(spark, monkeypatch, block):
    monkeypatch.setattr(units, "BLOCK_ITEMS", block)
    for n, k, most in [(5, 3, None), (5, 3, 17), (4, 4, None), (6, 1, None), (6, 2, 7)]:
        names = [f"i{j}" for j in range(n)]
        got = sorted((u._unit_pos, u.unit_id) for u in units.permutations(listed(spark, names), [f"p{i}" for i in range(k)], "id", ["id"], None, most).collect())
        assert got == list(enumerate("-".join(c) for c in itertools.permutations(names, k)))[:most]
    for sizes, most in [((3, 4, 2), None), ((7, 11), 13), ((1, 1, 9), 5), ((10, 2, 3), 23), ((5,), 3), ((0, 4), None)]:
        lists = [[f"{i}_{j:02d}" for j in range(n)] for i, n in enumerate(sizes)]
        groups = {f"g{i}": listed(spark, x) for i, x in enumerate(lists)}
        made = units.cross_product(groups, order_by={g: ["id"] for g in groups}, max_units=most)
        got = sorted((u._unit_pos, u.unit_id) for u in made.collect())
        assert got == list(enumerate("-".join(c) for c in itertools.product(*lists)))[:most]


def test_products_do_not_move(spark):
    """All exchanges lie below the generators that open the blocks."""
    groups = {"as": listed(spark, [f"a{i}" for i in range(300)]), "bs": listed(spark, [f"b{i}" for i in range(200)])}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        made = units.generate_units(groups, "cross_product", ["a", "b"])
        plan = made._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    lines = plan.splitlines()
    opened = next(i for i, x in enumerate(lines) if "Generate explode" in x)
    assert "Exchange" in plan and not any("Exchange" in x for x in lines[:opened])
    assert made.count() == 60_000
