"""Closed objects, further keywords, and schemas that are refused."""

import json

import pytest
from pyspark.sql import functions as F

from recordforge.operators.rules import check_rules
from recordforge.operators.schema_check import SchemaError, check_schema

SCHEMA = {
    "type": "object",
    "additionalProperties": False,
    "required": ["a"],
    "properties": {
        "a": {"type": "integer", "exclusiveMinimum": 0, "exclusiveMaximum": 10},
        "b": {"type": "string", "pattern": "^x+$"},
        "c": {"const": "yes"},
        "d": {"type": "object", "additionalProperties": False, "properties": {"e": {"type": "string", "minLength": 2}}},
    },
}


def judged(spark, docs, schema, **how):
    table = spark.createDataFrame([(i, d if isinstance(d, str) else json.dumps(d)) for i, d in enumerate(docs)], "i int, raw string")
    rows = check_schema(table, schema, "raw", **how).select("i", "errors").collect()
    return {r.i: [(e.path, e.validator, e.message) for e in r.errors] for r in rows}


def test_closed_objects(spark):
    docs = [
        {"a": 1}, {"a": 0}, {"a": 10}, {"a": 2, "z": 1, "y": 1}, {"a": 3, "b": "yx"}, {"a": 3, "b": "xx", "c": "yes"},
        {"a": 3, "c": "no"}, {"a": 3, "d": {"e": "ok", "f": 1}}, {"a": 3, "d": {"e": "k"}},
    ]
    got = judged(spark, docs, SCHEMA)
    assert got[0] == got[5] == []
    assert got[1] == [("$.a", "exclusiveMinimum", "0 is less than or equal to the minimum of 0")]
    assert got[2] == [("$.a", "exclusiveMaximum", "10 is greater than or equal to the maximum of 10")]
    assert got[3] == [("$", "additionalProperties", "Additional properties are not allowed ('y', 'z' were unexpected)")]
    assert got[4] == [("$.b", "pattern", "'yx' does not match '^x+$'")]
    assert got[6] == [("$.c", "const", "'yes' was expected")]
    assert got[7] == [("$.d", "additionalProperties", "Additional properties are not allowed ('f' was unexpected)")]
    assert [e[:2] for e in got[8]] == [("$.d.e", "minLength")]


@pytest.mark.parametrize("repair", [False, True])
def test_non_finite_numbers(spark, repair):
    got = judged(spark, ['{"a": NaN}'], {"type": "object", "properties": {"a": {"type": "number"}}}, repair=repair)
    assert ("$.a", "non_finite_number") in [e[:2] for e in got[0]]


@pytest.mark.parametrize(
    "schema",
    [
        {"type": "object", "properties": {"a": {"anyOf": []}}},
        {"type": "object", "properties": {"a": {"$ref": "#/$defs/none"}}},
        {"type": "object", "$defs": {"n": {"type": "object", "properties": {"next": {"$ref": "#/$defs/n"}}}}, "properties": {"a": {"$ref": "#/$defs/n"}}},
    ],
)
def test_refused_schemas(spark, schema):
    with pytest.raises(SchemaError):
        check_schema(spark.createDataFrame([("{}",)], "raw string"), schema, "raw")


def test_filters_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([(i % 3, i, '{"a": 1}') for i in range(30)], "step int, i int, raw string").write.partitionBy("step").parquet(path)
    table = spark.read.parquet(path)
    for df in (
        check_rules(table, {"rules": [{"name": "r", "expr": "i > 5"}]}).filter("step = 1"),
        check_schema(table, {"type": "object", "properties": {"a": {"type": "integer"}}}, "raw").filter("step = 1"),
    ):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [isnotnull(step" in plan, plan[:2000]
        assert df.count() == 10
    assert check_rules(table, {"rules": [{"name": "r", "expr": "i > 5"}]}).filter(F.size("errors") > 0).count() == 6
