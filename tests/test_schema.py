import json

import pytest
from pyspark.sql import functions as F

from recordforge.functions import jsonfix
from recordforge.operators import schema_check


def run(spark, schema, texts, **kw):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = schema_check.check_schema(df, schema, "t", **kw).withColumn("d", F.to_json("data")).orderBy("i").collect()
    return [
        (json.loads(r.d) if r.d else None, [e.rule for e in r.errors], [c.path for c in r.coercions], [e.path for e in r.errors]) for r in got
    ]


def one_field(kind, **more):
    return {"type": "object", "properties": {"x": {"type": kind, **more}}}


COERCIONS = [
    ("integer", '"5"', 5, True), ("integer", '" 5 "', 5, True), ("integer", '"+5"', 5, True), ("integer", '"5.5"', "5.5", False),
    ("integer", "5.0", 5, True), ("integer", "5.5", 5.5, False), ("integer", "true", True, False), ("integer", "null", None, False),
    ("number", '"5"', 5.0, True), ("number", '"1e3"', 1000.0, True), ("number", '"NaN"', "NaN", False), ("number", '"inf"', "inf", False),
    ("number", "7", 7, True), ("boolean", '"true"', True, True), ("boolean", '"FALSE"', False, True), ("boolean", '"yes"', "yes", False),
    ("array", '"[1,2]"', [1, 2], True), ("array", '"foo"', ["foo"], True), ("array", "[]", [], True), ("array", "{}", {}, False),
    ("string", "5", 5, False), ("object", "[]", [], False),
]


def test_coercion_table(spark):
    for kind in {c[0] for c in COERCIONS}:
        cases = [c for c in COERCIONS if c[0] == kind]
        got = run(spark, one_field(kind), [f'{{"x": {c[1]}}}' for c in cases])
        for case, (data, errors, _, _) in zip(cases, got):
            assert data["x"] == case[2] and type(data["x"]) is type(case[2]), case
            assert (errors == []) == case[3], case
            assert case[3] or errors == ["schema_type"], case


def test_enum_decorations(spark):
    schema = {"type": "object", "properties": {"x": {"type": "string", "enum": ["Hit", "stand"]}}}
    got = run(spark, schema, [f'{{"x": "{v}"}}' for v in ("Hit", "hit", "Shadow STAND | maybe", " hit ", "fold")])
    assert [g[0]["x"] for g in got] == ["Hit", "Hit", "stand", "Hit", "fold"]
    assert [g[1] for g in got] == [[], [], [], [], ["schema_enum"]]


def test_tag_objects_and_nested_paths(spark):
    item = {"type": "object", "required": ["tag"], "properties": {"tag": {"type": "string"}, "w": {"type": "integer", "maximum": 9}}}
    schema = {"type": "object", "properties": {"tags": {"type": "array", "minItems": 1, "items": item}}}
    got = run(spark, schema, ['{"tags": "calm"}', '{"tags": [{"tag": "a", "w": "3"}, {"w": 12}]}', '{"tags": []}'])
    assert got[0][0] == {"tags": [{"tag": "calm"}]} and got[0][1] == []
    assert got[1][0]["tags"][0]["w"] == 3 and got[1][2] == ["$.tags[0].w"]
    assert got[1][1] == ["schema_required", "schema_maximum"] and got[1][3] == ["$.tags[1]", "$.tags[1].w"]
    assert got[2][1] == ["schema_minItems"]


def test_bounds_lengths_and_required(spark):
    schema = {
        "type": "object", "required": ["a", "b"],
        "properties": {"a": {"type": "number", "minimum": 0, "maximum": 1}, "b": {"type": "string", "minLength": 2, "maxLength": 3}},
    }
    got = run(spark, schema, ['{"a": 0, "b": "éé"}', '{"a": 1.5, "b": "x"}', '{"a": -1, "b": "wxyz"}', '{"b": null}', "[]", "nope", ""])
    assert got[0][1] == []
    assert got[1][1] == ["schema_maximum", "schema_minLength"]
    assert got[2][1] == ["schema_minimum", "schema_maxLength"]
    assert got[3][1] == ["schema_type", "schema_required"]
    assert got[4][1] == ["schema_type"] and got[4][0] is None
    assert got[5][1] == ["schema_json_parse"] and got[6][1] == ["schema_json_parse"]


def test_non_finite_numbers_are_named(spark):
    got = run(spark, one_field("number"), ['{"x": NaN, "y": "NaN"}', '{"y": [1, -Infinity]}', '{"y": "Infinity"}'])
    assert "schema_non_finite_number" in got[0][1] and "$.x" in got[0][3]
    assert got[1][1] == ["schema_non_finite_number"] and got[1][3] == ["$.y[1]"]
    assert got[2][1] == []


def test_references_stop_at_circles(spark):
    schema = {"type": "object", "properties": {"a": {"$ref": "#/$defs/a"}, "b": {"$ref": "#/$defs/n"}}, "$defs": {"a": {"$ref": "#/$defs/a"}, "n": {"type": "integer"}}}
    got = run(spark, schema, ['{"a": 1, "b": "2"}', '{"b": "x"}'])
    assert got[0][1] == [] and got[0][0]["b"] == 2
    assert got[1][1] == ["schema_type"]


def test_uncoerced_values_can_be_kept(spark):
    got = run(spark, one_field("integer"), ['{"x": "5"}'], coerce=False)
    assert got[0][0] == {"x": "5"} and got[0][1] == []


@pytest.mark.parametrize(
    "text,want",
    [
        ('```json\n{"a": 1}\n```', {"a": 1}), ('so: ```\n[1]\n``` end', [1]), ('{"a": +4}', {"a": 4}), ("[+1, +2,]", [1, 2]),
        ('{"a":1,}', {"a": 1}), ('```json\n{"a": 1}', None), ("plain prose", None), ("", None), (None, None), ("7", 7),
    ],
)
def test_repair(spark, text, want):
    got = spark.createDataFrame([(text,)], "t string").select(F.to_json(jsonfix.repair_json(F.col("t")))).first()[0]
    assert (json.loads(got) if got is not None else None) == want


def test_safe_repair_leaves_good_text_alone(spark):
    df = spark.createDataFrame([('{"a": "x, +4 ,]"}',)], "t string")
    got = df.select(F.to_json(jsonfix.repair_json(F.col("t"))), F.to_json(jsonfix.repair_json(F.col("t"), safe=True))).first()
    assert json.loads(got[0]) == {"a": "x, 4 ]"} and json.loads(got[1]) == {"a": "x, +4 ,]"}


def test_strict_passes_all_or_nothing(spark):
    df = spark.createDataFrame([('{"x": 1}',), ('{"x": "z"}',)], "t string")
    checked = schema_check.check_schema(df, one_field("integer"), "t")
    assert schema_check.strict(checked).count() == 0
    assert schema_check.strict(checked.filter("is_valid")).count() == 1
