import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from recordforge.operators import derive, prompts, rules


def run(spark, df, spec):
    got = rules.check_rules(df, spec).collect()
    return [([e.rule for e in r.errors], [w.rule for w in r.warnings]) for r in got], [[e.message for e in r.errors] for r in got]


def rows(spark, *texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("d", F.parse_json("t"))
    return df.select(F.try_variant_get("d", "$.a", "variant").alias("a"), F.try_variant_get("d", "$.b", "variant").alias("b")).coalesce(1)


def test_required_null_and_absent(spark):
    got, said = run(spark, rows(spark, '{"a": null}', "{}", '{"a": 0}'), {"required": ["a", "c"], "ranges": {"a": [5, 6]}})
    assert [g[0] for g in got] == [["required_a", "required_c"], ["required_a", "required_c"], ["required_c"]]
    assert said[2] == ["Missing required field: 'c'"]


def test_types_by_row(spark):
    df = rows(spark, '{"a": 1}', '{"a": true}', '{"a": null}', "{}", '{"a": 1.5}', '{"a": "x"}')
    got, said = run(spark, df, {"types": {"a": "integer", "b": "odd"}})
    assert [g[0] for g in got] == [[], ["type_a"], ["type_a"], [], ["type_a"], ["type_a"]]
    assert said[1] == ["Field 'a': Expected integer, got bool"] and said[2] == ["Field 'a': Expected integer, got NoneType"]
    got, said = run(spark, rows(spark, '{"b": 1}'), {"types": {"b": "odd"}})
    assert said == [["Field 'b': Unknown type: odd"]]


def test_ranges_count_booleans(spark):
    got, _ = run(spark, rows(spark, '{"a": true}', '{"a": false}', '{"a": "9"}', '{"a": 3}'), {"ranges": {"a": [1, 2]}})
    assert [g[0] for g in got] == [[], ["range_a"], [], ["range_a"]]


def test_enums_ignore_case_of_text_only(spark):
    got, said = run(spark, rows(spark, '{"a": "HIT"}', '{"a": 2}', '{"a": 3}', "{}"), {"enums": {"a": ["hit", 2]}})
    assert [g[0] for g in got] == [[], [], ["enum_a"], []]
    assert said[2] == ["Field 'a' value '3' not in allowed values: ['hit', 2]"]


@pytest.mark.parametrize("expr,fails", [("0", True), ("''", True), ("array()", True), ("1", False), ("'x'", False), ("1/0", True), ("n > 2", False)])
def test_truth_of_rules(spark, expr, fails):
    df = spark.createDataFrame([(5,)], "n int")
    got, said = run(spark, df, {"rules": [{"name": "r", "expr": expr, "error": "bad {n} {zz}"}]})
    assert (got[0][0] == ["r"]) == fails
    if expr == "1/0":
        assert said[0][0].startswith("bad 5 {zz} (expression error")


def test_guards_and_levels(spark):
    df = spark.createDataFrame([(1,), (None,)], "n int").coalesce(1)
    spec = {
        "rules": [
            {"name": "a", "expr": "false", "when": "n = 2"},
            {"name": "b", "expr": "false", "when": "n = 1", "level": "warning"},
            {"name": "c", "expr": "n + 1 == 5", "error": "is {_computed}"},
        ]
    }
    got, said = run(spark, df, spec)
    assert got[0] == (["c"], ["b"]) and said[0] == ["is 2"]
    assert got[1] == (["c"], ["a", "b"])


def test_order_of_checks_and_many_rules(spark):
    df = spark.createDataFrame([("x", 99)], "s string, n int")
    many = [{"name": f"r{i}", "expr": f"n < {i}"} for i in range(50)]
    got, _ = run(spark, df, {"types": {"s": "number"}, "ranges": {"n": [0, 5]}, "enums": {"s": ["y"]}, "rules": many})
    assert got[0][0] == ["type_s", "range_n", "enum_s", *[f"r{i}" for i in range(50)]]


def test_division_by_zero_outside_rules_still_fails(spark):
    rules.check_rules(spark.range(1), {"rules": [{"name": "x", "expr": "1/0 > 0"}]}).collect()
    assert spark.conf.get("spark.sql.ansi.enabled") == "true"


def test_iterate_limit_and_stream_of_draws(spark):
    df = spark.range(500).select(F.col("id").cast("string").alias("unit_id"))
    never = derive.iterate(df, {"n": F.lit(0)}, lambda g, d: {"n": g("n") + 1}, lambda g: F.lit(False), max_iter=37)
    assert {(r.n, r._metadata.iterations, r._metadata.timeout) for r in never.collect()} == {(37, 37, True)}
    first = derive.iterate(df, {"n": F.lit(0)}, lambda g, d: {"n": g("n") + 1}, lambda g: F.lit(True))
    assert {(r.n, r._metadata.timeout) for r in first.collect()} == {(1, False)}
    walk = derive.iterate(
        df, {"p": F.lit(5)}, lambda g, d: {"p": g("p") + F.when(d.random("t") < 0.5, -1).otherwise(1)}, lambda g: (g("p") <= 0) | (g("p") >= 10)
    )
    share = walk.agg(F.avg((F.col("p") <= 0).cast("int"))).first()[0]
    assert 0.43 < share < 0.57


def test_prompts_are_strict(spark):
    df = spark.createDataFrame([("u", ("n", 3))], "unit_id string, item struct<name:string,k:int>")
    got = prompts.render_prompts(df, "Hi {{ item.name | upper }} {{item.k}}\n").first().prompt
    assert got == "Hi N 3\n"
    with pytest.raises(AnalysisException):
        prompts.render_prompts(df, "{{ nobody }}")


def test_derive_error_policies(spark):
    df = spark.createDataFrame([("a", 0), ("b", 2)], "unit_id string, n int")
    flagged = derive.derive(df, {"r": "4 / n", "s": "r + 1"}).orderBy("unit_id").collect()
    assert [(r.r, r._expr_error) for r in flagged] == [(None, "r"), (2.0, None)]
    assert derive.derive(df, {"r": "4 / n"}, on_error="drop").count() == 1
    with pytest.raises(Exception, match="failed for unit a"):
        derive.derive(df, {"r": "4 / n"}, on_error="fail").collect()


def test_hidden_fields_stay_out_of_expressions(spark):
    df = spark.createDataFrame([("a", 7, "raw")], "unit_id string, _repetition_seed bigint, _raw_text string")
    got = derive.derive(df, {"x": "_seed"}, on_error="ignore").first()
    assert got.x == 7 and got._repetition_seed == 7 and got._raw_text == "raw"
    with pytest.raises(AnalysisException):
        derive.derive(df, {"x": "_raw_text"})
