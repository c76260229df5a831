from pyspark.sql import functions as F

from recordforge.operators import integrity, ledger, reports, validate
from recordforge.streaming import jobs

SCHEMA = {"type": "object", "required": ["score"], "properties": {"score": {"type": "integer", "minimum": 0}}}


def results(spark, rows):
    df = spark.createDataFrame(rows, "unit_id string, t string")
    return df.select("unit_id", F.expr("cast(parse_json(t) as map<string,variant>)").alias("data"))


def test_every_input_is_valid_or_failed_once(spark):
    inputs = spark.createDataFrame([(f"u{i}", i) for i in range(6)], "unit_id string, base int")
    sent = results(spark, [("u0", '{"score": "7"}'), ("u1", '{"score": -1}'), ("u2", '{"note": 1}'), ("u3", '{"score": 1}'), ("zz", '{"score": 5}')])
    spec = {"rules": [{"name": "up", "expr": "score > base"}]}
    judged = validate.validate_step(sent, inputs, SCHEMA, spec, "s", {"base": "bigint"})
    got = {r.unit_id: (r.status, r.failure_stage, [e.rule for e in r.errors]) for r in judged.collect()}
    assert got == {
        "u0": ("valid", None, []),
        "u1": ("failed", "schema_validation", ["schema_minimum"]),
        "u2": ("failed", "schema_validation", ["schema_required"]),
        "u3": ("failed", "validation", ["up"]),
        "u4": ("failed", "pipeline_internal", ["pipeline_internal"]),
        "u5": ("failed", "pipeline_internal", ["pipeline_internal"]),
        "zz": ("failed", "validation", ["up"]),
    }
    ok, bad = validate.valid_rows(judged), validate.failed_rows(judged)
    assert ok.count() + bad.count() == 7
    data = {r.unit_id: r.s for r in judged.select("unit_id", F.try_variant_get("data", "$.score", "string").alias("s")).collect()}
    assert data["u0"] == "7"


def test_results_without_id_are_kept_apart(spark):
    inputs = spark.createDataFrame([("a", 1)], "unit_id string, base int")
    judged = validate.validate_step(results(spark, [(None, '{"x": 1}'), (None, '{"x": 1}')]), inputs, SCHEMA, None, "s")
    assert judged.filter("unit_id is null").count() == 2 and judged.count() == 3


def test_no_schema_skips_the_first_phase(spark):
    inputs = spark.createDataFrame([("a", 1)], "unit_id string, base int")
    judged = validate.validate_step(results(spark, [("a", '{"score": "x"}')]), inputs, None, {"rules": [{"name": "r", "expr": "base = 1"}]}, "s", {"base": "int"})
    assert judged.first().status == "valid"


def test_budget_edges(spark):
    rows = [("a", "validation", 2), ("b", None, 3), ("c", "odd", 0), ("d", "schema_validation", None), ("a", None, 0)]
    df = spark.createDataFrame([("s", *r) for r in rows], "step string, unit_id string, failure_stage string, retry_count int")
    got = {r.unit_id: (r.retry_count, r.decision) for r in ledger.retry_budget(df).collect()}
    assert got == {"a": (2, "retry"), "b": (3, "permanent"), "d": (0, "retry")}
    assert ledger.retry_budget(df, by_stage=False).count() == 4


def test_late_success_clears_a_failure(spark):
    bad = spark.createDataFrame([("s", "a", 1), ("s", "b", 2), ("t", "b", 3)], "step string, unit_id string, at int")
    good = spark.createDataFrame([("s", "a"), ("t", "b")], "step string, unit_id string")
    assert [(r.step, r.unit_id) for r in ledger.unresolved_failures(bad, good, "at").collect()] == [("s", "b")]


def test_rounds_never_exceed_the_budget(spark):
    bad = spark.createDataFrame([("s", f"u{i}", "validation", i % 4) for i in range(20)], "step string, unit_id string, failure_stage string, retry_count int")
    inputs = bad.select("step", "unit_id")

    def attempt(due, n):
        return due.filter("unit_id = 'u4'"), due.filter("unit_id <> 'u4'").withColumn("failure_stage", F.lit("validation")).select(*bad.columns)

    ok, left, _ = ledger.retry_rounds(bad, inputs, attempt)
    assert [r.unit_id for r in ok.collect()] == ["u4"]
    assert left.count() == 19 and left.agg(F.max("retry_count")).first()[0] == 3


def test_verify_counts(spark):
    units = spark.createDataFrame([(f"u{i}",) for i in range(5)], "unit_id string")
    out = spark.createDataFrame([("a", "u0"), ("a", "u0"), ("a", "u1"), ("a", "x"), ("b", "u0")], "step string, unit_id string")
    bad = spark.createDataFrame([("a", "u2")], "step string, unit_id string")
    got = {r.step: r.asDict() for r in integrity.verify_run(units, out, bad, ["a", "b"]).collect()}
    assert {k: got["a"][k] for k in ("expected", "valid", "failed", "missing", "duplicated", "orphaned", "status")} == {
        "expected": 5, "valid": 3, "failed": 1, "missing": 2, "duplicated": 1, "orphaned": 1, "status": "ERROR",
    }
    assert (got["b"]["expected"], got["b"]["missing"]) == (3, 2)


def test_completeness_at_ninety_percent(spark):
    rows = [(10, 9, 0, False), (10, 9, 0, True), (10, 8, 0, False), (10, 5, 5, True), (0, 0, 0, False), (10, 0, 0, False)]
    df = spark.createDataFrame(rows, "expected int, valid int, failed int, retry_marked boolean").coalesce(1)
    assert [r.skip for r in integrity.completeness(df).collect()] == [True, False, False, True, False, False]


def test_funnel_base_changes_at_fan_out(spark):
    units = spark.createDataFrame([("u0",), ("u1",)], "unit_id string")
    out = spark.createDataFrame([("split", f"c{i}") for i in range(10)] + [("check", f"c{i}") for i in range(4)], "step string, unit_id string")
    got = {r.step: r for r in reports.funnel(units, out, out.limit(0), ["split", "check", "never"], ["split"]).collect()}
    assert (got["split"].valid, got["check"].lost, got["check"].yield_pct, got["never"].valid) == (10, 6, 40.0, 0)


def test_stream_equals_batch_over_many_micro_batches(spark, tmp_path):
    src = str(tmp_path / "in")
    rows = spark.range(300).select(F.lit("s").alias("step"), (F.col("id") % 50).cast("string").alias("unit_id"), (F.col("id") % 5).cast("int").alias("retry_count"), (F.col("id") == 7).alias("ok"))
    rows.repartition(6).write.parquet(src)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(src)
    jobs.upserts(jobs.retry_budget(stream), str(tmp_path / "out"), str(tmp_path / "mark"))
    got = jobs.latest(spark, str(tmp_path / "out"), jobs.merge_budget()).select("step", "unit_id", "retry_count", "decision")
    want = jobs.retry_budget(rows).select("step", "unit_id", "retry_count", "decision")
    assert sorted(got.collect()) == sorted(want.collect())


def test_stream_cost_cap_carries_over_micro_batches(spark, tmp_path):
    src = str(tmp_path / "in")
    rows = spark.range(100).select("id", F.lit("r").alias("run"), F.lit(1.0).alias("cost"))
    rows.coalesce(1).write.parquet(src)
    rows.withColumn("id", F.col("id") + 100).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(src)
    jobs.cost_cap(stream, 150.0, "cost", ["id"], ["run"], str(tmp_path / "out"), str(tmp_path / "sum"), str(tmp_path / "mark"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 150


def test_one_row_per_key_depends_on_the_rows_alone(spark):
    rows = [("a", 1, "x"), ("a", 3, "b"), ("a", 2, "z"), ("b", 5, "q"), (None, 9, "n")]
    for parts in (1, 4):
        df = spark.createDataFrame(rows, "k string, n int, t string").repartition(parts)
        assert sorted(map(tuple, validate.one_per_key(df, "k").collect())) == [("a", 3, "b"), ("b", 5, "q")]
        ranked = df.withColumn("_r", F.col("t"))
        assert sorted(map(tuple, validate.one_per_key(ranked, "k", "_r").collect())) == [("a", 2, "z"), ("b", 5, "q")]
    once = spark.createDataFrame([("a", 1), (None, 2)], "k string, n int")
    assert validate.one_per_key(once, "k", unique=True).collect() == [("a", 1)]
    assert "Exchange" not in validate.one_per_key(once, "k", unique=True)._jdf.queryExecution().executedPlan().toString()


def test_inputs_in_the_order_asked_for(spark):
    sent = results(spark, [("a", '{"score": 5}')])
    inputs = spark.createDataFrame([("a", 1, 9), ("a", 2, 8)], "unit_id string, base int, at int")
    for order, base in (("at", 1), ("base", 2)):
        judged = validate.validate_step(sent, inputs, None, {"rules": [{"name": "r", "expr": "base > 0"}]}, "s", {"base": "int"}, inputs_order=[order])
        assert [r.b for r in judged.select(F.try_variant_get("data", "$.base", "int").alias("b")).collect()] == [base]
