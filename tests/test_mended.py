"""Cases in which results used to be wrong: ended runs, repeated ids, strict templates, folders of files."""

import json
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from recordforge.functions.variants import entries
from recordforge.operators import compare, health, ledger, prompts, reports, units, validate
from recordforge.session import checkpoint_dir
from recordforge.sources import files
from recordforge.streaming import jobs

STEPS = ["a", "b", "c"]


def test_failed_chunks_are_past_all_steps(spark):
    rows = [("only_failed", "FAILED"), ("only_failed", "FAILED"), ("mixed", "FAILED"), ("mixed", "b_PENDING"), ("new", "PENDING")]
    chunks = spark.createDataFrame([(r, i, s) for i, (r, s) in enumerate(rows)], "run string, chunk int, state string")
    steps = health.step_status(chunks, STEPS)
    got = {(r.run, r.step): r.status for r in steps.collect()}
    assert [got["only_failed", s] for s in STEPS] == ["complete"] * 3
    assert [got["mixed", s] for s in STEPS] == ["complete", "in_progress", "complete"]
    assert [got["new", s] for s in STEPS] == ["pending"] * 3
    overall = {r.run: r.status for r in health.overall_status(steps).collect()}
    assert overall == {"only_failed": "complete", "mixed": "active", "new": "pending"}


def test_names_that_give_one_id_fail(spark):
    items = spark.createDataFrame([("a b",), ("a_b",), ("c",)], "id string")
    with pytest.raises(units.GenerationError):
        units.generate_units(items, "permutation", positions=["x", "y"])
    good = units.generate_units(items.filter("id <> 'a_b'"), "permutation", positions=["x", "y"])
    assert units.duplicate_ids(good).count() == 0


def test_repeated_ids_are_compared_once(spark):
    a = spark.createDataFrame([("u", 1, None), ("u", 1, "x"), ("u", None, None), ("v", 2, "y")], "unit_id string, p int, q string")
    got = {r.unit_id: r.outcome for r in compare.compare_units(a, a, ["p", "q"]).collect()}
    assert got == {"u": "identical", "v": "identical"}


def test_repeated_results_do_not_multiply(spark):
    sent = [(u, json.dumps({"n": n})) for u, n in (("u", 1), ("u", 2), ("v", 3), (None, 4), (None, 5))]
    results = spark.createDataFrame(sent, "unit_id string, raw string").repartition(1)
    results = results.select("unit_id", entries(F.parse_json("raw")).alias("data"))
    inputs = spark.createDataFrame([("u", 0), ("u", 1), ("v", 0), ("w", 0)], "unit_id string, k int").repartition(1)
    schema = {"type": "object", "properties": {"n": {"type": "integer"}}}
    got = validate.validate_step(results, inputs, schema, None, "s").select("unit_id", "status").collect()
    assert sorted((r.unit_id or "", r.status) for r in got) == [
        ("", "valid"), ("", "valid"), ("u", "valid"), ("v", "valid"), ("w", "failed"),
    ]


def test_templates_are_strict(spark):
    row = spark.createDataFrame([("u", True, "abcdefgh", 0.5)], "unit_id string, flag boolean, name string, x double")
    said = lambda t: prompts.render_prompts(row, t).first().prompt
    assert said("{{ flag }} {{ name | truncate(6) }} {{ name | truncate(2) }} {{name|upper}}") == "True abcdefgh ... ABCDEFGH"
    for bad in ("{% if flag %}x{% endif %}", "{{ name | reverse }}", "{{ name", "{# note #}"):
        with pytest.raises(ValueError):
            said(bad)


def test_no_round_is_due(spark):
    failures = spark.createDataFrame([("s", "u", 3, "validation")], "step string, unit_id string, retry_count int, failure_stage string")
    inputs = spark.createDataFrame([("s", "u", 1)], "step string, unit_id string, x int")
    attempt = lambda due, k: (due.select("step", "unit_id"), failures.limit(0))
    valid, left, rounds = ledger.retry_rounds(failures, inputs, attempt)
    assert (valid.columns, valid.count(), left.count(), rounds) == (["step", "unit_id"], 0, 1, 0)


def test_missing_counts_are_the_chunks(spark):
    failures = spark.createDataFrame([("s", "u", None, 2), ("s", "v", None, 5)], "step string, unit_id string, retry_count int, chunk_n int")
    failures = failures.withColumn("failure_stage", F.lit("validation"))
    inputs = spark.createDataFrame([("s", "u"), ("s", "v")], "step string, unit_id string")
    again = ledger.build_retries(failures, inputs, chunk_count=F.col("chunk_n")).collect()
    assert [(r.unit_id, r.retry_count) for r in again] == [("u", 3)]


def test_messages_are_counted_whole(spark):
    rows = [("s", "x" * 120 + str(i % 2)) for i in range(5)]
    got = reports.top_errors(spark.createDataFrame(rows, "step string, error string")).collect()
    assert sorted(r.n for r in got) == [2, 3] and {len(r.message) for r in got} == {100}


def test_revalidation_keeps_rows_without_id(spark):
    rows = [(None, '{"n": 1}'), (None, '{"n": "x"}'), ("u", '{"n": 2}')]
    failures = spark.createDataFrame(rows, "unit_id string, raw_response string").withColumns(
        {
            "failure_stage": F.lit("validation"), "retry_count": F.lit(1),
            "input": F.lit(None).cast("map<string,variant>"), "errors": validate.no_errors(),
        }
    )
    schema = {"type": "object", "properties": {"n": {"type": "integer"}}}
    got = ledger.revalidate(failures, schema, None, "s").select("unit_id", "outcome").collect()
    assert sorted(((r.unit_id or ""), r.outcome) for r in got) == [("", "promoted"), ("", "still_failing"), ("u", "promoted")]


def test_runs_fall_back_one_by_one(spark, tmp_path):
    for run, step in (("r1", "first"), ("r1", "last"), ("r2", "first")):
        folder = tmp_path / run / "chunks" / "chunk_000"
        folder.mkdir(parents=True, exist_ok=True)
        (folder / f"{step}_validated.jsonl").write_text(json.dumps({"unit_id": step}) + "\n")
    got = files.read_step_output(spark, str(tmp_path), "validated", pipeline=["first", "last"]).select("run", "step").collect()
    assert sorted(map(tuple, got)) == [("r1", "last"), ("r2", "first")]


def test_streams_read_folders(spark, tmp_path):
    table = spark.range(90).withColumn("k", F.col("id") % 3)
    table.repartition(3).write.parquet(str(tmp_path / "events.parquet"))
    table.coalesce(1).write.parquet(str(tmp_path / "one"))
    single = next((tmp_path / "one").glob("part*"))
    for k, path in enumerate((str(tmp_path / "events.parquet"), str(single))):
        out, mark = str(tmp_path / f"out{k}"), str(tmp_path / f"mark{k}")
        jobs.finish(jobs.stream_table(spark, path, table.schema, per_trigger=1), out, mark)
        assert spark.read.parquet(out).count() == 90


def test_clusters_need_a_shared_folder():
    for master, fails in (("local[4]", False), ("local-cluster[3,2,1024]", True), ("yarn", True)):
        context = SimpleNamespace(master=master, getCheckpointDir=lambda: None, setCheckpointDir=lambda d: None)
        session = SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda k, d: None))
        if fails:
            with pytest.raises(ValueError):
                checkpoint_dir(session)
        else:
            assert checkpoint_dir(session)
