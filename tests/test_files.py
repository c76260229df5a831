import gzip
import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from recordforge.operators import infer
from recordforge.sources import files, pricing, sinks, vendors


def put(path, lines, zipped=False):
    path.parent.mkdir(parents=True, exist_ok=True)
    text = "\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines) + "\n"
    path.write_bytes(gzip.compress(text.encode()) if zipped else text.encode())


@pytest.fixture
def run_folder(tmp_path):
    base = tmp_path / "runs" / "job_20260101_120000"
    put(base / "chunks/chunk_000/first_step_validated.jsonl", [{"unit_id": "a"}, "", "{bad", {"unit_id": "b"}])
    put(base / "chunks/chunk_001/first_step_validated.jsonl.gz", [{"unit_id": "c"}], zipped=True)
    put(base / "chunks/retry_000/first_step_validated.jsonl", [{"unit_id": "d"}])
    put(base / "chunks/chunk_000/first_step_failures.jsonl", [{"unit_id": "e"}])
    chunks = {"chunk_000": {"state": "first_step_PENDING", "items": 3}, "chunk_001": {"state": "VALIDATED", "items": 1}}
    put(base / "MANIFEST.json", [{"pipeline": ["first_step"], "chunks": chunks, "created": "2026-01-01T12:00:00Z"}])
    put(tmp_path / "runs/_archive/old/MANIFEST.json", [{"created": "2025-01-01T12:00:00Z"}])
    put(tmp_path / "runs/broken/MANIFEST.json", ["{"])
    return str(tmp_path / "runs")


def test_step_files_of_all_chunks(spark, run_folder):
    got = files.read_step_output(spark, run_folder, "validated", pipeline=["first_step"])
    seen = {(r.chunk, r.u, r.step) for r in files.record_fields(got, {"unit_id": "string"}).withColumnRenamed("unit_id", "u").collect()}
    assert seen == {(c, u, "first_step") for c, u in [("chunk_000", "a"), ("chunk_000", "b"), ("chunk_001", "c"), ("retry_000", "d")]}
    assert files.read_step_output(spark, run_folder, "failures").count() == 1
    assert files.read_step_output(spark, run_folder, "validated", pipeline=["first_step", "nothing"]).count() == 4


def test_runs_and_chunks(spark, run_folder):
    runs = files.read_runs(spark, run_folder)
    assert [(r.run, r.pipeline_name, r.mode) for r in runs.collect()] == [("job_20260101_120000", "job", "batch")]
    assert files.read_runs(spark, run_folder, include_archived=True).count() == 2
    got = {r.chunk: (r.step, r.chunk_status, r["items"]) for r in files.run_chunks(runs).collect()}
    assert got == {"chunk_000": ("first_step", "PENDING", 3), "chunk_001": (None, "VALIDATED", 1)}


def test_missing_file_is_empty(spark, tmp_path):
    assert files.read_jsonl(spark, str(tmp_path / "none.jsonl")).count() == 0


def test_items_and_their_errors(spark, tmp_path):
    put(tmp_path / "items.json", ['{"people": [{"id": "x", "n": 1},', '{"id": "y", "n": 2}], "one": 5}'])
    got = files.item_columns(files.read_items(spark, str(tmp_path / "items.json"), "people"), "id string, n int")
    assert [(r.idx, r.id, r.n) for r in got.orderBy("idx").collect()] == [(0, "x", 1), (1, "y", 2)]
    for key, said in (("nobody", "not found"), ("one", "must be a list"), (None, "must be a list")):
        with pytest.raises(PySparkException, match=said):
            files.read_items(spark, str(tmp_path / "items.json"), key).collect()


def test_extract_one_file_per_unit(spark, tmp_path):
    df = spark.createDataFrame([("a/b", "one"), ("", "two"), ("c\\d", "three")], "name string, body string").withColumn("unit_id", F.col("name"))
    out = tmp_path / "out"
    got = sinks.extract_units(df, "name", "body", str(out), gzip=True).first()
    assert (got.extracted, got.errors) == (2, 1)
    assert sorted(p.name for p in out.iterdir()) == ["a_b.gz", "c_d.gz"]
    assert gzip.decompress((out / "a_b.gz").read_bytes()) == b"one"


def test_pricing_document(spark, tmp_path):
    doc = {"providers": {"v": {"default_model": "m", "realtime_multiplier": 2, "models": {"m": {"input_per_million": 1, "output_per_million": 2.5}}}}}
    put(tmp_path / "models.json", [doc])
    got = pricing.load_pricing(spark, str(tmp_path / "models.json")).first()
    assert (got.provider, got.model, got.input_per_million, got.provider_multiplier, got.is_default) == ("v", "m", 1.0, 2.0, True)


def test_requests_written_by_chunk(spark, tmp_path):
    df = spark.createDataFrame([("a", "hi", 0), ("b", "ho", 1)], "unit_id string, prompt string, chunk_id int")
    vendors.write_batch_requests(vendors.batch_requests(df, "gemini", "g"), str(tmp_path / "req"))
    back = spark.read.text(str(tmp_path / "req")).orderBy("chunk_id").collect()
    assert json.loads(back[0].value) == {"key": "a", "request": {"contents": [{"parts": [{"text": "hi"}]}]}}


def test_inference_retries_and_gives_up(spark):
    def fn(unit_id, prompt):
        if prompt == "limit":
            raise infer.RateLimited("slow down")
        if prompt == "boom":
            raise ValueError("boom")
        return {"text": "{}", "input_tokens": 3}

    df = spark.createDataFrame([("a", "ok"), ("b", "limit"), ("c", "boom")], "unit_id string, prompt string")
    got = {r.unit_id: (r.error_type, r.attempts) for r in infer.infer(df, fn, first_wait=0.01).collect()}
    assert got == {"a": (None, 1), "b": ("rate_limit", 3), "c": ("error", 1)}


def test_auth_errors_end_the_job(spark):
    def fn(unit_id, prompt):
        raise infer.AuthFailed("401")

    df = spark.createDataFrame([("a", "x")], "unit_id string, prompt string")
    with pytest.raises(PySparkException, match="401"):
        infer.infer(df, fn).collect()
