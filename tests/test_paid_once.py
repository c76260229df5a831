"""Answers that are paid once, files of units, listings of step files, and texts cut at a word."""

import gzip
import os

import pytest
from pyspark.sql import functions as F

from recordforge.operators import infer, prompts
from recordforge.sources import files, sinks


@pytest.fixture
def calls(tmp_path):
    folder = tmp_path / "calls"
    folder.mkdir()
    return folder


def model(folder, fails=()):
    def fn(unit_id, prompt):
        # Calls run in other processes: each leaves a file.
        with open(os.path.join(folder, f"{unit_id}-{len(os.listdir(folder))}-{os.getpid()}-{os.urandom(3).hex()}"), "w"):
            pass
        if unit_id in fails:
            raise ValueError("refused")
        if unit_id == "dies" and not os.path.exists(f"{folder}/../alive"):
            raise infer.AuthFailed("no key")
        return {"text": prompt.upper(), "input_tokens": 1}

    return fn


def n_calls(folder):
    return len(os.listdir(folder))


def test_answers_are_paid_once(spark, tmp_path, calls):
    asked = spark.createDataFrame([(f"u{i}", f"p{i % 3}") for i in range(12)] + [("u1", "p1")], "unit_id string, prompt string").repartition(3)
    log = str(tmp_path / "log")
    made = infer.infer_once(asked, model(str(calls), {"u5"}), log, waves=2)
    for _ in range(2):
        got = {(r.unit_id, r.raw_text, r.error) for r in made.collect()}
    assert n_calls(calls) == 12  # two reads and a repeated row cost nothing
    assert ("u5", None, "refused") in got and ("u4", "P1", None) in got and made.count() == 13
    again = infer.infer_once(asked, model(str(calls)), log)
    assert n_calls(calls) == 13 and {r.error for r in again.collect()} == {None}
    more = asked.union(spark.createDataFrame([("new", "p")], asked.schema))
    assert infer.infer_once(more, model(str(calls)), log).count() == 14 and n_calls(calls) == 14
    assert infer.infer_once(asked.limit(0), model(str(calls)), str(tmp_path / "none")).count() == 0


def test_a_failed_job_loses_one_wave(spark, tmp_path, calls):
    asked = spark.createDataFrame([(f"u{i}", "p") for i in range(20)] + [("dies", "p")], "unit_id string, prompt string").coalesce(1)
    log = str(tmp_path / "log")
    with pytest.raises(Exception, match="no key"):
        infer.infer_once(asked, model(str(calls)), log, waves=5)
    kept = spark.read.parquet(log).count() if os.path.exists(log) else 0
    before = n_calls(calls)
    (tmp_path / "alive").write_text("")
    assert infer.infer_once(asked, model(str(calls)), log, waves=5).count() == 21
    assert n_calls(calls) == before + 21 - kept


def test_files_of_units(spark, tmp_path):
    rows = [(1, "a/b", "one"), (2, "same", "x"), (3, "same", "y"), (4, "", "z"), (5, "c", None), (6, "d", "é")]
    df = spark.createDataFrame(rows, "unit_id int, name string, body string").repartition(3)
    told = sinks.extract_units(df, "name", "body", str(tmp_path / "out"), gzip=True).first()
    assert (told.extracted, told.errors) == (2, 4)
    for _ in range(2):  # a repeated job leaves no doubles
        sinks.extract_units(df, "name", "body", str(tmp_path / "out"), gzip=True)
    found = {n: gzip.decompress((tmp_path / "out" / n).read_bytes()).decode() for n in os.listdir(tmp_path / "out") if not n.endswith(".crc")}
    assert found == {"a_b.gz": "one", "d.gz": "é"}


def test_twins_and_last_steps(spark, tmp_path):
    def put(name, text, zipped=False):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(gzip.compress(text.encode()) if zipped else text.encode())

    put("data.jsonl.gz", '{"a": 1}\n\nbad\n{"a": 2}', True)
    assert files.read_jsonl(spark, str(tmp_path / "data.jsonl"), "a int").count() == 2
    assert files.read_jsonl(spark, str(tmp_path / "missing.jsonl"), "a int").count() == 0
    assert files.read_jsonl(spark, [str(tmp_path / "missing.jsonl"), str(tmp_path / "data.jsonl")]).count() == 2
    put("r/one/chunks/c1/s_validated.jsonl", '{"n": 1}')
    put("r/one/chunks/c1/s_validated.jsonl.gz", '{"n": 2}', True)
    put("r/one/chunks/c2/t_validated.jsonl.gz", '{"n": 3}', True)
    put("r/two/chunks/c1/s_validated.jsonl.gz", '{"n": 4}', True)
    put("r/two/chunks/c1/t_failures.jsonl", '{"n": 5}')
    read = lambda **kw: sorted(
        (r.run, r.step, r.n)
        for r in files.read_step_output(spark, str(tmp_path / "r"), "validated", **kw)
        .select("run", "step", F.try_variant_get("record", "$.n", "int").alias("n")).collect()
    )
    assert read(pipeline=["s", "t"]) == [("one", "t", 3), ("two", "s", 4)]
    assert read(step="s") == [("one", "s", 1), ("two", "s", 4)]
    assert read(step="none") == []
    # Only the wanted files are opened.
    opened = files.read_step_output(spark, str(tmp_path / "r"), "validated", pipeline=["s", "t"])
    assert {p.rpartition("/r/")[2] for p in opened.inputFiles()} == {"one/chunks/c2/t_validated.jsonl.gz", "two/chunks/c1/s_validated.jsonl.gz"}


@pytest.mark.parametrize(("most", "cut"), [(21, "one two three four five"), (10, "one..."), (15, "one two..."), (17, "one two three..."), (18, "one two three four five"), (3, "..."), (5, "on...")])
def test_truncated_at_words(spark, most, cut):
    df = spark.createDataFrame([("one two three four five",)], "t string")
    assert df.select(prompts.truncated(F.col("t"), most)).first()[0] == cut
