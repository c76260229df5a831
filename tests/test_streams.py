"""Streams over several micro-batches: state that shrinks, late rows, compacted tables, totals of one table."""

import os
import tempfile
import time

import pytest
from pyspark.sql import functions as F

from recordforge.sources import folders
from recordforge.streaming import jobs

ATTEMPTS = "step string, unit_id string, retry_count int, ok boolean"
LOG = "run string, ts timestamp, level string"


@pytest.fixture
def base():
    return tempfile.mkdtemp(prefix="stream-")


def arrive(spark, base, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{base}/in")


def test_budget_state_shrinks_and_late_success_clears(spark, base):
    merge = jobs.merge_budget(2)

    def run():
        stream = jobs.stream_table(spark, f"{base}/in", ATTEMPTS, per_trigger=1)
        query = jobs.upserts(jobs.retry_budget(stream, 2, "1 second"), f"{base}/out", f"{base}/mark", merge, every=3)
        return query.recentProgress[-1].stateOperators[0].numRowsTotal

    first = [("gen", f"u{i}", i % 4, False) for i in range(40)] + [("gen", "fine", None, True), ("gen", "fine", 1, False)]
    arrive(spark, base, first, ATTEMPTS)
    assert run() == 41
    decided = {r.unit_id: r.decision for r in jobs.latest(spark, f"{base}/out", merge).collect()}
    assert decided["fine"] == "resolved" and decided["u1"] == "retry" and decided["u2"] == "permanent"
    for k in range(4):
        time.sleep(2.1)
        arrive(spark, base, [("gen", f"u{k}", None, True)], ATTEMPTS)
        left = run()
    assert left <= 2  # of 41 units
    now = {r.unit_id: (r.retry_count, r.decision) for r in jobs.latest(spark, f"{base}/out", merge).collect()}
    assert now["u2"] == (2, "resolved") and now["u3"] == (3, "resolved") and now["u6"] == (2, "permanent")
    assert len(now) == 41 and jobs.latest(spark, f"{base}/out", merge).columns == ["step", "unit_id", "retry_count", "resolved", "decision"]


def test_last_level_of_spans(spark, base):
    merge = jobs.merge_level()
    for n, rows in enumerate([[("a", 100, "ERROR"), ("b", 50, "INFO")], [("a", 90, "INFO"), ("b", 60, "WARN")], [("a", 100, "ERROR")]]):
        made = spark.createDataFrame(rows, "run string, s int, level string").select("run", F.timestamp_seconds("s").alias("ts"), "level")
        made.coalesce(1).write.mode("append").parquet(f"{base}/in")
        stream = jobs.stream_table(spark, f"{base}/in", LOG)
        query = jobs.upserts(jobs.last_level(stream, keep="1 second"), f"{base}/out", f"{base}/mark", merge)
        if n:
            assert query.recentProgress[-1].stateOperators[0].numRowsTotal <= 2
        time.sleep(1.2)
    got = {r.run: (r.last_ts.timestamp(), r.last_level) for r in jobs.latest(spark, f"{base}/out", merge).collect()}
    assert got == {"a": (100.0, "ERROR"), "b": (60.0, "WARN")}


def test_compaction_keeps_few_tables(spark, base):
    merge = jobs.newest(["k"])
    for n in range(7):
        arrive(spark, base, [(n % 3, n), (10 + n, n)], "k int, v int")
        counts = jobs.stream_table(spark, f"{base}/in", "k int, v int").groupBy("k").agg(F.max("v").alias("v"))
        jobs.upserts(counts, f"{base}/out", f"{base}/mark", merge, every=3)
        names = {e.name for e in folders.children(spark, f"{base}/out")}
        assert len(names) <= 3
        got = {r.k: r.v for r in jobs.latest(spark, f"{base}/out", merge).collect()}
        assert got == {k: max(i for i in range(n + 1) if i % 3 == k) for k in range(min(3, n + 1))} | {10 + i: i for i in range(n + 1)}


def test_cost_cap_reads_one_totals_table(spark, base):
    spent, kept = {}, set()
    for n in range(5):
        rows = [(n * 10 + i, "xy"[i % 2], float(i + 1)) for i in range(6)]
        arrive(spark, base, rows, "id int, run string, cost double")
        stream = jobs.stream_table(spark, f"{base}/in", "id int, run string, cost double")
        jobs.cost_cap(stream, 20.0, "cost", ["id"], ["run"], f"{base}/out", f"{base}/totals", f"{base}/mark")
        for i, run, cost in rows:
            if spent.get(run, 0) < 20:
                kept.add(i)
            spent[run] = spent.get(run, 0) + cost
        tables = folders.children(spark, f"{base}/totals")
        assert len(tables) <= 2
        last = spark.read.parquet(max(tables, key=lambda e: int(e.name.partition("=")[2])).path)
        assert {r.run: r.spent for r in last.collect()} == spent
    assert {r.id for r in spark.read.parquet(f"{base}/out").collect()} == kept


@pytest.mark.parametrize("name", ["plain", "with space"])
def test_stream_of_a_file_or_a_folder(spark, base, name):
    folder = f"{base}/{name}"
    spark.range(20).repartition(2).write.parquet(folder)
    one = next(f"{folder}/{x}" for x in sorted(os.listdir(folder)) if x.endswith(".parquet"))
    for path, n in ((folder, 20), (folder + "/", 20), (one, spark.read.parquet(folders.literal(one)).count())):
        seen = []
        mark = tempfile.mkdtemp(prefix="mark-")
        jobs.each_batch(jobs.stream_table(spark, path, "id long"), lambda rows, _: seen.append(rows.count()), mark)
        assert sum(seen) == n


def test_folders(spark, base):
    assert not folders.exists(spark, f"{base}/none") and folders.children(spark, f"{base}/none") == []
    spark.range(3).coalesce(1).write.json(f"{base}/a/b")
    below = folders.files_below(spark, f"{base}/a")
    assert any(e.name.endswith(".json") and e.is_file and e.size > 0 for e in below)
    assert folders.is_file(spark, below[0].path) and not folders.is_file(spark, f"{base}/a")
    folders.remove(spark, f"{base}/a")
    assert folders.files_below(spark, f"{base}/a") == []
