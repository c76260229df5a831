"""Heavy work on rows runs once, in as many tasks as there are cores."""

from pyspark.sql import functions as F

from recordforge.operators import derive
from recordforge.plans import checks, deep_checks, derived, registry
from recordforge.sources import files, sinks
from tests.test_queries import SF


def _optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def _walk(spark, **options):
    rows = spark.range(0, 40, 1, 1).withColumn("unit_id", F.col("id").cast("string"))
    return derive.iterate(
        rows, {"place": F.lit(5)},
        lambda get, draw: {"place": get("place") + F.when(draw.random("turn") < 0.5, -1).otherwise(1)},
        lambda get: (get("place") <= 0) | (get("place") >= 10), step="walk", **options,
    )


def test_filters_stay_above_a_loop(spark):
    lines = _optimized(_walk(spark, tasks=7).filter("place <= 0 and _metadata.iterations < 60")).splitlines()
    assert any("aggregate(" in x for x in lines)
    assert not [x for x in lines if "Filter" in x and "aggregate(" in x]


def test_rows_are_spread_by_default(spark):
    assert registry.tasks(spark) >= spark.sparkContext.defaultParallelism
    assert derived._walks(spark, SF).rdd.getNumPartitions() == registry.tasks(spark)


def test_walks_are_made_once_for_their_statistics(spark):
    assert "sha2(" not in _optimized(derived.random_walk_stats(spark, SF))


def test_paths_are_handed_over_in_one_piece(spark, tmp_path, monkeypatch):
    """A file costs no call to the JVM of its own, neither when it is listed nor when it is read."""
    for i in range(300):
        at = tmp_path / "run [1]" / "chunks" / f"chunk_{i}"
        at.mkdir(parents=True)
        (at / "last_validated.jsonl").write_text(f'{{"n": {i}}}')
    calls, send = [], type(spark.sparkContext._gateway._gateway_client).send_command
    monkeypatch.setattr(
        type(spark.sparkContext._gateway._gateway_client), "send_command", lambda self, *a, **k: (calls.append(1), send(self, *a, **k))[1]
    )
    got = files.read_step_output(spark, str(tmp_path), "validated", pipeline=["last"])
    assert len(calls) < 3 * 300  # some hundreds whatever the number of files
    assert got.selectExpr("sum(try_variant_get(record, '$.n', 'int'))").first()[0] == sum(range(300))


def test_small_files_are_written_by_many_tasks(spark, tmp_path):
    rows = spark.range(0, 40, 1, 1).selectExpr("concat('f', id) AS filename", "cast(id AS string) AS content")
    seen = []
    status = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("files", "files")
    try:
        assert sinks.write_files(rows, str(tmp_path), tasks=6) == 40
        for job in status.getJobIdsForGroup("files"):
            seen += [status.getStageInfo(s).numTasks for s in status.getJobInfo(job).stageIds if status.getStageInfo(s)]
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert 6 in seen and len(list(tmp_path.glob("f*"))) == 40


def test_schema_checks_are_spread(spark):
    """One row group of orders is one task otherwise."""
    for made in (deep_checks.schema_deep, deep_checks.schema_non_finite):
        assert made(spark, SF).rdd.getNumPartitions() == registry.tasks(spark)


def test_steps_are_spread_before_they_are_parsed(spark):
    """Responses and inputs are narrow rows of few row groups until then."""
    lines = _optimized(checks.judged_step(spark, SF, fix=False)).splitlines()
    assert sum(f"Repartition {2 * spark.sparkContext.defaultParallelism}, true" in x for x in lines) == 2
