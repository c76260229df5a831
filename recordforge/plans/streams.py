"""Streaming jobs over events and orders, each run to its end and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from recordforge.plans.registry import query, table
from recordforge.plans.shared import CENTS, FAIL_COUNT, FAIL_STEP, RESPONSE, SCHEMA, UNIT
from recordforge.session import work_dir
from recordforge.streaming import jobs


def _events(spark, sf):
    schema = table(spark, sf, "events").schema
    return jobs.stream_table(spark, f"{sf}/events.parquet", schema).withColumn("ts", F.col("ts").cast("timestamp"))


def _orders(spark, sf):
    return jobs.stream_table(spark, f"{sf}/orders.parquet", table(spark, sf, "orders").schema)


def _paths(spark, name):
    base = work_dir(spark, name)
    return f"{base}/out", f"{base}/checkpoint"


@query("stream_throughput", "SELECT date_trunc('hour', ts) AS start, event_type, count(*)::BIGINT AS n FROM events GROUP BY ALL")
def stream_throughput(spark, sf):
    out, mark = _paths(spark, "throughput")
    jobs.upserts(jobs.throughput(_events(spark, sf), "ts", "1 hour", by=["event_type"]), out, mark)
    made = jobs.latest(spark, out, jobs.newest(["start", "event_type"]))
    return made.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query(
    "stream_failure_rate",
    """
    SELECT start, count(*)::BIGINT AS n, count(*) FILTER (event_type = 'error')::BIGINT AS failed, round(avg((event_type = 'error')::INT), 9) AS rate
    FROM (SELECT event_type, unnest([time_bucket(INTERVAL '1 hour', ts, TIMESTAMP '2024-01-01') - i * INTERVAL '1 hour' FOR i IN range(0, 6)]) AS start FROM events) GROUP BY start
    """,
)
def stream_failure_rate(spark, sf):
    out, mark = _paths(spark, "rate")
    jobs.upserts(jobs.failure_rate(_events(spark, sf), "ts", F.col("event_type") == "error", "6 hours", "1 hour"), out, mark)
    made = jobs.latest(spark, out, jobs.newest(["start"]))
    return made.select(F.col("start").cast("timestamp_ntz").alias("start"), "n", "failed", F.round("rate", 9).alias("rate"))


@query(
    "stream_activity",
    """
    WITH g AS (SELECT user_id, ts, (ts - lag(ts) OVER w >= INTERVAL '6 hours')::INT AS cut FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    s AS (SELECT user_id, ts, sum(coalesce(cut, 0)) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM g),
    e AS (SELECT user_id, min(ts) AS start, max(ts) + INTERVAL '6 hours' AS stop, count(*)::BIGINT AS n FROM s GROUP BY user_id, session)
    SELECT user_id, start, n FROM e WHERE stop <= (SELECT max(ts) - INTERVAL '10 minutes' FROM events)
    """,
)
def stream_activity(spark, sf):
    """Sessions that the watermark has closed."""
    out, mark = _paths(spark, "activity")
    jobs.finish(jobs.activity(_events(spark, sf), "ts", ["user_id"], "6 hours"), out, mark)
    made = spark.read.parquet(out)
    return made.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query("stream_dedup", "SELECT user_id, event_type, date_trunc('month', min(ts)) AS month FROM events GROUP BY ALL")
def stream_dedup(spark, sf):
    """One row per user and kind within the watermark delay."""
    out, mark = _paths(spark, "dedup")
    jobs.finish(jobs.stream_dedup(_events(spark, sf), ["user_id", "event_type"], "ts", "60 days"), out, mark)
    made = spark.read.parquet(out)
    return made.select("user_id", "event_type", F.date_trunc("month", "ts").cast("timestamp_ntz").alias("month"))


@query(
    "stream_overdue",
    """
    WITH s AS (SELECT user_id, ts FROM events WHERE event_type = 'signup'), p AS (SELECT user_id, ts FROM events WHERE event_type = 'purchase'),
    w AS (SELECT least((SELECT max(ts) FROM s), (SELECT max(ts) FROM p)) - INTERVAL '10 minutes' AS mark)
    SELECT user_id, ts AS submitted_at FROM s WHERE ts + INTERVAL '600 minutes' < (SELECT mark FROM w)
        AND NOT EXISTS (SELECT 1 FROM p WHERE p.user_id = s.user_id AND p.ts >= s.ts AND p.ts <= s.ts + INTERVAL '600 minutes')
    """,
)
def stream_overdue(spark, sf):
    """Sign-ups without a purchase within ten hours."""
    out, mark = _paths(spark, "overdue")
    events = _events(spark, sf)
    late = jobs.overdue(events.filter("event_type = 'signup'"), events.filter("event_type = 'purchase'"), "user_id", 600)
    jobs.finish(late, out, mark)
    return spark.read.parquet(out).select("user_id", F.col("submitted_at").cast("timestamp_ntz").alias("submitted_at"))


@query(
    "stream_retry_budget",
    f"""
    WITH a AS (SELECT {UNIT} AS unit_id, CASE WHEN event_type = 'error' THEN {FAIL_STEP} ELSE event_type END AS step,
        CASE WHEN event_type = 'error' THEN {FAIL_COUNT} ELSE 0 END AS retry_count, event_type <> 'error' AS ok FROM events)
    SELECT step, unit_id, max(coalesce(retry_count, 0))::INT AS retry_count,
        CASE WHEN bool_or(ok) THEN 'resolved' WHEN max(coalesce(retry_count, 0)) < 3 THEN 'retry' ELSE 'permanent' END AS decision FROM a GROUP BY step, unit_id
    """,
)
def stream_retry_budget(spark, sf):
    out, mark = _paths(spark, "budget")
    attempts = _events(spark, sf).selectExpr(
        f"{UNIT} AS unit_id",
        f"CASE WHEN event_type = 'error' THEN {FAIL_STEP} ELSE event_type END AS step",
        f"cast(CASE WHEN event_type = 'error' THEN {FAIL_COUNT} ELSE 0 END AS int) AS retry_count",
        "event_type <> 'error' AS ok",
    )
    jobs.upserts(jobs.retry_budget(attempts), out, mark, jobs.merge_budget())
    return jobs.latest(spark, out, jobs.merge_budget()).select("step", "unit_id", "retry_count", "decision")


@query("stream_last_level", "SELECT user_id, arg_max(event_type, ts) AS last_level FROM events GROUP BY user_id")
def stream_last_level(spark, sf):
    out, mark = _paths(spark, "level")
    log = _events(spark, sf).withColumnRenamed("event_type", "level")
    merge = jobs.merge_level(["user_id"])
    jobs.upserts(jobs.last_level(log, ["user_id"]), out, mark, merge)
    return jobs.latest(spark, out, merge).select("user_id", "last_level")


@query(
    "stream_cost_cap",
    """
    SELECT event_id, running::BIGINT AS running FROM (SELECT event_id, user_id AS c, sum(user_id) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS running FROM events)
    WHERE running - c < 50000
    """,
)
def stream_cost_cap(spark, sf):
    out, mark = _paths(spark, "cap")
    calls = _events(spark, sf).select("event_id", "event_type", "ts", F.col("user_id").cast("double").alias("cost"))
    jobs.cost_cap(calls, 50_000, "cost", ["ts", "event_id"], ["event_type"], out, out + "-totals", mark)
    return spark.read.parquet(out).select("event_id", F.col("running_cost").cast("bigint").alias("running"))


@query(
    "stream_validate",
    f"""
    SELECT o_orderkey::VARCHAR AS unit_id, CASE WHEN k IN (6, 7, 8) THEN 'schema_validation' WHEN {CENTS} < 5000000 THEN 'validation' END AS failure_stage
    FROM (SELECT *, o_orderkey % 10 AS k FROM orders)
    """,
)
def stream_validate(spark, sf):
    """Arriving vendor lines are parsed and judged into a valid and a failure table."""
    out, mark = _paths(spark, "validate")
    lines = _orders(spark, sf).selectExpr("cast(o_orderkey as string) AS unit_id", f"{RESPONSE} AS text")
    body = F.struct(F.array(F.struct(F.struct(F.col("text").alias("content")).alias("message"), F.lit("stop").alias("finish_reason"))).alias("choices"))
    line = F.to_json(F.struct(F.col("unit_id").alias("custom_id"), F.struct(F.lit(200).alias("status_code"), body.alias("body")).alias("response")))
    from recordforge.sources.vendors import parse_batch_results

    results = parse_batch_results(lines.select(line.alias("value")), "openai").select("unit_id", "content")
    rules = {"rules": [{"name": "worth_it", "expr": "cents >= 5000000"}]}
    jobs.stream_validate(results, SCHEMA, rules, out + "/valid", out + "/failed", mark)
    ok = spark.read.parquet(out + "/valid").select("unit_id", F.lit(None).cast("string").alias("failure_stage"))
    return ok.unionByName(spark.read.parquet(out + "/failed").select("unit_id", "failure_stage"))


@query(
    "stream_files",
    "SELECT o_orderpriority, count(*)::BIGINT AS n, sum(o_orderkey)::BIGINT AS tokens FROM orders GROUP BY 1",
)
def stream_files(spark, sf):
    """Result files that arrive one by one."""
    base = work_dir(spark, "arrive")
    lines = table(spark, sf, "orders").select(
        F.to_json(
            F.struct(
                F.concat_ws("|", "o_orderkey", "o_orderpriority").alias("key"),
                F.struct(
                    F.array(F.struct(F.struct(F.array(F.struct(F.lit("ok").alias("text"))).alias("parts")).alias("content"), F.lit("STOP").alias("finishReason"))).alias("candidates"),
                    F.struct(F.col("o_orderkey").alias("promptTokenCount")).alias("usageMetadata"),
                ).alias("response"),
            )
        ).alias("value")
    )
    lines.repartition(4).write.text(base + "/in")
    jobs.finish(jobs.stream_results(spark, base + "/in", "gemini", per_trigger=2), base + "/out", base + "/checkpoint")
    made = spark.read.parquet(base + "/out").filter("error is null")
    return made.groupBy(F.substring_index("unit_id", "|", -1).alias("o_orderpriority")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("input_tokens").alias("tokens")
    )
