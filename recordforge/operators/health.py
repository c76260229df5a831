"""State of runs: status, progress, step matrix, warnings, and one summary row per run."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordforge.functions.text import elapsed_text, eta_seconds

# Stored statuses that are taken as they are, and those that end a run.
STORED = ["complete", "failed", "paused", "killed"]
ENDED = ["complete", "failed", "killed"]


def step_index(steps: Sequence[str], step: Column) -> Column:
    """0-based place of a step in the pipeline; NULL if it is none."""
    return F.nullif(F.array_position(F.array(*[F.lit(s) for s in steps]), step), F.lit(0)) - 1


def with_step(chunks: DataFrame, steps: Sequence[str]) -> DataFrame:
    """Add `step`, `mark` and `step_no` from the chunk state; the split is at the last underscore."""
    step = F.regexp_extract("state", r"^(.*)_(PENDING|SUBMITTED|COMPLETE)$", 1)
    mark = F.regexp_extract("state", r"^(.*)_(PENDING|SUBMITTED|COMPLETE)$", 2)
    named = chunks.withColumns(
        {"step": F.nullif(step, F.lit("")), "mark": F.coalesce(F.nullif(mark, F.lit("")), F.col("state"))}
    )
    return named.withColumn("step_no", step_index(steps, F.col("step")))


def run_status(runs: DataFrame, chunks: DataFrame) -> DataFrame:
    """(run, status): the stored status, else what the chunk states say."""
    c = chunks.groupBy("run").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("state") == "VALIDATED").alias("validated"),
        F.count_if(F.col("state") == "FAILED").alias("failed"),
        F.count_if(F.col("state") == "PENDING").alias("pending"),
    )
    joined = runs.select("run", F.col("status").alias("stored")).join(c, "run", "left")
    status = (
        F.when(F.col("stored").isin(STORED), F.col("stored"))
        .when(F.col("stored") == "running", F.lit("active"))
        .when(F.coalesce("total", F.lit(0)) == 0, F.lit("pending"))
        .when(F.col("validated") == F.col("total"), F.lit("complete"))
        .when(F.col("failed") > 0, F.lit("failed"))
        .when(F.col("pending") == F.col("total"), F.lit("pending"))
        .otherwise(F.lit("detached"))
    )
    return joined.select("run", status.alias("status"))


def status_corrections(runs: DataFrame, chunks: DataFrame) -> DataFrame:
    """Runs whose chunks are all done while the stored status is not `complete`."""
    over = chunks.groupBy("run").agg(F.bool_and(F.col("state").isin("VALIDATED", "FAILED")).alias("over")).filter("over")
    wrong = runs.filter(F.coalesce("status", F.lit("")) != "complete")
    return wrong.join(over, "run").select("run", F.col("status").alias("stored"), F.lit("complete").alias("corrected"))


def run_progress(runs: DataFrame, chunks: DataFrame, steps: Sequence[str]) -> DataFrame:
    """(run, progress) in whole percent: steps completed over chunks times steps."""
    n = len(steps)
    done = F.when(F.col("state") == "VALIDATED", F.lit(n)).otherwise(F.coalesce("step_no", F.lit(0)))
    work = with_step(chunks, steps).groupBy("run").agg(F.sum(done).alias("done"), F.count(F.lit(1)).alias("chunks"))
    part = F.floor(F.col("done") * 100.0 / (F.col("chunks") * n)).cast("int")
    whole = F.when(F.col("status") == "complete", F.lit(100)).otherwise(F.coalesce(part, F.lit(0)))
    return runs.select("run", "status").join(work, "run", "left").select("run", whole.alias("progress"))


def unit_progress(step_counts: DataFrame, by: Sequence[str] = ("run",)) -> DataFrame:
    """Completed over total units, between 0 and 1."""
    ratio = F.least(F.coalesce(F.try_divide(F.sum("completed").cast("double"), F.sum("total")), F.lit(0.0)), F.lit(1.0))
    return step_counts.groupBy(*by).agg(ratio.alias("progress"))


def failed_units(runs: DataFrame, chunks: DataFrame) -> DataFrame:
    """(run, failed_chunks, failed_units): for an ended run the units that are not valid, else the counted failures."""
    c = chunks.groupBy("run").agg(
        F.coalesce(F.sum("items"), F.lit(0)).alias("items"),
        F.coalesce(F.sum("valid"), F.lit(0)).alias("valid"),
        F.coalesce(F.sum("failed"), F.lit(0)).alias("failed"),
        F.count_if(F.col("state") == "FAILED").alias("failed_chunks"),
    )
    ended = F.col("status").isin(ENDED) & (F.col("items") > 0)
    n = F.when(ended, F.greatest(F.col("items") - F.col("valid"), F.lit(0))).otherwise(F.coalesce("failed", F.lit(0)))
    return runs.select("run", "status").join(c, "run", "left").select(
        "run", F.coalesce("failed_chunks", F.lit(0)).alias("failed_chunks"), n.alias("failed_units")
    )


def current_step(chunks: DataFrame, steps: Sequence[str]) -> DataFrame:
    """(run, furthest_step, usual_step): the most advanced step of any chunk, and the one most chunks are at."""
    at = with_step(chunks, steps).filter("step_no is not null")
    counts = at.groupBy("run", "step", "step_no").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("run").agg(
        F.max_by("step", "step_no").alias("furthest_step"),
        F.max_by("step", F.struct("n", -F.col("step_no"))).alias("usual_step"),
    )


def throughput(runs: DataFrame, now: Column | None = None) -> DataFrame:
    """Units per hour and time left. `runs` has run, started, ended, total_units, done_units."""
    end = F.coalesce("ended", now if now is not None else F.current_timestamp())
    seconds = F.unix_timestamp(end) - F.unix_timestamp("started")
    usable = (F.col("elapsed_seconds") > 0) & (F.col("done_units") > 0)
    rate = F.when(usable, F.round(F.col("done_units") * 3600.0 / F.col("elapsed_seconds"), 1))
    left = F.col("total_units") - F.col("done_units")
    remaining = F.when((left > 0) & (F.col("units_per_hour") > 0), F.floor(left / F.col("units_per_hour") * 3600))
    return (
        runs.withColumn("elapsed_seconds", seconds)
        .withColumn("units_per_hour", rate)
        .withColumn("remaining_seconds", remaining)
        .withColumn("remaining", elapsed_text(F.col("remaining_seconds")))
        .withColumn("eta_seconds", eta_seconds(F.col("elapsed_seconds"), F.col("done_units") * 100.0 / F.col("total_units")))
    )


def chunk_warnings(
    chunks: DataFrame,
    failure_rate: float | None = None,
    max_tokens: int | None = None,
    max_minutes: float | None = None,
    now: Column | None = None,
) -> DataFrame:
    """(run, chunk, code, value): too many failures, too many tokens, submitted for too long.

    One pass over the chunks: every row yields the warnings it earns.
    """
    rules: list[Column] = []
    if failure_rate is not None:
        rate = F.try_divide(F.col("failed").cast("double"), F.col("items"))
        rules.append(F.when((F.col("failed") > 0) & (rate >= failure_rate), F.struct(F.lit("CHUNK_HAS_FAILURES").alias("code"), F.round(rate, 2).alias("value"))))
    if max_tokens is not None:
        used = F.coalesce("input_tokens", F.lit(0)) + F.coalesce("output_tokens", F.lit(0))
        rules.append(F.when(used > max_tokens, F.struct(F.lit("HIGH_TOKEN_USAGE").alias("code"), used.cast("double").alias("value"))))
    if max_minutes is not None:
        minutes = (F.unix_timestamp(now if now is not None else F.current_timestamp()) - F.unix_timestamp("submitted_at")) / 60.0
        waiting = F.col("state").endswith("_SUBMITTED")
        rules.append(F.when(waiting & (minutes > max_minutes), F.struct(F.lit("LONG_RUNNING_CHUNK").alias("code"), F.round(minutes, 1).alias("value"))))
    if not rules:
        raise ValueError("No threshold given")
    return chunks.select("run", "chunk", F.explode(F.array_compact(F.array(*rules))).alias("w")).select("run", "chunk", "w.*")


def step_counts(validated: DataFrame, failures: DataFrame, limit: int = 3) -> DataFrame:
    """Per step: valid rows, failures still to be tried, failures given up."""
    ok = validated.groupBy("step").agg(F.count(F.lit(1)).alias("valid"))
    count = F.coalesce("retry_count", F.lit(0))
    bad = failures.groupBy("step").agg(F.count_if(count < limit).alias("retry_pending"), F.count_if(count >= limit).alias("failed"))
    joined = ok.join(bad, "step", "full_outer")
    return joined.select("step", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("valid", "retry_pending", "failed")])


def retry_state(failures: DataFrame, validated: DataFrame, running: bool, max_retries: int = 3) -> DataFrame:
    """Per step over distinct failed units without a success: retrying, exhausted, highest attempt.

    Units are being retried only while the run is active.
    """
    open_units = failures.filter("unit_id is not null").groupBy("step", "unit_id").agg(F.max(F.coalesce("retry_count", F.lit(0))).alias("n"))
    done = validated.select("step", "unit_id").distinct()
    left = open_units.join(done, ["step", "unit_id"], "left_anti")
    due = (F.col("n") < max_retries) & F.lit(running)
    return left.groupBy("step").agg(
        F.count_if(due).alias("retrying"), F.count_if(~due).alias("exhausted"), F.max("n").cast("int").alias("max_attempt"),
        F.count(F.lit(1)).alias("permanently_failed"),
    )


def step_health(funnel: DataFrame, categories: DataFrame) -> DataFrame:
    """Per step: expected, valid, validation, hard and `ok`, `warning` or `mismatch`."""
    joined = funnel.select("step", "step_no", "expected", "valid").join(categories, "step", "left")
    filled = joined.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("validation", "hard")})
    seen = F.col("valid") + F.col("validation") + F.col("hard")
    status = (
        F.when(F.col("validation") + F.col("hard") > 0, F.lit("warning"))
        .when((F.col("expected") > 0) & (seen != F.col("expected")), F.lit("mismatch"))
        .otherwise(F.lit("ok"))
    )
    return filled.withColumn("status", status)


def disk_discrepancies(recorded: DataFrame, outputs: DataFrame, failures: DataFrame, last_step: str) -> DataFrame:
    """Chunks whose recorded counts differ from the rows found for the last step."""
    at_end = lambda df: df.filter(F.col("step") == last_step)
    ok = at_end(outputs).groupBy("run", "chunk").agg(F.count(F.lit(1)).alias("actual_valid"))
    bad = at_end(failures).groupBy("run", "chunk").agg(F.count(F.lit(1)).alias("actual_failed"))
    joined = recorded.select("run", "chunk", "valid", "failed").join(ok, ["run", "chunk"], "left").join(bad, ["run", "chunk"], "left")
    filled = joined.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("valid", "failed", "actual_valid", "actual_failed")})
    return filled.filter((F.col("valid") != F.col("actual_valid")) | (F.col("failed") != F.col("actual_failed")))


def chunk_matrix(chunks: DataFrame, failures: DataFrame, steps: Sequence[str]) -> DataFrame:
    """Per run and step: chunks per state and units at the step.

    A finished chunk counts at the last step; a failed one at the last step for which it has failures, else at the first.
    """
    placed = with_step(chunks, steps)
    last_bad = failures.withColumn("no", step_index(steps, F.col("step"))).groupBy("run", "chunk").agg(F.max_by("step", "no").alias("bad_step"))
    joined = placed.join(last_bad, ["run", "chunk"], "left")
    at = (
        F.when(F.col("mark") == "VALIDATED", F.lit(steps[-1]))
        .when(F.col("mark") == "FAILED", F.coalesce("bad_step", F.lit(steps[0])))
        .otherwise(F.col("step"))
    )
    kept = joined.withColumn("at", at).filter(step_index(steps, F.col("at")).isNotNull())
    names = {"PENDING": "pending", "SUBMITTED": "submitted", "COMPLETE": "completed", "VALIDATED": "validated", "FAILED": "failed"}
    return kept.groupBy("run", F.col("at").alias("step")).agg(
        *[F.count_if(F.col("mark") == k).alias(v) for k, v in names.items()], F.coalesce(F.sum("items"), F.lit(0)).alias("units")
    )


def tokens_per_step(results: DataFrame) -> DataFrame:
    return results.groupBy("step").agg(
        F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("input_tokens"),
        F.coalesce(F.sum("output_tokens"), F.lit(0)).alias("output_tokens"),
    )


def step_status(chunks: DataFrame, steps: Sequence[str]) -> DataFrame:
    """(run, step, step_no, status): complete, in_progress or pending, from where the chunks are.

    A chunk that ended, validated or failed, is past every step.
    """
    placed = with_step(chunks, steps).select("run", "state", "step_no")
    n = len(steps)
    at = F.when(F.col("state").isin("VALIDATED", "FAILED"), F.lit(n)).otherwise(F.coalesce("step_no", F.lit(-1)))
    # One row per (run, place) is enough, so the blow-up by the number of steps is small.
    places = placed.select("run", at.alias("at")).distinct()
    each = places.select("run", "at", F.posexplode(F.array(*[F.lit(s) for s in steps])).alias("step_no", "step"))
    flags = each.groupBy("run", "step", "step_no").agg(
        F.bool_and(F.col("at") > F.col("step_no")).alias("all_past"),
        F.bool_or(F.col("at") == F.col("step_no")).alias("any_here"),
        F.bool_or(F.col("at") > F.col("step_no")).alias("any_past"),
    )
    status = (
        F.when(F.col("all_past"), F.lit("complete"))
        .when(F.col("any_here"), F.lit("in_progress"))
        .when(F.col("any_past"), F.lit("complete"))
        .otherwise(F.lit("pending"))
    )
    return flags.select("run", "step", "step_no", status.alias("status"))


def overall_status(step_statuses: DataFrame) -> DataFrame:
    """(run, status) from the statuses of its steps."""
    s = F.col("status")
    done = step_statuses.groupBy("run").agg(
        F.bool_and(s == "complete").alias("all"), F.bool_or(s == "in_progress").alias("busy")
    )
    status = F.when(F.col("all"), F.lit("complete")).when(F.col("busy"), F.lit("active")).otherwise(F.lit("pending"))
    return done.select("run", status.alias("status"))


def chunks_at_step(chunks: DataFrame, steps: Sequence[str], step: str) -> DataFrame:
    """Chunks at a step or past it; all chunks of a run if none got there."""
    want = list(steps).index(step)
    placed = with_step(chunks, steps)
    hit = (F.col("state") == "VALIDATED") | (F.coalesce("step_no", F.lit(-1)) >= want)
    any_hit = placed.groupBy("run").agg(F.bool_or(hit).alias("_any"))
    return placed.join(any_hit, "run").filter(hit | ~F.col("_any")).drop("_any")


def run_duration(runs: DataFrame, now: Column | None = None) -> DataFrame:
    """Seconds from start to end; an unfinished run counts up to now."""
    end = F.coalesce("completed_at", "failed_at", "killed_at")
    until = F.when(F.col("status").isin(ENDED), end).otherwise(now if now is not None else F.current_timestamp())
    seconds = F.unix_timestamp(until) - F.unix_timestamp("started")
    return runs.withColumn("duration_seconds", F.when(seconds >= 0, seconds).when(seconds < 0, F.lit(0)))


def recent_runs(runs: DataFrame, n: int = 10) -> DataFrame:
    return runs.orderBy(F.desc("started"), "run").limit(n)


def log_health(log: DataFrame, bad_levels: Sequence[str] = ("ERROR",), good_levels: Sequence[str] = ("TICK",)) -> DataFrame:
    """Per run: last error, last healthy event, and whether the error is the newer one."""
    bad, good = F.col("level").isin(list(bad_levels)), F.col("level").isin(list(good_levels))
    seen = log.groupBy("run").agg(
        F.max(F.when(bad, F.col("ts"))).alias("last_error"),
        F.max(F.when(good, F.col("ts"))).alias("last_healthy"),
        F.max_by("level", "ts").alias("last_level"),
    )
    stuck = F.col("last_error").isNotNull() & (F.col("last_healthy").isNull() | (F.col("last_error") > F.col("last_healthy")))
    return seen.withColumn("has_recent_error", stuck)


def run_summary(runs: DataFrame, chunks: DataFrame, steps: Sequence[str], now: Column | None = None) -> DataFrame:
    """One row per run: status, progress, units, failures, tokens, current step, duration.

    The chunk table is read once per aspect and reduced to one row per run before any join.
    """
    base = chunks.groupBy("run").agg(
        F.count(F.lit(1)).alias("chunks"),
        F.coalesce(F.sum("items"), F.lit(0)).alias("total_units"),
        F.coalesce(F.sum("valid"), F.lit(0)).alias("valid_units"),
        F.coalesce(F.sum("retries"), F.lit(0)).alias("retries"),
        F.coalesce(F.sum(F.col("input_tokens") + F.col("output_tokens")), F.lit(0)).alias("tokens"),
    )
    timed = run_duration(runs, now).select("run", "duration_seconds")
    return (
        run_status(runs, chunks)
        .join(run_progress(runs, chunks, steps), "run")
        .join(base, "run", "left")
        .join(failed_units(runs, chunks), "run")
        .join(current_step(chunks, steps), "run", "left")
        .join(timed, "run")
    )


def status_rank(status: Column) -> Column:
    """Sort weight for lists of runs or units."""
    return F.when(status.isin("failed", "killed"), 0).when(status.isin("active", "in_progress"), 1).when(status == "pending", 2).otherwise(3)
