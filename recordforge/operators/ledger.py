"""Failures over all attempts: what is unresolved, what is tried again, what is given up."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordforge.functions.variants import entries, json_type
from recordforge.operators.infer import read_responses
from recordforge.operators.validate import judge, last_per_key
from recordforge.session import settle

# Stages worth another attempt.
RETRYABLE = ["schema_validation", "validation"]
MAX_RETRIES = 3


def is_retryable(stage: str | Column = "failure_stage") -> Column:
    """A missing stage counts as `validation`."""
    c = F.col(stage) if isinstance(stage, str) else stage
    return F.coalesce(c, F.lit("validation")).isin(RETRYABLE)


def unresolved_failures(failures: DataFrame, validated: DataFrame, order_by: str | list[str]) -> DataFrame:
    """Failures of units that succeeded nowhere in the same step; the last one per unit.

    A success in any attempt clears the failure. Hot keys cost nothing: both sides are reduced per key before the join.
    """
    done = validated.select("step", "unit_id").filter("unit_id is not null").distinct()
    last_in_step = last_per_key(failures, ["unit_id", "step"], order_by)
    open_ones = last_in_step.join(done, ["step", "unit_id"], "left_anti").select(*failures.columns)
    return last_per_key(open_ones, "unit_id", order_by)


def retry_budget(
    failures: DataFrame, max_retries: int = MAX_RETRIES, by_stage: bool = True, chunk_count: Column | None = None
) -> DataFrame:
    """(step, unit_id, retry_count, decision) with the highest count per unit; decision is `retry` or `permanent`.

    A missing count is the chunk's count, else 0. With `by_stage` only retryable stages are looked at.
    """
    rows = failures.filter(is_retryable()) if by_stage else failures
    count = F.coalesce(F.col("retry_count"), chunk_count if chunk_count is not None else F.lit(0), F.lit(0))
    return (
        rows.filter("unit_id is not null")
        .groupBy("step", "unit_id")
        .agg(F.max(count).cast("int").alias("retry_count"))
        .withColumn("decision", F.when(F.col("retry_count") < max_retries, F.lit("retry")).otherwise(F.lit("permanent")))
    )


def build_retries(
    failures: DataFrame,
    step_inputs: DataFrame,
    max_retries: int = MAX_RETRIES,
    deterministic_steps: list[str] = (),
    by_stage: bool = True,
    chunk_count: Column | None = None,
) -> DataFrame:
    """Inputs to run again, with `retry_count` raised by one. `chunk_count` stands in for missing counts.

    `step_inputs` holds (step, unit_id, ...) rows: what each step was given, which is the validated output of the step
    before, never the `input` of the failure. Units without such a row are skipped; `missing_inputs` lists them.
    Deterministic steps are not tried again.
    """
    due = retry_budget(failures, max_retries, by_stage, chunk_count).filter("decision = 'retry'")
    due = due.filter(~F.col("step").isin(list(deterministic_steps))) if deterministic_steps else due
    inputs = step_inputs.drop("retry_count")
    return inputs.join(due.select("step", "unit_id", "retry_count"), ["step", "unit_id"]).withColumn(
        "retry_count", F.col("retry_count") + 1
    )


def missing_inputs(
    failures: DataFrame, step_inputs: DataFrame, max_retries: int = MAX_RETRIES, chunk_count: Column | None = None
) -> DataFrame:
    due = retry_budget(failures, max_retries, chunk_count=chunk_count).filter("decision = 'retry'")
    return due.join(step_inputs.select("step", "unit_id").distinct(), ["step", "unit_id"], "left_anti")


def permanent_failures(failures: DataFrame, max_retries: int = MAX_RETRIES, by_stage: bool = False) -> DataFrame:
    """Units whose budget is spent: (unit_id, step, retry_count, source_chunk)."""
    rows = failures.filter(is_retryable()) if by_stage else failures
    chunk = F.col("chunk") if "chunk" in failures.columns else F.lit(None).cast("string")
    count = F.coalesce("retry_count", F.lit(0))
    return (
        rows.groupBy("unit_id", "step")
        .agg(F.max(count).alias("retry_count"), F.max_by(chunk, F.struct(count, chunk)).alias("source_chunk"))
        .filter(F.col("retry_count") >= max_retries)
    )


def exhaust_deterministic(failures: DataFrame, steps: list[str], max_retries: int = MAX_RETRIES) -> DataFrame:
    """Failures of deterministic steps get a spent budget."""
    spent = F.greatest(F.coalesce("retry_count", F.lit(0)), F.lit(max_retries))
    return failures.withColumn(
        "retry_count", F.when(F.col("step").isin(steps) & is_retryable(), spent).otherwise(F.col("retry_count"))
    )


def merge_retries(
    validated: DataFrame, failures: DataFrame, retried: DataFrame, new_validated: DataFrame, new_failures: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Tables after a retry round: successes added, failures of retried units replaced, the rest untouched."""
    keys = ["step", "unit_id"]
    tried = retried.select(*keys).distinct()
    kept_valid = validated.join(new_validated.select(*keys).distinct(), keys, "left_anti")
    kept_failed = failures.join(tried, keys, "left_anti").select(*failures.columns)
    return (
        kept_valid.select(*validated.columns).unionByName(new_validated, allowMissingColumns=True),
        kept_failed.unionByName(new_failures, allowMissingColumns=True),
    )


def revalidate(
    failures: DataFrame, schema: Mapping | None, spec: Mapping | None, step: str, types: Mapping[str, str] | None = None
) -> DataFrame:
    """Judge stored raw responses again, for example after the rules have changed.

    Adds `outcome`: `promoted`, `still_failing`, `no_raw_response`, or `untouched` for hard failures. `failures` has one
    row per unit with `input` as MAP<STRING, VARIANT> and `raw_response`.
    """
    read = read_responses(failures, "raw_response", "_parsed")
    soft = is_retryable()
    usable = soft & (json_type(F.col("_parsed")) == "object")
    ready = read.filter(usable).withColumn("_sent", entries(F.col("_parsed")))
    kept = F.map_filter(F.coalesce("input", F.col("_sent")), lambda k, _: ~F.map_contains_key(F.col("_sent"), k))
    merged = ready.select("unit_id", F.map_concat(kept, F.col("_sent")).alias("data"), "raw_response", "retry_count")
    judged = judge(
        merged.select(
            "unit_id",
            F.to_variant_object("data").alias("merged"),
            F.lit(None).cast("map<string,variant>").alias("input"),
            "raw_response",
            F.coalesce("retry_count", F.lit(0)).alias("retry_count"),
            F.lit(True).alias("_sent"),
        ),
        schema,
        spec,
        step,
        types,
    )
    again = judged.select(
        "unit_id",
        F.when(F.col("status") == "valid", F.lit("promoted")).otherwise(F.lit("still_failing")).alias("outcome"),
        "data",
        "errors",
    )
    rest = read.filter(~F.coalesce(usable, F.lit(False))).select(
        "unit_id",
        F.when(~soft, F.lit("untouched"))
        .when(F.col("raw_response").isNull(), F.lit("no_raw_response"))
        .otherwise(F.lit("still_failing"))
        .alias("outcome"),
        F.lit(None).cast("variant").alias("data"),
        "errors",
    )
    return again.unionByName(rest)


def reset_retries(
    failures: DataFrame, step: str | None = None, unit_ids: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """(failures left, units to queue again) after dropping the failures of a step or of given units."""
    hit = F.lit(True) if step is None else F.col("step") == step
    if unit_ids is None:
        return failures.filter(~hit), failures.filter(hit).select("step", "unit_id").distinct()
    wanted = unit_ids.select("unit_id").distinct()
    matched = failures.filter(hit)
    left = failures.filter(~hit).unionByName(matched.join(wanted, "unit_id", "left_anti").select(*failures.columns))
    return left, matched.join(wanted, "unit_id", "left_semi").select("step", "unit_id").distinct()


def retry_rounds(
    failures: DataFrame,
    step_inputs: DataFrame,
    attempt: Callable[[DataFrame, int], tuple[DataFrame, DataFrame]],
    max_retries: int = MAX_RETRIES,
) -> tuple[DataFrame, DataFrame, int]:
    """Run attempts until nothing is due or the budget is spent: (validated, failures, rounds).

    `attempt(inputs, round)` gives (validated, failures) of the units it was handed. Lineage is cut in the shared folder
    after every round, so the plan of a late round is as small as that of the first. If nothing is due, the validated
    table is what `attempt` gives for no units.
    """
    validated = None
    current = settle(failures)
    for done in range(max_retries):
        due = settle(build_retries(current, step_inputs, max_retries))
        if due.isEmpty():
            return validated if done else settle(attempt(due, 0)[0]), current, done
        ok, bad = attempt(due, done + 1)
        ok, bad = settle(ok), settle(bad)
        if validated is None:
            validated = ok.limit(0)
        validated, current = merge_retries(validated, current, due, ok, bad)
        validated, current = settle(validated), settle(current)
    return validated, current, max_retries


def token_ledger(attempts: DataFrame, run: list[str] | None = None) -> DataFrame:
    """Tokens of first attempts and of retries, per run."""
    first, again = F.coalesce("retry_count", F.lit(0)) == 0, F.coalesce("retry_count", F.lit(0)) > 0

    def total(column: str, when: Column) -> Column:
        return F.coalesce(F.sum(F.when(when, F.col(column))), F.lit(0)).cast("bigint")

    return attempts.groupBy(*(run or [])).agg(
        total("input_tokens", first).alias("initial_input_tokens"),
        total("output_tokens", first).alias("initial_output_tokens"),
        total("input_tokens", again).alias("retry_input_tokens"),
        total("output_tokens", again).alias("retry_output_tokens"),
    )
