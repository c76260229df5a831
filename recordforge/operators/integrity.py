"""Did every unit arrive: verification of a run step by step, repair, and completeness rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordforge.functions.variants import entries
from recordforge.operators.validate import last_per_key


def _ids(df: DataFrame) -> DataFrame:
    return df.filter("unit_id is not null and unit_id <> ''")


def _accounts(units: DataFrame, outputs: DataFrame, failures: DataFrame, steps: list[str], fan_out: list[str]) -> DataFrame:
    """One row per (step, unit) with flags: expected, rows valid, failed.

    All steps are handled together: every row of every source becomes flags of its (step, unit), and one aggregation with
    map-side combine brings them side by side. What a step expects is what the step before let through.
    """
    following = {a: b for a, b in zip(steps, steps[1:])}
    zero, one = F.lit(0).cast("bigint"), F.lit(1).cast("bigint")

    def flags(df: DataFrame, step: Column, expected=zero, valid=zero, failed=zero) -> DataFrame:
        return _ids(df).select(
            step.alias("step"), "unit_id", expected.alias("expected"), valid.alias("valid_rows"), failed.alias("failed_rows")
        )

    parts = flags(units, F.lit(steps[0]), expected=one)
    parts = parts.unionByName(flags(outputs, F.col("step"), valid=one))
    parts = parts.unionByName(flags(failures, F.col("step"), failed=one))
    if following:
        names = F.create_map(*[F.lit(x) for pair in following.items() for x in pair])
        later = outputs.withColumn("step", F.try_element_at(names, F.col("step"))).filter("step is not null")
        parts = parts.unionByName(flags(later, F.col("step"), expected=one))
    merged = parts.groupBy("step", "unit_id").agg(
        F.max("expected").alias("expected"), F.sum("valid_rows").alias("valid_rows"), F.sum("failed_rows").alias("failed_rows")
    )
    if fan_out:
        # Children carry new ids, so a fan-out step expects what it made.
        merged = merged.withColumn("expected", F.when(F.col("step").isin(fan_out), F.lit(1)).otherwise(F.col("expected")))
        merged = merged.filter(~F.col("step").isin(fan_out) | (F.col("valid_rows") + F.col("failed_rows") > 0))
    return merged


def verify_run(
    units: DataFrame, outputs: DataFrame, failures: DataFrame, steps: list[str], fan_out: list[str] = ()
) -> DataFrame:
    """Per step: expected, valid, failed, missing, duplicated, orphaned, status.

    `outputs` and `failures` are (step, unit_id) tables. `OK` means no missing and no duplicated units.
    """
    a = _accounts(units, outputs, failures, steps, list(fan_out))
    valid, failed, expected = F.col("valid_rows") > 0, F.col("failed_rows") > 0, F.col("expected") > 0
    report = a.groupBy("step").agg(
        F.count_if(expected).alias("expected"),
        F.count_if(valid).alias("valid"),
        F.count_if(failed).alias("failed"),
        F.count_if(expected & ~valid & ~failed).alias("missing"),
        F.sum(F.greatest(F.col("valid_rows") - 1, F.lit(0))).alias("duplicated"),
        F.count_if(~expected & (valid | failed)).alias("orphaned"),
    )
    return report.withColumn(
        "status", F.when((F.col("missing") == 0) & (F.col("duplicated") == 0), F.lit("OK")).otherwise(F.lit("ERROR"))
    )


def unit_issues(
    units: DataFrame, outputs: DataFrame, failures: DataFrame, steps: list[str], fan_out: list[str] = ()
) -> DataFrame:
    """(step, unit_id, issue) for every missing, duplicated or orphaned unit."""
    a = _accounts(units, outputs, failures, steps, list(fan_out))
    seen = (F.col("valid_rows") > 0) | (F.col("failed_rows") > 0)
    issue = (
        F.when((F.col("expected") > 0) & ~seen, F.lit("missing"))
        .when((F.col("expected") == 0) & seen, F.lit("orphaned"))
        .when(F.col("valid_rows") > 1, F.lit("duplicated"))
    )
    return a.select("step", "unit_id", issue.alias("issue")).filter("issue is not null")


def richest(records: DataFrame, fields: Column, chunk_order: list[str], key: list[str]) -> DataFrame:
    """Among records of one key the one with most fields; ties go to the first in chunk order."""
    scored = records.withColumn("_n_fields", fields)
    order = F.struct(F.col("_n_fields").alias("n"), *[(-F.col(c)).alias(f"o{i}") for i, c in enumerate(chunk_order)])
    return last_per_key(scored.withColumn("_order", order), key, "_order").drop("_order", "_n_fields")


def field_count(data: Column) -> Column:
    """Number of top-level fields of a VARIANT object."""
    return F.coalesce(F.size(F.map_keys(entries(data))), F.lit(0))


def repair_run(
    units: DataFrame, outputs: DataFrame, failures: DataFrame, steps: list[str], chunk_order: list[str], fields: Column
) -> DataFrame:
    """Missing units of every step with the record to run them from: the richest one of the step before.

    `units` and `outputs` share the same record columns; the first step runs from `units`.
    """
    missing = unit_issues(units, outputs, failures, steps).filter("issue = 'missing'").select("step", "unit_id")
    best = richest(_ids(outputs), fields, chunk_order, ["step", "unit_id"])
    following = {a: b for a, b in zip(steps, steps[1:])}
    cols = [c for c in units.columns if c != "step"]
    sources = _ids(units).select(F.lit(steps[0]).alias("step"), *cols)
    if following:
        names = F.create_map(*[F.lit(x) for pair in following.items() for x in pair])
        later = best.withColumn("step", F.try_element_at(names, F.col("step"))).filter("step is not null")
        sources = sources.unionByName(later.select("step", *cols))
    return sources.join(missing, ["step", "unit_id"], "left_semi")


def completeness(chunks: DataFrame, near: float = 0.9) -> DataFrame:
    """Which chunks of a step need no more work.

    `chunks` has (expected, valid, failed, retry_marked). Complete if valid and failed cover the expected units; or if
    nothing failed, at least `near` are valid, and no retry is marked.
    """
    covered = F.col("valid") + F.col("failed") >= F.col("expected")
    almost = (
        (F.col("valid") > 0) & (F.col("failed") == 0) & ~F.col("retry_marked") & (F.col("valid") >= F.col("expected") * F.lit(near))
    )
    return chunks.withColumn("skip", (F.col("expected") > 0) & (covered | almost)).withColumn(
        "unaccounted", F.greatest(F.col("expected") - F.col("valid") - F.col("failed"), F.lit(0))
    )


def terminal_runs(chunks: DataFrame, max_retries: int = 3) -> DataFrame:
    """(run, terminal): every chunk VALIDATED, or FAILED with its retries spent."""
    over = (F.col("state") == "VALIDATED") | ((F.col("state") == "FAILED") & (F.coalesce("retries", F.lit(0)) >= max_retries))
    return chunks.groupBy("run").agg(F.bool_and(over).alias("terminal"))


def stuck_chunks(step_counts: DataFrame) -> DataFrame:
    """Chunks without a valid unit in a step; they must not go on to the next one."""
    return step_counts.groupBy("step", "chunk").agg(F.sum("valid").alias("valid")).filter("valid = 0")
