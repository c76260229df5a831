"""Two-phase validation of a step: schema with coercion, then business rules, with nothing lost on the way."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordforge.functions.variants import entries, overlay, row_as_map
from recordforge.operators.rules import check_rules, finding
from recordforge.operators.schema_check import check_schema, field, field_types, no_errors, no_notes, typed_fields
from recordforge.session import settle

# Fixed value: the message of a record that came to nothing.
LOST = "Record lost during validation pipeline"


def last_per_key(df: DataFrame, key: str | list[str], order_by: str | list[str]) -> DataFrame:
    """The last row per key in the given order; rows with an empty key are dropped.

    `max_by` combines on the map side, so a key with any share of the rows costs one row per task.
    """
    keys = [key] if isinstance(key, str) else key
    order = [order_by] if isinstance(order_by, str) else order_by
    rest = [c for c in df.columns if c not in keys]
    kept = df
    for k in keys:
        kept = kept.filter(F.col(k).isNotNull() & (F.col(k).cast("string") != ""))
    best = kept.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_last"))
    return best.select(*keys, "_last.*").select(*df.columns)


def one_per_key(df: DataFrame, key: str, order: str | None = None, unique: bool = False) -> DataFrame:
    """One row per key; NULL keys are dropped.

    The row with the largest `order` (a column that is taken away) counts, and of equals, or without an order, the one
    whose values are last as text: so the choice depends on the rows alone, not on how they are spread or on tasks that ran
    again. `unique` says that keys are different, which spares the shuffle.
    """
    kept = df.filter(F.col(key).isNotNull())
    columns = [c for c in df.columns if c != order]
    if unique:
        return kept.select(*columns)
    row = F.struct(*[c for c in columns if c != key])
    rank = F.struct(*([F.col(order)] if order else []), F.to_json(row))
    best = kept.groupBy(key).agg(F.max_by(row, rank).alias("_last"))
    return best.select(key, "_last.*").select(*columns)


def _order(order_by: Sequence[str] | None) -> list[Column]:
    return [F.struct(*order_by).alias("_rank")] if order_by else []


def premerge(
    results: DataFrame,
    inputs: DataFrame,
    key: str = "unit_id",
    data: str = "data",
    order_by: Sequence[str] | None = None,
    unique: bool = False,
) -> DataFrame:
    """Add the input fields of the same unit below each result; result fields win. Unmatched results pass.

    `results` has `data` as MAP<STRING, VARIANT>; `inputs` has any columns, and one row per key counts, as `one_per_key`
    chooses it (`order_by` are columns of `inputs`). Adds `input`.
    """
    packed = inputs.select(F.col(key).alias("_key"), row_as_map(inputs.columns).alias("input"), *_order(order_by))
    packed = one_per_key(packed, "_key", "_rank" if order_by else None, unique)
    joined = results.join(packed, F.col(key) == F.col("_key"), "left").drop("_key")
    merged = F.when(F.col("input").isNotNull(), overlay(F.col("input"), F.col(data))).otherwise(F.col(data))
    return joined.withColumn(data, merged)


def passed_gate(rows: DataFrame, passed: DataFrame, key: str = "unit_id") -> DataFrame:
    """Rows whose key passed the phase before."""
    return rows.join(passed.select(key).distinct(), key, "left_semi")


def enrich_failures(
    failures: DataFrame, inputs: DataFrame, key: str = "unit_id", order_by: Sequence[str] | None = None, unique: bool = False
) -> DataFrame:
    """Put the step's input into each failure record, keep the raw text and retry count, lift upstream fields.

    A raw text comes from the failed output, then the failure, then the input. Lifted fields never replace a field of the
    record and never start with an underscore.
    """
    cols = failures.columns
    packed = inputs.select(F.col(key).alias("_key"), F.struct(*inputs.columns).alias("_in"), *_order(order_by))
    packed = one_per_key(packed, "_key", "_rank" if order_by else None, unique)
    joined = failures.join(packed, F.col(key) == F.col("_key"), "left")
    raw: list[Column] = [F.col(c) for c in ("raw_response", "_raw_text") if c in cols]
    if "_raw_text" in inputs.columns:
        raw.append(F.col("_in._raw_text"))
    count: list[Column] = []
    if "retry_count" in inputs.columns:
        count.append(F.col("_in.retry_count"))
    if "retry_count" in cols:
        count.append(F.col("retry_count"))
    count.append(F.lit(0))
    fixed = {"raw_response": F.coalesce(*raw) if raw else F.lit(None).cast("string"), "retry_count": F.coalesce(*count)}
    lifted = [c for c in inputs.columns if c not in cols and c not in fixed and c != key and not c.startswith("_")]
    return joined.select(
        *[c for c in cols if c not in ("input", "raw_response", "_raw_text", "retry_count")],
        F.col("_in").alias("input"),
        *[v.alias(n) for n, v in fixed.items()],
        *[F.col(f"_in.`{c}`").alias(c) for c in lifted],
    )


def lost_records(inputs: DataFrame, valid: DataFrame, failed: DataFrame, step: str, key: str = "unit_id") -> DataFrame:
    """Synthetic failures for inputs that are neither valid nor failed."""
    seen = valid.select(key).unionByName(failed.select(key)).filter(F.col(key).isNotNull())
    lost = inputs.join(seen.distinct(), key, "left_anti")
    return lost.select(
        F.col(key),
        F.lit("pipeline_internal").alias("failure_stage"),
        F.lit(step).alias("step"),
        row_as_map(inputs.columns).alias("input"),
        F.array(finding("$", "pipeline_internal", F.lit(LOST))).alias("errors"),
        (F.coalesce("retry_count", F.lit(0)) if "retry_count" in inputs.columns else F.lit(0)).alias("retry_count"),
    )


def validate_step(
    results: DataFrame,
    inputs: DataFrame,
    schema: Mapping | None,
    spec: Mapping | None,
    step: str,
    types: Mapping[str, str] | None = None,
    coerce: bool = True,
    fix: bool = True,
    results_order: Sequence[str] | None = None,
    inputs_order: Sequence[str] | None = None,
    unique: bool = False,
    tasks: int | None = None,
) -> DataFrame:
    """Judge every unit of a step once: (unit_id, step, status, failure_stage, data, input, errors, warnings, ...).

    `results` has `unit_id, data` (MAP<STRING, VARIANT>) and optional `raw_response, retry_count`. Of several results or
    inputs of one unit one counts, as `one_per_key` chooses it. Rules see the fields of `schema` plus
    those named in `types`. Inputs without a result become `pipeline_internal` failures by the same outer join that merges
    the inputs, so the whole step is one shuffle join and one stage of projections. `tasks` spreads the inputs before they
    are packed. `fix` stores the judged table in the
    shared folder, because valid and failed rows are read separately afterwards.
    """
    own = inputs.filter(F.col("unit_id").isNotNull())
    packed = (own.repartition(tasks) if tasks else own).select(
        F.col("unit_id").alias("_key"),
        row_as_map(inputs.columns).alias("input"),
        (F.col("retry_count").cast("int") if "retry_count" in inputs.columns else F.lit(None).cast("int")).alias("_in_count"),
        *_order(inputs_order),
    )
    packed = one_per_key(packed, "_key", "_rank" if inputs_order else None, unique)
    has_raw, has_count = "raw_response" in results.columns, "retry_count" in results.columns
    sent = results.select(
        "unit_id",
        # Results without an id match nothing; a key of their own each keeps them from meeting in one task.
        F.coalesce("unit_id", F.concat(F.lit("\u0000"), F.monotonically_increasing_id().cast("string"))).alias("_sent_key"),
        "data",
        (F.col("raw_response") if has_raw else F.lit(None).cast("string")).alias("raw_response"),
        (F.col("retry_count").cast("int") if has_count else F.lit(None).cast("int")).alias("_out_count"),
        F.lit(True).alias("_sent"),
        *_order(results_order),
    )
    sent = one_per_key(sent, "_sent_key", "_rank" if results_order else None, unique)
    both = sent.join(packed, F.col("_sent_key") == F.col("_key"), "full_outer").select(
        F.coalesce("unit_id", "_key").alias("unit_id"),
        F.to_variant_object(
            F.when(F.col("input").isNotNull(), overlay(F.col("input"), F.col("data"))).otherwise(F.col("data"))
        ).alias("merged"),
        "input",
        "raw_response",
        F.coalesce("_in_count", "_out_count", F.lit(0)).alias("retry_count"),
        F.coalesce("_sent", F.lit(False)).alias("_sent"),
    )
    done = judge(both, schema, spec, step, types, coerce)
    return settle(done) if fix else done


def judge(
    both: DataFrame,
    schema: Mapping | None,
    spec: Mapping | None,
    step: str,
    types: Mapping[str, str] | None = None,
    coerce: bool = True,
) -> DataFrame:
    """The row-wise part of `validate_step`: (unit_id, merged, input, raw_response, retry_count, _sent) to verdicts."""
    if schema:
        judged = check_schema(both, schema, "merged", coerce=True).withColumnRenamed("errors", "_schema_errors")
        known = field_types(schema)
    else:
        judged = both.withColumns({"data": F.col("merged"), "_schema_errors": no_errors(), "coercions": no_notes()})
        known = {}
    known = {**known, **(types or {})}
    fixed_names = {"unit_id", "merged", "input", "raw_response", "retry_count", "data", "coercions"}
    flat = {n: t for n, t in known.items() if n not in fixed_names}
    if spec:
        ruled = check_rules(typed_fields(judged, flat), spec, "_rule_errors", "warnings").drop(*flat)
    else:
        ruled = judged.withColumns({"_rule_errors": no_errors(), "warnings": no_errors()})
    lost = ~F.col("_sent")
    bad_schema, bad_rules = F.size("_schema_errors") > 0, F.size("_rule_errors") > 0
    stage = (
        F.when(lost, F.lit("pipeline_internal"))
        .when(bad_schema, F.lit("schema_validation"))
        .when(bad_rules, F.lit("validation"))
    )
    return ruled.select(
        "unit_id",
        F.lit(step).alias("step"),
        F.when(stage.isNull(), F.lit("valid")).otherwise(F.lit("failed")).alias("status"),
        stage.alias("failure_stage"),
        F.when(F.lit(coerce) | stage.isNotNull(), F.col("data")).otherwise(F.col("merged")).alias("data"),
        "input",
        F.coalesce("raw_response", field(F.col("merged"), "_raw_text", "string")).alias("raw_response"),
        F.when(lost, F.array(finding("$", "pipeline_internal", F.lit(LOST))))
        .when(bad_schema, F.col("_schema_errors"))
        .otherwise(F.col("_rule_errors"))
        .alias("errors"),
        F.when(stage.isNull(), F.col("warnings")).otherwise(no_errors()).alias("warnings"),
        "coercions",
        "retry_count",
    )


def valid_rows(judged: DataFrame) -> DataFrame:
    return judged.filter("status = 'valid'")


def failed_rows(judged: DataFrame) -> DataFrame:
    return judged.filter("status = 'failed'")


def as_fields(judged: DataFrame) -> DataFrame:
    """Judged data back as the map form that the next step merges into."""
    return judged.withColumn("data", entries(F.col("data")))
