"""Batch files of three model vendors: request lines out, result lines in."""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordforge.functions.variants import as_type, items, json_type

RESULT_COLUMNS = ["unit_id", "content", "error", "input_tokens", "output_tokens"]


def _get(doc: str, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(doc, path, kind)


def _count(doc: str, path: str) -> Column:
    return F.coalesce(_get(doc, path, "bigint"), F.lit(0).cast("bigint"))


def _nothing(v: Column) -> Column:
    """Absent or JSON null."""
    return v.isNull() | F.is_variant_null(v)


def _first(doc: str, path: str) -> Column:
    return F.try_element_at(items(_get(doc, path, "variant")), F.lit(1))


def _openai(d: str) -> dict[str, Column]:
    # The result format of this vendor, finish reasons that are no problem, and error texts.
    row_error = _get(d, "$.error", "variant")
    status = _count(d, "$.response.status_code")
    choice = _first(d, "$.response.body.choices")
    content = F.coalesce(F.try_variant_get(choice, "$.message.content", "string"), F.lit(""))
    reason = F.coalesce(F.try_variant_get(choice, "$.finish_reason", "string"), F.lit(""))
    has_error, bad_status = ~_nothing(row_error), status != 200
    said = F.concat(
        F.coalesce(_get(d, "$.error.code"), F.lit("unknown")), F.lit(": "), F.coalesce(_get(d, "$.error.message"), F.lit("Unknown error"))
    )
    blocked = ~reason.isin("", "stop", "length") & (content == "")
    failed = has_error | bad_status
    return {
        "unit_id": F.coalesce(_get(d, "$.custom_id"), F.lit("unknown")),
        "content": F.when(~failed & choice.isNotNull(), content),
        "error": F.when(has_error, said)
        .when(bad_status, F.concat(F.lit("HTTP "), status.cast("string")))
        .when(choice.isNull(), F.lit("no_choices"))
        .when(blocked, F.concat(F.lit("finish_reason: "), reason)),
        "input_tokens": F.when(failed, F.lit(0)).otherwise(_count(d, "$.response.body.usage.prompt_tokens")),
        "output_tokens": F.when(failed, F.lit(0)).otherwise(_count(d, "$.response.body.usage.completion_tokens")),
    }


def _gemini(d: str) -> dict[str, Column]:
    # The result format of this vendor, finish reasons that are no problem, and error texts.
    row_error = _get(d, "$.error", "variant")
    candidate = _first(d, "$.response.candidates")
    reason = F.coalesce(F.try_variant_get(candidate, "$.finishReason", "string"), F.lit(""))
    blocked = _get(d, "$.response.promptFeedback.blockReason")
    text = F.try_variant_get(candidate, "$.content.parts[0].text", "string")
    good = row_error.isNull() & candidate.isNotNull() & reason.isin("", "STOP", "MAX_TOKENS")
    shown = F.when(json_type(row_error) == "string", as_type(row_error, "string")).otherwise(F.to_json(row_error))
    return {
        "unit_id": F.coalesce(_get(d, "$.key"), F.lit("unknown")),
        "content": F.when(good, text),
        "error": F.when(row_error.isNotNull(), shown)
        .when(candidate.isNull() & blocked.isNotNull(), F.concat(F.lit("safety_filter: "), blocked))
        .when(candidate.isNull(), F.lit("no_response"))
        .when(~good, F.concat(F.lit("finish_reason: "), reason))
        .when(F.coalesce(text, F.lit("")) == "", F.lit("empty_response")),
        "input_tokens": _count(d, "$.response.usageMetadata.promptTokenCount"),
        "output_tokens": _count(d, "$.response.usageMetadata.candidatesTokenCount"),
    }


def _anthropic(d: str) -> dict[str, Column]:
    # The result format of this vendor and error texts.
    kind = F.coalesce(_get(d, "$.result.type"), F.lit("unknown"))
    good = kind == "succeeded"
    row_error = _get(d, "$.result.error", "variant")
    said = F.concat(
        F.coalesce(_get(d, "$.result.error.type"), F.lit("unknown")),
        F.lit(": "),
        F.coalesce(_get(d, "$.result.error.message"), F.lit("Unknown error")),
    )
    return {
        "unit_id": F.coalesce(F.nullif(_get(d, "$.custom_id"), F.lit("")), F.lit("unknown")),
        "content": F.when(good, _get(d, "$.result.message.content[0].text")),
        "error": F.when(good, F.lit(None).cast("string"))
        .when((kind == "errored") & _nothing(row_error), F.lit("Unknown error"))
        .when(kind == "errored", said)
        .when(kind == "expired", F.lit("Request expired"))
        .when(kind == "canceled", F.lit("Request canceled"))
        .otherwise(F.concat(F.lit("Unknown result type: "), kind)),
        "input_tokens": F.when(good, _count(d, "$.result.message.usage.input_tokens")).otherwise(F.lit(0)),
        "output_tokens": F.when(good, _count(d, "$.result.message.usage.output_tokens")).otherwise(F.lit(0)),
    }


PARSERS = {"openai": _openai, "gemini": _gemini, "anthropic": _anthropic}


def parse_batch_results(lines: DataFrame, vendor: str, column: str = "value") -> DataFrame:
    """Result lines as (unit_id, content, error, input_tokens, output_tokens); unreadable lines are skipped.

    Works on a table or a stream: every field is an expression over one VARIANT per line.
    """
    others = [c for c in lines.columns if c != column]
    docs = lines.select(*others, F.try_parse_json(column).alias("_doc")).filter(F.col("_doc").isNotNull())
    fields = PARSERS[vendor]("_doc")
    return docs.select(*others, *[fields[n].alias(n) for n in RESULT_COLUMNS])


def batch_totals(results: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Succeeded, failed and token totals of parsed results."""
    return results.groupBy(*(by or [])).agg(
        F.count_if(F.col("error").isNull()).alias("succeeded"),
        F.count_if(F.col("error").isNotNull()).alias("failed"),
        F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("input_tokens"),
        F.coalesce(F.sum("output_tokens"), F.lit(0)).alias("output_tokens"),
    )


def batch_requests(
    prompts: DataFrame, vendor: str, model: str, schema: Mapping | None = None, max_tokens: int = 4096
) -> DataFrame:
    """Prompts (unit_id, prompt, ...) with a `value` column that holds the vendor's request line."""
    unit, prompt = F.col("unit_id"), F.col("prompt")
    user = F.lit("user").alias("role")
    # The request formats of the vendors.
    if vendor == "openai":
        body = [F.lit(model).alias("model"), F.array(F.struct(user, prompt.alias("content"))).alias("messages")]
        if schema:
            body.append(F.struct(F.lit("json_object").alias("type")).alias("response_format"))
        line = F.struct(
            unit.alias("custom_id"), F.lit("POST").alias("method"), F.lit("/v1/chat/completions").alias("url"), F.struct(*body).alias("body")
        )
    elif vendor == "gemini":
        parts = F.array(F.struct(prompt.alias("text")))
        line = F.struct(
            unit.alias("key"), F.struct(F.array(F.struct(parts.alias("parts"))).alias("contents")).alias("request")
        )
    elif vendor == "anthropic":
        ask = F.lit(f"\n\nRespond with valid JSON matching this schema: {json.dumps(schema)}") if schema else F.lit("")
        line = F.struct(
            unit.alias("custom_id"),
            F.struct(
                F.lit(model).alias("model"),
                F.lit(max_tokens).alias("max_tokens"),
                F.array(F.struct(user, F.concat(prompt, ask).alias("content"))).alias("messages"),
            ).alias("params"),
        )
    else:
        raise ValueError(f"Unknown vendor '{vendor}'")
    return prompts.withColumn("value", F.to_json(line))


def write_batch_requests(requests: DataFrame, path: str, by: str = "chunk_id") -> None:
    """Request lines as text, one folder per chunk."""
    requests.select(by, "value").write.mode("overwrite").partitionBy(by).text(path)
