"""The model registry as a dimension table."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PRICING = (
    "provider string, model string, display_name string, input_per_million double, output_per_million double, "
    "realtime_multiplier double, provider_multiplier double, is_default boolean"
)


def pricing_rows(registry: dict) -> list[tuple]:
    """Rows of a registry document: providers with models, their prices, default model and realtime multiplier."""
    rows = []
    for provider, p in registry.get("providers", {}).items():
        for model, m in p.get("models", {}).items():
            rows.append(
                (
                    provider, model, m.get("display_name", model), m.get("input_per_million"), m.get("output_per_million"),
                    m.get("realtime_multiplier"), p.get("realtime_multiplier"), model == p.get("default_model"),
                )
            )
    return [tuple(float(x) if isinstance(x, int) and not isinstance(x, bool) else x for x in r) for r in rows]


def load_pricing(spark: SparkSession, path: str) -> DataFrame:
    """Read a registry document (JSON, or YAML where a reader is installed). It is a small configuration file."""
    text = "\n".join(r.value for r in spark.read.text(path, wholetext=True).collect())
    if path.endswith((".yaml", ".yml")):
        import yaml

        registry = yaml.safe_load(text)
    else:
        registry = json.loads(text)
    return spark.createDataFrame(pricing_rows(registry), PRICING)


def merge_pricing(current: DataFrame, listed: DataFrame, batch_discount: float = 0.5, tolerance: float = 0.001) -> DataFrame:
    """Compare stored prices with a vendor's current list by model: `update`, `unchanged`, `add`, `missing` or `unpriced`.

    Both have (model, input_per_million, output_per_million). List prices may be NULL; they are turned into batch prices
    with four decimals.
    """
    new = listed.select(
        F.col("model").alias("_model"),
        (F.col("input_per_million") * batch_discount).alias("_in"),
        (F.col("output_per_million") * batch_discount).alias("_out"),
    )
    old = current.select("model", F.col("input_per_million").alias("old_input"), F.col("output_per_million").alias("old_output"))
    both = old.join(new, F.col("model") == F.col("_model"), "full_outer")
    moved = (F.abs(F.coalesce("old_input", F.lit(0.0)) - F.col("_in")) > tolerance) | (
        F.abs(F.coalesce("old_output", F.lit(0.0)) - F.col("_out")) > tolerance
    )
    no_price = F.col("_in").isNull() | F.col("_out").isNull()
    action = (
        F.when(F.col("_model").isNull(), F.lit("missing"))
        .when(F.col("model").isNull(), F.when(no_price, F.lit("unpriced")).otherwise(F.lit("add")))
        .when(~no_price & moved, F.lit("update"))
        .otherwise(F.lit("unchanged"))
    )
    changed = F.col("action").isin("update", "add")
    return both.withColumn("action", action).select(
        F.coalesce("model", "_model").alias("model"),
        "old_input",
        "old_output",
        F.when(changed, F.round("_in", 4)).otherwise(F.col("old_input")).alias("new_input"),
        F.when(changed, F.round("_out", 4)).otherwise(F.col("old_output")).alias("new_output"),
        "action",
    )
