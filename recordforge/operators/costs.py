"""Tokens and money."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Prices per million tokens and multiplier where the registry names none.
DEFAULT_INPUT, DEFAULT_OUTPUT, DEFAULT_MULTIPLIER = 1.0, 2.0, 2.0


def with_prices(
    df: DataFrame,
    pricing: DataFrame,
    defaults: tuple[float, float] = (DEFAULT_INPUT, DEFAULT_OUTPUT),
    fall_back_to_default_model: bool = False,
) -> DataFrame:
    """Add `input_rate`, `output_rate` and `price_known` for (provider, model, mode).

    Registry prices are batch prices; realtime multiplies them by the model's, else the provider's, else a fixed factor.
    The registry is a configuration-sized table, and Spark broadcasts it while it stays below the session's threshold.
    """
    by_model = pricing.select(
        F.col("provider").alias("_p"), F.col("model").alias("_m"), F.col("input_per_million").alias("_in"),
        F.col("output_per_million").alias("_out"), F.col("realtime_multiplier").alias("_rm"),
    )
    by_provider = pricing.groupBy(F.col("provider").alias("_q")).agg(
        F.max("provider_multiplier").alias("_pm"),
        F.max(F.when(F.col("is_default"), F.col("input_per_million"))).alias("_din"),
        F.max(F.when(F.col("is_default"), F.col("output_per_million"))).alias("_dout"),
        F.max(F.when(F.col("is_default"), F.col("realtime_multiplier"))).alias("_drm"),
    )
    joined = df.join(by_model, (F.col("provider") == F.col("_p")) & (F.col("model") == F.col("_m")), "left")
    joined = joined.join(by_provider, F.col("provider") == F.col("_q"), "left")
    known = F.col("_p").isNotNull()
    if fall_back_to_default_model:
        rate_in, rate_out = F.coalesce("_in", "_din", F.lit(defaults[0])), F.coalesce("_out", "_dout", F.lit(defaults[1]))
    else:
        rate_in, rate_out = F.coalesce("_in", F.lit(defaults[0])), F.coalesce("_out", F.lit(defaults[1]))
    factor = F.when(F.col("mode") == "realtime", F.coalesce("_rm", "_pm", F.lit(DEFAULT_MULTIPLIER))).otherwise(F.lit(1.0))
    return joined.withColumns(
        {"input_rate": rate_in * factor, "output_rate": rate_out * factor, "price_known": known}
    ).drop("_p", "_m", "_in", "_out", "_rm", "_q", "_pm", "_din", "_dout", "_drm")


def cost(input_tokens: str | Column, output_tokens: str | Column, input_rate="input_rate", output_rate="output_rate") -> Column:
    c = [F.col(x) if isinstance(x, str) else x for x in (input_tokens, output_tokens, input_rate, output_rate)]
    return (c[0] * c[2] + c[1] * c[3]) / F.lit(1_000_000.0)


def run_costs(runs: DataFrame, pricing: DataFrame, surviving: DataFrame | None = None) -> DataFrame:
    """Per run: token totals, share of retries, cost, and cost per surviving unit.

    `runs` has run, provider, model, mode and the four token counts; `surviving` has (run, surviving).
    """
    zero = F.lit(0)
    filled = runs.withColumns(
        {c: F.coalesce(c, zero) for c in
         ("initial_input_tokens", "initial_output_tokens", "retry_input_tokens", "retry_output_tokens")}
    )
    total_in = F.col("initial_input_tokens") + F.col("retry_input_tokens")
    total_out = F.col("initial_output_tokens") + F.col("retry_output_tokens")
    retries = F.col("retry_input_tokens") + F.col("retry_output_tokens")
    priced = with_prices(filled, pricing).withColumns({"total_input": total_in, "total_output": total_out})
    done = priced.withColumns(
        {
            "retry_pct": F.coalesce(F.try_divide(retries * 100.0, total_in + total_out), F.lit(0.0)),
            "cost": cost("total_input", "total_output"),
        }
    )
    out = done.select("run", "provider", "model", "mode", "total_input", "total_output", "retry_pct", "cost", "price_known")
    if surviving is None:
        return out
    per_unit = F.coalesce(F.try_divide(F.col("cost"), F.col("surviving")), F.lit(0.0))
    return out.join(surviving.select("run", "surviving"), "run", "left").withColumn("cost_per_unit", per_unit)


def projected_cost(cost_so_far: Column, progress: Column) -> Column:
    """Cost at the end, once more than one percent (of 1.0) is done."""
    return F.when(progress > 0.01, cost_so_far / progress)


def dashboard_totals(runs: DataFrame) -> DataFrame:
    """Runs, active runs, tokens and cost over all runs."""
    return runs.agg(
        F.count(F.lit(1)).alias("runs"),
        F.count_if(F.col("status") == "active").alias("active_runs"),
        F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"),
        F.coalesce(F.sum("cost"), F.lit(0.0)).alias("cost"),
    )
