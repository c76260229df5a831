"""Running a caller's model function over prompts, and reading what comes back."""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recordforge.functions.jsonfix import repair_json
from recordforge.functions.variants import entries, json_type, overlay
from recordforge.operators.order import lay_out, previous_value, row_positions, running_sum
from recordforge.session import evaluated_once
from recordforge.sources import folders

RESPONSE_SCHEMA = (
    "unit_id string, raw_text string, error string, error_type string, "
    "input_tokens bigint, output_tokens bigint, model string, finish_reason string, attempts int"
)
COLUMNS = [c.split()[0] for c in RESPONSE_SCHEMA.split(", ")]
# Texts that mark an authentication or billing problem, in lower case.
AUTH_MARKS = [
    "401",
    "403",
    "authentication",
    "unauthorized",
    "forbidden",
    "invalid api key",
    "api key invalid",
    "billing",
    "quota exceeded",
    "insufficient_quota",
    "rate limit exceeded",
]
# Messages of responses that cannot go on to validation.
LOST_MESSAGES = {
    "not_object": "LLM response is not a JSON object",
    "not_json": "LLM response is not valid JSON",
    "empty": "Empty LLM response",
    "none": "No response data from LLM",
}


class RateLimited(Exception):
    """The model refused for now; the call is tried again later."""


class AuthFailed(Exception):
    """The model refuses these credentials; the job ends."""


def infer(
    prompts: DataFrame,
    fn: Callable[[str, str], dict],
    partitions: int | None = None,
    max_tries: int = 3,
    first_wait: float = 1.0,
    wait_factor: float = 2.0,
) -> DataFrame:
    """Call `fn(unit_id, prompt)` for every prompt; parallel over partitions, one Arrow batch at a time.

    `fn` returns a dict with `text` and optional `input_tokens, output_tokens, model, finish_reason`. Rate limits and
    timeouts are tried again with growing pauses; when tries run out the row carries the error. AuthFailed ends the job.
    """

    call = _caller(fn, max_tries, first_wait, wait_factor)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [call(u, p) for u, p in zip(batch["unit_id"], batch["prompt"])]
            yield pd.DataFrame(rows, columns=COLUMNS)

    work = prompts.select("unit_id", "prompt")
    if partitions:
        work = work.repartition(partitions)
    return work.mapInPandas(run, RESPONSE_SCHEMA)


def _caller(fn: Callable[[str, str], dict], max_tries: int, first_wait: float, wait_factor: float) -> Callable[[str, str], tuple]:
    def call(unit_id: str, prompt: str) -> tuple:
        wait = first_wait
        for attempt in range(1, max_tries + 1):
            try:
                r = fn(unit_id, prompt)
                return (unit_id, r.get("text"), None, None, r.get("input_tokens", 0), r.get("output_tokens", 0),
                        r.get("model"), r.get("finish_reason"), attempt)
            except AuthFailed:
                raise
            except (RateLimited, TimeoutError) as e:
                last = (unit_id, None, str(e), "rate_limit" if isinstance(e, RateLimited) else "timeout", 0, 0, None, None, attempt)
                if attempt < max_tries:
                    time.sleep(wait * (1 + 0.1 * random.random()))
                    wait *= wait_factor
            except Exception as e:  # a failed call is data, not a failed job
                return (unit_id, None, str(e), "error", 0, 0, None, None, attempt)
        return last

    return call


KEY = "prompt_key"


def infer_once(
    prompts: DataFrame,
    fn: Callable[[str, str], dict],
    log: str,
    waves: int = 1,
    partitions: int | None = None,
    max_tries: int = 3,
    first_wait: float = 1.0,
    wait_factor: float = 2.0,
) -> DataFrame:
    """Like `infer`, but every answer is paid once: answers go to a log in a shared folder, and are read from there.

    The log is keyed by a digest of unit and prompt. A second run calls only what has no answer yet, and reading the result
    calls nothing. Work is done in `waves`, each a job that appends to the log, so a job that fails loses no more than its
    own wave. Calls that ended in an error stay in the log too and are made again by the next run; the result has the
    answer of a prompt if there is one, else its error. Repeated rows share one call.
    """
    spark = prompts.sparkSession
    keyed = prompts.select("unit_id", "prompt", F.sha2(F.concat_ws("\x00", "unit_id", "prompt"), 256).alias(KEY))
    schema = f"{KEY} string, {RESPONSE_SCHEMA}"
    call = _caller(fn, max_tries, first_wait, wait_factor)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(k, *call(u, p)) for k, u, p in zip(batch[KEY], batch["unit_id"], batch["prompt"])]
            yield pd.DataFrame(rows, columns=[KEY, *COLUMNS])

    def logged() -> DataFrame:
        if not folders.exists(spark, log):
            return spark.createDataFrame([], schema)
        return spark.read.schema(schema).parquet(folders.literal(log))

    for wave in range(waves):
        answered = logged().filter("error is null").select(KEY)
        own = keyed.filter(F.pmod(F.xxhash64(KEY), F.lit(waves)) == wave).dropDuplicates([KEY])
        missing = own.join(answered, KEY, "left_anti")
        missing = missing.repartition(partitions) if partitions else missing
        missing.mapInPandas(run, schema).write.mode("append").parquet(log)
    best = F.min_by(F.struct(*COLUMNS[1:]), F.col("error").isNotNull()).alias("r")
    answers = logged().groupBy(KEY).agg(best)
    return keyed.join(answers, KEY).select("unit_id", "r.*")


def read_responses(df: DataFrame, column: str, out: str = "parsed", safe: bool = False) -> DataFrame:
    """Add the JSON value of a response text; it is parsed once, whatever is filtered on it later."""
    return evaluated_once(df.withColumn(out, repair_json(F.col(column), safe)), [out])


def classify_results(responses: DataFrame, step: str, safe: bool = False) -> DataFrame:
    """Read response text and say what each row is.

    Adds `parsed` (VARIANT), `data` (fields of an object, or the whole value under `response`), and for everything that
    cannot go on to validation a `failure_stage` and `message`. Error rows are kept apart in `outcome`.
    """
    parsed = responses.withColumn("parsed", repair_json(F.col("raw_text"), safe))
    kind = json_type(F.col("parsed"))
    outcome = (
        F.when(F.col("error").isNotNull(), F.lit("error"))
        .when(F.col("raw_text").isNull(), F.lit("none"))
        .when(F.col("raw_text") == "", F.lit("empty"))
        .when(kind.isNull(), F.lit("not_json"))
        .when(kind != "object", F.lit("not_object"))
        .otherwise(F.lit("parsed"))
    )
    message = F.when(F.col("outcome") == "error", F.col("error"))
    for name, text in LOST_MESSAGES.items():
        message = message.when(F.col("outcome") == name, F.lit(text))
    none = F.expr("cast(map() as map<string,variant>)")
    whole = F.when(F.col("outcome") == "parsed", entries(F.col("parsed"))).when(
        F.col("parsed").isNotNull(), F.create_map(F.lit("response"), F.col("parsed"))
    )
    done = (
        parsed.withColumn("outcome", outcome)
        .withColumn("message", message)
        .withColumn(
            "failure_stage",
            F.when(F.col("outcome").isin(*LOST_MESSAGES), F.lit("pipeline_internal")).when(
                F.col("outcome") == "error", F.lit("schema_validation")
            ),
        )
        .withColumn("step", F.lit(step))
        .withColumn("data", overlay(F.coalesce(whole, none), F.expr("map('unit_id', cast(unit_id as variant))")))
    )
    return evaluated_once(done, ["parsed", "outcome", "message", "failure_stage", "data"])


def cost_cap(df: DataFrame, cap: float, cost: str, order_by: list[str], run: list[str] | None = None) -> DataFrame:
    """Rows up to and including the one that brings the run's cost to the cap."""
    run = run or []
    running = running_sum(df, F.col(cost), order_by, run, out="running_cost")
    return running.filter(F.col("running_cost") - F.col(cost) < cap)


def auth_abort(df: DataFrame, order_by: list[str], run: list[str], first: int = 10) -> DataFrame:
    """Runs to stop early: among their first units, an authentication error before any success.

    `df` has `ok` and `error`. The limit on the rank reaches the map side, so a task sees `first` rows per run.
    """
    pattern = "|".join(AUTH_MARKS)
    ranked = df.withColumn("_n", F.row_number().over(Window.partitionBy(*run).orderBy(*order_by)))
    auth = ~F.col("ok") & F.coalesce(F.lower("error").rlike(pattern), F.lit(False))
    seen = ranked.filter(F.col("_n") <= first).groupBy(*run).agg(
        F.count(F.lit(1)).alias("checked"),
        F.min(F.when(F.col("ok"), F.col("_n"))).alias("first_success"),
        F.min(F.when(auth, F.col("_n"))).alias("first_auth_error"),
    )
    stop = F.col("first_auth_error") < F.coalesce(F.col("first_success"), F.lit(first + 1))
    return seen.withColumn("abort", F.coalesce(stop, F.lit(False)))


def error_streaks(df: DataFrame, error: str, order_by: list[str], run: list[str]) -> DataFrame:
    """Lengths of runs of the same error among a run's failures in order; successes between them do not count."""
    failed = df.filter(F.col(error).isNotNull()).select(*run, *order_by, F.col(error).alias("error"))
    laid = lay_out(failed, order_by, run)
    before = previous_value(laid, F.col("error"), order_by, run, out="_before", keep_layout=True)
    first = F.when(F.col("error").eqNullSafe(F.col("_before")), 0).otherwise(1)
    marked = running_sum(before, first, order_by, run, out="streak")
    return (
        marked.groupBy(*run, "streak", "error")
        .agg(F.count(F.lit(1)).alias("length"))
        .select(*run, "error", "streak", "length")
    )


def numbered(df: DataFrame, order_by: list[str]) -> DataFrame:
    """Call sequence numbers from 1 over the whole table."""
    return row_positions(df, order_by, out="seq").withColumn("seq", F.col("seq") + 1)
