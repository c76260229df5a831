"""Record tables derived from the given tables, as SQL that Spark and the comparison engine both read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordforge.plans.registry import table

STEPS = ["signup", "view", "click", "purchase"]
CENTS = "cast(round(o_totalprice * 100) as bigint)"

# A model response about every order, clean or damaged in one of nine ways by the order key.
_BASE = (
    f"""'{{"order": ' || o_orderkey || ', "cents": ' || {CENTS} || ', "status": "' || o_orderstatus || """
    """'", "priority": "' || o_orderpriority || '", "tags": ["a", "b"]}'"""
)
RESPONSE = f"""
    CASE o_orderkey % 10
    WHEN 1 THEN 'Here you are:' || chr(10) || '```json' || chr(10) || {_BASE} || chr(10) || '```'
    WHEN 2 THEN replace({_BASE}, '"cents": ', '"cents": +')
    WHEN 3 THEN replace({_BASE}, ']}}', ',],}}')
    WHEN 4 THEN '{{"order": "' || o_orderkey || '", "cents": " ' || {CENTS} || '", "status": "' || o_orderstatus || '"}}'
    WHEN 5 THEN '{{"order": ' || o_orderkey || ', "cents": ' || {CENTS} || ', "status": "shadow ' || lower(o_orderstatus) || ' | x"}}'
    WHEN 6 THEN '{{"order": ' || o_orderkey || ', "status": "' || o_orderstatus || '"}}'
    WHEN 7 THEN 'no answer for ' || o_orderkey
    WHEN 8 THEN '{{"order": ' || o_orderkey || '.5, "cents": ' || {CENTS} || ', "status": "' || o_orderstatus || '"}}'
    WHEN 9 THEN '{{"order": ' || o_orderkey || ', "cents": ' || {CENTS} || ', "status": "' || o_orderstatus || '", "tags": "a", "paid": "TRUE"}}'
    ELSE {_BASE} END
"""
SCHEMA = {
    "type": "object",
    "required": ["order", "cents", "status"],
    "properties": {
        "order": {"type": "integer", "minimum": 0},
        "cents": {"type": "integer"},
        "status": {"type": "string", "enum": ["O", "P", "F"]},
        "priority": {"type": "string", "minLength": 3},
        "tags": {"type": "array", "minItems": 1, "items": {"type": "string"}},
        "paid": {"type": "boolean"},
    },
}

# Attempts of a four-step run: events are outputs of the step they are named after, error events are failures.
UNIT = "'u' || user_id || '__h' || hour(ts)"
FAIL_STEP = "CASE event_id % 4 WHEN 0 THEN 'signup' WHEN 1 THEN 'view' WHEN 2 THEN 'click' ELSE 'purchase' END"
FAIL_STAGE = "CASE event_id % 3 WHEN 0 THEN NULL WHEN 1 THEN 'schema_validation' ELSE 'pipeline_internal' END"
FAIL_COUNT = "CASE WHEN event_id % 11 = 0 THEN NULL ELSE event_id % 5 END"
FAIL_MESSAGE = "CASE WHEN value < 30 THEN 'too small' WHEN value < 60 THEN 'bad tone in line ' || (event_id % 3) ELSE 'timeout' END"
CHUNK = "'chunk_00' || (event_id % 7)"
OUTPUTS_SQL = (
    f"SELECT {UNIT} AS unit_id, event_type AS step, {CHUNK} AS chunk, event_id, ts, value, props FROM events WHERE event_type <> 'error'"
)
FAILURES_SQL = f"""
    SELECT {UNIT} AS unit_id, {FAIL_STEP} AS step, {CHUNK} AS chunk, {FAIL_STAGE} AS failure_stage, {FAIL_COUNT} AS retry_count,
        {FAIL_MESSAGE} AS message, event_id, ts, value FROM events WHERE event_type = 'error'
"""
UNITS_SQL = f"SELECT DISTINCT {UNIT} AS unit_id FROM events"

# Runs and their chunks: a customer is a run, an order is a chunk.
RUN_STATUS = "CASE c_custkey % 6 WHEN 0 THEN 'complete' WHEN 1 THEN 'failed' WHEN 2 THEN 'running' WHEN 3 THEN 'paused' ELSE NULL END"
CHUNK_STATE = """CASE o_orderkey % 8 WHEN 0 THEN 'VALIDATED' WHEN 1 THEN 'signup_PENDING' WHEN 2 THEN 'view_SUBMITTED'
    WHEN 3 THEN 'click_COMPLETE' WHEN 4 THEN 'FAILED' WHEN 5 THEN 'purchase_PENDING' WHEN 6 THEN 'PENDING' ELSE 'VALIDATED' END"""
RUNS_SQL = f"""
    SELECT c_custkey AS run, {RUN_STATUS} AS status, CASE c_custkey % 3 WHEN 0 THEN 'realtime' ELSE 'batch' END AS mode,
        c_mktsegment AS provider, 'Brand#' || (c_custkey % 30) AS model,
        c_custkey * 100 AS initial_input_tokens, c_custkey * 10 AS initial_output_tokens, c_custkey % 50 AS retry_input_tokens,
        c_custkey % 20 AS retry_output_tokens FROM customer
"""
CHUNKS_SQL = f"""
    SELECT o_custkey AS run, o_orderkey AS chunk, {CHUNK_STATE} AS state, o_orderkey % 50 AS items, o_orderkey % 37 AS valid,
        o_orderkey % 13 AS failed, o_orderkey % 5 AS retries, {CENTS} AS input_tokens, o_orderkey % 900 AS output_tokens,
        o_orderdate AS submitted_at FROM orders
"""
NOW = "TIMESTAMP '2002-01-01 00:00:00'"


def derived(spark, sf: str, sql: str, name: str) -> DataFrame:
    """The rows of one of the statements above over a table in a folder."""
    return spark.sql(sql.replace(f"FROM {name}", "FROM {source}"), source=table(spark, sf, name))


def outputs(spark, sf: str) -> DataFrame:
    return derived(spark, sf, OUTPUTS_SQL, "events")


def failures(spark, sf: str) -> DataFrame:
    return derived(spark, sf, FAILURES_SQL, "events").withColumn("retry_count", F.col("retry_count").cast("int"))


def units(spark, sf: str) -> DataFrame:
    return derived(spark, sf, UNITS_SQL, "events")


def runs(spark, sf: str) -> DataFrame:
    return derived(spark, sf, RUNS_SQL, "customer")


def chunks(spark, sf: str) -> DataFrame:
    return derived(spark, sf, CHUNKS_SQL, "orders")


def responses(spark, sf: str, tasks: int | None = None) -> DataFrame:
    """(unit_id, k, response) per order; `tasks` spreads the rows first."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus", "o_orderpriority")
    orders = orders.repartition(tasks) if tasks else orders
    return orders.selectExpr("cast(o_orderkey as string) AS unit_id", "o_orderkey", "o_orderkey % 10 AS k", f"{RESPONSE} AS response")


def now():
    return F.expr(NOW)
