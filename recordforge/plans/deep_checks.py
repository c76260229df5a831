"""Schema checks of deep, closed and odd documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from recordforge.operators import schema_check
from recordforge.plans.registry import query, table, tasks

LEVELS = 10


def _deep_schema() -> dict:
    node = {"type": "object", "required": ["n"], "properties": {"n": {"type": "integer"}}, "additionalProperties": False}
    for level in range(LEVELS, 0, -1):
        node = {"type": "object", "required": [f"l{level}"], "properties": {f"l{level}": node}}
    row = {"type": "array", "items": {"type": "integer", "minimum": 0}}
    node["properties"]["grid"] = {"type": "array", "items": {"type": "array", "items": row}}
    return node


_OPEN = "".join(f'"l{i}": {{' for i in range(1, LEVELS + 1))
_DEEP = f"""'{{{_OPEN}"n": "' || o_orderkey || '"' || CASE WHEN o_orderkey % 3 = 0 THEN ', "odd": 1' ELSE '' END || '{"}" * LEVELS},
    "grid": [[["' || o_orderkey || '", 5' || CASE WHEN o_orderkey % 2 = 0 THEN ', "x"' ELSE '' END || '], []], []]}}'"""
_DEEP_PATH = "$." + ".".join(f"l{i}" for i in range(1, LEVELS + 1))


@query(
    "schema_deep",
    f"""
    SELECT o_orderkey, o_orderkey AS n, concat_ws(',', CASE WHEN o_orderkey % 3 = 0 THEN '{_DEEP_PATH}' END,
        CASE WHEN o_orderkey % 2 = 0 THEN '$.grid[0][0][2]' END) AS paths, '{_DEEP_PATH}.n,$.grid[0][0][0]' AS coerced FROM orders
    """,
)
def schema_deep(spark, sf):
    """Ten objects inside each other, the last one closed, and three arrays inside each other."""
    rows = table(spark, sf, "orders").selectExpr("o_orderkey", f"{_DEEP} AS j")
    checked = schema_check.check_schema(rows, _deep_schema(), "j", tasks=tasks(spark))
    return checked.select(
        "o_orderkey",
        F.try_variant_get("data", f"{_DEEP_PATH}.n", "bigint").alias("n"),
        F.array_join(F.transform("errors", lambda e: e.path), ",").alias("paths"),
        F.array_join(F.transform("coercions", lambda c: c.path), ",").alias("coerced"),
    )


_NUMBER = "CASE o_orderkey % 4 WHEN 0 THEN 'NaN' WHEN 1 THEN '-Infinity' ELSE cast(o_orderkey AS string) END"


@query(
    "schema_non_finite",
    """
    WITH d AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'nan' WHEN 1 THEN '-inf' END AS a,
        CASE o_orderkey % 3 WHEN 0 THEN 'inf' END AS y FROM orders)
    SELECT o_orderkey, concat_ws('; ', 'Non-finite number at $.o.a: ' || a, 'Non-finite number at $.x[3].y: ' || y) AS messages,
        a IS NULL AND y IS NULL AS is_valid FROM d
    """,
)
def schema_non_finite(spark, sf):
    """Numbers that JSON cannot hold, in an object and in an object inside an array; texts that look like them are fine."""
    text = (
        f"'{{\"o\": {{\"a\": ' || {_NUMBER} || ', \"say\": \"NaN, [1\"}}, \"x\": [1, \"Infinity\", [2], {{\"k\": {{}}, \"y\": ' "
        "|| CASE o_orderkey % 3 WHEN 0 THEN 'Infinity' ELSE '7' END || '}]}'"
    )
    schema = {
        "type": "object",
        "properties": {
            "o": {"type": "object", "properties": {"a": {"type": "number"}, "say": {"type": "string"}}},
            "x": {"type": "array", "items": {"properties": {"y": {"type": "number", "minimum": 0}}}},
        },
    }
    checked = schema_check.check_schema(table(spark, sf, "orders").selectExpr("o_orderkey", f"{text} AS j"), schema, "j", tasks=tasks(spark))
    return checked.select("o_orderkey", F.array_join(F.transform("errors", lambda e: e.message), "; ").alias("messages"), "is_valid")


@query(
    "schema_closed",
    """
    SELECT c_custkey, concat_ws('; ', CASE WHEN c_custkey % 2 = 0 THEN '$.inner: Additional properties are not allowed (''odd'' was unexpected)' END,
        CASE WHEN c_custkey % 3 = 0 THEN '$: Additional properties are not allowed (''a'', ''b'' were unexpected)' END) AS messages FROM customer
    """,
)
def schema_closed(spark, sf):
    """Objects that may hold nothing but their properties, at the root and below it."""
    inner = F.expr("if(c_custkey % 2 = 0, map('ok', c_custkey, 'odd', 1L), map('ok', c_custkey))")
    extra = lambda n: F.when(F.col("c_custkey") % 3 == 0, F.lit(n))
    rows = table(spark, sf, "customer").select(
        "c_custkey", F.to_json(F.struct(inner.alias("inner"), extra(1).alias("b"), extra(2).alias("a"))).alias("j")
    )
    closed = {"type": "object", "additionalProperties": False}
    schema = {**closed, "properties": {"inner": {**closed, "properties": {"ok": {"type": "integer"}}}}}
    checked = schema_check.check_schema(rows, schema, "j")
    said = F.transform("errors", lambda e: F.concat(e.path, F.lit(": "), e.message))
    return checked.select("c_custkey", F.array_join(said, "; ").alias("messages"))


@query(
    "schema_lengths",
    """
    SELECT c_custkey, CASE WHEN length(c_mktsegment) < 9 THEN '"' || c_mktsegment || '" is too short'
        WHEN length(c_mktsegment) > 9 THEN '"' || c_mktsegment || '" is too long' END AS message FROM customer
    """,
)
def schema_lengths(spark, sf):
    rows = table(spark, sf, "customer").select("c_custkey", F.to_json(F.struct("c_mktsegment")).alias("j"))
    schema = {"type": "object", "properties": {"c_mktsegment": {"type": "string", "minLength": 9, "maxLength": 9}}}
    return schema_check.check_schema(rows, schema, "j").select("c_custkey", F.get("errors", F.lit(0))["message"].alias("message"))


@query(
    "schema_integral",
    """
    SELECT o_orderkey, CASE o_orderkey % 4 WHEN 3 THEN NULL WHEN 2 THEN o_orderkey * 100 ELSE o_orderkey END AS whole,
        o_orderkey % 4 <> 3 AS is_valid, (o_orderkey % 4 IN (1, 2))::INT AS n_coercions FROM orders
    """,
)
def schema_integral(spark, sf):
    """Whole numbers that are written as floats become integers; others stay as they are and are refused."""
    written = (
        "o_orderkey || CASE o_orderkey % 4 WHEN 0 THEN '' WHEN 1 THEN '.0' WHEN 2 THEN '00.00' ELSE '.5' END"
    )
    rows = table(spark, sf, "orders").selectExpr("o_orderkey", f"'{{\"n\": ' || {written} || '}}' AS j")
    checked = schema_check.check_schema(rows, {"type": "object", "properties": {"n": {"type": "integer"}}}, "j")
    whole = F.when(F.schema_of_variant(schema_check.field(F.col("data"), "n")) == "BIGINT", schema_check.field(F.col("data"), "n", "bigint"))
    return checked.select("o_orderkey", whole.alias("whole"), "is_valid", F.size("coercions").alias("n_coercions"))
