"""Failures, retries, integrity and repair over attempts derived from events and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from recordforge.functions.variants import row_as_map
from recordforge.operators import integrity, ledger
from recordforge.operators.rules import finding
from recordforge.operators.validate import last_per_key
from recordforge.plans.registry import query, table
from recordforge.plans.shared import CENTS, FAILURES_SQL, OUTPUTS_SQL, SCHEMA, STEPS, UNITS_SQL, failures, outputs, responses, units

FO = f"WITH o AS ({OUTPUTS_SQL}), f AS ({FAILURES_SQL}), u AS ({UNITS_SQL})"
ORDER = ["ts", "event_id"]
BUDGET = """, b AS (SELECT step, unit_id, max(coalesce(retry_count, 0))::INT AS retry_count FROM f
    WHERE coalesce(failure_stage, 'validation') IN ('schema_validation', 'validation') GROUP BY ALL)"""
# What each step was given: units for the first, the last output of the step before for the others.
GIVEN = """, last_out AS (SELECT step, unit_id, arg_max(event_id, (ts, event_id)) AS event_id FROM o GROUP BY ALL),
    given AS (SELECT 'signup' AS step, unit_id, NULL::BIGINT AS event_id FROM u
        UNION ALL SELECT CASE step WHEN 'signup' THEN 'view' WHEN 'view' THEN 'click' ELSE 'purchase' END, unit_id, event_id
        FROM last_out WHERE step <> 'purchase')"""


def given(spark, sf):
    last = last_per_key(outputs(spark, sf), ["step", "unit_id"], ORDER).select("step", "unit_id", "event_id")
    following = F.create_map(*[F.lit(x) for pair in zip(STEPS, STEPS[1:]) for x in pair])
    later = last.withColumn("step", F.try_element_at(following, F.col("step"))).filter("step is not null")
    first = units(spark, sf).select(F.lit(STEPS[0]).alias("step"), "unit_id", F.lit(None).cast("bigint").alias("event_id"))
    return first.unionByName(later)


@query(
    "ledger_unresolved",
    FO
    + """, s AS (SELECT step, unit_id, arg_max(retry_count, (ts, event_id)) AS r0, max((ts, event_id)) AS seen_at, arg_max(event_id, (ts, event_id)) AS e FROM f GROUP BY ALL),
    open_ones AS (SELECT * FROM s WHERE (step, unit_id) NOT IN (SELECT (step, unit_id) FROM o))
    SELECT unit_id, arg_max(step, seen_at) AS step, arg_max(e, seen_at) AS event_id FROM open_ones GROUP BY unit_id""",
)
def ledger_unresolved(spark, sf):
    return ledger.unresolved_failures(failures(spark, sf), outputs(spark, sf), ORDER).select("unit_id", "step", "event_id")


@query("ledger_budget", FO + BUDGET + "SELECT *, CASE WHEN retry_count < 3 THEN 'retry' ELSE 'permanent' END AS decision FROM b")
def ledger_budget(spark, sf):
    return ledger.retry_budget(failures(spark, sf))


@query(
    "ledger_retries",
    FO + BUDGET + GIVEN
    + "SELECT g.step, g.unit_id, g.event_id, b.retry_count + 1 AS retry_count FROM given g JOIN b USING (step, unit_id) WHERE b.retry_count < 3 AND g.step <> 'click'",
)
def ledger_retries(spark, sf):
    return ledger.build_retries(failures(spark, sf), given(spark, sf), deterministic_steps=["click"]).select(
        "step", "unit_id", "event_id", "retry_count"
    )


@query(
    "ledger_missing_inputs",
    FO + BUDGET + GIVEN + "SELECT b.step, b.unit_id, b.retry_count FROM b ANTI JOIN given g USING (step, unit_id) WHERE b.retry_count < 3",
)
def ledger_missing_inputs(spark, sf):
    return ledger.missing_inputs(failures(spark, sf), given(spark, sf)).select("step", "unit_id", "retry_count")


@query(
    "ledger_permanent",
    FO
    + """SELECT unit_id, step, max(coalesce(retry_count, 0))::INT AS retry_count, arg_max(chunk, (coalesce(retry_count, 0), chunk)) AS source_chunk
    FROM f GROUP BY unit_id, step HAVING max(coalesce(retry_count, 0)) >= 3""",
)
def ledger_permanent(spark, sf):
    return ledger.permanent_failures(failures(spark, sf))


@query(
    "ledger_exhausted",
    FO
    + """SELECT event_id, CASE WHEN step = 'view' AND coalesce(failure_stage, 'validation') <> 'pipeline_internal'
        THEN greatest(coalesce(retry_count, 0), 3) ELSE retry_count END AS retry_count FROM f""",
)
def ledger_exhausted(spark, sf):
    return ledger.exhaust_deterministic(failures(spark, sf), ["view"]).select("event_id", "retry_count")


@query(
    "ledger_merge",
    FO + BUDGET
    + """, t AS (SELECT step, unit_id, retry_count + 1 AS retry_count, right(unit_id, 1) IN ('0', '2', '4', '6', '8') AS ok FROM b WHERE retry_count < 3),
    v AS (SELECT step, unit_id FROM o WHERE (step, unit_id) NOT IN (SELECT (step, unit_id) FROM t WHERE ok) UNION ALL SELECT step, unit_id FROM t WHERE ok),
    x AS (SELECT step, unit_id, retry_count FROM f WHERE (step, unit_id) NOT IN (SELECT (step, unit_id) FROM t) UNION ALL
        SELECT step, unit_id, retry_count FROM t WHERE NOT ok)
    SELECT 'valid' AS what, step, count(*)::BIGINT AS n, 0::BIGINT AS retries FROM v GROUP BY step
    UNION ALL SELECT 'failed', step, count(*), coalesce(sum(retry_count), 0)::BIGINT FROM x GROUP BY step""",
)
def ledger_merge(spark, sf):
    """Half of the retried units succeed; both tables are brought up to date."""
    f, o = failures(spark, sf), outputs(spark, sf)
    tried = ledger.retry_budget(f).filter("decision = 'retry'").select("step", "unit_id", (F.col("retry_count") + 1).alias("retry_count"))
    ok = F.right("unit_id", F.lit(1)).isin("0", "2", "4", "6", "8")
    valid, left = ledger.merge_retries(
        o.select("step", "unit_id"), f.select("step", "unit_id", "retry_count"), tried,
        tried.filter(ok).select("step", "unit_id"), tried.filter(~ok),
    )
    a = valid.groupBy("step").agg(F.count(F.lit(1)).alias("n")).select(F.lit("valid").alias("what"), "step", "n", F.lit(0).cast("bigint").alias("retries"))
    b = left.groupBy("step").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("retry_count"), F.lit(0)).alias("retries"))
    return a.unionByName(b.select(F.lit("failed").alias("what"), "step", "n", "retries"))


@query(
    "ledger_reset",
    FO
    + """SELECT 'left' AS what, count(*)::BIGINT AS n FROM f WHERE NOT (step = 'view' AND unit_id LIKE 'u1%')
    UNION ALL SELECT 'queued', count(DISTINCT unit_id) FROM f WHERE step = 'view' AND unit_id LIKE 'u1%'""",
)
def ledger_reset(spark, sf):
    wanted = units(spark, sf).filter(F.col("unit_id").startswith("u1"))
    left, queued = ledger.reset_retries(failures(spark, sf), "view", wanted)
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("what"), "n")
    return count(left, "left").unionByName(count(queued, "queued"))


@query(
    "ledger_revalidate",
    f"""
    SELECT o_orderkey::VARCHAR AS unit_id, CASE WHEN o_orderkey % 4 = 3 THEN 'untouched' WHEN k = 0 THEN 'no_raw_response'
        WHEN k IN (6, 7, 8) OR {CENTS} < 5000000 THEN 'still_failing' ELSE 'promoted' END AS outcome
    FROM (SELECT *, o_orderkey % 10 AS k FROM orders)
    """,
)
def ledger_revalidate(spark, sf):
    stored = responses(spark, sf).select(
        "unit_id",
        F.when(F.col("o_orderkey") % 4 == 3, F.lit("pipeline_internal")).alias("failure_stage"),
        F.when(F.col("k") != 0, F.col("response")).alias("raw_response"),
        row_as_map(["unit_id"]).alias("input"),
        F.array(finding("$", "old_rule", F.lit("old"))).alias("errors"),
        F.lit(1).alias("retry_count"),
    )
    rules = {"rules": [{"name": "worth_it", "expr": "cents >= 5000000"}]}
    return ledger.revalidate(stored, SCHEMA, rules, "price").select("unit_id", "outcome")


@query(
    "ledger_rounds",
    FO
    + """, b AS (SELECT step, unit_id, max(coalesce(retry_count, 0))::INT AS c FROM f WHERE coalesce(failure_stage, 'validation') <> 'pipeline_internal' GROUP BY ALL),
    g AS (SELECT *, right(unit_id, 1)::INT AS h FROM b),
    w AS (SELECT *, list_min(list_filter([1, 2, 3], lambda r: (h + r) % 4 = 0)) AS win FROM g)
    SELECT step, count(*) FILTER (c < 3 AND coalesce(win, 9) <= 3 - c)::BIGINT AS recovered, count(*) FILTER (NOT (c < 3 AND coalesce(win, 9) <= 3 - c))::BIGINT AS given_up
    FROM w GROUP BY step""",
)
def ledger_rounds(spark, sf):
    """Rounds of attempts until every soft failure has recovered or spent its budget."""
    soft = failures(spark, sf).filter(ledger.is_retryable()).select("step", "unit_id", "failure_stage", "retry_count")

    def attempt(due, round_no):
        ok = (F.right("unit_id", F.lit(1)).cast("int") + round_no) % 4 == 0
        return due.filter(ok), due.filter(~ok).withColumn("failure_stage", F.lit("validation")).select(*soft.columns)

    inputs = soft.select("step", "unit_id").distinct()
    ok, bad, _ = ledger.retry_rounds(soft, inputs, attempt)
    parts = ok.select("step", "unit_id", F.lit(True).alias("won")).unionByName(bad.select("step", "unit_id", F.lit(False).alias("won")))
    each = parts.groupBy("step", "unit_id").agg(F.bool_or("won").alias("won"))
    return each.groupBy("step").agg(F.count_if("won").alias("recovered"), F.count_if(~F.col("won")).alias("given_up"))


@query(
    "token_ledger",
    """
    SELECT event_type AS run, sum(CASE WHEN event_id % 4 = 0 THEN round(value)::BIGINT ELSE 0 END)::BIGINT AS initial_input_tokens,
        sum(CASE WHEN event_id % 4 = 0 THEN user_id ELSE 0 END)::BIGINT AS initial_output_tokens,
        sum(CASE WHEN event_id % 4 > 0 THEN round(value)::BIGINT ELSE 0 END)::BIGINT AS retry_input_tokens,
        sum(CASE WHEN event_id % 4 > 0 THEN user_id ELSE 0 END)::BIGINT AS retry_output_tokens FROM events GROUP BY event_type
    """,
)
def token_ledger(spark, sf):
    calls = table(spark, sf, "events").selectExpr(
        "event_type AS run", "cast(round(value) as bigint) AS input_tokens", "user_id AS output_tokens", "event_id % 4 AS retry_count"
    )
    return ledger.token_ledger(calls, ["run"])


EXPECTED = """, e AS (SELECT *, 1 AS k FROM (SELECT 'signup' AS step, unit_id FROM u UNION
        SELECT CASE step WHEN 'signup' THEN 'view' WHEN 'view' THEN 'click' ELSE 'purchase' END, unit_id FROM o WHERE step <> 'purchase')),
    v AS (SELECT step, unit_id, count(*) AS n FROM o GROUP BY ALL), x AS (SELECT DISTINCT step, unit_id, 1 AS k FROM f),
    a AS (SELECT step, unit_id, e.k IS NOT NULL AS expected, coalesce(v.n, 0) AS n, x.k IS NOT NULL AS failed
        FROM e FULL JOIN v USING (step, unit_id) FULL JOIN x USING (step, unit_id))"""


@query(
    "verify_run",
    FO + EXPECTED
    + """SELECT step, count(*) FILTER (expected)::BIGINT AS expected, count(*) FILTER (n > 0)::BIGINT AS valid, count(*) FILTER (failed)::BIGINT AS failed,
        count(*) FILTER (expected AND n = 0 AND NOT failed)::BIGINT AS missing, sum(greatest(n - 1, 0))::BIGINT AS duplicated,
        count(*) FILTER (NOT expected AND (n > 0 OR failed))::BIGINT AS orphaned,
        CASE WHEN count(*) FILTER (expected AND n = 0 AND NOT failed) = 0 AND sum(greatest(n - 1, 0)) = 0 THEN 'OK' ELSE 'ERROR' END AS status
    FROM a GROUP BY step""",
)
def verify_run(spark, sf):
    return integrity.verify_run(units(spark, sf), outputs(spark, sf), failures(spark, sf), STEPS)


@query(
    "unit_issues",
    FO + EXPECTED
    + """SELECT * FROM (SELECT step, unit_id, CASE WHEN expected AND n = 0 AND NOT failed THEN 'missing' WHEN NOT expected AND (n > 0 OR failed) THEN 'orphaned'
        WHEN n > 1 THEN 'duplicated' END AS issue FROM a) WHERE issue IS NOT NULL""",
)
def unit_issues(spark, sf):
    return integrity.unit_issues(units(spark, sf), outputs(spark, sf), failures(spark, sf), STEPS)


@query(
    "repair_run",
    FO + EXPECTED
    + """, best AS (SELECT step, unit_id, arg_max(event_id, (coalesce((value > 50)::INT, 0), -event_id)) AS event_id FROM o GROUP BY ALL),
    g AS (SELECT 'signup' AS step, unit_id, NULL::BIGINT AS event_id FROM u UNION ALL
        SELECT CASE step WHEN 'signup' THEN 'view' WHEN 'view' THEN 'click' ELSE 'purchase' END, unit_id, event_id FROM best WHERE step <> 'purchase')
    SELECT g.step, g.unit_id, g.event_id FROM g JOIN a USING (step, unit_id) WHERE a.expected AND a.n = 0 AND NOT a.failed""",
)
def repair_run(spark, sf):
    """Missing units with the richest record of the step before; here a record counts as richer above 50."""
    o = outputs(spark, sf).select("step", "unit_id", "event_id", "value")
    u = units(spark, sf).select("unit_id", F.lit(None).cast("bigint").alias("event_id"), F.lit(None).cast("double").alias("value"))
    made = integrity.repair_run(u, o, failures(spark, sf), STEPS, ["event_id"], F.coalesce((F.col("value") > 50).cast("int"), F.lit(0)))
    return made.select("step", "unit_id", "event_id")


@query(
    "richest_record",
    """
    SELECT user_id, arg_max(event_id, (n, -event_id)) AS event_id, max(n) AS n_fields FROM (
        SELECT user_id, event_id, 1 + (event_id % 3 = 0)::INT + (value > 50)::INT AS n FROM events) GROUP BY user_id
    """,
)
def richest_record(spark, sf):
    """Among the records of a user the one with most JSON fields; the first one wins a tie."""
    doc = F.to_json(
        F.struct("event_id", F.when(F.col("event_id") % 3 == 0, F.lit(1)).alias("a"), F.when(F.col("value") > 50, F.lit(1)).alias("b"))
    )
    rows = table(spark, sf, "events").select("user_id", "event_id", F.parse_json(doc).alias("d"))
    rows = rows.withColumn("n_fields", integrity.field_count(F.col("d"))).drop("d")
    return integrity.richest(rows, F.col("n_fields"), ["event_id"], ["user_id"])


@query(
    "completeness",
    """
    SELECT o_orderkey, e > 0 AND (v + f >= e OR (v > 0 AND f = 0 AND NOT marked AND v >= e * 0.9)) AS skip, greatest(e - v - f, 0) AS unaccounted
    FROM (SELECT o_orderkey, o_orderkey % 21 AS e, o_orderkey % 19 AS v, CASE WHEN o_orderkey % 2 = 0 THEN 0 ELSE o_orderkey % 5 END AS f,
        o_orderkey % 7 = 0 AS marked FROM orders)
    """,
)
def completeness(spark, sf):
    chunks = table(spark, sf, "orders").selectExpr(
        "o_orderkey", "o_orderkey % 21 AS expected", "o_orderkey % 19 AS valid",
        "CASE WHEN o_orderkey % 2 = 0 THEN 0 ELSE o_orderkey % 5 END AS failed", "o_orderkey % 7 = 0 AS retry_marked",
    )
    return integrity.completeness(chunks).select("o_orderkey", "skip", "unaccounted")


@query(
    "terminal_runs",
    """
    SELECT o_custkey AS run, bool_and(o_orderkey % 4 <> 1 OR o_orderkey % 5 >= 3) AS terminal FROM orders GROUP BY o_custkey
    """,
)
def terminal_runs(spark, sf):
    chunks = table(spark, sf, "orders").selectExpr(
        "o_custkey AS run", "CASE WHEN o_orderkey % 4 = 1 THEN 'FAILED' ELSE 'VALIDATED' END AS state", "o_orderkey % 5 AS retries"
    )
    return integrity.terminal_runs(chunks)


@query(
    "stuck_chunks",
    FO + "SELECT step, chunk, 0::BIGINT AS valid FROM (SELECT DISTINCT step, unit_id AS chunk FROM f) ANTI JOIN (SELECT DISTINCT step, unit_id AS chunk FROM o) USING (step, chunk)",
)
def stuck_chunks(spark, sf):
    """Chunks (here one per unit) that failed in a step without a single valid row."""
    ok = outputs(spark, sf).select("step", F.col("unit_id").alias("chunk"), F.lit(1).alias("valid"))
    bad = failures(spark, sf).select("step", F.col("unit_id").alias("chunk"), F.lit(0).alias("valid"))
    return integrity.stuck_chunks(ok.unionByName(bad))
