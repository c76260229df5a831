"""Report, comparison, cost and health tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from recordforge.operators import compare, costs, health, ledger, reports, rules
from recordforge.plans.checks import ORDER_RULES
from recordforge.plans.ledgers import FO
from recordforge.plans.registry import query, table
from recordforge.plans.shared import CHUNKS_SQL, NOW, RUNS_SQL, STEPS, chunks, failures, now, outputs, runs, units
from recordforge.sources.pricing import merge_pricing

RC = f"WITH r AS ({RUNS_SQL}), c AS ({CHUNKS_SQL})"
STEP_NO = "CASE WHEN state LIKE 'signup%' THEN 0 WHEN state LIKE 'view%' THEN 1 WHEN state LIKE 'click%' THEN 2 WHEN state LIKE 'purchase%' THEN 3 END"


@query(
    "count_distribution",
    """
    SELECT source AS "group", lang AS value, count(*)::BIGINT AS n, (sum(count(*)) OVER (PARTITION BY source))::BIGINT AS group_n,
        round(count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY source), 6) AS pct FROM documents GROUP BY source, lang
    """,
)
def count_distribution(spark, sf):
    return reports.count_distribution(table(spark, sf, "documents"), "source", "lang").withColumn("pct", F.round("pct", 6))


@query(
    "distribution_matrix",
    """
    SELECT source AS "group", count(*) FILTER (lang = 'de')::BIGINT AS de, count(*) FILTER (lang = 'en')::BIGINT AS en, count(*) FILTER (lang = 'es')::BIGINT AS es,
        count(*) FILTER (lang = 'fr')::BIGINT AS fr, count(*)::BIGINT AS total,
        (count(*) FILTER (lang IN ('en', 'fr')) - count(*) FILTER (lang = 'de'))::BIGINT AS net FROM documents GROUP BY source
    """,
)
def distribution_matrix(spark, sf):
    return reports.distribution_matrix(table(spark, sf, "documents"), "source", "lang", ["EN", "fr"], ["de", "en"])


@query(
    "net_score",
    """
    SELECT user_id::VARCHAR AS "group", sum(CASE WHEN event_type IN ('purchase', 'signup') THEN 1 WHEN event_type = 'error' THEN -1 ELSE 0 END)::BIGINT AS net
    FROM events GROUP BY user_id
    """,
)
def net_score(spark, sf):
    return reports.net_score(table(spark, sf, "events"), "user_id", "event_type", ["Purchase", "signup"], ["ERROR", "signup"])


@query(
    "numeric_stats",
    """
    SELECT event_type AS "group", count(*)::BIGINT AS count, round(avg(value), 6) AS mean, round(median(value), 6) AS median, round(stddev_samp(value), 6) AS stdev,
        round(var_samp(value), 5) AS variance, min(value) AS min_val, max(value) AS max_val, round(sum(value), 4) AS sum_val,
        round(stddev_samp(value) / avg(value), 6) AS spread FROM events GROUP BY event_type
    """,
)
def numeric_stats(spark, sf):
    stats = reports.numeric_stats(table(spark, sf, "events"), "event_type", "value", {"spread": "stdev / mean"})
    return stats.select(
        "group", "count", F.round("mean", 6).alias("mean"), F.round("median", 6).alias("median"), F.round("stdev", 6).alias("stdev"),
        F.round("variance", 5).alias("variance"), "min_val", "max_val", F.round("sum_val", 4).alias("sum_val"), F.round("spread", 6).alias("spread"),
    )


@query(
    "numeric_stats_by_user",
    """
    SELECT user_id::VARCHAR AS "group", count(*)::BIGINT AS count, round(median(value), 6) AS median, round(coalesce(stddev_samp(value), 0), 6) AS stdev
    FROM events GROUP BY user_id
    """,
)
def numeric_stats_by_user(spark, sf):
    stats = reports.numeric_stats(table(spark, sf, "events"), "user_id", "value")
    return stats.select("group", "count", F.round("median", 6).alias("median"), F.round("stdev", 6).alias("stdev"))


@query(
    "numeric_stats_of_text",
    "SELECT c_mktsegment AS \"group\", count(*)::BIGINT AS count, median(c_nationkey)::DOUBLE AS median FROM customer WHERE c_custkey % 3 <> 0 GROUP BY 1",
)
def numeric_stats_of_text(spark, sf):
    """A field that is a number as text in some rows only."""
    people = table(spark, sf, "customer").withColumn(
        "field", F.when(F.col("c_custkey") % 3 == 0, F.lit("n/a")).otherwise(F.concat(F.lit(" "), "c_nationkey"))
    )
    return reports.numeric_stats(people, "c_mktsegment", "field").select("group", "count", "median")


@query(
    "data_stats",
    'SELECT event_type AS "group", round(sum(abs(value - 50)), 4) AS distance, max(value) - min(value) AS span FROM events GROUP BY event_type',
)
def data_stats(spark, sf):
    made = reports.data_stats(table(spark, sf, "events"), "event_type", "value", {"distance": "sum(abs(x - 50))", "span": "max(x) - min(x)"})
    return made.withColumn("distance", F.round("distance", 4))


@query(
    "skipped_rows",
    "SELECT count(*) FILTER (quality IS NULL)::BIGINT AS skipped, count(*)::BIGINT AS total FROM documents LEFT JOIN labels USING (doc_id)",
)
def skipped_rows(spark, sf):
    return reports.skipped_rows(table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left"), "lang", "quality")


FUNNEL = FO + """, s AS (SELECT * FROM (VALUES ('signup', 0), ('view', 1), ('click', 2), ('purchase', 3)) t(step, step_no)),
    v AS (SELECT step, count(DISTINCT unit_id)::BIGINT AS valid FROM o GROUP BY step), x AS (SELECT step, count(DISTINCT unit_id)::BIGINT AS failed FROM f GROUP BY step),
    k AS (SELECT step, step_no, coalesce(valid, 0) AS valid, coalesce(failed, 0) AS failed, (SELECT count(*) FROM u)::BIGINT AS base,
        coalesce(lag(valid) OVER (ORDER BY step_no), (SELECT count(*) FROM u))::BIGINT AS expected FROM s LEFT JOIN v USING (step) LEFT JOIN x USING (step))"""


@query(
    "funnel",
    FUNNEL
    + """SELECT step, step_no, expected, valid, failed, base - valid AS lost, round(valid * 100.0 / expected, 6) AS pass_pct,
        round(valid * 100.0 / base, 6) AS yield_pct FROM k""",
)
def funnel(spark, sf):
    made = reports.funnel(units(spark, sf), outputs(spark, sf), failures(spark, sf), STEPS)
    return made.select(
        "step", "step_no", "expected", "valid", "failed", "lost", F.round("pass_pct", 6).alias("pass_pct"), F.round("yield_pct", 6).alias("yield_pct")
    )


@query(
    "funnel_fan_out",
    """
    WITH n AS (SELECT count(*)::BIGINT AS parents, sum(len(string_split(text, chr(10))))::BIGINT AS children,
        sum(len(list_filter(string_split(text, chr(10)), lambda x: length(x) > 20)))::BIGINT AS good FROM documents)
    SELECT 'split' AS step, parents AS expected, children AS valid, 0::BIGINT AS lost, 0.0::DOUBLE AS yield_pct FROM n
    UNION ALL SELECT 'check', children, good, children - good, round(good * 100.0 / children, 6) FROM n
    """,
)
def funnel_fan_out(spark, sf):
    """Documents split into lines; the yield of the next step counts from the lines."""
    docs = table(spark, sf, "documents").select(F.concat(F.lit("d"), "doc_id").alias("unit_id"), F.posexplode(F.split("text", "\n")).alias("i", "line"))
    lines = docs.select(F.format_string("%s__fan%03d", "unit_id", "i").alias("unit_id"), "line")
    start = table(spark, sf, "documents").select(F.concat(F.lit("d"), "doc_id").alias("unit_id"))
    made = lines.select(F.lit("split").alias("step"), "unit_id").unionByName(
        lines.filter(F.length("line") > 20).select(F.lit("check").alias("step"), "unit_id")
    )
    none = made.limit(0)
    out = reports.funnel(start, made, none, ["split", "check"], ["split"])
    return out.select("step", "expected", "valid", "lost", F.round("yield_pct", 6).alias("yield_pct"))


@query(
    "failures_by_item",
    "SELECT event_type AS step, 'item' || (user_id % 40) AS \"group\", count(*)::BIGINT AS n FROM events GROUP BY ALL",
)
def failures_by_item(spark, sf):
    rows = table(spark, sf, "events").selectExpr("event_type AS step", "concat('item', user_id % 40, '__rep', lpad(event_id, 4, '0')) AS unit_id")
    return reports.failures_by(rows)


@query(
    "failures_by_field",
    FO + "SELECT step, coalesce(failure_stage, '(missing)') AS \"group\", count(*)::BIGINT AS n FROM f GROUP BY ALL",
)
def failures_by_field(spark, sf):
    return reports.failures_by(failures(spark, sf), "failure_stage")


@query(
    "failures_matrix",
    FO
    + """SELECT chunk AS "group", count(*) FILTER (step = 'signup')::BIGINT AS signup, count(*) FILTER (step = 'view')::BIGINT AS view,
        count(*) FILTER (step = 'click')::BIGINT AS click, count(*) FILTER (step = 'purchase')::BIGINT AS purchase FROM f GROUP BY chunk""",
)
def failures_matrix(spark, sf):
    return reports.failures_matrix(reports.failures_by(failures(spark, sf), "chunk"), STEPS)


@query(
    "top_errors",
    FO
    + """SELECT step, message, n, rank FROM (SELECT step, message, count(*)::BIGINT AS n, row_number() OVER (PARTITION BY step ORDER BY count(*) DESC, message) AS rank
        FROM f GROUP BY step, message) WHERE rank <= 3""",
)
def top_errors(spark, sf):
    return reports.top_errors(failures(spark, sf), message=F.col("message"))


@query(
    "top_errors_long",
    """
    SELECT source AS step, CASE WHEN length(t) > 100 THEN left(t, 97) || '...' ELSE t END AS message, n, rank
    FROM (SELECT source, t, count(*)::BIGINT AS n, row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, t) AS rank
        FROM (SELECT source, CASE WHEN doc_id % 3 = 0 THEN 'one prefix ' || repeat('x', 100) || (doc_id % 4) WHEN doc_id % 2 = 0 THEN text ELSE 'short ' || lang END AS t
            FROM documents) GROUP BY source, t) WHERE rank <= 3
    """,
)
def top_errors_long(spark, sf):
    """The first non-empty of several error fields; long texts are counted whole and cut for display."""
    prefix = F.concat(F.lit("one prefix "), F.repeat(F.lit("x"), 100), (F.col("doc_id") % 4).cast("string"))
    rows = table(spark, sf, "documents").select(
        F.col("source").alias("step"),
        F.when(F.col("doc_id") % 3 == 0, prefix).when(F.col("doc_id") % 2 == 0, F.lit("")).alias("verification_details"),
        F.when(F.col("doc_id") % 2 == 0, F.col("text")).alias("error"),
        F.concat(F.lit("short "), "lang").alias("validation_error"),
    )
    return reports.top_errors(rows)


@query(
    "errors_by_rule",
    """
    SELECT o_orderpriority AS step, rule, count(*)::BIGINT AS n FROM (SELECT o_orderpriority, unnest(list_filter([
        CASE WHEN o_totalprice < 5000 OR o_totalprice > 400000 THEN 'range_o_totalprice' END, CASE WHEN o_orderstatus = 'F' THEN 'enum_o_orderstatus' END,
        CASE WHEN o_orderpriority = '1-URGENT' AND o_totalprice >= 300000 THEN 'urgent_is_cheap' END, CASE WHEN o_custkey % 7 = 0 THEN 'share' END],
        lambda x: x IS NOT NULL)) AS rule FROM orders) GROUP BY ALL
    """,
)
def errors_by_rule(spark, sf):
    failed = rules.check_rules(table(spark, sf, "orders"), ORDER_RULES).filter(F.size("errors") > 0)
    return reports.errors_by_rule(failed.withColumnRenamed("o_orderpriority", "step"))


@query(
    "failure_categories",
    FO + """SELECT step, count(*) FILTER (coalesce(failure_stage, 'validation') <> 'pipeline_internal')::BIGINT AS validation,
        count(*) FILTER (failure_stage = 'pipeline_internal')::BIGINT AS hard FROM f GROUP BY step""",
)
def failure_categories(spark, sf):
    return reports.failure_categories(failures(spark, sf), ledger.is_retryable())


@query(
    "failure_groups",
    FO
    + """, g AS (SELECT step, coalesce(failure_stage, 'validation') AS failure_stage, message, unit_id, unit_id || ' said ' || event_id AS raw FROM f),
    n AS (SELECT step, failure_stage, message, count(*)::BIGINT AS n FROM g GROUP BY ALL),
    b AS (SELECT *, row_number() OVER (PARTITION BY step ORDER BY n DESC, failure_stage, message) AS rank FROM n),
    s AS (SELECT *, row_number() OVER (PARTITION BY step, failure_stage, message ORDER BY unit_id, raw) AS sample FROM g)
    SELECT step, failure_stage, message, n, rank, sample, unit_id, raw FROM b JOIN s USING (step, failure_stage, message) WHERE rank <= 4 AND sample <= 3""",
)
def failure_groups(spark, sf):
    rows = failures(spark, sf).withColumns(
        {
            "errors": F.array(F.struct(F.col("message").alias("message"), F.lit("r").alias("rule"))),
            "raw_response": F.concat("unit_id", F.lit(" said "), "event_id"),
        }
    )
    return reports.failure_groups(rows, top=4)


@query(
    "retry_hot_spots",
    FO
    + """, p AS (SELECT unit_id, string_split(unit_id, '__')[1] AS a, string_split(unit_id, '__')[2] AS b FROM f)
    SELECT 'unit' AS kind, unit_id AS key, count(*)::BIGINT AS n FROM p GROUP BY unit_id UNION ALL SELECT 'first', a, count(*) FROM p GROUP BY a
    UNION ALL SELECT 'second', b, count(*) FROM p GROUP BY b UNION ALL SELECT 'pair', a || '__' || b, count(*) FROM p GROUP BY a, b""",
)
def retry_hot_spots(spark, sf):
    return reports.retry_hot_spots(failures(spark, sf))


@query(
    "attach_prompts",
    FO
    + """, q AS (SELECT step, unit_id, 'Do ' || step || ' for ' || unit_id AS prompt FROM o GROUP BY ALL)
    SELECT f.event_id, q.prompt FROM f LEFT JOIN q USING (step, unit_id)""",
)
def attach_prompts(spark, sf):
    asked = outputs(spark, sf).select("step", "unit_id").distinct().withColumn("prompt", F.format_string("Do %s for %s", "step", "unit_id"))
    return reports.attach_prompts(failures(spark, sf), asked).select("event_id", "prompt")


@query(
    "all_units",
    FO
    + """SELECT unit_id, step, event_id, 'valid' AS status, 1 AS attempts FROM o UNION ALL
    SELECT unit_id, step, event_id, 'failed', (coalesce(retry_count, 0) + 1)::INT FROM f""",
)
def all_units(spark, sf):
    both = reports.all_units(outputs(spark, sf), failures(spark, sf))
    return both.select("unit_id", "step", "event_id", "status", "attempts")


@query(
    "browse_units",
    FO
    + """SELECT status, step, unit_id FROM (SELECT 'valid' AS status, step, unit_id FROM o UNION ALL SELECT 'failed', step, unit_id FROM f)
    ORDER BY (status <> 'failed')::INT, step, unit_id LIMIT 500""",
)
def browse_units(spark, sf):
    """The display list of a run: failures first, cut at a page of 500."""
    both = reports.all_units(outputs(spark, sf), failures(spark, sf))
    return reports.browse(both, cap=500).select("status", "step", "unit_id")


def _pricing(spark, sf):
    """Prices per model from parts: a brand is a model, a market segment a vendor."""
    brands = table(spark, sf, "part").groupBy(F.col("p_brand").alias("model")).agg(
        F.round(F.avg("p_retailprice"), 2).alias("input_per_million"), F.max("p_size").cast("double").alias("output_per_million")
    )
    # Every (vendor, model) pair in use gets the price of its model.
    used = runs(spark, sf).select("provider", "model").distinct()
    default = used.select("provider", F.lit("Brand#1").alias("model")).distinct()
    paired = used.unionByName(default).distinct().join(brands, "model")
    return paired.select(
        "provider", "model", F.col("model").alias("display_name"), "input_per_million", "output_per_million",
        F.when(F.col("provider") == "MACHINERY", F.lit(3.0)).alias("realtime_multiplier"),
        F.when(F.col("provider") == "HOUSEHOLD", F.lit(1.5)).alias("provider_multiplier"),
        (F.col("model") == "Brand#1").alias("is_default"),
    )


PRICED = RC + """, p AS (SELECT p_brand AS model, round(avg(p_retailprice), 2) AS pi, max(p_size)::DOUBLE AS po FROM part GROUP BY 1),
    q AS (SELECT r.*, coalesce(pi, 1.0) AS ri, coalesce(po, 2.0) AS ro, p.model IS NOT NULL AS price_known,
        CASE WHEN mode <> 'realtime' THEN 1.0 WHEN provider = 'MACHINERY' AND p.model IS NOT NULL THEN 3.0 WHEN provider = 'HOUSEHOLD' THEN 1.5 ELSE 2.0 END AS k
        FROM r LEFT JOIN p USING (model)),
    cost AS (SELECT run, provider, model, mode, price_known, initial_input_tokens + retry_input_tokens AS ti, initial_output_tokens + retry_output_tokens AS t_o,
        retry_input_tokens + retry_output_tokens AS tr, ((initial_input_tokens + retry_input_tokens) * (ri * k) + (initial_output_tokens + retry_output_tokens) * (ro * k)) / 1000000.0::DOUBLE AS cost FROM q)"""


@query(
    "run_costs",
    PRICED
    + """, s AS (SELECT run, sum(valid)::BIGINT AS surviving FROM c GROUP BY run)
    SELECT run, ti AS total_input, t_o AS total_output, round(coalesce(tr * 100.0 / nullif(ti + t_o, 0), 0), 6) AS retry_pct, round(cost, 10) AS cost, price_known,
        round(coalesce(cost / nullif(surviving, 0), 0), 11) AS cost_per_unit FROM cost LEFT JOIN s USING (run)""",
)
def run_costs(spark, sf):
    alive = chunks(spark, sf).groupBy("run").agg(F.sum("valid").alias("surviving"))
    made = costs.run_costs(runs(spark, sf), _pricing(spark, sf), alive)
    return made.select(
        "run", "total_input", "total_output", F.round("retry_pct", 6).alias("retry_pct"), F.round("cost", 10).alias("cost"), "price_known",
        F.round("cost_per_unit", 11).alias("cost_per_unit"),
    )


@query(
    "price_fallback",
    PRICED
    + """, d AS (SELECT pi, po FROM p WHERE model = 'Brand#1')
    SELECT run, round(CASE WHEN price_known THEN ri * k ELSE (SELECT pi FROM d) * CASE WHEN mode <> 'realtime' THEN 1.0 WHEN provider = 'HOUSEHOLD' THEN 1.5 ELSE 2.0 END END, 6) AS input_rate
    FROM q""",
)
def price_fallback(spark, sf):
    """Unknown models take the price of the vendor's default model."""
    priced = costs.with_prices(runs(spark, sf), _pricing(spark, sf), (0.075, 0.30), fall_back_to_default_model=True)
    return priced.select("run", F.round("input_rate", 6).alias("input_rate"))


@query(
    "dashboard_totals",
    PRICED
    + """SELECT count(*)::BIGINT AS runs, count(*) FILTER (run % 6 = 2)::BIGINT AS active_runs, sum(ti + t_o)::BIGINT AS tokens, round(sum(cost), 6) AS cost FROM cost""",
)
def dashboard_totals(spark, sf):
    spent = costs.run_costs(runs(spark, sf), _pricing(spark, sf)).withColumn("tokens", F.col("total_input") + F.col("total_output"))
    state = health.run_status(runs(spark, sf), chunks(spark, sf))
    return costs.dashboard_totals(spent.join(state, "run")).withColumn("cost", F.round("cost", 6))


@query(
    "projected_cost",
    "SELECT o_orderkey, CASE WHEN o_orderkey % 100 > 1 THEN round(o_totalprice / ((o_orderkey % 100) / 100.0), 4) END AS projected FROM orders",
)
def projected_cost(spark, sf):
    p = (F.col("o_orderkey") % 100) / 100.0
    return table(spark, sf, "orders").select("o_orderkey", F.round(costs.projected_cost(F.col("o_totalprice"), p), 4).alias("projected"))


@query(
    "merge_pricing",
    """
    SELECT p_partkey::VARCHAR AS model, CASE WHEN p_partkey % 5 = 1 THEN 'missing' WHEN p_partkey % 5 = 2 THEN CASE WHEN p_partkey % 2 = 0 THEN 'unpriced' ELSE 'add' END
        WHEN p_partkey % 5 = 3 AND p_partkey % 2 = 1 THEN 'update' ELSE 'unchanged' END AS action,
        CASE WHEN p_partkey % 5 = 2 THEN CASE WHEN p_partkey % 2 = 1 THEN round(p_retailprice / 2, 4) END
            WHEN p_partkey % 5 = 3 AND p_partkey % 2 = 1 THEN round((p_retailprice + 1) / 2, 4) ELSE p_retailprice / 2 END AS new_input FROM part
    """,
)
def pricing_merge(spark, sf):
    """Stored prices against a list with changed, new, missing and unpriced models."""
    parts = table(spark, sf, "part").withColumn("k", F.col("p_partkey") % 5).withColumn("odd", F.col("p_partkey") % 2 == 1)
    model = F.col("p_partkey").cast("string").alias("model")
    current = parts.filter("k <> 2").select(
        model, (F.col("p_retailprice") / 2).alias("input_per_million"), (F.col("p_retailprice") / 2).alias("output_per_million")
    )
    price = (
        F.when((F.col("k") == 2) & ~F.col("odd"), F.lit(None)).when((F.col("k") == 3) & F.col("odd"), F.col("p_retailprice") + 1).otherwise(F.col("p_retailprice"))
    )
    listed = parts.filter("k <> 1").select(model, price.alias("input_per_million"), price.alias("output_per_million"))
    return merge_pricing(current, listed).select("model", "action", "new_input")


@query(
    "compare_runs",
    FO
    + """, t AS (SELECT chunk AS run, count(DISTINCT unit_id)::BIGINT AS total_units, count(DISTINCT CASE WHEN step = 'purchase' THEN unit_id END)::BIGINT AS valid_units,
        sum(event_id)::BIGINT AS cost FROM o GROUP BY chunk)
    SELECT run, total_units, valid_units, round(valid_units * 100.0 / total_units, 6) AS pass_rate, round(cost / valid_units, 6) AS cost_per_unit FROM t""",
)
def compare_runs(spark, sf):
    """Chunks of the events stand for runs."""
    made = outputs(spark, sf).withColumnRenamed("chunk", "run")
    spent = made.groupBy("run").agg(F.sum("event_id").alias("cost"))
    table_ = compare.compare_runs(made.select("run", "unit_id"), made, "purchase", spent)
    return table_.select(
        "run", "total_units", "valid_units", F.round("pass_rate", 6).alias("pass_rate"), F.round("cost_per_unit", 6).alias("cost_per_unit")
    )


@query(
    "net_by_run",
    FO
    + """SELECT unit_id, sum(CASE WHEN chunk = 'chunk_000' THEN CASE WHEN step = 'purchase' THEN 1 ELSE -1 END END)::BIGINT AS zero,
        sum(CASE WHEN chunk = 'chunk_006' THEN CASE WHEN step = 'purchase' THEN 1 ELSE -1 END END)::BIGINT AS six FROM o GROUP BY unit_id""",
)
def net_by_run(spark, sf):
    made = outputs(spark, sf).withColumnRenamed("chunk", "run")
    wide = compare.net_by_run(made, "unit_id", F.when(F.col("step") == "purchase", 1).otherwise(-1))
    return wide.select("unit_id", F.col("chunk_000").alias("zero"), F.col("chunk_006").alias("six"))


def _two_runs(spark, sf):
    """One pipeline over orders run twice: the second judges some orders otherwise and lacks others."""
    orders = table(spark, sf, "orders").withColumn("unit_id", F.col("o_orderkey").cast("string"))
    result = lambda limit: F.when(F.col("o_totalprice") > limit, F.lit("high"))
    a = orders.filter("o_orderkey % 11 <> 0").select("unit_id", result(200000).alias("result"), F.col("o_custkey").alias("customer"), "o_orderstatus")
    b = orders.filter("o_orderkey % 13 <> 0").select("unit_id", result(250000).alias("result"), (F.col("o_custkey") + (F.col("o_orderkey") % 17 == 0).cast("int")).alias("customer"), "o_orderstatus")
    return a, b


TWO = """WITH a AS (SELECT o_orderkey::VARCHAR AS unit_id, CASE WHEN o_totalprice > 200000 THEN 'high' END AS result, o_custkey AS customer, o_orderstatus FROM orders WHERE o_orderkey % 11 <> 0),
    b AS (SELECT o_orderkey::VARCHAR AS unit_id, CASE WHEN o_totalprice > 250000 THEN 'high' END AS result, o_custkey + (o_orderkey % 17 = 0)::INT AS customer, o_orderstatus FROM orders WHERE o_orderkey % 13 <> 0),
    j AS (SELECT coalesce(a.unit_id, b.unit_id) AS unit_id, a.unit_id IS NOT NULL AS in_a, b.unit_id IS NOT NULL AS in_b,
        CASE WHEN a.result IS DISTINCT FROM b.result THEN 'result:' || coalesce(a.result, '-') || '>' || coalesce(b.result, '-') END AS d1,
        CASE WHEN a.customer IS DISTINCT FROM b.customer THEN 'customer:' || a.customer || '>' || b.customer END AS d2 FROM a FULL JOIN b ON a.unit_id = b.unit_id),
    k AS (SELECT unit_id, CASE WHEN NOT in_a THEN 'only_2' WHEN NOT in_b THEN 'only_1' WHEN d1 IS NULL AND d2 IS NULL THEN 'identical' ELSE 'divergent' END AS outcome,
        CASE WHEN in_a AND in_b THEN concat_ws(';', d1, d2) END AS diffs FROM j)"""


@query("compare_units", TWO + "SELECT unit_id, outcome, coalesce(diffs, '') AS diffs FROM k")
def compare_units(spark, sf):
    made = compare.compare_units(*_two_runs(spark, sf), ["result", "customer", "o_orderstatus"])
    shown = F.transform("diffs", lambda d: F.concat(d.field, F.lit(":"), F.coalesce(d.a, F.lit("-")), F.lit(">"), F.coalesce(d.b, F.lit("-"))))
    return made.select("unit_id", "outcome", F.coalesce(F.array_join(shown, ";"), F.lit("")).alias("diffs"))


@query("comparison_counts", TWO + "SELECT outcome, count(*)::BIGINT AS n FROM k GROUP BY outcome")
def comparison_counts(spark, sf):
    return compare.comparison_counts(compare.compare_units(*_two_runs(spark, sf), ["result", "customer"]))


@query("populations", TWO + "SELECT unit_id, CASE WHEN outcome IN ('only_1', 'only_2') THEN outcome ELSE 'common' END AS side FROM k")
def populations(spark, sf):
    return compare.populations(*_two_runs(spark, sf))


@query(
    "unit_diff",
    TWO
    + """, ta AS (UNPIVOT (SELECT unit_id, coalesce(result, '~') AS result, customer::VARCHAR AS customer, o_orderstatus FROM a) ON result, customer, o_orderstatus INTO NAME field VALUE v),
    tb AS (UNPIVOT (SELECT unit_id, coalesce(result, '~') AS result, customer::VARCHAR AS customer, o_orderstatus FROM b) ON result, customer, o_orderstatus INTO NAME field VALUE v)
    SELECT unit_id, field, nullif(ta.v, '~') AS run_1, nullif(tb.v, '~') AS run_2, nullif(ta.v, '~') IS NOT DISTINCT FROM nullif(tb.v, '~') AS match
    FROM ta FULL JOIN tb USING (unit_id, field)""",
)
def unit_diff(spark, sf):
    return compare.unit_diff(*_two_runs(spark, sf))


@query(
    "watch_deltas",
    """
    WITH s AS (SELECT user_id AS run, date_trunc('day', ts) AS day, count(*) FILTER (event_type <> 'error')::BIGINT AS valid, count(*) FILTER (event_type = 'error')::BIGINT AS failed FROM events GROUP BY ALL)
    SELECT run, day::DATE AS day, valid - coalesce(lag(valid) OVER w, 0) AS new_valid, failed - coalesce(lag(failed) OVER w, 0) AS new_failed FROM s WINDOW w AS (PARTITION BY run ORDER BY day)
    """,
)
def watch_deltas(spark, sf):
    looks = table(spark, sf, "events").groupBy(F.col("user_id").alias("run"), F.to_date("ts").alias("ts")).agg(
        F.count_if(F.col("event_type") != "error").alias("valid"), F.count_if(F.col("event_type") == "error").alias("failed")
    )
    return compare.watch_deltas(looks, ["run"]).select("run", F.col("ts").alias("day"), "new_valid", "new_failed")


STATUS = """, n AS (SELECT run, count(*) AS total, count(*) FILTER (state = 'VALIDATED') AS v, count(*) FILTER (state = 'FAILED') AS f, count(*) FILTER (state = 'PENDING') AS p,
        sum(items)::BIGINT AS items, sum(valid)::BIGINT AS valid, sum(failed)::BIGINT AS failed FROM c GROUP BY run),
    st AS (SELECT r.run, CASE WHEN status IN ('complete', 'failed', 'paused', 'killed') THEN status WHEN status = 'running' THEN 'active' WHEN total IS NULL THEN 'pending'
        WHEN v = total THEN 'complete' WHEN f > 0 THEN 'failed' WHEN p = total THEN 'pending' ELSE 'detached' END AS status FROM r LEFT JOIN n USING (run)),
    pr AS (SELECT r.run, CASE WHEN r.status = 'complete' THEN 100 ELSE coalesce(floor(d * 100.0 / (k * 4)), 0) END::INT AS progress FROM r LEFT JOIN
        (SELECT run, sum(CASE WHEN state = 'VALIDATED' THEN 4 ELSE coalesce(""" + STEP_NO + """, 0) END) AS d, count(*) AS k FROM c GROUP BY run) USING (run)),
    fu AS (SELECT r.run, coalesce(f, 0)::BIGINT AS failed_chunks, CASE WHEN status IN ('complete', 'failed', 'killed') AND items > 0 THEN greatest(items - valid, 0) ELSE coalesce(failed, 0) END::BIGINT AS failed_units
        FROM r LEFT JOIN n USING (run)),
    at AS (SELECT run, split_part(state, '_', 1) AS step, """ + STEP_NO + """ AS no, count(*) AS k FROM c WHERE """ + STEP_NO + """ IS NOT NULL GROUP BY ALL),
    cs AS (SELECT run, arg_max(step, no) AS furthest_step, arg_max(step, (k, -no)) AS usual_step FROM at GROUP BY run)"""
STATUS = STATUS.replace("    at AS (", "    places AS (").replace("FROM at GROUP", "FROM places GROUP")


@query("run_status", RC + STATUS + "SELECT * FROM st")
def run_status(spark, sf):
    return health.run_status(runs(spark, sf), chunks(spark, sf))


@query("run_progress", RC + STATUS + "SELECT * FROM pr")
def run_progress(spark, sf):
    return health.run_progress(runs(spark, sf), chunks(spark, sf), STEPS)


@query("failed_units", RC + STATUS + "SELECT * FROM fu")
def failed_units(spark, sf):
    return health.failed_units(runs(spark, sf), chunks(spark, sf))


@query("current_step", RC + STATUS + "SELECT * FROM cs")
def current_step(spark, sf):
    return health.current_step(chunks(spark, sf), STEPS)


@query(
    "status_corrections",
    RC + """SELECT run, status AS stored, 'complete' AS corrected FROM r JOIN (SELECT run FROM c GROUP BY run HAVING bool_and(state IN ('VALIDATED', 'FAILED'))) USING (run)
    WHERE coalesce(status, '') <> 'complete'""",
)
def status_corrections(spark, sf):
    return health.status_corrections(runs(spark, sf), chunks(spark, sf))


@query(
    "unit_progress",
    "SELECT o_custkey AS run, round(least(sum(o_orderkey % 30) / nullif(sum(o_orderkey % 40), 0), 1.0), 9) AS progress FROM orders GROUP BY 1".replace("nullif(sum(o_orderkey % 40), 0)", "sum(o_orderkey % 40 + 1)"),
)
def unit_progress(spark, sf):
    counts = table(spark, sf, "orders").selectExpr("o_custkey AS run", "o_orderkey % 30 AS completed", "o_orderkey % 40 + 1 AS total")
    return health.unit_progress(counts).withColumn("progress", F.round("progress", 9))


@query(
    "throughput",
    f"""
    WITH t AS (SELECT o_custkey AS run, min(o_orderdate) AS started, CASE WHEN o_custkey % 2 = 0 THEN max(o_orderdate) END AS ended, sum(o_orderkey % 50 + 60)::BIGINT AS total_units,
        sum(o_orderkey % 50)::BIGINT AS done_units FROM orders GROUP BY o_custkey),
    e AS (SELECT *, epoch(coalesce(ended, {NOW}))::BIGINT - epoch(started)::BIGINT AS s FROM t),
    h AS (SELECT *, CASE WHEN s > 0 AND done_units > 0 THEN round(done_units * 3600.0 / s, 1) END AS units_per_hour FROM e)
    SELECT run, s AS elapsed_seconds, units_per_hour, CASE WHEN total_units > done_units AND units_per_hour > 0 THEN floor((total_units - done_units) / units_per_hour * 3600)::BIGINT END AS remaining_seconds FROM h
    """,
)
def throughput(spark, sf):
    timed = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("run")).agg(
        F.min("o_orderdate").cast("timestamp").alias("started"),
        F.when(F.col("o_custkey") % 2 == 0, F.max("o_orderdate").cast("timestamp")).alias("ended"),
        F.sum(F.col("o_orderkey") % 50 + 60).alias("total_units"),
        F.sum(F.col("o_orderkey") % 50).alias("done_units"),
    )
    return health.throughput(timed, now()).select("run", "elapsed_seconds", "units_per_hour", "remaining_seconds")


@query(
    "chunk_warnings",
    RC
    + f"""SELECT run, chunk, 'CHUNK_HAS_FAILURES' AS code, round(failed / items, 2)::DOUBLE AS value FROM c WHERE failed > 0 AND items > 0 AND failed / items >= 0.25
    UNION ALL SELECT run, chunk, 'HIGH_TOKEN_USAGE', (input_tokens + output_tokens)::DOUBLE FROM c WHERE input_tokens + output_tokens > 40000000
    UNION ALL SELECT run, chunk, 'LONG_RUNNING_CHUNK', round((epoch({NOW}) - epoch(submitted_at)) / 60.0, 1)::DOUBLE FROM c
        WHERE state LIKE '%_SUBMITTED' AND (epoch({NOW}) - epoch(submitted_at)) / 60.0 > 2000000""",
)
def chunk_warnings(spark, sf):
    return health.chunk_warnings(chunks(spark, sf), 0.25, 40_000_000, 2_000_000, now())


@query(
    "step_counts",
    FO
    + """SELECT step, v AS valid, p AS retry_pending, x AS failed FROM (SELECT step, count(*)::BIGINT AS v FROM o GROUP BY step)
    JOIN (SELECT step, count(*) FILTER (coalesce(retry_count, 0) < 3)::BIGINT AS p, count(*) FILTER (coalesce(retry_count, 0) >= 3)::BIGINT AS x FROM f GROUP BY step) USING (step)""",
)
def step_counts(spark, sf):
    return health.step_counts(outputs(spark, sf), failures(spark, sf))


@query(
    "retry_state",
    FO
    + """, k AS (SELECT step, unit_id, max(coalesce(retry_count, 0)) AS n FROM f GROUP BY ALL)
    SELECT step, count(*) FILTER (n < 3)::BIGINT AS retrying, count(*) FILTER (n >= 3)::BIGINT AS exhausted, max(n)::INT AS max_attempt, count(*)::BIGINT AS permanently_failed
    FROM k ANTI JOIN o USING (step, unit_id) GROUP BY step""",
)
def retry_state(spark, sf):
    return health.retry_state(failures(spark, sf), outputs(spark, sf), running=True)


@query(
    "step_health",
    FUNNEL
    + """, g AS (SELECT step, count(*) FILTER (coalesce(failure_stage, 'validation') <> 'pipeline_internal')::BIGINT AS validation, count(*) FILTER (failure_stage = 'pipeline_internal')::BIGINT AS hard FROM f GROUP BY step)
    SELECT step, step_no, expected, valid, validation, hard, CASE WHEN validation + hard > 0 THEN 'warning' WHEN expected > 0 AND valid + validation + hard <> expected THEN 'mismatch' ELSE 'ok' END AS status
    FROM k JOIN g USING (step)""",
)
def step_health(spark, sf):
    steps = reports.funnel(units(spark, sf), outputs(spark, sf), failures(spark, sf), STEPS)
    return health.step_health(steps, reports.failure_categories(failures(spark, sf), ledger.is_retryable()))


@query(
    "disk_discrepancies",
    FO
    + """, r AS (SELECT chunk, user_id AS run, count(*) FILTER (event_type = 'purchase')::BIGINT AS valid, (count(*) FILTER (event_type = 'error') // 4)::BIGINT AS failed
        FROM (SELECT *, 'chunk_00' || (event_id % 7) AS chunk FROM events) GROUP BY ALL),
    v AS (SELECT split_part(substr(unit_id, 2), '__', 1)::BIGINT AS run, chunk, count(*)::BIGINT AS n FROM o WHERE step = 'purchase' GROUP BY ALL),
    x AS (SELECT split_part(substr(unit_id, 2), '__', 1)::BIGINT AS run, chunk, count(*)::BIGINT AS n FROM f WHERE step = 'purchase' GROUP BY ALL)
    SELECT run, chunk, valid, failed, coalesce(v.n, 0) AS actual_valid, coalesce(x.n, 0) AS actual_failed FROM r LEFT JOIN v USING (run, chunk) LEFT JOIN x USING (run, chunk)
    WHERE valid <> coalesce(v.n, 0) OR failed <> coalesce(x.n, 0)""",
)
def disk_discrepancies(spark, sf):
    owner = F.regexp_extract("unit_id", "^u([0-9]+)__", 1).cast("bigint")
    noted = table(spark, sf, "events").groupBy(F.col("user_id").alias("run"), F.concat(F.lit("chunk_00"), F.col("event_id") % 7).alias("chunk")).agg(
        F.count_if(F.col("event_type") == "purchase").alias("valid"), F.expr("count_if(event_type = 'error') div 4").alias("failed")
    )
    return health.disk_discrepancies(
        noted, outputs(spark, sf).withColumn("run", owner), failures(spark, sf).withColumn("run", owner), "purchase"
    )


@query(
    "chunk_matrix",
    RC
    + """, b AS (SELECT o_custkey AS run, o_orderkey AS chunk, CASE WHEN o_orderkey % 3 = 0 THEN 'click' WHEN o_orderkey % 3 = 1 THEN 'view' END AS bad FROM orders),
    p AS (SELECT c.run, items, CASE WHEN state = 'VALIDATED' THEN 'purchase' WHEN state = 'FAILED' THEN coalesce(bad, 'signup') ELSE split_part(state, '_', 1) END AS step,
        CASE WHEN state IN ('VALIDATED', 'FAILED') THEN state ELSE split_part(state, '_', 2) END AS mark FROM c JOIN b USING (run, chunk) WHERE state <> 'PENDING')
    SELECT run, step, count(*) FILTER (mark = 'PENDING')::BIGINT AS pending, count(*) FILTER (mark = 'SUBMITTED')::BIGINT AS submitted, count(*) FILTER (mark = 'COMPLETE')::BIGINT AS completed,
        count(*) FILTER (mark = 'VALIDATED')::BIGINT AS validated, count(*) FILTER (mark = 'FAILED')::BIGINT AS failed, sum(items)::BIGINT AS units FROM p GROUP BY run, step""",
)
def chunk_matrix(spark, sf):
    orders = table(spark, sf, "orders")
    bad = orders.filter("o_orderkey % 3 < 2").selectExpr("o_custkey AS run", "o_orderkey AS chunk", "explode(CASE WHEN o_orderkey % 3 = 0 THEN array('signup', 'click') ELSE array('view') END) AS step")
    return health.chunk_matrix(chunks(spark, sf), bad, STEPS)


@query(
    "tokens_per_step",
    "SELECT event_type AS step, sum(user_id)::BIGINT AS input_tokens, sum(event_id % 100)::BIGINT AS output_tokens FROM events GROUP BY 1",
)
def tokens_per_step(spark, sf):
    return health.tokens_per_step(table(spark, sf, "events").selectExpr("event_type AS step", "user_id AS input_tokens", "event_id % 100 AS output_tokens"))


STEP_STATUS = RC + """, a AS (SELECT run, CASE WHEN state IN ('VALIDATED', 'FAILED') THEN 4 ELSE coalesce(""" + STEP_NO + """, -1) END AS here FROM c),
    s AS (SELECT * FROM (VALUES ('signup', 0), ('view', 1), ('click', 2), ('purchase', 3)) t(step, step_no)),
    t AS (SELECT run, step, step_no, CASE WHEN bool_and(here > step_no) THEN 'complete' WHEN bool_or(here = step_no) THEN 'in_progress' WHEN bool_or(here > step_no) THEN 'complete' ELSE 'pending' END AS status
        FROM a, s GROUP BY ALL)"""


@query("step_status", STEP_STATUS + "SELECT * FROM t")
def step_status(spark, sf):
    return health.step_status(chunks(spark, sf), STEPS)


@query(
    "overall_status",
    STEP_STATUS + "SELECT run, CASE WHEN bool_and(status = 'complete') THEN 'complete' WHEN bool_or(status = 'in_progress') THEN 'active' ELSE 'pending' END AS status FROM t GROUP BY run",
)
def overall_status(spark, sf):
    return health.overall_status(health.step_status(chunks(spark, sf), STEPS))


@query(
    "chunks_at_step",
    RC
    + """, h AS (SELECT run, chunk, state = 'VALIDATED' OR coalesce(""" + STEP_NO + """, -1) >= 2 AS hit FROM c), y AS (SELECT run, bool_or(hit) AS any_hit FROM h GROUP BY run)
    SELECT run, chunk FROM h JOIN y USING (run) WHERE hit OR NOT any_hit""",
)
def chunks_at_step(spark, sf):
    return health.chunks_at_step(chunks(spark, sf), STEPS, "click").select("run", "chunk")


@query(
    "run_duration",
    f"""
    SELECT c_custkey AS run, CASE WHEN c_custkey % 3 = 0 THEN CASE WHEN c_custkey % 2 = 0 THEN 5000 WHEN c_custkey % 5 = 0 THEN 9000 END ELSE 366 * 86400 - c_custkey END::BIGINT AS duration_seconds FROM customer
    """,
)
def run_duration(spark, sf):
    """Finished runs end at the first end time stored; others last until now."""
    start = F.timestamp_add("SECOND", F.col("c_custkey"), F.expr("TIMESTAMP '2000-12-31 00:00:00'"))
    after = lambda s: F.timestamp_add("SECOND", F.lit(s), start)
    made = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("run"),
        F.when(F.col("c_custkey") % 3 == 0, F.lit("complete")).otherwise(F.lit("running")).alias("status"),
        start.alias("started"),
        F.when(F.col("c_custkey") % 2 == 0, after(5000)).alias("completed_at"),
        F.when(F.col("c_custkey") % 5 == 0, after(9000)).alias("failed_at"),
        F.lit(None).cast("timestamp").alias("killed_at"),
    )
    return health.run_duration(made, now()).select("run", "duration_seconds")


@query("recent_runs", "SELECT o_orderkey AS run, o_orderdate AS started FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 25")
def recent_runs(spark, sf):
    """The newest runs (a top-k report)."""
    made = table(spark, sf, "orders").select(F.col("o_orderkey").alias("run"), F.col("o_orderdate").alias("started"))
    return health.recent_runs(made, 25)


@query(
    "log_health",
    """
    WITH h AS (SELECT user_id AS run, max(ts) FILTER (event_type = 'error') AS e, max(ts) FILTER (event_type = 'view') AS g, arg_max(event_type, ts) AS last_level FROM events GROUP BY user_id)
    SELECT run, last_level, e IS NOT NULL AND (g IS NULL OR e > g) AS has_recent_error FROM h
    """,
)
def log_health(spark, sf):
    log = table(spark, sf, "events").select(F.col("user_id").alias("run"), "ts", F.col("event_type").alias("level"))
    return health.log_health(log, ["error"], ["view"]).select("run", "last_level", "has_recent_error")


@query(
    "run_summary",
    RC + STATUS
    + """SELECT st.run, st.status, progress, total AS chunks, items AS total_units, valid AS valid_units, failed_units, furthest_step
    FROM st JOIN pr USING (run) LEFT JOIN n USING (run) JOIN fu USING (run) LEFT JOIN cs USING (run)""",
)
def run_summary(spark, sf):
    made = runs(spark, sf).withColumns(
        {c: F.lit(None).cast("timestamp") for c in ("started", "completed_at", "failed_at", "killed_at")}
    )
    out = health.run_summary(made, chunks(spark, sf), STEPS, now())
    return out.select("run", "status", "progress", "chunks", "total_units", "valid_units", "failed_units", "furthest_step")


@query(
    "id_sets",
    FO
    + """, a AS (SELECT DISTINCT unit_id FROM o), b AS (SELECT DISTINCT unit_id FROM f)
    SELECT 'both' AS what, count(*)::BIGINT AS n FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'only_valid', count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b)
    UNION ALL SELECT 'accounted', count(*) FROM (SELECT * FROM a UNION SELECT * FROM b)""",
)
def id_sets(spark, sf):
    """Ids in both tables, in the first only, and in any."""
    a, b = outputs(spark, sf).select("unit_id"), failures(spark, sf).select("unit_id")
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("what"), "n")
    return count(a.intersect(b), "both").unionByName(count(a.subtract(b), "only_valid")).unionByName(count(a.union(b).distinct(), "accounted"))


@query(
    "units_sorted",
    FO + "SELECT status, step, unit_id, event_id FROM (SELECT 'valid' AS status, step, unit_id, event_id FROM o UNION ALL SELECT 'failed', step, unit_id, event_id FROM f)",
)
def units_sorted(spark, sf):
    both = reports.all_units(outputs(spark, sf), failures(spark, sf))
    return both.orderBy(health.status_rank(F.col("status")), "step", "unit_id", "event_id").select("status", "step", "unit_id", "event_id")
