"""Rules that stand alone: step files, item documents, prices, names, error policies, casts, mathematics, run scope, samples,
cut texts, and answers that are paid once."""

from __future__ import annotations

from pyspark.sql import functions as F

from recordforge.operators import compare, derive, infer, order, prompts, reports, units
from recordforge.plans.derived import answer
from recordforge.plans.registry import query, table, tasks
from recordforge.plans.reporting import TWO, _two_runs
from recordforge.session import settle, work_dir
from recordforge.sources import files, pricing, sinks



@query(
    "step_outputs",
    """
    WITH e AS (SELECT event_id, user_id % 7 AS run, CASE WHEN event_id % 2 = 0 OR user_id % 7 = 3 THEN 'first' ELSE 'last' END AS step FROM events)
    SELECT 'run_' || run AS run, step, count(*)::BIGINT AS n, sum(event_id)::BIGINT AS ids FROM e
    WHERE step = 'last' OR run = 3 GROUP BY ALL
    """,
)
def step_outputs(spark, sf):
    """Step files of several runs, compressed and plain, some with a compressed twin that must not count; a run that never
    reached the last step gives all it has."""
    base = work_dir(spark, "runs")
    step = "CASE WHEN event_id % 2 = 0 OR user_id % 7 = 3 THEN 'first' ELSE 'last' END"
    rows = table(spark, sf, "events").selectExpr(
        "user_id % 7 AS n", f"concat('run_', user_id % 7, '/chunks/chunk_', event_id div 1000, '/', {step}, '_validated.jsonl') AS filename",
        "to_json(struct(event_id)) AS line",
    )
    # A file has at most 1,000 lines.
    made = settle(rows.groupBy("n", "filename").agg(F.array_join(F.collect_list("line"), "\n").alias("content")))
    sinks.write_files(made.filter("n % 2 = 1"), base, tasks=tasks(spark))
    sinks.write_files(made.filter("n % 2 = 0"), base, gzip=True, tasks=tasks(spark))
    sinks.write_files(made.filter("n = 1").withColumn("content", F.lit('{"event_id": -1}')), base, gzip=True, tasks=tasks(spark))
    got = files.read_step_output(spark, base, "validated", pipeline=["first", "last"])
    return got.groupBy("run", "step").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.try_variant_get("record", "$.event_id", "bigint")).alias("ids")
    )


@query(
    "items_from_document",
    "SELECT doc_id, i - 1 AS idx, string_split(text, chr(10))[i] AS item FROM (SELECT doc_id, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)",
)
def items_from_document(spark, sf):
    """Item lists inside JSON documents, one document per row of the table."""
    docs = table(spark, sf, "documents").select("doc_id", F.to_json(F.struct(F.split("text", "\n").alias("items"))).alias("value"))
    found = files.document_items(docs, "value", "items")
    return found.select("doc_id", F.col("idx").cast("bigint").alias("idx"), F.try_variant_get("item", "$", "string").alias("item"))


@query(
    "pricing_loaded",
    """
    SELECT p_brand AS vendor, p_type AS model, max(p_retailprice) AS input_per_million, max(p_size) % 2 = 0 AS named FROM part GROUP BY ALL
    """,
)
def pricing_loaded(spark, sf):
    """A registry document (a price per brand and type, so of bounded size), read back."""
    path = work_dir(spark, "prices") + "/registry"
    priced = table(spark, sf, "part").groupBy("p_brand", "p_type").agg(F.max("p_retailprice").alias("price"), F.max("p_size").alias("size"))
    named = F.when(F.col("size") % 2 == 0, F.lit("Even"))
    entry = F.struct(named.alias("display_name"), F.col("price").alias("input_per_million"))
    models = priced.groupBy("p_brand").agg(F.map_from_entries(F.collect_list(F.struct("p_type", entry))).alias("models"))
    providers = models.agg(F.map_from_entries(F.collect_list(F.struct("p_brand", F.struct("models")))).alias("providers"))
    providers.select(F.to_json(F.struct("providers"))).write.text(path)
    read = pricing.load_pricing(spark, path)
    return read.select(F.col("provider").alias("vendor"), "model", "input_per_million", (F.col("display_name") == "Even").alias("named"))


@query(
    "name_fallback",
    """
    SELECT 'c' || c_custkey AS by_field, c_custkey::VARCHAR AS by_id, replace(replace(c_name, ' ', '_'), '/', '-') AS by_name FROM customer
    """,
)
def name_fallback(spark, sf):
    """Units are named by the field asked for, else by `id`, else by `name`."""
    people = table(spark, sf, "customer").select(
        "c_custkey", F.col("c_name").alias("name"), F.col("c_custkey").cast("string").alias("id"), F.concat(F.lit("c"), "c_custkey").alias("code")
    )
    named = lambda df, out: units.direct(df, "code").select("c_custkey", F.col("unit_id").alias(out))
    made = named(people, "by_field").join(named(people.drop("code"), "by_id"), "c_custkey")
    return made.join(named(people.drop("code", "id"), "by_name"), "c_custkey").select("by_field", "by_id", "by_name")


@query(
    "derive_strict",
    "SELECT l_orderkey, l_linenumber, l_quantity * 2 AS doubled, round(l_tax / (1 + l_discount), 6) AS share FROM lineitem",
)
def derive_strict(spark, sf):
    """Shared expressions of a step: one failure would end the job, and none fails."""
    lines = table(spark, sf, "lineitem").withColumn("unit_id", F.concat_ws("-", "l_orderkey", "l_linenumber"))
    made = derive.derive(lines, {"doubled": "l_quantity * 2", "share": "l_tax / (1 + l_discount)"}, on_error="fail")
    return made.select("l_orderkey", "l_linenumber", "doubled", F.round("share", 6).alias("share"))


@query("hidden_fields", "SELECT c_custkey, c_acctbal > 0 AS seen, c_custkey AS hidden FROM customer")
def hidden_fields(spark, sf):
    """Expressions do not see `_raw_text` and `_metadata`, which come through unchanged."""
    people = table(spark, sf, "customer").select(
        F.col("c_name").alias("unit_id"), "c_custkey", "c_acctbal", F.col("c_custkey").alias("_metadata"), F.lit("x").alias("_raw_text")
    )
    made = derive.derive(people, {"seen": "c_acctbal > 0", "_note": "'own'"}, on_error="ignore")
    return made.select("c_custkey", "seen", F.col("_metadata").alias("hidden"))


@query(
    "expression_casts",
    """
    SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderkey END AS as_int,
        CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderkey::DOUBLE END AS as_float, o_orderkey::VARCHAR AS as_text,
        o_orderkey % 2 <> 0 AS as_bool, [o_orderkey, o_custkey]::VARCHAR AS as_list, trunc(o_totalprice)::BIGINT AS whole FROM orders
    """,
)
def expression_casts(spark, sf):
    """Constructors and casts in expressions; a bad cast fails the expression of its row."""
    orders = table(spark, sf, "orders").withColumn("unit_id", F.col("o_orderkey").cast("string"))
    text = "CASE WHEN o_orderkey % 3 = 0 THEN 'none' ELSE cast(o_orderkey AS string) END"
    made = derive.derive(
        orders,
        {
            "as_int": f"cast({text} AS bigint)", "as_float": f"cast({text} AS double)", "as_text": "cast(o_orderkey AS string)",
            "as_bool": "cast(o_orderkey % 2 AS boolean)", "as_list": "cast(array(o_orderkey, o_custkey) AS string)",
            "whole": "cast(o_totalprice AS bigint)",
        },
        on_error="ignore",
    )
    return made.select("o_orderkey", "as_int", "as_float", "as_text", "as_bool", "as_list", "whole")


@query(
    "expression_mathematics",
    """
    SELECT o_orderkey, round(sqrt(o_totalprice), 6) AS root, round(ln(o_totalprice), 9) AS log, round(exp(-o_totalprice / 100000), 9) AS exp,
        round(pow(o_totalprice, 0.25), 6) AS power, CASE WHEN o_orderkey % 5 <> 0 THEN 0::DOUBLE END AS log_of_one FROM orders
    """,
)
def expression_mathematics(spark, sf):
    orders = table(spark, sf, "orders").withColumn("unit_id", F.col("o_orderkey").cast("string"))
    made = derive.derive(
        orders,
        {
            "root": "sqrt(o_totalprice)", "log": "ln(o_totalprice)", "exp": "exp(-o_totalprice / 100000)",
            "power": "pow(o_totalprice, 0.25)", "log_of_one": "ln(CASE WHEN o_orderkey % 5 = 0 THEN 0 ELSE 1 END)",
        },
        on_error="ignore",
    )
    rounded = {"root": 6, "log": 9, "exp": 9, "power": 6, "log_of_one": 6}
    return made.select("o_orderkey", *[F.round(c, n).alias(c) for c, n in rounded.items()])


@query(
    "run_scope",
    """
    SELECT 'spent' AS hook, o_orderstatus AS name, round(sum(o_totalprice), 2) AS value FROM orders GROUP BY 2
    UNION ALL SELECT 'orders', o_orderpriority, count(*)::DOUBLE FROM orders GROUP BY 2
    """,
)
def run_scope(spark, sf):
    """Functions over all final records of a run."""
    hooks = {
        "spent": lambda df: df.groupBy(F.col("o_orderstatus").alias("name")).agg(F.round(F.sum("o_totalprice"), 2).alias("value")),
        "orders": lambda df: df.groupBy(F.col("o_orderpriority").alias("name")).agg(F.count(F.lit(1)).cast("double").alias("value")),
    }
    made = derive.run_scope(table(spark, sf, "orders"), hooks)
    return made["spent"].select(F.lit("spent").alias("hook"), "*").union(made["orders"].select(F.lit("orders").alias("hook"), "*"))


@query("sample_divergent", TWO + "SELECT unit_id, outcome FROM k WHERE outcome = 'divergent' ORDER BY md5('0:' || unit_id), unit_id LIMIT 20")
def sample_divergent(spark, sf):
    """Some divergent units, picked by a digest of their id (a sampling operator)."""
    made = compare.compare_units(*_two_runs(spark, sf), ["result", "customer"])
    return compare.sample_units(made.filter("outcome = 'divergent'"), 20).select("unit_id", "outcome")


@query(
    "prompt_truncate",
    """
    SELECT conv_id, turn, CASE WHEN length(text) <= 45 THEN text
        WHEN contains(left(text, 37), ' ') THEN regexp_replace(left(text, 37), ' [^ ]*$', '', 's') || '...'
        ELSE left(text, 37) || '...' END AS prompt
    FROM (SELECT conv_id, turn, replace(text, chr(10), ' ') AS text FROM conversations)
    """,
)
def prompt_truncate(spark, sf):
    """Texts are cut at a word, and not at all within five characters of the limit."""
    talk = table(spark, sf, "conversations").select(
        "conv_id", "turn", F.translate("text", "\n", " ").alias("said"), F.concat_ws("-", "conv_id", "turn").alias("unit_id")
    )
    asked = prompts.render_prompts(talk, "{{ said | truncate(40) }}", "reply")
    ids = F.split("unit_id", "-")
    return asked.select(ids[0].cast("bigint").alias("conv_id"), ids[1].cast(talk.schema["turn"].dataType).alias("turn"), "prompt")


@query(
    "inference_logged",
    """
    SELECT unit_id, n % 17 = 0 AS failed, CASE WHEN n % 17 = 0 THEN 0 ELSE n // 4 END AS input_tokens, 1 + (n % 17 = 0)::INT AS logged
    FROM (SELECT 'c' || conv_id || 't' || turn AS unit_id, length(text) AS n FROM conversations)
    """,
)
def inference_logged(spark, sf):
    """Every answer is in the log once; a second run calls again only what ended in an error."""
    log = work_dir(spark, "answers")
    talk = table(spark, sf, "conversations").select("text", F.expr("concat('c', conv_id, 't', turn)").alias("unit_id"))
    asked = prompts.render_prompts(talk, "{{text}}", "reply")
    for _ in range(2):
        made = infer.infer_once(asked, answer, log, waves=2)
    counted = spark.read.parquet(log).groupBy("unit_id").agg(F.count(F.lit(1)).cast("int").alias("logged"))
    return made.join(counted, "unit_id").select("unit_id", F.col("error").isNotNull().alias("failed"), "input_tokens", "logged")


@query(
    "numeric_report",
    """
    SELECT o_orderpriority AS "group", round(avg(o_custkey), 6) AS mean, row_number() OVER (ORDER BY avg(o_custkey) DESC, o_orderpriority) - 1 AS place
    FROM orders GROUP BY o_orderpriority
    """,
)
def numeric_report(spark, sf):
    """Statistics in report order."""
    stats = reports.by_mean(reports.numeric_stats(table(spark, sf, "orders"), "o_orderpriority", "o_custkey"))
    placed = order.row_positions(stats, [-F.col("mean"), "group"], out="place")
    return placed.select("group", F.round("mean", 6).alias("mean"), "place")


@query(
    "distribution_of_values",
    """
    SELECT o_orderpriority AS "group", count(*) FILTER (o_orderstatus = 'F')::BIGINT AS "F", count(*) FILTER (o_orderstatus = 'O')::BIGINT AS "O",
        count(*) FILTER (o_orderstatus IN ('F', 'O'))::BIGINT AS total FROM orders GROUP BY 1
    """,
)
def distribution_of_values(spark, sf):
    """The wide form for values that are given."""
    return reports.distribution_matrix(table(spark, sf, "orders"), "o_orderpriority", "o_orderstatus", values=["O", "F"])
