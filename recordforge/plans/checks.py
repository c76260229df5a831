"""Reading, coercing and judging model responses and typed records."""

from __future__ import annotations

from pyspark.sql import functions as F

from recordforge.functions.variants import entries
from recordforge.operators import gates, infer, rules, schema_check, validate
from recordforge.plans.registry import query, table, tasks
from recordforge.plans.shared import CENTS, RESPONSE, SCHEMA, responses


@query(
    "json_repair",
    f"""
    WITH raw AS (SELECT o_orderkey, trim({RESPONSE}) AS t FROM orders),
    opened AS (SELECT o_orderkey, CASE WHEN contains(t, '```json') AND regexp_extract(t, '(?s)```json(.*?)```', 1) <> ''
        THEN trim(regexp_extract(t, '(?s)```json(.*?)```', 1), chr(10) || ' ') ELSE t END AS t FROM raw),
    plus AS (SELECT o_orderkey, regexp_replace(t, '"\\s*:\\s*\\+([0-9])', '": \\1', 'g') AS t FROM opened),
    fixed AS (SELECT o_orderkey, regexp_replace(t, ',\\s*([}}\\]])', '\\1', 'g') AS t FROM plus)
    SELECT o_orderkey, json_valid(t) AS parsed, CASE WHEN json_valid(t) THEN trim(json_extract_string(t, '$.cents'))::BIGINT END AS cents,
        CASE WHEN json_valid(t) THEN len(json_keys(t)) END AS n_fields FROM fixed
    """,
)
def json_repair(spark, sf):
    read = infer.read_responses(responses(spark, sf), "response", "v")
    return read.select(
        "o_orderkey",
        F.col("v").isNotNull().alias("parsed"),
        F.try_variant_get("v", "$.cents", "string").cast("bigint").alias("cents"),
        F.size(entries(F.col("v"))).alias("n_fields"),
    )


@query(
    "schema_check",
    f"""
    SELECT o_orderkey, CASE k WHEN 6 THEN 'schema_required' WHEN 7 THEN 'schema_json_parse' WHEN 8 THEN 'schema_type' ELSE '' END AS rules,
        CASE k WHEN 6 THEN '$' WHEN 7 THEN '$' WHEN 8 THEN '$.order' ELSE '' END AS paths,
        CASE k WHEN 4 THEN '$.order,$.cents' WHEN 5 THEN '$.status' WHEN 9 THEN '$.paid,$.tags' ELSE '' END AS coerced,
        k NOT IN (6, 7, 8) AS is_valid, CASE WHEN k NOT IN (6, 7) THEN c END AS cents, CASE WHEN k <> 7 THEN o_orderstatus END AS status,
        CASE WHEN k = 9 THEN true END AS paid, CASE WHEN k IN (0, 1, 2, 3) THEN 'a,b' WHEN k = 9 THEN 'a' END AS tags
    FROM (SELECT *, o_orderkey % 10 AS k, {CENTS} AS c FROM orders)
    """,
)
def schema_check_rows(spark, sf):
    checked = schema_check.check_schema(responses(spark, sf), SCHEMA, "response", repair=True, tasks=tasks(spark))
    typed = schema_check.typed_fields(checked, schema_check.field_types(SCHEMA))
    return typed.select(
        "o_orderkey",
        F.array_join("errors.rule", ",").alias("rules"),
        F.array_join("errors.path", ",").alias("paths"),
        F.array_join("coercions.path", ",").alias("coerced"),
        "is_valid",
        "cents",
        "status",
        "paid",
        F.array_join("tags", ",").alias("tags"),
    )


@query(
    "schema_summary",
    """
    SELECT count(*) FILTER (k NOT IN (6, 7, 8))::BIGINT AS valid, count(*) FILTER (k IN (6, 7, 8))::BIGINT AS invalid, count(*)::BIGINT AS total,
        sum(CASE k WHEN 4 THEN 2 WHEN 5 THEN 1 WHEN 9 THEN 2 ELSE 0 END)::BIGINT AS coerced_fields FROM (SELECT o_orderkey % 10 AS k FROM orders)
    """,
)
def schema_summary(spark, sf):
    return schema_check.check_summary(schema_check.check_schema(responses(spark, sf), SCHEMA, "response", repair=True))


@query("schema_strict", "SELECT count(*)::BIGINT AS all_good, 0::BIGINT AS with_bad FROM orders")
def schema_strict(spark, sf):
    """One bad row empties the result; a table of good rows passes whole."""
    rows = table(spark, sf, "orders").select(F.to_json(F.struct("o_orderkey", "o_orderstatus")).alias("j"))
    ok = schema_check.check_schema(rows, {"type": "object", "required": ["o_orderkey"]}, "j")
    bad = schema_check.check_schema(responses(spark, sf), SCHEMA, "response")
    passed = schema_check.strict(ok).select(F.lit(True).alias("good")).unionByName(
        schema_check.strict(bad).select(F.lit(False).alias("good"))
    )
    return passed.agg(F.count_if("good").alias("all_good"), F.count_if(~F.col("good")).alias("with_bad"))


NESTED = {
    "type": "object",
    "required": ["lines"],
    "properties": {
        "lines": {
            "type": "array",
            "minItems": 1,
            "maxItems": 2000,
            "items": {"type": "object", "required": ["n", "words"], "properties": {"n": {"$ref": "#/$defs/count"}, "words": {"type": "integer", "minimum": 1, "maximum": 60}}},
        },
        "lang": {"enum": ["EN", "FR", "DE"]},
    },
    "additionalProperties": {"type": "number"},
    "$defs": {"count": {"type": "integer", "minimum": 0}},
}


@query(
    "schema_nested",
    """
    WITH d AS (SELECT doc_id, lang, string_split(text, chr(10)) AS p FROM documents),
    l AS (SELECT doc_id, i, len(string_split(p[i], ' ')) AS w FROM (SELECT doc_id, p, unnest(range(1, len(p) + 1)) AS i FROM d)),
    e AS (SELECT doc_id, count(*) FILTER (w > 60)::INT AS too_long, max(w) AS most FROM l GROUP BY doc_id)
    SELECT d.doc_id, too_long + (lang NOT IN ('en', 'fr', 'de'))::INT + (len(p) > 2000)::INT AS n_errors, len(p) + 1 + (lang IN ('en', 'fr', 'de'))::INT AS n_coercions
    FROM d JOIN e USING (doc_id)
    """,
)
def schema_nested(spark, sf):
    """Arrays of objects with string counts, references, an enum in another case, and extra fields checked by type."""
    lines = F.transform(
        F.split("text", "\n"),
        lambda x, i: F.struct(i.alias("n"), F.size(F.split(x, " ")).cast("string").alias("words")),
    )
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang", "n_chars").select(
        "doc_id", F.to_json(F.struct(lines.alias("lines"), "lang", F.col("n_chars").cast("string").alias("chars"))).alias("j")
    )
    checked = schema_check.check_schema(docs, NESTED, "j", tasks=tasks(spark))
    return checked.select("doc_id", F.size("errors").alias("n_errors"), F.size("coercions").alias("n_coercions"))


@query(
    "response_unwrapped",
    "SELECT o_orderkey, o_orderkey % 3 <> 2 AS is_valid, o_orderkey % 3 = 0 AS keeps_outer FROM orders",
)
def response_unwrapped(spark, sf):
    """A response wrapped as text inside `response` is lifted; outer fields are never replaced."""
    inner = F.format_string('```json\n{"order": %d, "note": "inner",}\n```', "o_orderkey")
    k = F.col("o_orderkey") % 3
    outer = (
        F.when(k == 0, F.to_json(F.struct(F.lit("outer").alias("note"), inner.alias("response"))))
        .when(k == 1, F.to_json(F.struct(inner.alias("response"))))
        .otherwise(F.to_json(F.struct(F.lit("nothing").alias("response"))))
    )
    rows = table(spark, sf, "orders").select("o_orderkey", outer.alias("j"))
    checked = schema_check.check_schema(rows, {"type": "object", "required": ["order"], "properties": {"order": {"type": "integer"}}}, "j")
    keeps = F.coalesce(schema_check.field(F.col("data"), "note", "string") == "outer", F.lit(False))
    return checked.select("o_orderkey", "is_valid", keeps.alias("keeps_outer"))


ORDER_RULES = {
    "required": ["o_custkey"],
    "types": {"o_totalprice": "number", "o_orderstatus": "string"},
    "ranges": {"o_totalprice": [5000, 400000]},
    "enums": {"o_orderstatus": ["o", "P"]},
    "rules": [
        {
            "name": "urgent_is_cheap",
            "expr": "o_totalprice < 300000",
            "when": "o_orderpriority = '1-URGENT'",
            "error": "Urgent order {o_orderkey} costs {_computed}, see {nothing}",
        },
        {"name": "odd_customer", "expr": "o_custkey % 2", "level": "warning", "error": "customer {o_custkey} is even"},
        {"name": "share", "expr": "1000 / (o_custkey % 7) > 0", "error": "no share"},
        {"name": "guarded", "expr": "false", "when": "1 / (o_custkey % 3) < 0", "error": "never"},
    ],
}


@query(
    "rule_check",
    """
    WITH c AS (SELECT *, o_totalprice < 5000 OR o_totalprice > 400000 AS r, o_orderstatus = 'F' AS f,
        o_orderpriority = '1-URGENT' AND o_totalprice >= 300000 AS u, o_custkey % 7 = 0 AS z FROM orders)
    SELECT o_orderkey, array_to_string(list_filter([CASE WHEN r THEN 'range_o_totalprice' END, CASE WHEN f THEN 'enum_o_orderstatus' END,
            CASE WHEN u THEN 'urgent_is_cheap' END, CASE WHEN z THEN 'share' END], lambda x: x IS NOT NULL), ',') AS errors,
        array_to_string(list_filter([CASE WHEN r THEN 'Field ''o_totalprice'' value ' || o_totalprice::VARCHAR || ' outside range [5000, 400000]' END,
            CASE WHEN f THEN 'Field ''o_orderstatus'' value ''F'' not in allowed values: [''o'', ''P'']' END,
            CASE WHEN u THEN 'Urgent order ' || o_orderkey || ' costs ' || o_totalprice::VARCHAR || ', see {nothing}' END,
            CASE WHEN z THEN 'no share (expression error: no value)' END], lambda x: x IS NOT NULL), '|') AS messages,
        array_to_string(list_filter([CASE WHEN o_custkey % 2 = 0 THEN 'customer ' || o_custkey || ' is even' END,
            CASE WHEN o_custkey % 3 = 0 THEN 'when clause failed to evaluate: no value' END], lambda x: x IS NOT NULL), '|') AS warnings FROM c
    """,
)
def rule_check(spark, sf):
    checked = rules.check_rules(table(spark, sf, "orders"), ORDER_RULES)
    return checked.select(
        "o_orderkey",
        F.array_join("errors.rule", ",").alias("errors"),
        F.array_join("errors.message", "|").alias("messages"),
        F.array_join("warnings.message", "|").alias("warnings"),
    )


@query(
    "rule_required_stops",
    """
    SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'required_score' WHEN event_id % 4 = 1 THEN 'type_score,range_flag' WHEN event_id % 4 = 2 THEN 'range_score' ELSE '' END AS errors
    FROM events
    """,
)
def rule_required_stops(spark, sf):
    """Values whose type differs by row: null, text, number; a boolean counts as 0 or 1 in a range."""
    k = F.col("event_id") % 4
    doc = (
        F.when(k == 0, F.lit('{"score": null, "flag": 5}'))
        .when(k == 1, F.lit('{"score": "high", "flag": true}'))
        .when(k == 2, F.lit('{"score": 11, "flag": false}'))
        .otherwise(F.lit('{"score": 7.5}'))
    )
    rows = table(spark, sf, "events").select("event_id", F.parse_json(doc).alias("d"))
    flat = schema_check.typed_fields(rows, {"score": "variant", "flag": "variant"}, "d")
    checked = rules.check_rules(
        flat, {"required": ["score"], "types": {"score": "number"}, "ranges": {"score": [0, 10], "flag": [0, 0.5]}}
    )
    return checked.select("event_id", F.array_join("errors.rule", ",").alias("errors"))


@query(
    "rule_failures",
    """
    SELECT o_orderkey::VARCHAR AS unit_id, 'validation' AS failure_stage, 'price' AS step, o_totalprice AS price, 0 AS retry_count
    FROM orders WHERE NOT (o_totalprice > 100000)
    """,
)
def rule_failures(spark, sf):
    orders = table(spark, sf, "orders").withColumn("unit_id", F.col("o_orderkey").cast("string"))
    checked = rules.check_rules(orders, {"rules": [{"name": "price", "expr": "o_totalprice > 100000"}]})
    made = rules.rule_failures(checked, "price")
    return made.select("unit_id", "failure_stage", "step", F.col("input.o_totalprice").alias("price"), "retry_count")


STEP_RULES = {
    "rules": [
        {"name": "worth_it", "expr": "cents >= 5000000", "error": "only {cents}"},
        {"name": "even_customer", "expr": "custkey % 2 = 0", "level": "warning", "error": "customer {custkey}"},
    ]
}


def judged_step(spark, sf, fix: bool = True):
    """The response step judged: responses that are no JSON are lost on the way and come back as failures.

    Order keys are the primary key of both sides, so neither needs a choice of one row per unit.
    """
    n = 2 * spark.sparkContext.defaultParallelism  # a task of this plan costs much by itself
    read = infer.read_responses(responses(spark, sf, n), "response", "v").filter("v is not null")
    results = read.select("unit_id", entries(F.col("v")).alias("data"), F.col("response").alias("raw_response"))
    inputs = table(spark, sf, "orders").select("o_orderkey", "o_custkey").selectExpr(
        "cast(o_orderkey as string) AS unit_id", "o_custkey AS custkey", "cast(o_orderkey % 3 as int) AS retry_count"
    )
    return validate.validate_step(results, inputs, SCHEMA, STEP_RULES, "price", {"custkey": "bigint"}, fix=fix, unique=True, tasks=n)


STEP_SQL = f"""
    SELECT o_orderkey::VARCHAR AS unit_id, o_orderkey % 3 AS retry_count, o_custkey, {CENTS} AS c, o_orderkey % 10 AS k,
        CASE WHEN o_orderkey % 10 = 7 THEN 'pipeline_internal' WHEN o_orderkey % 10 IN (6, 8) THEN 'schema_validation'
            WHEN {CENTS} < 5000000 THEN 'validation' END AS failure_stage FROM orders
"""


@query(
    "step_validation",
    f"""
    SELECT unit_id, retry_count, CASE WHEN failure_stage IS NULL THEN 'valid' ELSE 'failed' END AS status, failure_stage,
        CASE WHEN k = 7 THEN 'pipeline_internal' WHEN k = 6 THEN 'schema_required' WHEN k = 8 THEN 'schema_type' WHEN c < 5000000 THEN 'worth_it' ELSE '' END AS errors,
        CASE WHEN failure_stage IS NULL AND o_custkey % 2 = 1 THEN 'customer ' || o_custkey ELSE '' END AS warnings,
        CASE WHEN k NOT IN (6, 7) THEN c END AS cents, o_custkey AS custkey FROM ({STEP_SQL})
    """,
)
def step_validation(spark, sf):
    judged = judged_step(spark, sf)
    return judged.select(
        "unit_id", "retry_count", "status", "failure_stage",
        F.array_join("errors.rule", ",").alias("errors"),
        F.array_join("warnings.message", ",").alias("warnings"),
        schema_check.field(F.col("data"), "cents", "bigint").alias("cents"),
        F.try_variant_get(F.try_element_at("input", F.lit("custkey")), "$", "bigint").alias("custkey"),
    )


@query(
    "premerge",
    f"SELECT o_orderkey::VARCHAR AS unit_id, o_custkey AS custkey, 'result' AS origin, CASE WHEN o_orderkey % 10 = 6 THEN NULL ELSE {CENTS} END AS cents FROM orders WHERE o_orderkey % 10 <> 7",
)
def premerge(spark, sf):
    read = infer.read_responses(responses(spark, sf), "response", "v").filter("v is not null")
    tagged = F.map_concat(entries(F.col("v")), F.expr("map('origin', cast('result' as variant))"))
    results = read.select("unit_id", tagged.alias("data"))
    inputs = table(spark, sf, "orders").selectExpr("cast(o_orderkey as string) AS unit_id", "o_custkey AS custkey", "'input' AS origin")
    merged = validate.premerge(results, inputs)
    get = lambda n, t: F.try_variant_get(F.try_element_at("data", F.lit(n)), "$", t)
    return merged.select(
        "unit_id", get("custkey", "bigint").alias("custkey"), get("origin", "string").alias("origin"), get("cents", "string").cast("bigint").alias("cents")
    )


@query("phase_gate", "SELECT o_orderkey FROM orders WHERE o_orderkey % 10 NOT IN (6, 7, 8)")
def phase_gate(spark, sf):
    checked = schema_check.check_schema(responses(spark, sf), SCHEMA, "response", repair=True)
    ok, _ = schema_check.split_valid(checked)
    return validate.passed_gate(table(spark, sf, "orders").withColumn("unit_id", F.col("o_orderkey").cast("string")), ok).select("o_orderkey")


@query(
    "failure_enrichment",
    """
    SELECT o_orderkey::VARCHAR AS unit_id, o_orderkey % 4 AS retry_count, c_name, c_mktsegment AS input_segment, 'raw ' || o_orderkey AS raw_response
    FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_totalprice <= 100000
    """,
)
def failure_enrichment(spark, sf):
    orders = table(spark, sf, "orders").withColumn("unit_id", F.col("o_orderkey").cast("string"))
    checked = rules.check_rules(orders, {"rules": [{"name": "price", "expr": "o_totalprice > 100000"}]})
    failed = rules.rule_failures(checked, "price").drop("input")
    people = table(spark, sf, "customer")
    inputs = orders.join(people, F.col("c_custkey") == F.col("o_custkey")).select(
        "unit_id", "c_name", "c_mktsegment", (F.col("o_orderkey") % 4).alias("retry_count"), F.concat(F.lit("raw "), "o_orderkey").alias("_raw_text")
    )
    made = validate.enrich_failures(failed, inputs)
    return made.select("unit_id", "retry_count", "c_name", F.col("input.c_mktsegment").alias("input_segment"), "raw_response")


@query(
    "lost_records",
    "SELECT o_orderkey::VARCHAR AS unit_id, 'pipeline_internal' AS failure_stage, 'price' AS step, 'Record lost during validation pipeline' AS message FROM orders WHERE o_orderkey % 10 = 7",
)
def lost_records(spark, sf):
    inputs = table(spark, sf, "orders").selectExpr("cast(o_orderkey as string) AS unit_id", "o_custkey")
    read = infer.read_responses(responses(spark, sf), "response", "v").filter("v is not null").drop("v")
    checked = schema_check.check_schema(read, SCHEMA, "response", repair=True)
    lost = validate.lost_records(inputs, *schema_check.split_valid(checked), "price")
    return lost.select("unit_id", "failure_stage", "step", F.col("errors")[0]["message"].alias("message"))


@query(
    "last_per_key",
    "SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY user_id",
)
def last_per_key(spark, sf):
    return validate.last_per_key(table(spark, sf, "events"), "user_id", ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@query(
    "quality_gates",
    """
    SELECT 'known_langs' AS gate, count(*) FILTER (lang NOT IN ('en', 'de', 'fr', 'es'))::DOUBLE AS value, count(*) FILTER (lang NOT IN ('en', 'de', 'fr', 'es')) = 0 AS passed FROM documents
    UNION ALL SELECT 'english_share', round(avg((lang = 'en')::INT), 9), avg((lang = 'en')::INT) BETWEEN 0.25 AND 0.75 FROM documents
    UNION ALL SELECT 'all_langs', 1 + (4 - count(DISTINCT lang)), false FROM documents
    UNION ALL SELECT 'counted', count(*) FILTER (n_chars <> length(text))::DOUBLE, count(*) FILTER (n_chars <> length(text)) = 0 FROM documents
    UNION ALL SELECT 'shortest', min(n_chars)::DOUBLE, min(n_chars) >= 1 FROM documents
    """,
)
def quality_gates(spark, sf):
    made = gates.quality_gates(
        table(spark, sf, "documents"),
        {
            "known_langs": gates.values_in("lang", ["en", "de", "fr", "es"]),
            "english_share": gates.balance(F.col("lang") == "en"),
            "all_langs": gates.categories_present("lang", ["en", "de", "fr", "es", "it"]),
            "counted": gates.all_true(F.col("n_chars") == F.length("text")),
            "shortest": gates.minimum(F.col("n_chars"), 1),
        },
    )
    return made.select("gate", F.round("value", 9).alias("value"), "passed")
