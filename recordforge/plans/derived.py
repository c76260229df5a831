"""Seeded draws, loops, derived columns, prompts, inference and its accounting."""

from __future__ import annotations

from pyspark.sql import functions as F

from recordforge.functions import rng, text
from recordforge.operators import derive, infer, prompts, reports, rules, units
from recordforge.plans.registry import query, table, tasks
from recordforge.session import settle

CUSTOMER_UNIT = "replace(replace(c_name, ' ', '_'), '/', '-')"


def u01(seed: str, name: str, i: str = "0") -> str:
    """The uniform draw in SQL."""
    return f"(('0x' || left(sha256(({seed})::VARCHAR || ':{name}:' || ({i})::VARCHAR), 13))::BIGINT / 4503599627370496.0::DOUBLE)"


def seed_of(text_sql: str) -> str:
    return f"(('0x' || right(sha256({text_sql}), 8))::BIGINT & 2147483647)"


def _walks(spark, sf):
    """Two seeded random walks per customer from 5 until 0 or 10 is reached."""
    people = table(spark, sf, "customer").select("c_name", "c_nationkey")
    starts = units.repeat(units.direct(people, "c_name").select("unit_id", "c_nationkey"), 2)
    walked = derive.iterate(
        starts,
        init={"place": F.lit(5)},
        body=lambda get, draw: {"place": get("place") + F.when(draw.random("turn") < 0.5, -1).otherwise(1)},
        until=lambda get: (get("place") <= 0) | (get("place") >= 10),
        step="walk",
        tasks=tasks(spark),
    )
    outcome = F.when(F.col("place") <= 0, F.lit("fell_in_water")).when(F.col("place") >= 10, F.lit("reached_ship"))
    return walked.withColumns({"outcome": outcome, "steps": F.col("_metadata.iterations"), "timeout": F.col("_metadata.timeout")})


WALK_SQL = f"""
    WITH RECURSIVE base AS (
        SELECT {CUSTOMER_UNIT} || '__rep' || lpad(r::VARCHAR, 4, '0') AS unit_id, c_nationkey,
            {seed_of(CUSTOMER_UNIT)} + r AS seed
        FROM customer CROSS JOIN range(2) t(r)),
    walk AS (
        SELECT unit_id, c_nationkey, seed, 5 AS place, 0 AS steps FROM base
        UNION ALL
        SELECT unit_id, c_nationkey, seed, place + CASE WHEN {u01('seed', 'turn', 'steps + 1')} < 0.5 THEN -1 ELSE 1 END, steps + 1
        FROM walk WHERE place > 0 AND place < 10 AND steps < 1000),
    ended AS (SELECT *, CASE WHEN place <= 0 THEN 'fell_in_water' WHEN place >= 10 THEN 'reached_ship' END AS outcome
        FROM (SELECT unit_id, c_nationkey, arg_max(place, steps) AS place, max(steps) AS steps FROM walk GROUP BY 1, 2))
"""


@query(
    "random_walk_outcomes",
    WALK_SQL
    + """
    , counted AS (SELECT n_name, outcome, count(*) AS n FROM ended JOIN nation ON n_nationkey = c_nationkey
        WHERE steps <= 60 AND outcome IS NOT NULL GROUP BY ALL)
    SELECT n_name AS "group", outcome AS value, n::BIGINT AS n, (sum(n) OVER (PARTITION BY n_name))::BIGINT AS group_n,
        round(n * 100.0 / sum(n) OVER (PARTITION BY n_name), 6) AS pct FROM counted
    """,
)
def random_walk_outcomes(spark, sf):
    """The whole chain: items, units, repetitions, simulation, a rule, and the outcome distribution per nation."""
    judged = rules.check_rules(
        _walks(spark, sf).drop("_metadata"),
        {"required": ["outcome"], "rules": [{"name": "short_walk", "expr": "steps <= 60", "error": "{steps} steps"}]},
    )
    nations = table(spark, sf, "nation").select("n_nationkey", "n_name")
    valid = judged.filter(F.size("errors") == 0).join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    return reports.count_distribution(valid, "n_name", "outcome").withColumn("pct", F.round("pct", 6))


@query("random_walk_ends", WALK_SQL + "SELECT unit_id, place, steps, outcome IS NULL AS timeout FROM ended")
def random_walk_ends(spark, sf):
    return _walks(spark, sf).select("unit_id", "place", "steps", "timeout")


@query(
    "random_walk_stats",
    WALK_SQL
    + """
    SELECT c_nationkey::VARCHAR AS "group", count(*)::BIGINT AS count, round(avg(steps), 6) AS mean, median(steps)::DOUBLE AS median,
        round(coalesce(stddev_samp(steps), 0), 6) AS stdev, min(steps)::DOUBLE AS min_val, max(steps)::DOUBLE AS max_val,
        sum(steps)::DOUBLE AS sum_val FROM ended GROUP BY 1
    """,
)
def random_walk_stats(spark, sf):
    # Statistics and medians read the walks several times.
    ended = settle(_walks(spark, sf).select("c_nationkey", "steps"))
    stats = reports.numeric_stats(ended, "c_nationkey", "steps")
    return stats.select(
        "group", "count", F.round("mean", 6).alias("mean"), "median", F.round("stdev", 6).alias("stdev"), "min_val", "max_val", "sum_val"
    )


@query(
    "derive_ordered",
    """
    SELECT o_orderkey, round(base * 1.08, 6) AS total, round(base * 1.08 - base, 6) AS tax, label || '!' AS label FROM (
        SELECT o_orderkey, o_totalprice * 0.9 AS base, lower(o_orderpriority) AS label FROM orders)
    """,
)
def derive_ordered(spark, sf):
    orders = table(spark, sf, "orders").withColumn("unit_id", F.col("o_orderkey").cast("string"))
    made = derive.derive(
        orders,
        {
            "base": "o_totalprice * 0.9D",
            "label": "lower(o_orderpriority)",
            "total": "base * 1.08D",
            "tax": "total - base",
            "label2": "concat(label, '!')",
        },
    )
    return made.select("o_orderkey", F.round("total", 6).alias("total"), F.round("tax", 6).alias("tax"), F.col("label2").alias("label"))


@query(
    "derive_reassign",
    "SELECT c_custkey, (c_nationkey + 1) * 2 AS x, ((c_nationkey + 1) * 2) + 5 AS y FROM customer",
)
def derive_reassign(spark, sf):
    """A repeated name hides the earlier value from there on."""
    people = table(spark, sf, "customer").withColumn("unit_id", F.col("c_name"))
    first = derive.derive(people, {"x": "c_nationkey + 1"}, on_error="ignore")
    return derive.derive(first, {"x": "x * 2", "y": "x + 5"}, on_error="ignore").select("c_custkey", "x", "y")


@query(
    "derive_seeds",
    f"""
    SELECT c_custkey, {seed_of(CUSTOMER_UNIT + " || 'deal'")} AS seed, round({u01(seed_of(CUSTOMER_UNIT + " || 'deal'"), 'x', 'c_custkey')}, 12) AS u
    FROM customer
    """,
)
def derive_seeds(spark, sf):
    base = units.direct(table(spark, sf, "customer"), "c_name")
    made = derive.derive(base, {"seed": "_seed", "u": rng.u01("_seed", "x", F.col("c_custkey"))}, step="deal")
    return made.select("c_custkey", "seed", F.round("u", 12).alias("u"))


@query(
    "derive_errors",
    """
    SELECT l_orderkey, l_linenumber, CASE WHEN l_discount = 0 THEN 'per_discount' END AS _expr_error,
        CASE WHEN l_discount = 0 THEN NULL ELSE round(l_tax / l_discount, 6) END AS per_discount FROM lineitem
    """,
)
def derive_errors(spark, sf):
    """Division by zero fails the expression of that row, not the job."""
    lines = table(spark, sf, "lineitem").withColumn("unit_id", F.concat_ws("-", "l_orderkey", "l_linenumber"))
    made = derive.derive(lines, {"doubled": "l_quantity * 2", "per_discount": "l_tax / l_discount"})
    return made.select("l_orderkey", "l_linenumber", "_expr_error", F.round("per_discount", 6).alias("per_discount"))


@query(
    "derive_errors_dropped",
    "SELECT count(*)::BIGINT AS kept, round(sum(l_tax / l_discount), 4) AS total FROM lineitem WHERE l_discount <> 0",
)
def derive_errors_dropped(spark, sf):
    lines = table(spark, sf, "lineitem").withColumn("unit_id", F.concat_ws("-", "l_orderkey", "l_linenumber"))
    made = derive.derive(lines, {"r": "l_tax / l_discount"}, on_error="drop")
    return made.agg(F.count(F.lit(1)).alias("kept"), F.round(F.sum("r"), 4).alias("total"))


@query("condition_truth", "SELECT event_id FROM events WHERE (value::BIGINT % 3) <> 0")
def condition_truth(spark, sf):
    """A number counts as a condition: zero is false."""
    events = table(spark, sf, "events")
    return derive.matches(events, "cast(bround(value) as bigint) % 3").select("event_id")


SEGMENTS = ["gold", "silver", "bronze", "iron", "tin"]
SEGMENT_SQL = "['gold', 'silver', 'bronze', 'iron', 'tin']"


def ordered_sql(seed: str, name: str) -> str:
    draws = f"list_transform(range(5), lambda i: {{'u': {u01(seed, name, 'i')}, 'i': i}})"
    return f"list_transform(list_sort({draws}), lambda s: {SEGMENT_SQL}[s.i + 1])"


@query(
    "random_draws",
    f"""
    SELECT c_custkey, {SEGMENT_SQL}[1 + floor({u01('c_custkey', 'pick')} * 5)::INT] AS picked,
        3 + floor({u01('c_custkey', 'dice')} * 16)::BIGINT AS dice, round({u01('c_custkey', 'r')}, 10) AS r,
        round(-2 + {u01('c_custkey', 'span')} * 7, 10) AS span,
        array_to_string({ordered_sql('c_custkey', 'hand')}[1:3], ',') AS hand,
        array_to_string({ordered_sql('c_custkey', 'deck')}, ',') AS deck,
        round(10 + 2 * sqrt(-2 * ln(1 - {u01('c_custkey', 'g/r')})) * cos(2 * pi() * {u01('c_custkey', 'g/t')}), 6) AS g
    FROM customer
    """,
)
def random_draws(spark, sf):
    seq = F.array(*[F.lit(s) for s in SEGMENTS])
    key = "c_custkey"
    return table(spark, sf, "customer").select("c_custkey").select(
        key,
        rng.choice(key, "pick", seq).alias("picked"),
        rng.integer(key, "dice", F.lit(3), F.lit(18)).alias("dice"),
        F.round(rng.u01(key, "r"), 10).alias("r"),
        F.round(rng.uniform(key, "span", F.lit(-2), F.lit(5)), 10).alias("span"),
        F.array_join(rng.sample(key, "hand", seq, 3), ",").alias("hand"),
        F.array_join(rng.shuffle(key, "deck", seq), ",").alias("deck"),
        F.round(rng.gauss(key, "g", F.lit(10.0), F.lit(2.0)), 6).alias("g"),
    )


@query(
    "text_formats",
    """
    SELECT o_orderkey,
        CASE WHEN o_orderkey < 60 THEN o_orderkey || 's' WHEN o_orderkey < 3600 THEN (o_orderkey // 60) || 'm ' || (o_orderkey % 60) || 's'
            ELSE (o_orderkey // 3600) || 'h ' || ((o_orderkey % 3600) // 60) || 'm ' || (o_orderkey % 60) || 's' END AS elapsed,
        CASE WHEN o_orderkey >= 3600 THEN (o_orderkey // 3600) || ':' ELSE '' END || lpad(((o_orderkey % 3600) // 60)::VARCHAR, 2, '0')
            || ':' || lpad((o_orderkey % 60)::VARCHAR, 2, '0') AS clock,
        CASE WHEN o_orderkey <= 0 THEN chr(8212) WHEN o_orderkey < 60 THEN '~<1m' WHEN o_orderkey < 3600 THEN '~' || (o_orderkey // 60) || 'm'
            WHEN (o_orderkey % 3600) // 60 > 0 THEN '~' || (o_orderkey // 3600) || 'h ' || ((o_orderkey % 3600) // 60) || 'm'
            ELSE '~' || (o_orderkey // 3600) || 'h' END AS eta,
        CASE WHEN o_custkey >= 1000 THEN printf('%.1fK', o_custkey / 1000.0) ELSE o_custkey::VARCHAR END AS tokens,
        o_orderkey % 7 * 3600 + o_orderkey % 50 * 60 + o_orderkey % 60 AS seconds
    FROM orders
    """,
)
def text_formats(spark, sf):
    o = F.col("o_orderkey")
    written = F.format_string("%dh%dm%ds", o % 7, o % 50, o % 60)
    return table(spark, sf, "orders").select(
        o,
        text.elapsed_text(o).alias("elapsed"),
        text.clock_text(o).alias("clock"),
        text.eta_text(o).alias("eta"),
        text.token_text(F.col("o_custkey")).alias("tokens"),
        text.duration_seconds(written).alias("seconds"),
    )


@query(
    "expression_functions",
    """
    SELECT doc_id, len(w) AS n_words, list_max(list_transform(w, lambda x: length(x)))::INT AS longest, w[1] AS first_word,
        list_sum(list_transform(w, lambda x: length(x)))::BIGINT AS letters, len(list_distinct(w)) AS n_distinct,
        list_bool_or(list_transform(w, lambda x: length(x) > 12)) AS any_long, upper(lang) AS lang_upper,
        round_even(n_chars / 8.0, 0) AS eighth
    FROM (SELECT *, string_split(text, ' ') AS w FROM documents)
    """,
)
def expression_functions(spark, sf):
    """Everyday expression functions as SQL expressions of a derive step."""
    docs = table(spark, sf, "documents").withColumn("unit_id", F.col("doc_id").cast("string"))
    made = derive.derive(
        docs,
        {
            "w": "split(text, ' ')",
            "n_words": "size(w)",
            "longest": "array_max(transform(w, x -> length(x)))",
            "first_word": "w[0]",
            "letters": "aggregate(w, 0L, (acc, x) -> acc + length(x))",
            "n_distinct": "size(array_distinct(w))",
            "any_long": "exists(w, x -> length(x) > 12)",
            "lang_upper": "upper(lang)",
            "eighth": "bround(n_chars / 8D, 0)",
        },
    )
    return made.select("doc_id", "n_words", "longest", "first_word", "letters", "n_distinct", "any_long", "lang_upper", "eighth")


@query(
    "prompt_render",
    """
    SELECT 'c' || conv_id || 't' || turn AS unit_id, 'reply' AS step,
        'Style: short' || chr(10) || upper(role) || ' (turn ' || turn || ') says: ' || text || chr(10) AS prompt FROM conversations
    """,
)
def prompt_render(spark, sf):
    talk = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text").withColumn("unit_id", F.expr("concat('c', conv_id, 't', turn)"))
    template = "Style: {{style}}\n{{ role | upper }} (turn {{turn}}) says: {{text}}\n"
    return prompts.render_prompts(talk, template, "reply", {"style": "long", "role": "nobody"}, {"style": "short"})


@query(
    "prompt_loops",
    """
    SELECT 'doc' || doc_id AS unit_id, 'sum' AS step,
        CASE WHEN n_chars > 1000 THEN 'Long text' ELSE 'Short text' END || ':' || chr(10)
            || array_to_string(list_transform(string_split(text, chr(10)), lambda x: '- ' || x), chr(10)) AS prompt FROM documents
    """,
)
def prompt_loops(spark, sf):
    docs = table(spark, sf, "documents").withColumn("unit_id", F.expr("concat('doc', doc_id)"))
    prompt = F.concat(
        F.when(F.col("n_chars") > 1000, F.lit("Long text")).otherwise(F.lit("Short text")),
        F.lit(":\n"),
        prompts.each(F.split("text", "\n"), lambda x: F.concat(F.lit("- "), x), "\n"),
    )
    return prompts.render_prompts(docs, prompt, "sum")


def answer(unit_id: str, prompt: str) -> dict:
    """A stand-in for a model: the answer depends on the prompt only."""
    n = len(prompt)
    if n % 17 == 0:
        raise ValueError("model refused")
    body = f'{{"length": {n}, "unit": "{unit_id}"}}'
    return {
        "text": f"```json\n{body}\n```" if n % 2 else body,
        "input_tokens": n // 4,
        "output_tokens": len(body),
        "model": "stub",
        "finish_reason": "stop",
    }


@query(
    "inference_rows",
    """
    SELECT unit_id, CASE WHEN n % 17 = 0 THEN 'error' ELSE 'parsed' END AS outcome, CASE WHEN n % 17 <> 0 THEN n END AS length,
        CASE WHEN n % 17 = 0 THEN 'model refused' END AS message, CASE WHEN n % 17 = 0 THEN 0 ELSE n // 4 END AS input_tokens
    FROM (SELECT 'c' || conv_id || 't' || turn AS unit_id, length(text) AS n FROM conversations)
    """,
)
def inference_rows(spark, sf):
    talk = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text").withColumn("unit_id", F.expr("concat('c', conv_id, 't', turn)"))
    asked = prompts.render_prompts(talk, "{{text}}", "reply")
    back = infer.classify_results(infer.infer(asked, answer), "reply")
    return back.select(
        "unit_id", "outcome", F.try_variant_get(F.try_element_at("data", F.lit("length")), "$", "bigint").alias("length"), "message", "input_tokens"
    )


@query(
    "response_classes",
    """
    SELECT k, CASE k WHEN 0 THEN 'parsed' WHEN 1 THEN 'not_object' WHEN 2 THEN 'not_json' WHEN 3 THEN 'empty' WHEN 4 THEN 'none' ELSE 'error' END AS outcome,
        CASE WHEN k IN (1, 2, 3, 4) THEN 'pipeline_internal' WHEN k = 5 THEN 'schema_validation' END AS failure_stage,
        CASE k WHEN 1 THEN 'LLM response is not a JSON object' WHEN 2 THEN 'LLM response is not valid JSON' WHEN 3 THEN 'Empty LLM response'
            WHEN 4 THEN 'No response data from LLM' WHEN 5 THEN 'quota' END AS message, count(*)::BIGINT AS n
    FROM (SELECT o_orderkey % 6 AS k FROM orders) GROUP BY k
    """,
)
def response_classes(spark, sf):
    k = F.col("o_orderkey") % 6
    raw = (
        F.when(k == 0, F.format_string('{"order": %d}', "o_orderkey"))
        .when(k == 1, F.format_string("[%d]", "o_orderkey"))
        .when(k == 2, F.lit("sorry, no"))
        .when(k == 3, F.lit(""))
    )
    sent = table(spark, sf, "orders").select(
        F.col("o_orderkey").cast("string").alias("unit_id"), k.alias("k"), raw.alias("raw_text"), F.when(k == 5, F.lit("quota")).alias("error")
    )
    return infer.classify_results(sent, "s").groupBy("k", "outcome", "failure_stage", "message").agg(F.count(F.lit(1)).alias("n"))


@query(
    "cost_cap",
    """
    SELECT event_id, event_type, running::BIGINT AS running FROM (
        SELECT event_id, event_type, round(value * 100)::BIGINT AS c,
            sum(round(value * 100)::BIGINT) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS running FROM events)
    WHERE running - c < 3000000
    """,
)
def cost_cap(spark, sf):
    calls = table(spark, sf, "events").select("event_id", "event_type", "ts", F.round(F.col("value") * 100).cast("bigint").alias("cents"))
    kept = infer.cost_cap(calls, 3_000_000, "cents", ["ts", "event_id"], ["event_type"])
    return kept.select("event_id", "event_type", F.col("running_cost").alias("running"))


FAILED_CALL = "CASE WHEN event_type = 'error' THEN CASE WHEN value > 60 THEN 'HTTP 401: Unauthorized' ELSE 'timeout' END END"


@query(
    "auth_abort",
    f"""
    WITH r AS (SELECT user_id AS run, ({FAILED_CALL}) AS error, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
    s AS (SELECT run, count(*)::BIGINT AS checked, min(n) FILTER (error IS NULL) AS first_success,
        min(n) FILTER (error LIKE '%401%') AS first_auth_error FROM r WHERE n <= 10 GROUP BY run)
    SELECT *, coalesce(first_auth_error < coalesce(first_success, 11), false) AS abort FROM s
    """,
)
def auth_abort(spark, sf):
    calls = table(spark, sf, "events").select(
        F.col("user_id").alias("run"), "ts", "event_id", F.expr(FAILED_CALL).alias("error")
    ).withColumn("ok", F.col("error").isNull())
    return infer.auth_abort(calls, ["ts", "event_id"], ["run"])


@query(
    "error_streaks",
    """
    WITH f AS (SELECT date_trunc('day', ts)::DATE AS run, event_type AS error, event_id,
            row_number() OVER (PARTITION BY date_trunc('day', ts) ORDER BY ts, event_id) AS a,
            row_number() OVER (PARTITION BY date_trunc('day', ts), event_type ORDER BY ts, event_id) AS b
        FROM events WHERE event_type IN ('error', 'click')),
    g AS (SELECT run, error, a - b AS island, count(*)::BIGINT AS length FROM f GROUP BY ALL)
    SELECT run, error, length, count(*)::BIGINT AS streaks FROM g GROUP BY ALL
    """,
)
def error_streaks(spark, sf):
    """Streaks of equal errors per day, counted by their length."""
    calls = table(spark, sf, "events").select(
        F.to_date("ts").alias("run"), "ts", "event_id", F.when(F.col("event_type").isin("error", "click"), F.col("event_type")).alias("error")
    )
    streaks = infer.error_streaks(calls, "error", ["ts", "event_id"], ["run"])
    return streaks.groupBy("run", "error", "length").agg(F.count(F.lit(1)).alias("streaks"))


@query("call_sequence", "SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS seq FROM events")
def call_sequence(spark, sf):
    return infer.numbered(table(spark, sf, "events").select("event_id", "ts"), ["ts", "event_id"]).select("event_id", "seq")
