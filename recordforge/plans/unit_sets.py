"""Unit generation and fan-out over customers, suppliers, parts, orders and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from recordforge.operators import fanout, units
from recordforge.plans.registry import query, table

CUSTOMER_UNIT = "replace(replace(c_name, ' ', '_'), '/', '-')"
SEED = "('0x' || right(sha256({}), 8))::BIGINT & 2147483647"


@query("unit_direct", f"SELECT {CUSTOMER_UNIT} AS unit_id, c_custkey, c_mktsegment, c_acctbal FROM customer")
def unit_direct(spark, sf):
    return units.direct(table(spark, sf, "customer"), "c_name").select("unit_id", "c_custkey", "c_mktsegment", "c_acctbal")


@query(
    "unit_permutations",
    """
    SELECT a.r_name || '-' || b.r_name || '-' || c.r_name || '-' || replace(replace(c_name, ' ', '_'), '/', '-') AS unit_id,
        a.r_regionkey AS first_key, b.r_regionkey AS second_key, c.r_regionkey AS third_key, c_custkey
    FROM (SELECT r_regionkey, replace(replace(r_name, ' ', '_'), '/', '-') AS r_name FROM region) a
    JOIN (SELECT r_regionkey, replace(replace(r_name, ' ', '_'), '/', '-') AS r_name FROM region) b
        ON a.r_regionkey <> b.r_regionkey
    JOIN (SELECT r_regionkey, replace(replace(r_name, ' ', '_'), '/', '-') AS r_name FROM region) c
        ON c.r_regionkey <> a.r_regionkey AND c.r_regionkey <> b.r_regionkey
    CROSS JOIN customer
    """,
)
def unit_permutations(spark, sf):
    """Every order of three regions, for every customer."""
    routes = units.permutations(table(spark, sf, "region"), ["first", "second", "third"], "r_name", ["r_regionkey"])
    customers = table(spark, sf, "customer").select(F.col("c_name").alias("id"), "c_custkey")
    made = units.cross_product(
        {"route": routes.withColumnRenamed("unit_id", "id"), "customer": customers},
        order_by={"route": ["_unit_pos"], "customer": ["c_custkey"]},
    )
    return made.select(
        "unit_id",
        F.col("route.first.r_regionkey").alias("first_key"),
        F.col("route.second.r_regionkey").alias("second_key"),
        F.col("route.third.r_regionkey").alias("third_key"),
        F.col("customer.c_custkey").alias("c_custkey"),
    )


@query(
    "unit_cross_product",
    """
    SELECT replace(s_name, ' ', '_') || '-' || c_mktsegment || '-' || lang AS unit_id, s_suppkey, c_mktsegment AS segment, lang,
        row_number() OVER (ORDER BY s_suppkey, c_mktsegment, lang) - 1 AS pos
    FROM supplier CROSS JOIN (SELECT DISTINCT c_mktsegment FROM customer) CROSS JOIN (SELECT DISTINCT lang FROM documents)
    """,
)
def unit_cross_product(spark, sf):
    groups = {
        "suppliers": table(spark, sf, "supplier").select(F.col("s_name").alias("id"), "s_suppkey"),
        "segments": table(spark, sf, "customer").select(F.col("c_mktsegment").alias("id")).distinct(),
        "langs": table(spark, sf, "documents").select(F.col("lang").alias("id")).distinct(),
    }
    order = {"suppliers": ["s_suppkey"], "segments": ["id"], "langs": ["id"]}
    made = units.cross_product(groups, ["supplier", "segment", "lang"], order_by=order)
    return made.select(
        "unit_id", F.col("supplier.s_suppkey").alias("s_suppkey"), F.col("segment.id").alias("segment"),
        F.col("lang.id").alias("lang"), F.col("_unit_pos").alias("pos"),
    )


@query(
    "unit_group_limit",
    """
    SELECT p_name_id || '-' || c_mktsegment AS unit_id, p_partkey FROM
    (SELECT p_partkey, p_partkey::VARCHAR AS p_name_id FROM part ORDER BY p_partkey LIMIT 4),
    (SELECT DISTINCT c_mktsegment FROM customer ORDER BY 1 LIMIT 4)
    """,
)
def unit_group_limit(spark, sf):
    """The first items of every list (the list limit is the feature shown)."""
    groups = {
        "part": table(spark, sf, "part").select(F.col("p_partkey").alias("id")),
        "segment": table(spark, sf, "customer").select(F.col("c_mktsegment").alias("id")).distinct(),
    }
    made = units.cross_product(groups, order_by={"part": ["id"], "segment": ["id"]}, limit=4)
    return made.select("unit_id", F.col("part.id").alias("p_partkey"))


@query(
    "unit_repeat",
    f"""
    SELECT {CUSTOMER_UNIT} || '__rep' || lpad(r::VARCHAR, 4, '0') AS unit_id, c_custkey, r AS _repetition_id,
        ({SEED.format(CUSTOMER_UNIT)}) + r AS _repetition_seed
    FROM customer CROSS JOIN range(10) t(r)
    """,
)
def unit_repeat(spark, sf):
    base = units.direct(table(spark, sf, "customer"), "c_name").select("unit_id", "c_custkey")
    return units.repeat(base, 10)


@query(
    "unit_interleaved_limit",
    f"""
    SELECT unit_id, _repetition_id, pos FROM (
        SELECT {CUSTOMER_UNIT} || '__rep' || lpad(r::VARCHAR, 4, '0') AS unit_id, r AS _repetition_id,
            row_number() OVER (ORDER BY r, c_custkey) - 1 AS pos
        FROM customer CROSS JOIN range(5) t(r)) WHERE pos < 2000
    """,
)
def unit_interleaved_limit(spark, sf):
    """The first 2000 units of five repetitions, numbered repetition by repetition (the unit limit is the feature)."""
    made = units.generate_units(
        table(spark, sf, "customer"), "direct", name_field="c_name", repeat_count=5, max_units=2000, order_by=["c_custkey"]
    )
    return made.select("unit_id", "_repetition_id", F.col("_unit_pos").alias("pos"))


@query(
    "unit_duplicate_ids",
    "SELECT replace(replace(p_name, ' ', '_'), '/', '-') AS unit_id, count(*)::BIGINT AS n FROM part GROUP BY 1 HAVING count(*) > 1",
)
def unit_duplicate_ids(spark, sf):
    return units.duplicate_ids(units.direct(table(spark, sf, "part"), "p_name"))


@query(
    "unit_chunks",
    """
    SELECT chunk_id::INT AS chunk_id, 'chunk_' || CASE WHEN chunk_id < 1000 THEN lpad(chunk_id::VARCHAR, 3, '0') ELSE chunk_id::VARCHAR END AS chunk_name,
        count(*)::BIGINT AS n, min(o_orderkey) AS first_key, max(o_orderkey) AS last_key
    FROM (SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey) - 1) // 500 AS chunk_id FROM orders) GROUP BY chunk_id
    """,
)
def unit_chunks(spark, sf):
    chunked = units.assign_chunks(table(spark, sf, "orders").select("o_orderkey"), 500, ["o_orderkey"])
    return chunked.groupBy("chunk_id", "chunk_name").agg(
        F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("first_key"), F.max("o_orderkey").alias("last_key")
    )


@query(
    "unit_generation_summary",
    """
    SELECT 'direct' AS strategy, count(*)::BIGINT * 3 AS total_units, count(DISTINCT c_name)::BIGINT AS base_units,
        ceil(count(*) * 3 / 100.0)::BIGINT AS chunks FROM customer
    """,
)
def unit_generation_summary(spark, sf):
    made = units.generate_units(
        table(spark, sf, "customer"), "direct", name_field="c_name", repeat_count=3, order_by=["c_custkey"]
    )
    return units.generation_summary(units.assign_chunks(made, 100), "direct")


def _documents(spark, sf):
    return table(spark, sf, "documents").select(
        F.concat(F.lit("doc"), F.col("doc_id")).alias("unit_id"), "doc_id", "lang", F.split("text", "\n").alias("parts")
    )


LINES = "SELECT 'doc' || doc_id AS parent, doc_id, lang, unnest(range(len(p))) AS i, unnest(p) AS part FROM (SELECT *, string_split(text, chr(10)) AS p FROM documents)"
CHILD = "parent || '__fan' || CASE WHEN i < 1000 THEN lpad(i::VARCHAR, 3, '0') ELSE i::VARCHAR END"


@query(
    "fan_out_lines",
    f"SELECT {CHILD} AS unit_id, lang, md5(part) AS line_md5, i::INT AS _fan_index, parent AS _fan_parent_id FROM ({LINES})",
)
def fan_out_lines(spark, sf):
    children = fanout.fan_out(_documents(spark, sf), "parts", "line", drop_array=True)
    return children.select("unit_id", "lang", F.md5("line").alias("line_md5"), "_fan_index", "_fan_parent_id")


@query(
    "fan_out_chunks",
    f"""
    SELECT (7 + pos // 250)::INT AS chunk_id, count(*)::BIGINT AS n, min(unit_id) AS first_id FROM (
        SELECT {CHILD} AS unit_id, row_number() OVER (ORDER BY parent, i) - 1 AS pos FROM ({LINES})) GROUP BY 1
    """,
)
def fan_out_chunks(spark, sf):
    children = fanout.fan_out(_documents(spark, sf), "parts", "line", drop_array=True).drop("line")
    chunked = fanout.chunk_children(children, 250, first_chunk=7)
    return chunked.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("n"), F.min("unit_id").alias("first_id"))


@query(
    "fan_out_expansion",
    """
    SELECT count(*)::BIGINT AS parents, sum(len(string_split(text, chr(10))))::BIGINT AS children,
        sum(len(string_split(text, chr(10))))::DOUBLE / count(*) AS ratio FROM documents
    """,
)
def fan_out_expansion(spark, sf):
    return fanout.expansion(_documents(spark, sf), "parts")
