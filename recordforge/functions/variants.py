"""Typed access to values whose type is only known per row (VARIANT)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Type names as they appear in error records.
INSTANCE_NAMES = {
    "integer": "int",
    "number": "float",
    "string": "str",
    "boolean": "bool",
    "array": "list",
    "object": "dict",
    "null": "null",
}


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate `value` once and use it several times in `body`."""
    return F.element_at(F.transform(F.array(value), body), 1)


def type_name(s: Column) -> Column:
    """JSON type name for a schema text of `schema_of_variant`."""
    return (
        F.when(s == "STRING", F.lit("string"))
        .when(s == "BIGINT", F.lit("integer"))
        .when(s == "BOOLEAN", F.lit("boolean"))
        .when(s.startswith("DECIMAL") | s.isin("DOUBLE", "FLOAT"), F.lit("number"))
        .when(s.startswith("ARRAY"), F.lit("array"))
        .when(s.startswith("OBJECT"), F.lit("object"))
        .when(s == "VOID", F.lit("null"))
        .otherwise(F.lower(s))
    )


def json_type(v: Column) -> Column:
    """JSON type name of a VARIANT; NULL if the value is absent."""
    return F.when(v.isNotNull(), let(F.schema_of_variant(v), type_name))


def instance_name(kind: Column) -> Column:
    pairs = [F.lit(x) for pair in INSTANCE_NAMES.items() for x in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), kind), kind)


def as_type(v: Column, kind: str) -> Column:
    return F.try_variant_get(v, "$", kind)


def entries(v: Column) -> Column:
    """Top-level fields of an object; NULL for anything else."""
    return F.try_variant_get(v, "$", "map<string,variant>")


def items(v: Column) -> Column:
    return F.try_variant_get(v, "$", "array<variant>")


def row_as_map(columns: list[str]) -> Column:
    """Columns of a row as MAP<STRING, VARIANT>; NULL columns count as absent fields."""
    return F.from_json(F.to_json(F.struct(*[F.col(f"`{c}`") for c in columns])), "map<string,variant>")


def overlay(base: Column, top: Column) -> Column:
    """Fields of both maps; `top` wins where both have one."""
    none = F.expr("cast(map() as map<string,variant>)")
    base, top = F.coalesce(base, none), F.coalesce(top, none)
    return F.map_concat(F.map_filter(base, lambda k, _: ~F.map_contains_key(top, k)), top)
