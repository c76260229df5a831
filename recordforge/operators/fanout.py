"""One child row per element of an array field."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, VariantType

from recordforge.functions.variants import items, json_type
from recordforge.operators.units import assign_chunks


def fan_out(df: DataFrame, field: str, child_field: str, drop_array: bool = False) -> DataFrame:
    """Children with `_fan_index`, `_fan_parent_id` and id `parent__fanNNN`. Parents without elements give none.

    Parent fields ride along, the array too unless `drop_array`. A VARIANT field that is not an array gives no child.
    """
    dtype = df.schema[field].dataType
    if isinstance(dtype, VariantType):
        elements = F.when(json_type(F.col(field)) == "array", items(F.col(field)))
    elif isinstance(dtype, ArrayType):
        elements = F.col(field)
    else:
        elements = F.expr("cast(null as array<string>)")
    kept = [
        c for c in df.columns
        if c not in ("unit_id", child_field, "_fan_index", "_fan_parent_id", "_unit_pos") and not (drop_array and c == field)
    ]
    opened = df.select(F.col("unit_id").alias("_fan_parent_id"), *kept, F.posexplode(elements).alias("_fan_index", child_field))
    return opened.select(
        F.format_string("%s__fan%03d", "_fan_parent_id", "_fan_index").alias("unit_id"),
        *kept,
        child_field,
        "_fan_index",
        "_fan_parent_id",
    )


def chunk_children(children: DataFrame, size: int = 100, first_chunk: int = 0, order_by: list[str] | None = None) -> DataFrame:
    """Pack children into chunks numbered after the existing ones."""
    return assign_chunks(children, size, order_by or ["_fan_parent_id", "_fan_index"], first_chunk)


def expansion(df: DataFrame, field: str) -> DataFrame:
    """Parents, children and their ratio, without building the children."""
    n = F.greatest(F.coalesce(F.size(field), F.lit(0)), F.lit(0))
    totals = df.agg(F.count(F.lit(1)).alias("parents"), F.sum(n).cast("bigint").alias("children"))
    return totals.withColumn("ratio", F.try_divide(F.col("children").cast("double"), F.col("parents")))
