"""Ordered work over whole tables without a single-task window.

`lay_out` sorts a table over all partitions and fixes the result in the shared folder. Running values are then computed
inside each partition and completed by a carry per partition, so neither a table nor one group ever sits in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordforge.session import settle

PART, ROW = "_part", "_row"
_PART_BITS = 33  # monotonically_increasing_id keeps the partition number above this bit


def lay_out(df: DataFrame, order_by: Sequence[str | Column] = (), group_by: Sequence[str] = ()) -> DataFrame:
    """Rows in global order with `_part` (partition number) and `_row` (offset inside it).

    Ties are broken by input position, which also lets a run of equal keys spread over many partitions. Without any
    order the input position alone decides.
    """
    keys = [F.col(c) if isinstance(c, str) else c for c in (*group_by, *order_by)]
    if keys:
        named = [k.alias(f"_k{i}") for i, k in enumerate(keys)]
        tied = df.select("*", *named, F.monotonically_increasing_id().alias("_tie"))
        names = [*(f"_k{i}" for i in range(len(keys))), "_tie"]
        df = tied.repartitionByRange(*names).sortWithinPartitions(*names).drop(*names)
    at = F.monotonically_increasing_id()
    numbered = df.withColumn("_at", at).select(
        "*",
        F.shiftright("_at", _PART_BITS).cast("int").alias(PART),
        F.col("_at").bitwiseAND(F.lit((1 << _PART_BITS) - 1)).alias(ROW),
    )
    return settle(numbered.drop("_at"))


def row_positions(
    df: DataFrame, order_by: Sequence[str | Column] = (), out: str = "_pos", keep_layout: bool = False
) -> DataFrame:
    """Dense positions 0..n-1 in global order."""
    laid = df if PART in df.columns else lay_out(df, order_by)
    sizes = laid.groupBy(PART).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(F.lit(0)).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(PART, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    # One row per partition of the layout, so the broadcast side is bounded by the number of partitions.
    placed = laid.join(F.broadcast(starts), PART).withColumn(out, F.col("_start") + F.col(ROW)).drop("_start")
    return placed if keep_layout else placed.drop(PART, ROW)


def _carry(laid: DataFrame, group_by: list[str], partial: Column, combine) -> DataFrame:
    """Per (group, partition): the combined value of the group's rows in earlier partitions.

    Only groups that continue from an earlier partition are kept: at most one per partition.
    """
    totals = laid.groupBy(*group_by, PART).agg(partial.alias("_value"))
    earlier = Window.partitionBy(*(group_by or [F.lit(0)])).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(
        *group_by, PART, combine(F.col("_value")).over(earlier).alias("_carry"), F.count(F.lit(1)).over(earlier).alias("_seen")
    )
    return carried.filter("_seen > 0").drop("_seen")


def _with_carry(local: DataFrame, carried: DataFrame, group_by: list[str]) -> DataFrame:
    renamed = carried.select(
        F.col(PART).alias("_cpart"), F.col("_carry"), *[F.col(g).alias(f"_c_{g}") for g in group_by]
    )
    same = F.col(PART) == F.col("_cpart")
    for g in group_by:
        same = same & F.col(g).eqNullSafe(F.col(f"_c_{g}"))
    # Bounded like `row_positions`: at most one carried group per partition.
    return local.join(F.broadcast(renamed), same, "left").drop("_cpart", *[f"_c_{g}" for g in group_by])


def running_sum(
    df: DataFrame,
    value: Column,
    order_by: Sequence[str | Column],
    group_by: Sequence[str] = (),
    out: str = "running",
    keep_layout: bool = False,
) -> DataFrame:
    """Sum of `value` over this and all earlier rows of the group. A group may be any share of the table."""
    group_by = list(group_by)
    laid = df if PART in df.columns else lay_out(df, order_by, group_by)
    laid = laid.withColumn("_v", value)
    here = Window.partitionBy(PART, *group_by).orderBy(ROW).rowsBetween(Window.unboundedPreceding, 0)
    local = laid.withColumn("_local", F.sum("_v").over(here))
    full = _with_carry(local, _carry(laid, group_by, F.sum("_v"), F.sum), group_by)
    done = full.withColumn(out, F.coalesce(F.col("_carry") + F.col("_local"), F.col("_local"), F.col("_carry")))
    done = done.drop("_v", "_local", "_carry")
    return done if keep_layout else done.drop(PART, ROW)


def previous_value(
    df: DataFrame,
    value: Column,
    order_by: Sequence[str | Column],
    group_by: Sequence[str] = (),
    out: str = "previous",
    keep_layout: bool = False,
) -> DataFrame:
    """`value` of the row before this one in the group; NULL for the first row."""
    group_by = list(group_by)
    laid = df if PART in df.columns else lay_out(df, order_by, group_by)
    laid = laid.withColumn("_v", F.struct(value.alias("v")))
    local = laid.withColumn("_local", F.lag("_v").over(Window.partitionBy(PART, *group_by).orderBy(ROW)))
    newest = _carry(laid, group_by, F.max_by("_v", ROW), F.last)
    full = _with_carry(local, newest, group_by)
    done = full.withColumn(out, F.coalesce(F.col("_local"), F.col("_carry"))["v"]).drop("_v", "_local", "_carry")
    return done if keep_layout else done.drop(PART, ROW)
