"""Quality gates: named checks over a whole table, each one row with a value and a verdict."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Gate:
    """A check: an aggregate `value` and a condition on it."""

    def __init__(self, value: Column, passes: Column):
        self.value, self.passes = value.cast("double"), passes


def values_in(column: str, allowed: Sequence) -> Gate:
    """All values are allowed; the value is the number that is not."""
    bad = F.count_if(~F.coalesce(F.col(column).isin(list(allowed)), F.lit(False)))
    return Gate(bad, bad == 0)


def balance(condition: Column, low: float = 0.25, high: float = 0.75) -> Gate:
    """The share of rows that meet a condition lies between two bounds."""
    share = F.avg(condition.cast("double"))
    return Gate(share, F.coalesce(share.between(low, high), F.lit(False)))


def categories_present(column: str, required: Sequence) -> Gate:
    """Every category occurs; the value is how many do not."""
    gone = sum((1 - F.coalesce(F.max((F.col(column) == c).cast("int")), F.lit(0)) for c in required), F.lit(0))
    return Gate(gone, gone == 0)


def all_true(condition: Column) -> Gate:
    bad = F.count_if(~F.coalesce(condition, F.lit(False)))
    return Gate(bad, bad == 0)


def minimum(value: Column, floor: float) -> Gate:
    low = F.min(value)
    return Gate(low, F.coalesce(low >= floor, F.lit(False)))


def quality_gates(df: DataFrame, gates: Mapping[str, Gate]) -> DataFrame:
    """(gate, value, passed). All gates are aggregates of one pass over the table."""
    row = df.agg(*[F.struct(g.value.alias("value"), g.passes.alias("passed")).alias(n) for n, g in gates.items()])
    pairs = F.array(*[F.struct(F.lit(n).alias("gate"), F.col(f"`{n}`.value"), F.col(f"`{n}`.passed")) for n in gates])
    return row.select(F.explode(pairs).alias("g")).select("g.*")
