"""Differences between runs, between the units of two runs, and between snapshots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordforge.operators.order import previous_value


def compare_runs(
    units: DataFrame, outputs: DataFrame, last_step: str, costs: DataFrame, fan_out_step: str | None = None
) -> DataFrame:
    """Per run: units, survivors of the last step, pass rate, cost, cost per survivor.

    With a fan-out step the base of the pass rate is its children.
    """
    valid = outputs.filter("unit_id is not null")
    start = valid.filter(F.col("step") == fan_out_step) if fan_out_step else units
    totals = start.groupBy("run").agg(F.countDistinct("unit_id").alias("total_units"))
    alive = valid.filter(F.col("step") == last_step).groupBy("run").agg(F.countDistinct("unit_id").alias("valid_units"))
    joined = totals.join(alive, "run", "left").join(costs.select("run", "cost"), "run", "left")
    n = F.coalesce("valid_units", F.lit(0))
    return joined.select(
        "run",
        "total_units",
        n.alias("valid_units"),
        F.coalesce(F.try_divide(n * 100.0, F.col("total_units")), F.lit(0.0)).alias("pass_rate"),
        "cost",
        F.coalesce(F.try_divide(F.col("cost"), n), F.lit(0.0)).alias("cost_per_unit"),
    )


def net_by_run(results: DataFrame, group: str, score, runs: Sequence[str] | None = None) -> DataFrame:
    """Net score of every group, one column per run; with `runs` for these only, without looking the runs up first."""
    return results.groupBy(group).pivot("run", list(runs) if runs else None).agg(F.sum(score))


def populations(a: DataFrame, b: DataFrame) -> DataFrame:
    """Ids of two runs with where they occur: `common`, `only_1` or `only_2`."""
    left = a.filter("unit_id is not null").select(F.col("unit_id").alias("u1")).distinct()
    right = b.filter("unit_id is not null").select(F.col("unit_id").alias("u2")).distinct()
    side = F.when(F.col("u2").isNull(), F.lit("only_1")).when(F.col("u1").isNull(), F.lit("only_2")).otherwise(F.lit("common"))
    return left.join(right, F.col("u1") == F.col("u2"), "full_outer").select(F.coalesce("u1", "u2").alias("unit_id"), side.alias("side"))


def compare_units(a: DataFrame, b: DataFrame, fields: Sequence[str]) -> DataFrame:
    """One row per unit of either run: side, and the fields that differ with both values.

    Of several rows with one id the richest is compared: the one with most fields, of these the largest.
    """

    def pack(df: DataFrame, n: int) -> DataFrame:
        held = sum((F.col(f).isNotNull().cast("int") for f in fields), F.lit(0))
        record = F.struct(*fields)
        best = df.filter("unit_id is not null").groupBy("unit_id").agg(F.max_by(record, F.struct(held, record)).alias(f"r{n}"))
        return best.withColumnRenamed("unit_id", f"u{n}")

    both = pack(a, 1).join(pack(b, 2), F.col("u1") == F.col("u2"), "full_outer")
    changed = F.array_compact(
        F.array(
            *[
                F.when(
                    ~F.col(f"r1.{f}").eqNullSafe(F.col(f"r2.{f}")),
                    F.struct(F.lit(f).alias("field"), F.col(f"r1.{f}").cast("string").alias("a"), F.col(f"r2.{f}").cast("string").alias("b")),
                )
                for f in fields
            ]
        )
    )
    common = F.col("u1").isNotNull() & F.col("u2").isNotNull()
    side = F.when(~common, F.when(F.col("u1").isNull(), F.lit("only_2")).otherwise(F.lit("only_1")))
    return both.withColumn("diffs", F.when(common, changed)).select(
        F.coalesce("u1", "u2").alias("unit_id"),
        F.coalesce(side, F.when(F.size("diffs") > 0, F.lit("divergent")).otherwise(F.lit("identical"))).alias("outcome"),
        "diffs",
    )


def comparison_counts(compared: DataFrame) -> DataFrame:
    return compared.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


def unit_diff(a: DataFrame, b: DataFrame, unit_id: str | None = None) -> DataFrame:
    """Every field of both records side by side with a match flag, for one unit or all."""
    fields = sorted((set(a.columns) | set(b.columns)) - {"unit_id"})

    def tall(df: DataFrame, name: str) -> DataFrame:
        kept = df.filter(F.col("unit_id") == unit_id) if unit_id else df
        pairs = [F.struct(F.lit(f).alias("field"), F.col(f"`{f}`").cast("string").alias(name)) for f in fields if f in df.columns]
        return kept.select("unit_id", F.explode(F.array(*pairs)).alias("p")).select("unit_id", "p.*")

    joined = tall(a, "run_1").join(tall(b, "run_2"), ["unit_id", "field"], "full_outer")
    return joined.withColumn("match", F.col("run_1").eqNullSafe(F.col("run_2")))


def sample_units(df: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """n units picked by a digest of seed and id: random-looking, and the same on every run and in every engine."""
    return df.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), "unit_id")), "unit_id").limit(n)


def watch_deltas(snapshots: DataFrame, keys: Sequence[str] = ("run", "step")) -> DataFrame:
    """Rise of `valid` and `failed` since the snapshot before; the first one counts from zero.

    The snapshot before is found over the whole ordered table, so one run may have any share of the snapshots.
    """
    seen = previous_value(snapshots, F.struct("valid", "failed"), ["ts"], list(keys), out="_before")
    rise = lambda c: F.col(c) - F.coalesce(F.col(f"_before.{c}"), F.lit(0))
    return seen.withColumns({"new_valid": rise("valid"), "new_failed": rise("failed")}).drop("_before")
