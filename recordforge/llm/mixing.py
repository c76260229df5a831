"""Mixing sources to target weights by capped water-filling.

Every source has a weight and may be repeated at most `max_epochs` times. A source whose share of the whole would exceed
that is clamped, and what it cannot take is dealt again over the others by weight until nobody is above. The result is a
water level: target = min(cap, level * weight). The level is found without iteration: with sources sorted by cap / weight,
the level implied by "the first k are clamped" rises as long as clamping is right and falls afterwards, so it is the
largest of these values. Positions and running sums come from range-sorted layouts, so neither the list of sources nor the
documents of a hot source ever sit in one task.

Sampling is systematic: documents of a source are numbered by (size, seeded hash); each gets the whole repetitions, and the
fractional one goes to every position where `floor(position * fraction + offset)` steps up. Neighbours have similar sizes,
so the words taken stay within one document of the target. Of 16 seeded offsets the one nearest to the target is used.

NULL sources form one source, sorted last. NULL texts have size 0. Sources of size 0 have target 0. Repeated rows each take
part; order among fully equal rows is immaterial. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordforge.llm.work import stored
from recordforge.operators.order import lay_out, row_positions, running_sum

OFFSETS = 16


def source_targets(sizes: DataFrame, weights: Sequence[int] = (5, 2, 1), max_epochs: int = 3) -> DataFrame:
    """(source, source_size, target) for a table (source, size); weights repeat over sources in code point order."""
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = [F.col("source").isNull(), F.col("source")]
    placed = row_positions(per_source, order, out="place")
    wheel = F.array(*[F.lit(int(w)) for w in weights])
    weighed = placed.select(
        "source",
        "source_size",
        F.element_at(wheel, (F.col("place") % len(weights) + 1).cast("int")).alias("weight"),
        (F.col("source_size") * max_epochs).alias("cap"),
    )
    laid = lay_out(weighed, [F.col("cap") / F.col("weight")])
    run = running_sum(laid, F.col("cap"), [], out="caps", keep_layout=True)
    run = running_sum(run, F.col("weight").cast("long"), [], out="weights", keep_layout=True)
    whole = laid.agg(F.sum("source_size").alias("all_size"), F.sum("weight").alias("all_weight"))
    rest = run.crossJoin(F.broadcast(whole)).select(  # one row
        (
            (F.col("all_size") - (F.col("caps") - F.col("cap"))).cast("double")
            / (F.col("all_weight") - (F.col("weights") - F.col("weight"))).cast("double")
        ).alias("level")
    )
    level = rest.agg(F.max("level").alias("level"))
    return laid.crossJoin(F.broadcast(level)).select(  # one row
        "source", "source_size", F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight")).alias("target")
    )


def _start(seed: int) -> Column:
    """A number in [0, 1) from the source and the seed."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("source"), F.lit("")))
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def _extra(offset: Column) -> Column:
    step = lambda at: F.floor(F.col("fraction") * at + offset)
    return (step(F.col("place") + 1) - step(F.col("place"))).cast("long")


def mix(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), max_epochs: int = 3, seed: int = 0) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies) for a table (doc_id, source, size)."""
    docs = stored(docs.select("doc_id", "source", F.col("size").cast("long").alias("size")), "mix-sizes")
    targets = stored(source_targets(docs, weights, max_epochs), "mix-targets")
    tie = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    at = row_positions(docs, [F.col("source").isNull(), F.col("source"), F.col("size"), tie], out="at")
    starts = at.groupBy("source").agg(F.min("at").alias("start"))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    plan = targets.join(starts.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s").select(
        "source",
        "source_size",
        "target",
        "start",
        F.floor(ratio).alias("whole"),
        (ratio - F.floor(ratio)).alias("fraction"),
        _start(seed).alias("u"),
    )
    named = plan.withColumnRenamed("source", "s")
    rows = at.join(named, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    rows = stored(rows.withColumn("place", F.col("at") - F.col("start")).drop("at", "start"), "mix-places")
    offset = lambda k: (F.col("u") + F.lit(k / OFFSETS)) % 1
    tried = rows.groupBy("source").agg(
        *[
            F.abs(F.sum(_extra(offset(k)) * F.col("size")) - F.max(F.col("fraction") * F.col("source_size"))).alias(f"e{k}")
            for k in range(OFFSETS)
        ]
    )
    errors = F.array(*[F.col(f"e{k}") for k in range(OFFSETS)])
    best = tried.select(F.col("source").alias("s"), (F.array_position(errors, F.array_min(errors)) - 1).alias("k"))
    chosen = rows.join(best, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    copies = F.col("whole") + _extra((F.col("u") + F.col("k") / F.lit(float(OFFSETS))) % 1)
    return chosen.select("doc_id", "source", "size", "source_size", "target", copies.cast("long").alias("copies"))
