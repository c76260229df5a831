"""Sharding by longest-processing-time scheduling.

Rows that must stay together form a group; groups, largest first, go to the least loaded shard through a heap. A heap is
one sequential loop, so it must not see one entry per group of a large corpus. Groups larger than a fixed fraction of the
whole are few (at most `items` of them, whatever the input) and are entries of their own; the remaining small groups are
first dealt by hash into at most `items` parcels, and each parcel is an entry. So the loop handles at most 2 * `items`
entries at any scale, every group stays whole, and the last parcels even out the shards.

Equal texts form a group; NULL texts form one group, empty texts another. An empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordforge.llm.work import stored

ITEMS = 20_000  # bound on large groups, and on parcels of small ones
SLOT_PARTS = 512  # parts of a shard that are numbered independently


def schedule(entries: Iterable[tuple[object, int]], shards: int) -> dict[object, int]:
    """Shard of each (key, size): largest first, to the least loaded shard; ties by key and by shard number."""
    heap = [(0, s) for s in range(shards)]
    out = {}
    for key, size in sorted(entries, key=lambda e: (-e[1], e[0])):
        load, shard = heapq.heappop(heap)
        out[key] = shard
        heapq.heappush(heap, (load + size, shard))
    return out


def assign(rows: DataFrame, shards: int, items: int = ITEMS) -> DataFrame:
    """Add `shard` to a table with `group` (long, not NULL) and `size` (long)."""
    spark = rows.sparkSession
    groups = stored(rows.groupBy("group").agg(F.sum("size").alias("size")), "shard-groups")
    total = groups.agg(F.sum("size")).first()[0] or 0
    # Sizes above total / items: fewer than `items` groups can be that large.
    large = F.col("size") * F.lit(items) > F.lit(total)
    parcel = F.when(large, F.col("group")).otherwise(F.pmod(F.xxhash64("group"), F.lit(items)))
    entries = groups.groupBy(large.alias("large"), parcel.alias("parcel")).agg(F.sum("size").alias("size")).collect()
    placed = schedule((((e["large"], e["parcel"]), e["size"]) for e in entries), shards)
    plan = spark.createDataFrame(
        [(k[0], k[1], s) for k, s in placed.items()], "large boolean, parcel long, shard int"
    )
    small = plan.filter("not large").select(F.col("parcel").alias("_parcel"), F.col("shard").alias("_small"))
    big = plan.filter("large").select(F.col("parcel").alias("_group"), F.col("shard").alias("_big"))
    # Both sides hold at most `items` rows.
    with_shard = (
        rows.withColumn("_p", F.pmod(F.xxhash64("group"), F.lit(items)))
        .join(F.broadcast(big), F.col("group") == F.col("_group"), "left")
        .join(F.broadcast(small), F.col("_p") == F.col("_parcel"), "left")
    )
    return with_shard.withColumn("shard", F.coalesce("_big", "_small")).drop("_p", "_group", "_parcel", "_big", "_small")


def number(rows: DataFrame, key: str, parts: int = SLOT_PARTS) -> DataFrame:
    """Add `slot`: 0, 1, … without gaps inside each shard, in parts, so that a shard with most rows is no single task."""
    from pyspark.sql import Window

    parted = stored(rows.withColumn("_part", F.pmod(F.xxhash64(key), F.lit(parts))), "shard-parts")
    sizes = parted.groupBy("shard", "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(
        F.col("shard").alias("_s"), F.col("_part").alias("_q"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start")
    )
    at = F.row_number().over(Window.partitionBy("shard", "_part").orderBy(key))
    local = parted.withColumn("_at", at)
    # One row per shard and part.
    placed = local.join(F.broadcast(starts), (F.col("shard") == F.col("_s")) & (F.col("_part") == F.col("_q")))
    slot = (F.col("_start") + F.col("_at") - 1).cast("long")
    return placed.withColumn("slot", slot).drop("_part", "_at", "_start", "_s", "_q")


def shard_documents(docs: DataFrame, shards: int = 40, overhead: int = 16) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard): texts to shards of near equal bytes."""
    raw = F.encode("text", "UTF-8")
    rows = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + overhead).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"),
        # Equal for equal texts; two different texts that share it merely stay together.
        F.xxhash64(F.md5(raw)).alias("group"),
    )
    rows = stored(rows, "shard-sizes")
    numbered = number(assign(rows, shards), "doc_id")
    return numbered.select(
        "doc_id",
        "size",
        F.col("text_crc32").cast("long").alias("text_crc32"),
        F.lit("bytes").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
