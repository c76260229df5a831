"""The polling duties of a run as streams: collect, validate, deduplicate, watch, time out, budget."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from recordforge.operators.order import running_sum
from recordforge.operators.rules import check_rules
from recordforge.operators.schema_check import check_schema, field_types, typed_fields
from recordforge.operators.validate import last_per_key
from recordforge.sources import folders
from recordforge.sources.vendors import parse_batch_results

BATCH = "batch"


def stream_lines(spark: SparkSession, path: str, per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    return reader.text(path)


def stream_table(spark: SparkSession, path: str, schema: StructType | str, per_trigger: int | None = None) -> DataFrame:
    """A parquet table, one file or a folder of part files, as a stream."""
    reader = spark.readStream.schema(schema)
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    if not folders.is_file(spark, path):
        return reader.parquet(folders.literal(path))
    # A single file is the only one of its name in its folder.
    folder, _, name = path.rpartition("/")
    return reader.option("pathGlobFilter", folders.literal(name)).parquet(folders.literal(folder or "."))


def stream_results(spark: SparkSession, path: str, vendor: str, per_trigger: int | None = None) -> DataFrame:
    """Arriving vendor result files as parsed rows."""
    return parse_batch_results(stream_lines(spark, path, per_trigger), vendor)


def finish(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process what is there and stop. Only for `append`; see `upserts` for changing rows."""
    query = (
        df.writeStream.outputMode(mode).format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
    )
    query.awaitTermination()


def each_batch(
    df: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append"
) -> StreamingQuery:
    """Run `work` on every micro-batch of what is there; the finished query tells how each went."""
    query = (
        df.writeStream.outputMode(mode).foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return query


def _put(df: DataFrame, path: str, batch: int) -> None:
    """Write one micro-batch into a folder of its own; doing it again replaces it."""
    df.write.mode("overwrite").parquet(f"{path}/{BATCH}={batch}")


Merge = Callable[[DataFrame], DataFrame]


def newest(keys: Sequence[str]) -> Merge:
    """Of several stored rows per key the one of the last micro-batch."""
    return lambda rows: last_per_key(rows, list(keys), BATCH)


def upserts(df: DataFrame, path: str, checkpoint: str, merge: Merge | None = None, every: int = 16) -> StreamingQuery:
    """Store the changed rows of an aggregation per micro-batch; `latest` reads the current state.

    With `merge`, every so many micro-batches all stored rows become one compacted table, so a reader opens that table and
    at most `every` small ones, however long the stream has run.
    """

    def work(rows: DataFrame, n: int) -> None:
        _put(rows, path, n)
        if merge and n % every == every - 1:
            _compact(rows.sparkSession, path, n, merge)

    return each_batch(df, work, checkpoint, mode="update")


COMPACTED = "compacted="


def _stored(spark: SparkSession, path: str) -> tuple[list[str], dict[int, str], dict[int, str]]:
    """The folders to read, all batches by number, and the finished compacted tables by their last batch."""
    found = folders.children(spark, path)
    numbered = lambda mark: {int(e.name[len(mark) :]): e.path for e in found if e.name.startswith(mark)}
    batches, tables = numbered(f"{BATCH}="), numbered(COMPACTED)
    tables = {n: p for n, p in tables.items() if folders.exists(spark, f"{p}/_SUCCESS")}
    last = max(tables, default=-1)
    open_batches = [p for n, p in sorted(batches.items()) if n > last]
    return ([tables[last]] if tables else []) + open_batches, batches, tables


def _read(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Stored rows with their batch; a compacted table holds the column itself."""
    parts = []
    for p in paths:
        rows, name = spark.read.parquet(folders.literal(p)), p.rstrip("/").rpartition("/")[2]
        parts.append(rows if name.startswith(COMPACTED) else rows.withColumn(BATCH, F.lit(int(name.partition("=")[2]))))
    return reduce(DataFrame.unionByName, parts)


def _compact(spark: SparkSession, path: str, n: int, merge: Merge) -> None:
    paths, batches, tables = _stored(spark, path)
    if n not in tables:
        merge(_read(spark, paths)).write.mode("overwrite").parquet(f"{path}/{COMPACTED}{n}")
    for k, p in [*batches.items(), *tables.items()]:
        if k < n or p == batches.get(k):
            folders.remove(spark, p)


def latest(spark: SparkSession, path: str, merge: Merge | Sequence[str]) -> DataFrame:
    """The stored rows, merged; with keys instead of a merge the newest stored row per key."""
    merge = merge if callable(merge) else newest(merge)
    return merge(_read(spark, _stored(spark, path)[0])).drop(BATCH, "_span")


def stream_validate(
    results: DataFrame,
    schema: Mapping,
    spec: Mapping | None,
    valid_path: str,
    failed_path: str,
    checkpoint: str,
    column: str = "content",
) -> None:
    """Judge responses as they arrive and write valid rows and failures to two tables, exactly once per micro-batch."""
    types = field_types(schema)

    def work(rows: DataFrame, n: int) -> None:
        judged = check_schema(rows, schema, column, repair=True).withColumnRenamed("errors", "schema_errors")
        flat = typed_fields(judged.drop("is_valid"), {k: t for k, t in types.items() if k not in judged.columns})
        ruled = check_rules(flat, spec or {})
        done = ruled.withColumn("errors", F.when(F.size("schema_errors") > 0, F.col("schema_errors")).otherwise(F.col("errors")))
        done = done.withColumn(
            "failure_stage",
            F.when(F.size("schema_errors") > 0, F.lit("schema_validation")).when(F.size("errors") > 0, F.lit("validation")),
        )
        kept = ["unit_id", "data", "errors", "failure_stage", column]
        fixed = done.select(*kept).withColumn("data", F.to_json("data")).persist()
        try:
            _put(fixed.filter("failure_stage is null").select("unit_id", "data"), valid_path, n)
            _put(fixed.filter("failure_stage is not null"), failed_path, n)
        finally:
            fixed.unpersist()

    each_batch(results, work, checkpoint)


def stream_dedup(df: DataFrame, keys: Sequence[str], ts: str, delay: str = "1 hour") -> DataFrame:
    """The first row per key within the watermark delay."""
    return df.withWatermark(ts, delay).dropDuplicatesWithinWatermark(list(keys))


def throughput(df: DataFrame, ts: str, width: str = "1 hour", delay: str = "10 minutes", by: Sequence[str] = ()) -> DataFrame:
    """Rows per tumbling window."""
    grouped = df.withWatermark(ts, delay).groupBy(F.window(ts, width), *by).agg(F.count(F.lit(1)).alias("n"))
    return grouped.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *by, "n")


def failure_rate(
    df: DataFrame, ts: str, failed: Column, width: str = "10 minutes", slide: str = "1 minute", delay: str = "10 minutes"
) -> DataFrame:
    """Share of failed rows per sliding window."""
    grouped = df.withWatermark(ts, delay).groupBy(F.window(ts, width, slide)).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(failed).alias("failed")
    )
    return grouped.select(
        F.col("window.start").alias("start"), F.col("window.end").alias("end"), "n", "failed",
        (F.col("failed") / F.col("n")).alias("rate"),
    )


def activity(df: DataFrame, ts: str, by: Sequence[str], gap: str | Column, delay: str = "10 minutes") -> DataFrame:
    """Sessions of activity; a new one starts after a silence of `gap`."""
    grouped = df.withWatermark(ts, delay).groupBy(F.session_window(ts, gap), *by).agg(F.count(F.lit(1)).alias("n"))
    return grouped.select(*by, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def hang_gap(chunks: Column, base: int = 300, per_chunk: int = 30, cap: int = 1800) -> Column:
    """Silence in seconds after which a run counts as hung; it grows with the number of chunks up to a bound."""
    return F.least(F.lit(base) + chunks * per_chunk, F.lit(cap))


def overdue(submitted: DataFrame, finished: DataFrame, key: str, minutes: int, delay: str = "10 minutes") -> DataFrame:
    """Submissions without an end within the given minutes, reported once the watermark has passed that time.

    Both streams have (key, ts). The time bound lets Spark drop the state of both sides.
    """
    a = submitted.select(F.col(key).alias(key), F.col("ts").alias("submitted_at")).withWatermark("submitted_at", delay)
    b = finished.select(F.col(key).alias("_key"), F.col("ts").alias("finished_at")).withWatermark("finished_at", delay)
    match = (F.col(key) == F.col("_key")) & F.expr(
        f"finished_at >= submitted_at and finished_at <= submitted_at + interval {int(minutes)} minutes"
    )
    return a.join(b, match, "leftOuter").filter("finished_at is null").select(key, "submitted_at")


def facts(df: DataFrame, keys: Sequence[str], found: Sequence[Column], keep: str = "1 hour") -> DataFrame:
    """Facts per key over rows that arrive within the same span of time, to be merged when they are read.

    The spans follow arrival time, so no row can come too late, however old it is, and a span leaves the state as soon as
    the next one has begun: the state holds the keys of one span, not all keys that ever were. What is found must be of
    the kind that can be found again from its results (largest, newest, any). Equal keys are combined before they are
    shuffled, so a hot key is no hot spot. Write with `upserts`, read with `latest` and a merge of the same kind.
    """
    arrived = df.withColumn("_arrived", F.current_timestamp()).withWatermark("_arrived", "0 seconds")
    grouped = arrived.groupBy(F.window("_arrived", keep).alias("_span"), *keys).agg(*found)
    return grouped.withColumn("_span", F.col("_span.start"))


def retry_budget(attempts: DataFrame, max_retries: int = 3, keep: str = "1 hour") -> DataFrame:
    """Decision per (step, unit): resolved, retry or permanent, from the attempts that arrived in one span of time.

    A success in any attempt clears the unit, no matter when it arrives: `merge_budget` takes all spans together.
    """
    found = [F.max(F.coalesce("retry_count", F.lit(0))).alias("retry_count"), F.bool_or(F.coalesce("ok", F.lit(False))).alias("resolved")]
    seen = facts(attempts, ["step", "unit_id"], found, keep)
    return seen.withColumn("decision", _decision(F.col("resolved"), max_retries))


def _decision(resolved: Column, max_retries: int) -> Column:
    open_unit = F.when(F.col("retry_count") < max_retries, F.lit("retry")).otherwise(F.lit("permanent"))
    return F.when(resolved, F.lit("resolved")).otherwise(open_unit).alias("decision")


def merge_budget(max_retries: int = 3) -> Merge:
    def merge(rows: DataFrame) -> DataFrame:
        all_seen = rows.groupBy("step", "unit_id").agg(
            F.max("retry_count").alias("retry_count"), F.bool_or("resolved").alias("resolved"),
            F.max("_span").alias("_span"), F.max(BATCH).alias(BATCH),
        )
        return all_seen.withColumn("decision", _decision(F.col("resolved"), max_retries))

    return merge


def last_level(log: DataFrame, by: Sequence[str] = ("run",), keep: str = "1 hour") -> DataFrame:
    """Level and time of the newest event per run, among those that arrived in one span of time; `merge_level` takes all
    spans together. A run that has ended is in no later span, and so leaves the state."""
    return facts(log, by, [F.max("ts").alias("last_ts"), F.max_by("level", "ts").alias("last_level")], keep)


def merge_level(by: Sequence[str] = ("run",)) -> Merge:
    def merge(rows: DataFrame) -> DataFrame:
        return rows.groupBy(*by).agg(
            F.max("last_ts").alias("last_ts"), F.max_by("last_level", "last_ts").alias("last_level"),
            F.max("_span").alias("_span"), F.max(BATCH).alias(BATCH),
        )

    return merge


def cost_cap(
    results: DataFrame, cap: float, cost: str, order_by: list[str], run: list[str], path: str, totals_path: str, checkpoint: str
) -> None:
    """Keep results of each run until its cost reaches the cap; the one that crosses is kept.

    The totals are a table with one row per run, written anew with every micro-batch from the one before, which is all that
    is read of it. Two of these tables are kept, so a micro-batch can be repeated. Inside a batch the running sum is spread
    over all tasks, so one dominant run is no hot spot.
    """

    def work(rows: DataFrame, n: int) -> None:
        spark = rows.sparkSession
        totals = {int(e.name.partition("=")[2]): e.path for e in folders.children(spark, totals_path) if "=" in e.name}
        before = max((k for k in totals if k < n), default=None)
        local = running_sum(rows, F.col(cost), order_by, run, out="_in_batch")
        spent = rows.groupBy(*run).agg(F.sum(cost).alias("spent"))
        if before is None:
            carried = local.withColumn("_before", F.lit(0.0))
        else:
            known = spark.read.parquet(folders.literal(totals[before])).select(*run, F.col("spent").alias("_before"))
            carried = local.join(known, run, "left").withColumn("_before", F.coalesce("_before", F.lit(0.0)))
            spent = spent.unionByName(known.withColumnRenamed("_before", "spent")).groupBy(*run).agg(F.sum("spent").alias("spent"))
        kept = carried.withColumn("running_cost", F.col("_before") + F.col("_in_batch")).filter(F.col("running_cost") - F.col(cost) < cap)
        _put(kept.drop("_before", "_in_batch"), path, n)
        _put(spent, totals_path, n)
        for k, p in totals.items():
            if before is not None and k < before:
                folders.remove(spark, p)

    each_batch(results, work, checkpoint)
