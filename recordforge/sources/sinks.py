"""Writing units, step tables, extracted files and report files."""

from __future__ import annotations

import gzip as gz
import uuid
from collections.abc import Iterable

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from recordforge.operators.units import assign_chunks
from recordforge.session import settle


def write_units(units: DataFrame, path: str, chunk_size: int = 100, order_by: list[str] | None = None, compression: str | None = None) -> None:
    """JSON lines, at most `chunk_size` rows per `chunk_id` folder, in order.

    Rows are spread by chunk, so every chunk is one file written by one task and a task holds many chunks.
    """
    chunked = assign_chunks(units, chunk_size, order_by)
    hidden = [c for c in ("_unit_pos", "chunk_name") if c in chunked.columns]
    placed = chunked.repartition("chunk_id").sortWithinPartitions("chunk_id", "_unit_pos").drop(*hidden)
    writer = placed.write.mode("overwrite").partitionBy("chunk_id")
    (writer.option("compression", compression) if compression else writer).json(path)


def write_step(df: DataFrame, path: str, by: list[str] = ("step",), compression: str | None = None) -> None:
    """Replace just the partitions (for example the steps) that `df` holds, so a repeated job leaves no doubles."""
    writer = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by)
    (writer.option("compression", compression) if compression else writer).parquet(path)


def append_records(df: DataFrame, path: str, compression: str | None = None) -> None:
    """Add JSON lines to a folder."""
    writer = df.write.mode("append")
    (writer.option("compression", compression) if compression else writer).json(path)


def extracted(units: DataFrame, filename: str | Column, content: str | Column) -> DataFrame:
    """(unit_id, filename, content, error): slashes of a name become `_`, an empty name or content is an error."""
    name = F.expr(filename) if isinstance(filename, str) else filename
    body = F.expr(content) if isinstance(content, str) else content
    safe = F.translate(name.cast("string"), "/\\", "__")
    named = units.select("unit_id", safe.alias("filename"), body.cast("string").alias("content"))
    problem = F.when(F.coalesce("filename", F.lit("")) == "", F.lit("empty_filename")).when(
        F.col("content").isNull(), F.lit("no_content")
    )
    return named.withColumn("error", problem)


def extract_units(units: DataFrame, filename: str | Column, content: str | Column, path: str, gzip: bool = False, tasks: int | None = None) -> DataFrame:
    """Write one file per unit into a folder that all executors share; returns counts of extracted and errors.

    Names that several units have are errors, so no file replaces another. A file is written beside its place under a name
    of its own and then put there, so a task that runs again or twice leaves neither doubles nor halves. Any store that
    pyarrow knows by its address can hold the folder. `tasks` spreads the writing.
    """
    made, without = extract_told(units, filename, content, path, gzip, tasks)
    bad = without.agg(F.count(F.lit(1)).alias("errors"))
    return bad.select(F.lit(made.count()).cast("long").alias("extracted"), "errors")


def extract_told(
    units: DataFrame, filename: str | Column, content: str | Column, path: str, gzip: bool = False, tasks: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """`extract_units` told one by one: (filename) of the files, and (unit_id, filename, content, error) of units without one.

    Contents of units without a file stay where they are, so a name that many lack is no hot key.
    """
    work = settle(extracted(units, filename, content).withColumn("unit_id", F.col("unit_id").cast("string")))
    fine = work.filter(F.col("error").isNull())
    shared = fine.groupBy("filename").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    judged = fine.join(shared, "filename", "left").withColumn("error", F.when(F.col("_n").isNotNull(), F.lit("duplicate_filename")))
    judged = judged.repartition(tasks, "filename") if tasks else judged
    told = settle(_written(judged.drop("_n").unionByName(work.filter(F.col("error").isNotNull())), path, gzip))
    return told.filter(F.col("error").isNull()).select("filename"), told.filter(F.col("error").isNotNull())


def write_files(rows: DataFrame, path: str, gzip: bool = False, tasks: int | None = None) -> int:
    """Write `content` of every row into the file `filename` below a folder; returns their number. Names are different.

    Files cost time by their number and not by their size, which is all that Spark looks at when it merges small parts of a
    shuffle; `tasks` spreads the files over that many tasks.
    """
    rows = rows.select("filename", "content")
    rows = rows.repartition(tasks, "filename") if tasks else rows
    return _written(rows.withColumn("error", F.lit(None).cast("string")), path, gzip).count()


def _written(rows: DataFrame, path: str, gzip: bool) -> DataFrame:
    """Rows with an error as they are, all others without content: theirs is written into a file when they are read."""
    ending = ".gz" if gzip else ""

    def save(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(path)
        known = ""
        for b in batches:
            names, texts, errors = (b.column(c).to_pylist() for c in ("filename", "content", "error"))
            for name, text in ((n, t) for n, t, e in zip(names, texts, errors) if e is None):
                folder, _, last = f"{base}/{name}".rpartition("/")
                if folder != known:
                    store.create_dir(folder, recursive=True)
                    known = folder
                data = text.encode()
                beside = f"{folder}/.{uuid.uuid4().hex}"
                with store.open_output_stream(beside, compression=None) as f:
                    f.write(gz.compress(data, mtime=0) if gzip else data)
                store.move(beside, f"{folder}/{last}{ending}")
            left = pa.array([t if e is not None else None for t, e in zip(texts, errors)], b.column("content").type)
            yield pa.RecordBatch.from_arrays([left if c == "content" else b.column(c) for c in b.schema.names], names=b.schema.names)

    return rows.mapInArrow(save, StructType([StructField(f.name, f.dataType) for f in rows.schema]))


def extract_counts(work: DataFrame) -> DataFrame:
    return work.agg(F.count_if(F.col("error").isNull()).alias("extracted"), F.count_if(F.col("error").isNotNull()).alias("errors"))


def write_report_csv(
    report: DataFrame, path: str, decimals: dict[str, int] | None = None, default: int = 2, files: int | None = None
) -> None:
    """A report (one row per group) as CSV: numbers rounded, missing values empty; `files` sets the number of files."""
    decimals = decimals or {}
    cols = [
        F.round(f.name, decimals.get(f.name, default)).alias(f.name) if f.dataType.typeName() in ("double", "float") else F.col(f"`{f.name}`")
        for f in report.schema.fields
    ]
    rows = report.select(*cols)
    rows = rows.repartition(files) if files else rows
    rows.write.mode("overwrite").option("header", "true").option("nullValue", "").csv(path)
