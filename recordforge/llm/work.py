"""Intermediate tables in the shared folder, and column names that cannot clash."""

from __future__ import annotations

import ctypes
import inspect

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordforge.session import work_dir

SPACES = " \t\n\x0b\x0c\r"  # the bytes \x20 and \x09-\x0D that separate words
SMALL_GROUP = 1 << 18  # bytes of a group below which memory is kept


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: computed once, lineage cut, safe from lost executors."""
    path = work_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def documents(spark, sf_dir: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return df.select(*columns) if columns else df


def free_name(df: DataFrame, base: str) -> str:
    """A column name that the table does not have yet."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def n_words(text: Column) -> Column:
    """Number of runs without \\x20 and \\x09-\\x0D; 0 for NULL."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def give_back_memory() -> None:
    """Return memory that this process no longer uses to the system; workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def tidy(run):
    """A map over Arrow batches that gives memory back at the end of its task."""

    def wrapped(batches):
        yield from run(batches)
        give_back_memory()

    return wrapped


def tidy_group(run):
    """A function of Arrow groups that gives memory back after each group that is not small."""

    def wrapped(*args):
        out = run(*args)
        if sum(a.nbytes for a in args if isinstance(a, pa.Table)) >= SMALL_GROUP:
            give_back_memory()
        return out

    # Spark counts a function's parameters.
    by_count = {1: lambda a: wrapped(a), 2: lambda a, b: wrapped(a, b), 3: lambda a, b, c: wrapped(a, b, c)}
    return by_count[len(inspect.signature(run).parameters)]
