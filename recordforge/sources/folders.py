"""Questions to the file system that Spark itself uses, so that any store it can read may be asked."""

from __future__ import annotations

import gzip as gz
from collections.abc import Iterable
from typing import NamedTuple

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession


READ_BYTES = 8 << 20  # contents handed over at once


class Entry(NamedTuple):
    path: str
    name: str
    is_file: bool
    size: int


def _open(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    store, where = _open(spark, path)
    return store.exists(where)


def is_file(spark: SparkSession, path: str) -> bool:
    store, where = _open(spark, path)
    return store.exists(where) and store.getFileStatus(where).isFile()


def children(spark: SparkSession, path: str) -> list[Entry]:
    """What a folder holds; nothing if it does not exist."""
    store, where = _open(spark, path)
    if not store.exists(where):
        return []
    found = store.listStatus(where)
    return [Entry(f.getPath().toString(), f.getPath().getName(), f.isFile(), f.getLen()) for f in found]


def files_below(spark: SparkSession, path: str) -> list[Entry]:
    """All files below a folder, or the file itself."""
    store, where = _open(spark, path)
    if not store.exists(where):
        return []
    found, out = store.listFiles(where, True), []
    while found.hasNext():
        f = found.next()
        out.append(Entry(f.getPath().toString(), f.getPath().getName(), True, f.getLen()))
    return out


def paths_below(spark: SparkSession, path: str) -> list[str]:
    """Paths of all files below a folder. A local folder is walked at once, where other stores are asked file by file."""
    store, where = _open(spark, path)
    if store.getUri().getScheme() != "file" or is_file(spark, path):
        return [e.path for e in files_below(spark, path)]
    below = fs.FileSelector(where.toUri().getPath(), allow_not_found=True, recursive=True)
    return [f"file://{f.path}" for f in fs.LocalFileSystem().get_file_info(below) if f.is_file]


def text_of(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The lines of many files. Their paths are handed over in one piece, not one call each."""
    handed = spark._jvm.java.util.regex.Pattern.compile("\n").splitAsStream("\n".join(map(literal, paths))).toList()
    reader = spark.read
    return reader._df(reader._jreader.text(spark._jvm.PythonUtils.toSeq(handed)))


def contents(names: DataFrame, path: str, gzip: bool = False, tasks: int | None = None) -> DataFrame:
    """(filename, content) of the files below a folder that a table names; `tasks` spreads the reading.

    Tasks open the files. A reader of folders lists them first and keeps every path in the driver, leaves out empty files
    and names that begin with `_` or `.`, and tells names in the form of addresses.
    """
    ending = ".gz" if gzip else ""

    def read(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(path)
        told = lambda c: pa.RecordBatch.from_arrays([pa.array(c[0], pa.string()), pa.array(c[1], pa.binary())], names=["filename", "content"])
        for b in batches:
            held, size = ([], []), 0
            for name in b.column(0).to_pylist():
                with store.open_input_stream(f"{base}/{name}{ending}", compression=None) as f:
                    data = f.read()
                held[0].append(name)
                held[1].append(gz.decompress(data) if gzip else data)
                size += len(held[1][-1])
                if size >= READ_BYTES:
                    yield told(held)
                    held, size = ([], []), 0
            if held[0]:
                yield told(held)

    rows = names.select("filename")
    rows = rows.repartition(tasks, "filename") if tasks else rows
    return rows.mapInArrow(read, "filename string, content binary")


def remove(spark: SparkSession, path: str) -> None:
    store, where = _open(spark, path)
    store.delete(where, True)


def literal(path: str) -> str:
    """A path for readers that take patterns, where every sign of it stands for itself."""
    return "".join(f"\\{c}" if c in "\\[]{}*?" else c for c in path)
