"""Session settings shared by every job."""

from __future__ import annotations

import contextlib
import os
import re
import tempfile
import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def build_session(app: str = "recordforge", master: str | None = None, **conf: object) -> SparkSession:
    """A session with adaptive execution on and timestamps in UTC."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        # Call sites of column expressions are only wanted while debugging; recording them slows query building.
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # Skewed joins are split even where the split costs one more shuffle.
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        # Checkpoint files go when nothing refers to them any more.
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        **{k: str(v) for k, v in conf.items()},
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints, which `spark.checkpoint.dir` names.

    Only a session inside one process may go without; it gets a temporary folder. On a cluster that would be another
    folder on every host, so it is an error.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(folder)
    return folder


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder for a table written by a job."""
    return os.path.join(checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex}")


def settle(df):
    """Cut lineage in the shared folder, so that later branches read one computed copy."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


@contextlib.contextmanager
def null_on_error(spark: SparkSession):
    """Analyze expressions so that division by zero or a bad cast gives NULL.

    The choice is fixed when an expression is analyzed, so the setting is put back at once.
    """
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", "false")
    try:
        yield
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)


def evaluated_once(df, columns: list[str]):
    """Keep later filters on these columns above the projections that compute them.

    Pushed down, a filter would repeat the whole computation inside its condition, and again for every helper column it
    is built from. Made by a generator with one row, the columns stay above it, while filters on the others pass.
    """
    made = F.inline(F.array(F.struct(*[F.col(f"`{c}`") for c in columns])))
    rest = [c for c in df.columns if c not in columns]
    return df.select(*[F.col(f"`{c}`") for c in rest], made).select(*[F.col(f"`{c}`") for c in df.columns])
