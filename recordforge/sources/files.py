"""Files of a run as tables: JSON lines, item lists, manifests, step outputs and logs. Gzip is read as it is."""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from recordforge.functions.variants import as_type, json_type
from recordforge.operators.validate import last_per_key
from recordforge.sources import folders

# Fixed patterns: chunk folders, step files and log lines.
STEP_FILE = r"/([^/]+)/chunks/([^/]+)/(.+)_(validated|failures|results|prompts)\.jsonl(\.gz)?$"
LOG_LINE = r"^\[([^\]]+)\] \[([^\]]+)\] ?(.*)$"
CHUNK_STATE = r"^(.*)_(PENDING|SUBMITTED|COMPLETE)$"
MANIFEST_SCHEMA = """
    status string, pipeline array<string>, created string, updated string, completed_at string, failed_at string,
    killed_at string, error_message string,
    metadata struct<pipeline_name:string, display_name:string, provider:string, model:string, mode:string,
        start_time:string, end_time:string, initial_input_tokens:bigint, initial_output_tokens:bigint,
        retry_input_tokens:bigint, retry_output_tokens:bigint>,
    chunks map<string, struct<state:string, items:bigint, valid:bigint, failed:bigint, retries:bigint,
        input_tokens:bigint, output_tokens:bigint, submitted_at:string>>
"""


GZ = ".gz"


def existing(spark: SparkSession, path: str) -> str | None:
    """The file, its compressed twin if only that is there, or nothing."""
    return next((p for p in (path, path + GZ) if folders.exists(spark, p)), None)


def read_lines(spark: SparkSession, path: str | list[str], glob: str | None = None) -> DataFrame:
    """(value, file) per line; a path that does not exist is read from its `.gz` twin, and gives no rows without one.

    A path may hold a pattern, which is left to the reader.
    """
    paths = [path] if isinstance(path, str) else list(path)
    plain = [p for p in paths if not set("*?[{") & set(p)]
    found = [p for p in paths if p not in plain] + [folders.literal(q) for p in plain if (q := existing(spark, p))]
    if not found:
        return spark.createDataFrame([], "value string, file string")
    reader = spark.read.option("recursiveFileLookup", "true") if glob else spark.read
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    try:
        return reader.text(found).select("value", F.col("_metadata.file_path").alias("file"))
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], "value string, file string")


def read_jsonl(
    spark: SparkSession, path: str | list[str], schema: str | StructType | None = None, glob: str | None = None
) -> DataFrame:
    """One record per line; blank and malformed lines are skipped. Without a schema the record is `record` VARIANT."""
    lines = read_lines(spark, path, glob).withColumn("record", F.try_parse_json("value")).filter(F.col("record").isNotNull())
    if schema is None:
        return lines.select("record", "file")
    kept = lines.filter(json_type(F.col("record")) == "object")
    return kept.select(F.from_json("value", schema).alias("r"), "file").select("r.*", "file")


def read_jsonl_keyed(spark: SparkSession, path: str | list[str], key: str = "unit_id") -> DataFrame:
    """(key, record): the last record per key in order of file name and place; records with an empty key are dropped."""
    lines = spark.read.text(path).select(
        F.try_parse_json("value").alias("record"),
        F.struct(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("line"),
        ).alias("_at"),
    )
    keyed = lines.filter(F.col("record").isNotNull()).withColumn(key, F.try_variant_get("record", f"$.{key}", "string"))
    return last_per_key(keyed, key, "_at").drop("_at")


def read_items(spark: SparkSession, path: str, key: str | None = None) -> DataFrame:
    """Items of a JSON document that is a list, or a list under `key`, as (`idx`, `item` VARIANT)."""
    return document_items(spark.read.text(path, wholetext=True), "value", key).drop("value")


def document_items(docs: DataFrame, column: str, key: str | None = None) -> DataFrame:
    """`docs` with (`idx`, `item`) for each item of the JSON document in a column; a document without a list is an error."""
    doc = F.try_parse_json(column)
    source = F.try_variant_get(doc, f"$.{key}", "variant") if key else doc
    kind = json_type(source)
    where = f"'{key}'" if key else "the document"
    checked = (
        F.when(doc.isNull(), F.raise_error(F.lit("The source is not JSON")))
        .when(kind.isNull(), F.raise_error(F.lit(f"Key {where} not found in the source")))
        .when(kind != "array", F.raise_error(F.concat(F.lit(f"{where} must be a list, got "), kind)))
        .otherwise(as_type(source, "array<variant>"))
    )
    return docs.select("*", F.posexplode(checked).alias("idx", "item"))


def item_columns(items: DataFrame, schema: str) -> DataFrame:
    """Items as typed columns."""
    return items.select("idx", F.from_json(F.to_json("item"), schema).alias("i")).select("idx", "i.*")


def locate(df: DataFrame, file: str = "file") -> DataFrame:
    """Add `run`, `chunk`, `step` and `kind` from the path of a step file; rows of other files are dropped."""
    names = ("run", "chunk", "step", "kind")
    return df.withColumns({n: F.regexp_extract(file, STEP_FILE, i) for i, n in enumerate(names, 1)}).filter("step <> ''")


def step_files(spark: SparkSession, runs_path: str, kind: str, step: str | None = None) -> DataFrame:
    """(run, chunk, step, record) of all chunks of all runs below a folder, retries included."""
    lines = read_jsonl(spark, runs_path, glob=f"{step or '*'}_{kind}.jsonl*")
    return locate(lines).select("run", "chunk", "step", "record")


def read_step_output(
    spark: SparkSession, runs_path: str, kind: str, step: str | None = None, pipeline: list[str] | None = None
) -> DataFrame:
    """(run, chunk, step, record) of one step, by default the last of the pipeline; of all files for a run in which that
    step wrote nothing. Of a file and its compressed twin the plain one counts.

    Folders are listed before any file is opened, so only wanted files are read.
    """
    found: dict[tuple[str, str, str], str] = {}
    for path in folders.paths_below(spark, runs_path):
        at = re.search(STEP_FILE, path)
        if at and at[4] == kind and (step is None or at[3] == step):
            place = at.group(1, 2, 3)
            if place not in found or not at[5]:
                found[place] = path
    if pipeline and not step:
        reached = {run for run, _, s in found if s == pipeline[-1]}
        found = {k: p for k, p in found.items() if k[0] not in reached or k[2] == pipeline[-1]}
    return locate(_records(spark, list(found.values()))).select("run", "chunk", "step", "record")


def _records(spark: SparkSession, paths: list[str]) -> DataFrame:
    if not paths:
        return spark.createDataFrame([], "value string, file string").select(F.try_parse_json("value").alias("record"), "file")
    lines = folders.text_of(spark, paths).select("value", F.col("_metadata.file_path").alias("file"))
    return lines.select(F.try_parse_json("value").alias("record"), "file").filter(F.col("record").isNotNull())


def parse_state(state: Column) -> tuple[Column, Column]:
    """(step, status) of a chunk state. Step names may hold `_`, so the split is at the last one."""
    step, status = F.regexp_extract(state, CHUNK_STATE, 1), F.regexp_extract(state, CHUNK_STATE, 2)
    return F.when(step != "", step), F.when(status != "", status).otherwise(state)


def read_runs(spark: SparkSession, runs_path: str, include_archived: bool = False) -> DataFrame:
    """One row per run, newest first. Hidden folders and unreadable manifests are skipped, the archive on request only."""

    def documents(path: str, archived: bool) -> DataFrame:
        docs = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="MANIFEST.json")
        run = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/MANIFEST\.json$", 1)
        return docs.select("value", run.alias("run"), F.lit(archived).alias("archived"))

    # A listing leaves out folders that start with an underscore, so the archive is read by its own path.
    found = documents(runs_path, False)
    if include_archived:
        try:
            found = found.unionByName(documents(f"{runs_path.rstrip('/')}/_archive", True))
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
    return parse_manifests(found, include_archived)


def parse_manifests(docs: DataFrame, include_archived: bool = False) -> DataFrame:
    """Manifest texts (run, archived, value) as rows, newest first."""
    read = docs.filter(F.try_parse_json("value").isNotNull()).filter(~F.col("run").startswith("."))
    read = read.select("run", "archived", F.from_json("value", MANIFEST_SCHEMA).alias("m")).select("run", "archived", "m.*")
    if not include_archived:
        read = read.filter(~F.col("archived"))
    started = F.coalesce(F.try_to_timestamp("metadata.start_time"), F.try_to_timestamp("created"))
    named = read.withColumns(
        {
            "started": started,
            "mode": F.coalesce("metadata.mode", F.lit("batch")),
            "pipeline_name": F.coalesce("metadata.pipeline_name", F.regexp_replace("run", r"_[0-9]{8}_[0-9]{6}$", "")),
        }
    )
    return named.orderBy(F.desc_nulls_last("started"), "run")


def run_chunks(runs: DataFrame) -> DataFrame:
    """One row per chunk of a run."""
    opened = runs.select("run", F.explode(F.map_entries("chunks")).alias("e"))
    step, status = parse_state(F.col("e.value.state"))
    return opened.select("run", F.col("e.key").alias("chunk"), step.alias("step"), status.alias("chunk_status"), "e.value.*")


def parse_log(lines: DataFrame, column: str = "value") -> DataFrame:
    """Log lines as (ts, level, message); lines of another form are dropped."""
    c = F.col(column)
    others = [x for x in lines.columns if x != column]
    parsed = lines.select(
        *others,
        F.try_to_timestamp(F.regexp_extract(c, LOG_LINE, 1)).alias("ts"),
        F.regexp_extract(c, LOG_LINE, 2).alias("level"),
        F.regexp_extract(c, LOG_LINE, 3).alias("message"),
    )
    return parsed.filter("ts is not null")


def read_run_log(spark: SparkSession, path: str) -> DataFrame:
    return parse_log(read_lines(spark, path)).drop("file")


def record_fields(df: DataFrame, fields: dict[str, str]) -> DataFrame:
    """Typed columns from the `record` VARIANT."""
    return df.withColumns({n: F.try_variant_get("record", f"$.{n}", t) for n, t in fields.items()})


