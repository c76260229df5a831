"""From raw documents to token ids: language ID, near duplicates, repeated passages, source mix, BPE.

Each stage takes all that the one before kept, is written as Parquet in the shared folder and read again. Stages but the last
return the columns of `documents`; columns beyond these pass through. Rows with one doc_id count as one document: they stay
or go together. NULL ids match no other document, so they are only judged by themselves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordforge.llm import bpe, jaccard, language, mixing, repeats
from recordforge.llm.queries import id_remainder, tokenizer_file
from recordforge.llm.work import free_name, n_words, stored

LEAST_SCORE = 0.25  # language scores below this are as good as no language


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language: not those without a letter, nor those that resemble no learned language."""
    found = language.identify(docs, id_remainder(3) != 1, docs.columns)
    name, score = found.columns[-2:]
    return found.filter((F.col(name) != "und") & (F.col(score) >= LEAST_SCORE)).select(*docs.columns)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id."""
    groups = jaccard.near_duplicates(docs)
    gone = stored(groups.filter("doc_id <> component_id").select("doc_id").distinct(), "near-duplicates")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that start earlier; those of which nothing is left go."""
    cut = repeats.remove_repeats(docs)
    removed = F.col(cut.columns[-1])
    kept = cut.filter((removed == 0) | (F.col("text") != ""))
    size = F.when(removed == 0, F.col("n_chars")).otherwise(F.char_length("text").cast("long"))
    return kept.withColumn("n_chars", size).select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    size, copies, key = (free_name(docs, c) for c in ("_size", "_copies", "_key"))
    sized = docs.withColumn(size, n_words(F.col("text")))
    taken = mixing.mix(sized.select("doc_id", "source", F.col(size).alias("size")))
    # Equal ids, sources and sizes: one number of copies for all, the largest.
    row = lambda n: F.struct("doc_id", "source", F.col(n).alias("size"))
    plan = taken.groupBy(row("size").alias(key)).agg(F.max("copies").alias(copies)).filter(F.col(copies) > 0)
    rows = sized.withColumn(key, row(size)).join(plan, key)
    return rows.withColumn(copies, F.explode(F.sequence(F.lit(1), F.col(copies).cast("int")))).select(*docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, n_tokens, ids, same_text) of every row."""
    coded = bpe.encode(docs.select("doc_id", "lang", "source", "text"), tokenizer_file())
    return coded.select(
        "doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids",
        F.col("decoded").eqNullSafe(F.coalesce("text", F.lit(""))).alias("same_text"),
    )


STAGES = [
    ("language", identified),
    ("near_duplicates", without_near_duplicates),
    ("repeats", without_repeats),
    ("mix", mixed),
    ("bpe", encoded),
]

ORACLE_SQL = None  # language ID and BPE have no SQL form


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
