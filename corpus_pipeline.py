"""A pipeline from documents to packed sequences: five stages, each over all rows that the one before kept.

Language ID drops texts in no language; exact dedup keeps one of equal texts; the n-gram join keeps one of each group
of like texts; decontamination drops texts that hold benchmark passages; packing returns the pieces of sequences.
All stages but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from equireach.llm import decontaminate, exact_dedup, language, ngram_join, packing
from equireach.llm.common import Scratch, without


#: The name of a row's key within a stage.
ROW = "_pipeline_row"


def _keyed(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """docs with ROW, a key for each row in the order of the ids, nulls last; written, as a key must not change."""
    at = docs.withColumn("_pipeline_at", F.monotonically_increasing_id())
    return scratch.table(at.orderBy(F.asc_nulls_last("doc_id"), "_pipeline_at").drop("_pipeline_at").withColumn(ROW, F.monotonically_increasing_id()), "rows")


def _drop(docs: DataFrame, decide: Callable[[DataFrame], DataFrame], where: str, id_col: str, name: str) -> DataFrame:
    """The rows of docs but those whose id `where` holds for in what decide() gives; every column. Decisions are written
    first, as they are read twice. Where an id is null or stands in several rows, all rows are decided by keys of their own."""
    scratch, key = Scratch(docs.sparkSession, name), "doc_id"
    ids = docs.groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    if ids.where("id IS NULL OR n > 1").take(1):
        docs, key = _keyed(docs, scratch), ROW
    rows = docs if key == "doc_id" else docs.withColumn("doc_id", F.col(ROW)).drop(ROW)
    gone = scratch.table(decide(rows).where(where).select(F.col(id_col).alias("gone_id")), "gone")
    return without(docs, key, gone, "gone_id").drop(ROW)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that language identification rejects."""
    return _drop(docs, language.of_documents, "NOT accepted", "id", "language-id")


def exact_dups(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the longest of equal texts, then the smallest id, then one of its rows."""
    return _drop(docs, exact_dedup.groups, "NOT kept", "doc_id", "exact-dups")


def near_dups(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest id of each component of like texts."""
    return _drop(docs, ngram_join.link, "doc_id <> component_id", "doc_id", "near-dups")


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a passage like a benchmark item."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _drop(docs, lambda rows: decontaminate.find(rows, benchmark).select("doc_id").distinct(), "TRUE", "doc_id", "decontaminate")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 1024 tokens."""
    return packing.pack(docs)


STAGES = [("language ID", language_id), ("exact dedup", exact_dups), ("n-gram Jaccard join", near_dups), ("benchmark decontamination", decontaminated), ("packing", packed)]

#: SQL has no tokenizer, SimHash or trained model.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over sf_dir's documents, each written as Parquet and read again."""
    scratch, docs = Scratch(spark, "pipeline"), spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = scratch.table(stage(spark, docs, sf_dir), f"stage-{k}")
        if k:
            scratch.drop(f"stage-{k - 1}")
    return docs
