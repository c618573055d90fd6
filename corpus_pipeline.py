"""Corpus pipeline: quality filter, near-duplicates, decontamination, mixing and sharding, each stage on what the last one kept.

Every stage takes (spark, docs, sf_dir); its result is written as Parquet and read again as the next stage's documents.
All but the last return the columns of ``documents``, whatever other columns these have; the last adds where each row goes.
Documents that mixing takes several times are repeated rows from there on. Every stage judges rows, not ids: rows with a null or a
repeated id are rows like others. Null and empty texts are texts without words, and an empty table stays empty.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from folioframe.llm import decontaminate, mixing, nearcopies, quality, sharding
from folioframe.llm.common import removed, shared_folder, table


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality classifier rejects go; equal texts are rejected alike, empty ones are scored like others."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies (five-word shingles, similarity 0.8 or more) stays, one of the smallest doc_id, null last.

    Texts without words are copies of each other.
    """
    return nearcopies.keep_one(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold a window of a benchmark item go; a text without words holds none, an item without words has none."""
    return decontaminate.clean_only(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix of sources takes it; null is a source, and texts without words are taken once."""
    return mixing.take(docs)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of each row: shard and slot. Equal rows are in one shard, in slots of their own; null ids are in one shard."""
    return sharding.shard_documents(docs)


STAGES = [
    ("quality", good_quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontaminated),
    ("mixing", mixed),
    ("sharding", sharded),
]

#: SQL can't express the classifier or the near copies; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies STAGES to documents. What a stage keeps is written to the shared checkpoint folder, and removed once the next stage is written."""
    at = f"{shared_folder(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{name}")
        docs = spark.read.parquet(f"{at}/{name}")
        if before:
            removed(spark, before)
        before = f"{at}/{name}"
    return STAGES[-1][1](spark, docs, sf_dir)
