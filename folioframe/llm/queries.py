"""Registered queries of the training-data operators, at production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from folioframe.llm import decontaminate, exact, language, licences, mixing, negatives, passages, quality, sharding, simhash, suffixes, topk, variants
from folioframe.llm.common import table


def op1_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.licence_report(table(spark, sf_dir, "documents"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(table(spark, sf_dir, "documents"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.remove_repeated_passages(table(spark, sf_dir, "documents"), with_text=False).drop("kept")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("items", "row")


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def op9_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeated_bytes(table(spark, sf_dir, "documents")).drop("starts", "ends")


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_inner(table(spark, sf_dir, "embeddings"))


def op11_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_duplicates(table(spark, sf_dir, "documents"), largest=True)


def op12_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    return negatives.hard_negatives(v.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))))


def op13_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.spelling_variants(variants.vocabulary(table(spark, sf_dir, "documents")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_licences": op1_licences,
        "op2_simhash": op2_simhash,
        "op3_mixing": op3_mixing,
        "op4_quality": op4_quality,
        "op5_passages": op5_passages,
        "op6_sharding": op6_sharding,
        "op7_decontamination": op7_decontamination,
        "op8_language": op8_language,
        "op9_suffixes": op9_suffixes,
        "op10_topk": op10_topk,
        "op11_exact": op11_exact,
        "op12_negatives": op12_negatives,
        "op13_variants": op13_variants,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_mixing": mixing.ORACLE, "op6_sharding": sharding.ORACLE, "op10_topk": topk.ORACLE, "op11_exact": exact.ORACLE, "op12_negatives": negatives.ORACLE, "op13_variants": variants.ORACLE}
