"""Runs: the newest one of each document, rows that belong to it, lineage joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F


def latest_run(runs: DataFrame, key: str = "document_id", status: str | None = "COMPLETED", order: str = "created", tie: str = "run_id") -> DataFrame:
    """One run a document: of ``status`` (None: any), newest by created_at, or by completed_at (nulls last) and then created_at; ties to the larger id."""
    by = [F.col("created_at").desc(), F.col(tie).desc()]
    if order == "completed":
        by.insert(0, F.col("completed_at").desc_nulls_last())
    own = runs if status is None else runs.filter(F.col("status") == status)
    return own.withColumn("_r", F.row_number().over(W.partitionBy(key).orderBy(*by))).filter("_r = 1").drop("_r")


def only_latest(rows: DataFrame, runs: DataFrame, key: str = "document_id", run_id: str = "run_id", **how) -> DataFrame:
    """Rows whose run is the newest of its document."""
    return rows.join(latest_run(runs, key, **how).select(run_id), run_id, "left_semi")


def run_confidence(rows: DataFrame, run_id: str = "run_id") -> DataFrame:
    """Mean confidence of each run's rows; nulls don't count, null when there is none."""
    return rows.groupBy(run_id).agg(F.avg("confidence").alias("confidence"))


def with_document(fields: DataFrame, pages: DataFrame, documents: DataFrame) -> DataFrame:
    return fields.join(pages, "page_id").join(documents, "document_id")


def results_with_fields(results: DataFrame, fields: DataFrame) -> DataFrame:
    return results.join(fields.select("field_id", "field_name"), "field_id")


def audit_with_document(audit: DataFrame, documents: DataFrame) -> DataFrame:
    return audit.join(documents, "document_id")


def split_new_existing(incoming: DataFrame, existing: DataFrame, key: str = "sha256", order: str = "file_id") -> DataFrame:
    """Adds outcome: ALREADY_EXISTS if the hash is known, DUPLICATE_IN_BATCH after its first upload in the batch, else NEW."""
    known = existing.select(F.col(key).alias("_k")).distinct().withColumn("_known", F.lit(True))
    first = F.row_number().over(W.partitionBy(key).orderBy(order))
    out = F.when(F.col("_known"), "ALREADY_EXISTS").when(F.col("_n") > 1, "DUPLICATE_IN_BATCH").otherwise("NEW")
    return incoming.join(known, F.col(key) == F.col("_k"), "left").withColumn("_n", first).withColumn("outcome", out).drop("_k", "_known", "_n")


def upload_status(uploads: DataFrame, before: DataFrame, key: str = "sha256", order: str = "file_id") -> DataFrame:
    """Adds status and first_id: ALREADY_EXISTS and the id it came with, if the hash is among ``before`` (one row a hash, with first_id) or on an earlier upload, else NEW and its own id."""
    b = before.select(F.col(key).alias("_k"), F.col("first_id").alias("_before"))
    w = W.partitionBy(key).orderBy(order)
    j = uploads.join(b, F.col(key) == F.col("_k"), "left").withColumns({"_n": F.row_number().over(w), "_first": F.first(order).over(w)})
    new = F.col("_before").isNull() & (F.col("_n") == 1)
    return j.withColumns({"status": F.when(new, "NEW").otherwise("ALREADY_EXISTS"), "first_id": F.coalesce("_before", "_first")}).drop("_k", "_before", "_n", "_first")


def first_values(fields: DataFrame, names: tuple[str, ...], key: str = "run_id") -> DataFrame:
    """First non-blank value of each named field in creation order, one column a name."""
    value = F.trim(F.coalesce(F.nullif(F.trim("value"), F.lit("")), "normalized_value", F.lit("")))
    own = fields.withColumn("_v", value).filter((F.col("_v") != "") & F.col("field_name").isin(*names))
    pick = lambda n: F.min_by(F.when(F.col("field_name") == n, F.col("_v")), F.when(F.col("field_name") == n, F.struct("created_at", "field_id"))).alias(n)
    return own.groupBy(key).agg(*map(pick, names))


def dedup_strongest(fields: DataFrame, *keys: str) -> DataFrame:
    """Of rows equal in keys, field_name and normalized_value, the most confident; the first in reading order wins ties."""
    w = W.partitionBy(*keys, "field_name", "normalized_value").orderBy(F.col("confidence").desc_nulls_last(), "position", "field_id")
    return fields.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def union_fields(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
