"""Workspace metrics on the newest runs, text assembly and ordered reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from folioframe import presets as P
from folioframe.functions.geometry import unit_confidence
from folioframe.functions.text import status_bucket
from folioframe.operators.runs import latest_run, only_latest


def status_counts(docs: DataFrame) -> DataFrame:
    return docs.groupBy(F.upper("status").alias("status")).agg(F.count(F.lit(1)).alias("n"))


def _one_row(*parts: DataFrame) -> DataFrame:
    """Joins aggregates of one row each."""
    out = parts[0].withColumn("_1", F.lit(1))
    for p in parts[1:]:
        out = out.join(p.withColumn("_1", F.lit(1)), "_1")
    return out.drop("_1")


def workspace_summary(docs: DataFrame, fields: DataFrame, runs: DataFrame, results: DataFrame, vruns: DataFrame) -> DataFrame:
    """One row: documents by bucket, and fields and results of the newest completed runs only."""
    b = status_bucket("status")
    d = docs.agg(F.count(F.lit(1)).alias("total_documents"), *[F.count_if(b == k).alias(f"{k}_documents") for k in P.STATUS_BUCKETS])
    f = only_latest(fields, runs, order="completed").agg(F.count_if(F.col("validation_status").isin(*P.REVIEW_STATUSES)).alias("fields_needing_review"), F.count(F.lit(1)).alias("total_extracted_fields"), F.avg("confidence").alias("average_confidence"))
    s = F.upper("status")
    r = only_latest(results, vruns, order="completed").agg(F.count_if(s == "PASS").alias("validation_passed"), F.count_if(s.isin("REVIEW", "WARNING")).alias("validation_review"), F.count_if(s.isin("FAIL", "FAILED")).alias("validation_failed"))
    return _one_row(d, f, r)


def validation_summary(results: DataFrame, vruns: DataFrame) -> DataFrame:
    """Per document: results of its newest validation run, of any status."""
    newest = latest_run(vruns, status=None).select("run_id", "document_id")
    s = F.upper("status")
    return results.join(newest, "run_id").groupBy("document_id").agg(F.count(F.lit(1)).alias("total"), F.count_if(s == "PASS").alias("passed"), F.count_if(s == "WARNING").alias("warnings"), F.count_if(s == "REVIEW").alias("review"))


def document_metrics(fields: DataFrame) -> DataFrame:
    s = F.upper("validation_status")
    return fields.groupBy("document_id").agg(F.count_if(s == "PASS").alias("pass_count"), F.count_if(s.isin("WARNING", "REVIEW", "FAIL")).alias("review_count"), F.avg(unit_confidence(F.col("confidence"))).alias("mean_confidence"))


def document_status(results: DataFrame, ocr_runs: DataFrame) -> DataFrame:
    """FAILED if an OCR run failed, VALIDATION_REQUIRED if any result isn't a pass, else PROCESSED."""
    bad = results.groupBy("document_id").agg(F.bool_or(F.col("status").isin("REVIEW", "WARNING", "FAIL")).alias("_bad"))
    failed = ocr_runs.groupBy("document_id").agg(F.bool_or(F.col("status") == "FAILED").alias("_failed"))
    out = F.when(F.coalesce("_failed", F.lit(False)), "FAILED").when(F.coalesce("_bad", F.lit(False)), "VALIDATION_REQUIRED").otherwise("PROCESSED")
    return failed.join(bad, "document_id", "full").select("document_id", out.alias("document_status"))


def assemble_lines(words: DataFrame) -> DataFrame:
    """Words (page_id, block_num, par_num, line_num, word_num, left, top, width, height, conf, text) to lines: text, mean confidence, union box."""
    right, bottom = F.max(F.col("left") + F.col("width")), F.max(F.col("top") + F.col("height"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word_num", "left", "text"))), lambda w: w["text"]), " ")
    return words.groupBy("page_id", "block_num", "par_num", "line_num").agg(text.alias("text"), F.avg("conf").alias("confidence"), F.min("left").alias("x"), F.min("top").alias("y"), (right - F.min("left")).alias("width"), (bottom - F.min("top")).alias("height"))


def assemble_text(blocks: DataFrame, key: str = "page_id") -> DataFrame:
    """Blocks to a text: lines in block order, mean of the confidences that aren't negative."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block_number", "text"))), lambda b: b["text"]), "\n")
    return blocks.groupBy(key).agg(text.alias("text"), F.avg(F.when(F.col("confidence") >= 0, F.col("confidence"))).alias("confidence"))


def pipeline_summary(pages: DataFrame, fields: DataFrame, results: DataFrame) -> DataFrame:
    """Per document with pages: pages, fields, results, and whether any result needs review."""
    p = pages.groupBy("document_id").agg(F.count_distinct("page_id").alias("pages"))
    f = fields.groupBy("document_id").agg(F.count(F.lit(1)).alias("fields"))
    r = results.groupBy("document_id").agg(F.count(F.lit(1)).alias("results"), F.bool_or(F.col("status") != "PASS").alias("needs_review"))
    j = p.join(f, "document_id", "left").join(r, "document_id", "left")
    return j.select("document_id", "pages", F.coalesce("fields", F.lit(0)).alias("fields"), F.coalesce("results", F.lit(0)).alias("results"), F.coalesce("needs_review", F.lit(False)).alias("needs_review"))


def review_summary(queue: DataFrame) -> DataFrame:
    """One row: items in the queue, and how many of them require review."""
    return queue.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("validation_status") == "REVIEW").alias("review_required"))


def stage_progress(docs: DataFrame, fields: DataFrame, vruns: DataFrame) -> DataFrame:
    """Per document: states of the stages document, ocr, extraction and validation."""
    f = fields.groupBy("document_id").agg(F.count(F.lit(1)).alias("_n"), F.count_if(F.upper("validation_status").isin("WARNING", "REVIEW", "FAIL")).alias("_bad"))
    v = vruns.select("document_id").distinct().withColumn("_v", F.lit(True))
    j = docs.select("document_id").join(f, "document_id", "left").join(v, "document_id", "left")
    there = F.when(F.coalesce("_n", F.lit(0)) > 0, "complete").otherwise("pending")
    return j.select("document_id", F.lit("complete").alias("document"), there.alias("ocr"), there.alias("extraction"), F.coalesce("_n", F.lit(0)).alias("n_fields"), F.when(F.col("_v"), F.when(F.coalesce("_bad", F.lit(0)) > 0, "warning").otherwise("complete")).otherwise("pending").alias("validation"))


def recent(docs: DataFrame, n: int = 5) -> DataFrame:
    return docs.orderBy(F.col("created_at").desc(), F.col("document_id").desc()).limit(n)


def audit_feed(audit: DataFrame, n: int = 200) -> DataFrame:
    return audit.orderBy(F.col("ts").desc(), F.col("action_id").desc()).limit(n)


def audit_history(audit: DataFrame, document_id) -> DataFrame:
    return audit.filter(F.col("document_id") == document_id).orderBy(F.col("ts").desc(), F.col("action_id").desc())


def document_fields(fields: DataFrame, document_id=None) -> DataFrame:
    """Fields by page and creation, each with its place in that order in its document."""
    own = fields if document_id is None else fields.filter(F.col("document_id") == document_id)
    w = W.partitionBy("document_id").orderBy("page_number", "created_at", "field_id")
    return own.withColumn("place", F.row_number().over(w))


def document_pages(pages: DataFrame, document_id=None) -> DataFrame:
    own = pages if document_id is None else pages.filter(F.col("document_id") == document_id)
    return own.withColumn("place", F.row_number().over(W.partitionBy("document_id").orderBy("page_number", "page_id")))
