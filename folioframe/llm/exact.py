"""Exact dedup by a content sort, in DataFrame functions only.

Rows are range-partitioned by the first bytes of their normalised text, an external sort places equal texts next to each other, and a window
over the sorted rows compares whole neighbours: a run of equal texts is a group. Splitters are sampled from keys of a bounded size, so
neither the driver nor the sampler ever holds a whole text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from folioframe.llm.common import checkpointed

#: Code points of a text that the splitters see; a hash of the whole text orders what agrees in them.
LEAD = 16
#: A text is split into parts where it has more than 1/PARTS of a mean task's rows.
PARTS = 4


def _runs(docs: DataFrame, normalise: Callable[[Column], Column] | None, largest: bool, *carried: Column) -> DataFrame:
    """Each row with its run: ``_n`` rows, ``_best`` the id that leads it, ``_first`` for its first row, ``_part`` the part of a text that has many rows.

    The sort key is (lead, hash, text, part): equal texts agree in all but the part. Only the hash's counts are exchanged to find the texts
    of many rows; as counts add up to the number of rows, there are at most PARTS of them for each shuffle partition.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    d = docs.select(F.col("doc_id").alias("_id"), (normalise(text) if normalise else text).alias("_t"), *carried).withColumn("_h", F.xxhash64("_t"))
    most = PARTS * int(spark.conf.get("spark.sql.shuffle.partitions"))
    total = max(1, docs.count())
    many = d.groupBy(F.col("_h").alias("_mh")).agg(F.count(F.lit(1)).alias("_mn")).filter(F.col("_mn") * most > total)
    # Bounded: at most ``most`` hashes, as each has more than total / most of the rows.
    d = d.join(F.broadcast(many), F.col("_h") == F.col("_mh"), "left").drop("_mh")
    part = F.pmod(F.xxhash64("_id", F.spark_partition_id()), F.ceil(F.col("_mn") * most / F.lit(total)).cast("long"))
    d = d.withColumns({"_part": F.when(F.col("_mn").isNotNull(), part), "_lead": F.substring("_t", 1, LEAD)}).drop("_mn")
    run = W.partitionBy("_lead", "_h", "_t", "_part").orderBy(F.col("_id").desc_nulls_last() if largest else F.col("_id").asc_nulls_last())
    whole = run.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    # The window's keys hold the range partitioning's, so that it sorts what is there and exchanges nothing.
    return d.repartitionByRange("_lead", "_h", "_part").withColumns({
        "_n": F.count(F.lit(1)).over(whole),
        "_best": F.first("_id").over(whole),
        "_first": F.row_number().over(run) == 1,
    })


def exact_duplicates(docs: DataFrame, normalise: Callable[[Column], Column] | None = None, largest: bool = False) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), one row per row of ``docs``.

    Texts are equal when all their bytes are, after ``normalise`` (none: as they are). Of equal texts the row with the smallest doc_id
    stays, or with the largest; null ids lose to all others, and of rows that tie in id and text one stays. A null text counts as empty
    (also for ``normalise``), empty texts are equal, and texts of any length are compared whole. An empty table gives no rows; other
    columns of any name are ignored.

    A text with a large part of all rows is sorted in parts of a share of a task; what its parts found, one row a part, is put together
    by the text's SHA-256. Rows without their texts are checkpointed in between, so texts are exchanged and sorted once.
    """
    rows = _runs(docs, normalise, largest).select("_id", "_n", "_best", "_first", "_part", F.sha2("_t", 256).alias("_sha"))
    return _joined_parts(checkpointed(rows), largest).select(F.col("_id").alias("doc_id"), F.col("_best").alias("keep_id"), F.col("_n").alias("group_size"), F.col("_kept").alias("kept"), F.col("_sha").alias("text_sha256"))


def _joined_parts(rows: DataFrame, largest: bool) -> DataFrame:
    """Rows with ``_n``, ``_best`` and ``_kept`` of whole groups. Texts in parts are few (see ``_runs``), so their sums are broadcast."""
    lead = (F.max_by if largest else F.min_by)("_part", F.struct(F.col("_best").isNotNull() if largest else F.col("_best").isNull(), "_best", "_part"))
    whole = rows.filter("_part IS NOT NULL AND _first").groupBy(F.col("_sha").alias("_ws")).agg(F.sum("_n").alias("_wn"), (F.max if largest else F.min)("_best").alias("_wb"), lead.alias("_wp"))
    j = rows.join(F.broadcast(whole), (F.col("_sha") == F.col("_ws")) & F.col("_part").isNotNull(), "left")
    split = F.col("_ws").isNotNull()
    return j.withColumns({"_n": F.coalesce("_wn", "_n"), "_best": F.when(split, F.col("_wb")).otherwise(F.col("_best")), "_kept": F.col("_first") & (~split | (F.col("_part") == F.col("_wp")))})


def unique_rows(docs: DataFrame, normalise: Callable[[Column], Column] | None = None, largest: bool = False) -> DataFrame:
    """The rows that ``exact_duplicates`` keeps, with all their columns and their own text, whatever other columns are called."""
    rows = _runs(docs, normalise, largest, F.struct("*").alias("_row")).filter("_first").select("_n", "_best", "_first", "_part", F.sha2("_t", 256).alias("_sha"), "_row")
    return _joined_parts(checkpointed(rows), largest).filter("_kept").select("_row.*")


ORACLE = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
  row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents) WINDOW g AS (PARTITION BY t)
"""
