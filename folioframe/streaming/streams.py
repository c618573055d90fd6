"""Structured Streaming twins of upload dedup, review folding and live review counts."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from folioframe.operators.review import DECISIONS, apply_reviews, last_decisions, valid_actions
from folioframe.operators.runs import upload_status


def dedup_uploads(uploads: DataFrame, ts: str = "ts", within: str = "1 day", key: str = "sha256") -> DataFrame:
    """The first upload of each content hash; state is dropped once the watermark has passed."""
    return uploads.withWatermark(ts, within).dropDuplicatesWithinWatermark([key])


def review_counts(actions: DataFrame, ts: str = "ts", late: str = "10 minutes", width: str = "30 seconds") -> DataFrame:
    """Decisions in tumbling windows, by status."""
    return actions.withWatermark(ts, late).groupBy(F.window(ts, width), F.col("status")).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "status", "n")


def live_decisions(actions: DataFrame) -> DataFrame:
    """The last decision and edit of each field, kept as the query's state; in update mode a batch gives the fields that it changed.

    ``review.with_decisions`` puts them on the fields.
    """
    return last_decisions(actions)


def fold_reviews(actions: DataFrame, path: str, checkpoint: str):
    """Starts a query that appends the valid actions to a log, batch by batch; ``folded`` reads the fields' state from it.

    A batch is written under its number, so one that is run again replaces itself.
    """

    def batch(df: DataFrame, n: int) -> None:
        valid_actions(df).select("action_id", "field_id", "action", "new_value", "reason", "ts").write.mode("overwrite").parquet(f"{path}/batch={n}")

    return actions.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def folded(fields: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """(fields, audit) after all batches that have been written."""
    return apply_reviews(fields, fields.sparkSession.read.parquet(path).drop("batch"))


#: Buckets of stored hashes: their first two hexadecimal digits.
BUCKET = 2


def known_hashes(spark: SparkSession, path: str) -> DataFrame | None:
    """(sha256, file_id, batch, bucket) of all uploads that came first, or None before there is one."""
    try:
        return spark.read.schema("sha256 string, file_id long, batch long, bucket string").parquet(f"{path}/hashes")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def follow_uploads(uploads: DataFrame, path: str, checkpoint: str):
    """Starts a query that tells for each upload (file_id long, sha256) whether its content was ever uploaded before, however long ago.

    The hashes of first uploads are kept under ``path``/hashes, in buckets by their first digits and with Bloom filters in the files; a batch reads
    the buckets that it has hashes in, and of many hashes only the files' parts that may hold one of its own. What is found is confirmed by a join.
    ``path``/status has (file_id, sha256, status, first_id), NEW or ALREADY_EXISTS. Of equal hashes in one batch the smallest file_id is first. A
    batch that is run again replaces its own files, and doesn't meet its own hashes.
    """

    def batch(df: DataFrame, n: int) -> None:
        spark = df.sparkSession
        own = df.select("file_id", "sha256").withColumn("bucket", F.substring("sha256", 1, BUCKET))
        known = known_hashes(spark, path)
        if known is None:
            before = own.select("bucket", "sha256", F.col("file_id").alias("first_id")).limit(0)
        else:
            buckets = [r.bucket for r in own.select("bucket").distinct().collect()]  # 256 at most
            before = known.filter(F.col("batch") < n).filter(F.col("bucket").isin(buckets)).select("bucket", "sha256", F.col("file_id").alias("first_id"))
            before = before.join(own.select("bucket", "sha256").distinct(), ["bucket", "sha256"], "left_semi")
        out = upload_status(own, before)
        out.drop("bucket").write.mode("overwrite").parquet(f"{path}/status/batch={n}")
        said = spark.read.parquet(f"{path}/status/batch={n}")
        fresh = said.filter("status = 'NEW'").select("sha256", "file_id", F.substring("sha256", 1, BUCKET).alias("bucket"))
        writer = fresh.repartition("bucket").write.mode("overwrite").partitionBy("bucket").option("parquet.bloom.filter.enabled#sha256", "true")
        writer.parquet(f"{path}/hashes/batch={n}")

    return uploads.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


#: What is known of a field: its actions of late, in order, the value of its last edit before them, and what its last action decided.
STATE = "ts array<long>, ids array<long>, actions array<string>, new_values array<string>, reasons array<string>, base string"
FOLLOWED = "kind string, field_id string, action_id long, action string, old_value string, new_value string, decision string, reason string, ts long, was string, now string, value string"


def _fold(late_us: int):
    """Folds a batch of a field's actions into its state; gives audit rows that are new or have changed, and what the field was and is."""
    import pandas as pd

    names = [c.split()[0] for c in FOLLOWED.split(", ")]

    def values(actions: list[tuple], base: str | None) -> dict:
        out, now = {}, base
        for _, i, action, new, _ in actions:
            old, now = now, new.strip(" ") if action == "EDIT" else now
            out[i] = (old, now)
        return out

    def fold(key, frames, state):
        known, base = [], None
        if state.exists:
            *columns, base = state.get
            known = list(zip(*columns, strict=True))
        have = {a[1] for a in known}
        horizon = known[-1][0] - late_us if known else None
        fresh = {}
        for f in frames:
            for a in zip(f["us"], f["action_id"], f["action"], f["new_value"], f["reason"], strict=True):
                a = tuple(None if x is None or x != x else x for x in a)
                if a[1] not in have and (horizon is None or a[0] >= horizon):
                    fresh[int(a[1])] = (int(a[0]), int(a[1]), *a[2:])
        if not fresh:
            return
        before, was = values(known, base), DECISIONS[known[-1][2]] if known else None
        actions = sorted([*known, *fresh.values()], key=lambda a: a[:2])
        after, now = values(actions, base), DECISIONS[actions[-1][2]]
        rows = [("audit", key[0], i, action, *after[i], DECISIONS[action], reason, ts, None, None, None) for ts, i, action, _, reason in actions if before.get(i) != after[i]]
        value = after[actions[-1][1]][1]
        rows.append(("field", key[0], None, None, None, None, None, None, None, was, now, value))
        # What is older than ``late`` is only kept as the value that it left; the last action stays.
        cut = next(k for k, a in enumerate(actions) if a[0] >= actions[-1][0] - late_us)
        base = after[actions[cut - 1][1]][1] if cut else base
        state.update((*map(list, zip(*actions[cut:], strict=True)), base))
        out = pd.DataFrame(rows, columns=names)
        out[["action_id", "ts"]] = out[["action_id", "ts"]].astype("Int64")
        yield out

    return fold


def follow_reviews(fields: DataFrame, actions: DataFrame, path: str, checkpoint: str, late: str = "1 day"):
    """Starts a query that keeps each field's review as state, and under ``path`` its audit, its last decision and edit, and changes of counts by status.

    A field's state has its actions of ``late`` before its newest, whatever their number before. Actions may come in any order within that time: they are
    folded in (ts, action_id) order, and audit rows that an action changes come again. Older ones come too late and are left out, as is an action_id that is there, or
    what is not on one of ``fields``. A batch's files are replaced if it is run again. ``reviewed``, ``audit_of`` and ``status_counts`` read what is there.
    """
    spark = actions.sparkSession
    late_us = int(spark.sql(f"SELECT unix_micros(timestamp'1970-01-01 00:00:00Z' + INTERVAL {late})").first()[0])
    own = valid_actions(actions).join(fields.select("field_id").distinct(), "field_id", "left_semi").select("field_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.col("action_id").cast("long").alias("action_id"), "action", "new_value", "reason")
    rows = own.groupBy("field_id").applyInPandasWithState(_fold(late_us), FOLLOWED, STATE, "update", "NoTimeout")

    def batch(df: DataFrame, n: int) -> None:
        df.write.mode("overwrite").partitionBy("kind").parquet(f"{path}/rows/batch={n}")
        # A changed status takes one from what it was and adds one to what it is; a field that had no decision yet was what the fields' table says.
        said = df.sparkSession.read.schema(FOLLOWED).parquet(f"{path}/rows/batch={n}").filter("kind = 'field'")
        moved = said.select("field_id", F.inline(F.array(F.struct(F.col("was").alias("status"), F.lit(-1).alias("n")), F.struct(F.col("now").alias("status"), F.lit(1).alias("n")))))
        decided = moved.filter("status IS NOT NULL").groupBy("status").agg(F.sum("n").alias("n"))
        decided.write.mode("overwrite").parquet(f"{path}/counts/batch={n}")

    return rows.writeStream.outputMode("update").foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _last(spark: SparkSession, path: str, kind: str, key: str) -> DataFrame:
    rows = spark.read.schema(FOLLOWED + ", batch long").parquet(f"{path}/rows").filter(F.col("kind") == kind)
    return rows.withColumn("_r", F.row_number().over(W.partitionBy(key).orderBy(F.col("batch").desc()))).filter("_r = 1")


def audit_of(fields: DataFrame, path: str) -> DataFrame:
    """(action_id, field_id, action, old_value, new_value, decision, reason, ts), as ``review.audit_rows`` has them."""
    a = _last(fields.sparkSession, path, "audit", "action_id").join(fields.select("field_id", F.col("value").alias("_start")), "field_id")
    return a.select("action_id", "field_id", "action", F.coalesce("old_value", "_start").alias("old_value"), F.coalesce("new_value", "_start").alias("new_value"), "decision", "reason", F.timestamp_micros("ts").alias("ts"))


def reviewed(spark: SparkSession, path: str) -> DataFrame:
    """(field_id, decision, edited) after all batches; ``review.with_decisions`` puts them on the fields."""
    return _last(spark, path, "field", "field_id").select("field_id", F.col("now").alias("decision"), F.col("value").alias("edited"))


def status_counts(fields: DataFrame, path: str) -> DataFrame:
    """(status, n) of the fields now: the table's counts of fields without a decision, and the sums of all changes."""
    spark = fields.sparkSession
    changes = spark.read.schema("status string, n long, batch long").parquet(f"{path}/counts").select("status", "n")
    start = fields.join(reviewed(spark, path), "field_id", "left_anti").groupBy(F.col("validation_status").alias("status")).agg(F.count(F.lit(1)).alias("n"))
    return start.unionByName(changes).groupBy("status").agg(F.sum("n").alias("n")).filter("n <> 0")
