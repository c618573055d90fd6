"""Streams with state that lasts, over shuffled batches and restarts, against their batch twins."""

import datetime as dt
import random

from pyspark.sql import functions as F

from folioframe.operators import review, runs
from folioframe.streaming import streams

ACTION = "action_id long, field_id string, action string, new_value string, reason string, ts timestamp"


def arrive(spark, rows, schema, path, batches):
    """One file a batch, in the order of ``batches``."""
    for b in batches:
        spark.createDataFrame(b, schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_reviews_over_shuffled_batches_and_a_restart(spark, tmp_path):
    rng = random.Random(2)
    t = dt.datetime(2024, 1, 1)
    kinds = ["ACCEPT", "EDIT", "EDIT", "FLAG", "REJECT", "VERIFY", "BOGUS"]
    rows = [(i, f"f{rng.randrange(7)}", (k := rng.choice(kinds)), (" " if rng.random() < 0.2 else f" v{i} ") if k == "EDIT" else None, rng.choice([None, "seen"]), t + dt.timedelta(seconds=rng.randrange(60))) for i in range(80)]
    fields = spark.createDataFrame([(f"f{i}", f"S{i}", f"s{i}", "PENDING" if i % 2 else "REVIEW") for i in range(6)] + [("g", "G", "g", "PENDING")], "field_id string, value string, normalized_value string, validation_status string")
    rng.shuffle(rows)
    batches, at, done = [rows[i::4] for i in range(4)], [str(tmp_path / x) for x in ("in", "out", "c")], []
    for k, b in enumerate([batches[0], batches[1], batches[2] + batches[0][:5], batches[3], []]):  # some come twice; the last start finds nothing
        stream = arrive(spark, rows, ACTION, at[0], [b] if b else [])
        streams.follow_reviews(fields, stream, at[1], at[2]).awaitTermination(120)
        done += b if k != 2 else batches[2]
        want, audit = review.apply_reviews(fields, spark.createDataFrame(done, ACTION))
        got = review.with_decisions(fields, streams.reviewed(spark, at[1]))
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
        assert sorted(map(str, streams.audit_of(fields, at[1]).select(audit.columns).collect())) == sorted(map(str, audit.collect()))
        counts = want.groupBy("validation_status").count()
        assert {r.status: r.n for r in streams.status_counts(fields, at[1]).collect()} == {r[0]: r[1] for r in counts.collect()}


def test_actions_that_come_too_late(spark, tmp_path):
    """What is older than ``late`` before a field's newest action changes nothing; what it left as value stays."""
    t = dt.datetime(2024, 1, 1)
    row = lambda i, kind, value, minute: (i, "f", kind, value, None, t + dt.timedelta(minutes=minute))
    fields = spark.createDataFrame([("f", "S", "s", "PENDING")], "field_id string, value string, normalized_value string, validation_status string")
    at = [str(tmp_path / x) for x in ("in", "out", "c")]
    for b in ([row(1, "EDIT", "one", 0)], [row(2, "FLAG", None, 50)], [row(3, "EDIT", "late", 10), row(4, "ACCEPT", None, 45)]):
        streams.follow_reviews(fields, arrive(spark, b, ACTION, at[0], [b]), at[1], at[2], late="20 minutes").awaitTermination(120)
    r = review.with_decisions(fields, streams.reviewed(spark, at[1])).first()
    assert (r.value, r.validation_status) == ("one", "FLAGGED")
    assert {(r.action_id, r.old_value, r.new_value) for r in streams.audit_of(fields, at[1]).collect()} == {(1, "S", "one"), (2, "one", "one"), (4, "one", "one")}


def test_uploads_meet_all_history(spark, tmp_path):
    schema = "file_id long, sha256 string"
    digest = lambda x: F.sha2(F.lit(str(x)), 256)
    name = spark.range(1).select(*[digest(i).alias(f"h{i}") for i in range(40)]).first()
    rng = random.Random(1)
    rows = [(i, name[f"h{rng.randrange(40)}"]) for i in range(120)]
    at = [str(tmp_path / x) for x in ("in", "out", "c")]
    for k in range(4):  # a start a month
        streams.follow_uploads(arrive(spark, rows, schema, at[0], [rows[30 * k : 30 * k + 15], rows[30 * k + 15 : 30 * k + 30]]), at[1], at[2]).awaitTermination(120)
    own = spark.createDataFrame(rows, schema)
    want = runs.upload_status(own, own.select("sha256", F.col("file_id").alias("first_id")).limit(0))
    got = spark.read.parquet(f"{at[1]}/status").select(want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert streams.known_hashes(spark, at[1]).count() == len({h for _, h in rows})
