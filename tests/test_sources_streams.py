"""Sources, sinks and streaming twins."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from folioframe.operators import review
from folioframe.sources import readers, writers
from folioframe.streaming import streams


def test_admission_and_hash(spark, tmp_path):
    rows = [("a.pdf", "application/pdf", b"%PDF-1"), ("", "application/pdf", b"%PDF-1"), ("x" * 260 + ".pdf", "application/pdf", b"%PDF-1"), ("a.exe", "application/pdf", b"x"), ("a.png", "text/html", b"x"), ("a.jpg", "image/jpeg", b""), ("a.tif", "image/tiff", b"II*\x00" + b"0" * 2_000_000), ("a.jpeg", "image/jpeg", b"nope"), ("B.TIFF", "image/tiff", b"MM\x00*z"), (None, None, None)]
    got = readers.admit_files(spark.createDataFrame(rows, "name string, content_type string, content binary"), max_mb=1).collect()
    assert [r.admitted for r in got] == [True, False, False, False, False, False, False, False, True, False]
    assert [(r.reason or "ok").split(" ")[0] for r in got] == ["ok", "A", "Filename", "Unsupported", "Unsupported", "Uploaded", "File", "File", "ok", "A"]
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "x.bin").write_bytes(b"abc")
    r = readers.read_files(spark, str(tmp_path / "f")).select("name", "size", readers.content_hash("content").alias("h")).first()
    assert (r.name, r["size"], r.h) == ("x.bin", 3, "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad")


def test_layout_json(spark, tmp_path):
    good = {"image": "scans/p1.png", "width": 10, "height": 10, "blocks": [{"order": 0, "label": "Table", "type": "Table", "bbox_xyxy": [1, 2, 4, 6], "conf": 0.9, "text": "<table></table>"}, {"order": 1, "type": "Text", "bbox_xyxy": [], "text": "x"}], "markdown": ""}
    (tmp_path / "a.json").write_text(json.dumps(good, indent=1))
    (tmp_path / "b.json").write_text("{ broken")
    got = readers.read_layout_json(spark, str(tmp_path)).orderBy("block_order").collect()
    assert [(r.image, r.type, r.bbox.width) for r in got] == [("p1.png", "Table", 3.0), ("p1.png", "Text", None)]


def test_word_tsv(spark, tmp_path):
    head = "level\tpage_num\tblock_num\tpar_num\tline_num\tword_num\tleft\ttop\twidth\theight\tconf\ttext"
    lines = ["5\t1\t0\t0\t0\t1\t1\t2\t3\t4\t91.5\tgood", "5\t1\t0\t0\t0\t2\t1\t2\t3\t4\t-1\tno", "5\t1\t0\t0\t0\t3\t1\t2\t3\t4\tx\tnan", "5\t1\t0\t0\t0\t4\t1\t2\t3\t4\t50\t ", '5\t1\t0\t0\t0\t5\t1\t2\t3\t4\t0\t"quoted']
    (tmp_path / "w.tsv").write_text("\n".join([head, *lines]))
    got = readers.read_word_tsv(spark, str(tmp_path / "w.tsv")).orderBy("word_num").collect()
    assert [(r.text, r.conf, r.left) for r in got] == [("good", 91.5, 1), ('"quoted', 0.0, 1)]


def test_manifest_and_reference(spark, tmp_path):
    (tmp_path / "m.csv").write_text("﻿image,ground_truth\na.png,x\n ,y\n", encoding="utf-8")
    assert [r.image for r in readers.read_manifest(spark, str(tmp_path / "m.csv"), ("image", "ground_truth")).collect()] == ["a.png"]
    with pytest.raises(ValueError):
        readers.read_manifest(spark, str(tmp_path / "m.csv"), ("missing",))
    data = [{"district_name": " Pune ", "village_name": "W", "eferfar_local_name": " "}]
    (tmp_path / "r.json").write_text(json.dumps({"status": "success", "data": data}))
    (tmp_path / "s.json").write_text(json.dumps({"status": "error", "data": data}))
    got = readers.import_reference(spark, str(tmp_path / "*.json")).collect()
    assert [(r.district_name, r.village_name, r.local_name, r.lgd_code) for r in got] == [("Pune", "W", None, None)]


def test_guarded_load_and_stages(spark, tmp_path):
    df = spark.range(10)
    assert writers.load_table(df, str(tmp_path / "t")) == 10
    with pytest.raises(Exception, match="(?i)exists"):
        writers.load_table(df, str(tmp_path / "t"))
    assert writers.load_table(df.limit(3), str(tmp_path / "t"), replace=True) == 3
    for run, n in (("r1", 4), ("r2", 5), ("r1", 2)):
        writers.write_stage(spark.range(n), str(tmp_path / "s"), run)
    assert {r.run_id: r["count"] for r in spark.read.parquet(str(tmp_path / "s")).groupBy("run_id").count().collect()} == {"r1": 2, "r2": 5}
    writers.write_report(spark.createDataFrame([("summary", "{}")], "part string, content string"), str(tmp_path / "rep"))
    assert spark.read.json(str(tmp_path / "rep")).count() == 1


ACTION = "action_id long, field_id string, action string, new_value string, reason string, ts timestamp, status string"


def actions(spark):
    t = dt.datetime(2024, 1, 1)
    kinds = ["ACCEPT", "EDIT", "FLAG", "REJECT", "EDIT", "BOGUS"]
    return spark.createDataFrame([(i, f"f{i % 4}", kinds[i % 6], f"v{i}" if i % 6 != 4 else " ", None, t + dt.timedelta(seconds=7 * i), kinds[i % 6]) for i in range(40)], ACTION)


def stream_of(spark, df, path):
    for i in range(3):
        df.filter(F.col(df.columns[0]) % 3 == i).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_review_counts_equal_the_batch(spark, tmp_path):
    df = actions(spark)
    q = streams.review_counts(stream_of(spark, df, str(tmp_path / "in")), late="1 hour").writeStream.outputMode("update").format("memory").queryName("counts").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = spark.table("counts").groupBy("start", "status").agg(F.max("n").alias("n"))
    want = df.groupBy(F.window("ts", "30 seconds").start.alias("start"), "status").agg(F.count(F.lit(1)).alias("n"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_review_fold_equals_the_batch(spark, tmp_path):
    df = actions(spark)
    fields = spark.createDataFrame([(f"f{i}", f"S{i}", f"s{i}", "PENDING") for i in range(5)], "field_id string, value string, normalized_value string, validation_status string")
    q = streams.fold_reviews(stream_of(spark, df, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "c"))
    q.awaitTermination(120)
    got, audit = streams.folded(fields, str(tmp_path / "out"))
    want, want_audit = review.apply_reviews(fields, df)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert sorted(map(str, audit.collect())) == sorted(map(str, want_audit.collect()))


def test_live_decisions_equal_the_batch(spark, tmp_path):
    df = actions(spark)
    fields = spark.createDataFrame([(f"f{i}", f"S{i}", f"s{i}", "PENDING") for i in range(5)], "field_id string, value string, normalized_value string, validation_status string")
    q = streams.live_decisions(stream_of(spark, df, str(tmp_path / "in"))).writeStream.outputMode("complete").format("memory").queryName("decisions").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = review.with_decisions(fields, spark.table("decisions"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, review.apply_reviews(fields, df)[0].collect()))


def test_upload_dedup(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(i, f"h{i % 4}", t + dt.timedelta(minutes=i)) for i in range(20)], "file_id long, sha256 string, ts timestamp")
    q = streams.dedup_uploads(stream_of(spark, df, str(tmp_path / "in"))).writeStream.format("memory").queryName("uploads").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r.sha256 for r in spark.table("uploads").collect()) == ["h0", "h1", "h2", "h3"]
