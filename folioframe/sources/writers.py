"""Sinks: guarded loads, stages with their run id, JSON reports."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, functions as F


def load_table(df: DataFrame, path: str, replace: bool = False) -> int:
    """Writes rows to a new place, or over the old with ``replace``; what can be read back must be as many as were written.

    The new rows are written beside the old and counted there; only then do they take their place, by renaming.
    """
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    at = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    fs = at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(at(path)) and not replace:
        raise FileExistsError(f"{path} exists")
    tag = uuid.uuid4().hex
    new, old = f"{path.rstrip('/')}.new-{tag}", f"{path.rstrip('/')}.old-{tag}"
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(new)
    there = spark.read.schema(df.schema).parquet(new).count()
    if there != seen.get["n"]:
        fs.delete(at(new), True)
        raise RuntimeError(f"{there} rows could be read back for {path}, {seen.get['n']} were written; what was there stays")
    if fs.exists(at(path)):
        fs.rename(at(path), at(old))
    fs.rename(at(new), at(path))
    fs.delete(at(old), True)
    return there


def write_stage(df: DataFrame, path: str, run_id: str) -> None:
    """Appends a stage's rows under its run id; a run that is written again replaces itself alone."""
    df.withColumn("run_id", F.lit(run_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(path)


def write_report(report: DataFrame, path: str) -> None:
    report.write.mode("overwrite").json(path)
