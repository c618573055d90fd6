"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: ASCII white space that separates words: 0x20 and 0x09-0x0D.
WORD = "[^\\x20\\x09-\\x0D]+"
NULL_ID = -(2**63)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts lineage through the shared checkpoint folder."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Only in local mode, where one machine does all, a temporary one stands in where it is unset."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a folder that this library wrote."""
    sc = spark.sparkContext
    at = sc._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)


def row_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """Tells rows apart by id and text; equal rows share it, and get equal answers."""
    return F.xxhash64(F.col(doc_id), F.col(text))


def doc_key(doc_id: str = "doc_id") -> Column:
    """The id as a long; null comes before all others."""
    return F.coalesce(F.col(doc_id).cast("long"), F.lit(NULL_ID))


def word_count(text: str | Column = "text") -> Column:
    c = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(c, F.lit(WORD)), F.lit(0)).cast("long")


def spread_join(left: DataFrame, right: DataFrame, key: str, weight: str, total: int, most: int = 2000) -> DataFrame:
    """Left outer join on a key of which one value may hold a large part of the left rows.

    ``right`` has one row per key and in ``weight`` how many left rows hold it. Keys with at least total/most
    rows are at most ``most`` (their weights sum to total), so that list is broadcast; the others are shuffled,
    and rows of hot keys are spread evenly meanwhile. Columns of other names may have any name, on both sides.
    """
    cols = [c for c in right.columns if c not in (key, weight)]
    r = right.select(F.col(key).alias("rk"), F.col(weight).alias("rn"), F.struct(F.lit(True).alias("is"), *cols).alias("r"))
    hot = F.col("rn") * most >= F.lit(max(total, 1))
    few = r.filter(hot).select(F.col("rk").alias("hk"), F.col("r").alias("h"))
    rest = r.filter(~hot).select("rk", F.xxhash64("rk").alias("rh"), F.lit(0).alias("rs"), "r")
    j = left.select(F.struct("*").alias("l"), F.col(key).alias("lk")).join(F.broadcast(few), F.col("lk") == F.col("hk"), "left")
    j = j.withColumns({"jh": F.when(F.col("h").isNotNull(), F.xxhash64("l")).otherwise(F.xxhash64("lk")), "js": F.col("h").isNotNull().cast("int")})
    j = j.join(rest, (F.col("jh") == F.col("rh")) & (F.col("js") == F.col("rs")) & (F.col("lk") == F.col("rk")), "left").withColumn("a", F.coalesce("h", "r"))
    return j.select("l.*", *(F.col(f"a.`{c}`").alias(c) for c in cols))


def kept_rows(docs: DataFrame, rows: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``kept`` names, and one only of rows that are equal in id and text.

    ``rows`` has (doc, row), that is doc_key() and row_key(), of every row of ``docs``, ``kept`` of those that stay. All columns are kept.
    """
    n = rows.groupBy("doc", "row").agg(F.count(F.lit(1)).alias("n"))
    stay = kept.select("doc", "row", F.lit(True).alias("stay"))
    state = checkpointed(n.join(stay, ["doc", "row"], "left").select(F.struct("doc", "row").alias("k"), "n", F.col("n").alias("times"), F.coalesce("stay", F.lit(False)).alias("stay")))
    total = state.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    packed = docs.select(F.struct("*").alias("d"), F.struct(doc_key().alias("doc"), row_key().alias("row")).alias("k"))
    j = spread_join(packed, state, "k", "n", total).filter("stay")
    once = j.filter("times = 1").select("d.*")
    if state.filter("stay AND times > 1").isEmpty():
        return once
    return once.unionByName(j.filter("times > 1").groupBy("k").agg(F.first("d").alias("d")).select("d.*"))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a long, b long): rows (node, label), label the smallest node reachable.

    Each round sends a node to the smallest of itself and its neighbours and contracts the edges, so rounds grow
    with the logarithm of the longest path; every round is checkpointed. Nodes without an edge are left out.
    """
    both = lambda e: e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    e = checkpointed(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    steps = []
    while not e.isEmpty():
        low = checkpointed(both(e).groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("up")))
        steps.append(low)
        to = lambda c: low.select(F.col("node").alias(c), F.col("up").alias(f"_{c}"))  # noqa: B023, E731
        e = checkpointed(e.join(to("a"), "a").join(to("b"), "b").select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).filter("a <> b").distinct())
    if not steps:
        return edges.select(F.col("a").alias("node"), F.col("a").alias("label")).limit(0)
    out = steps[-1].select("node", F.col("up").alias("label"))
    for low in reversed(steps[:-1]):
        nxt = out.select(F.col("node").alias("_n"), "label")
        out = low.join(nxt, low["up"] == nxt["_n"], "left").select("node", F.coalesce("label", "up").alias("label"))
    return out
