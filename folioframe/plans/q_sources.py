"""Sources and sinks: tables are written in the shape that a source reads, and read back."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession, functions as F

from folioframe.functions.text import blank_to_null
from folioframe.operators import evaluate
from folioframe.plans.views import frame, sql
from folioframe.sources import readers, writers

QUERIES: dict = {}


def folder(spark: SparkSession) -> str:
    """A new folder below the shared one that spark.checkpoint.dir names; a temporary one in local mode without it."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return f"{base.rstrip('/')}/sources-{uuid.uuid4().hex}"


def register(name: str, oracle: str, *views: str):
    """f(spark, a new folder, the views)."""

    def wrap(f):
        QUERIES[name] = (lambda spark, sf_dir: f(spark, folder(spark), *[frame(spark, sf_dir, v) for v in views]), sql(oracle, *views))
        return f

    return wrap


@register("n24_blank_to_null", "SELECT field_id, nullif(trim(value), '') AS value FROM v_fields", "v_fields")
def n24(spark, at, fields):
    return fields.select("field_id", blank_to_null("value").alias("value"))


# A layout file a part: its blocks hold name and brand, the second without a box; every seventh file is damaged.
@register("s3_layout_json", """SELECT p_partkey || '.png' AS image, 1 AS block_order, 'Text' AS label, p_name AS text, 1.0::DOUBLE AS x, 4.0::DOUBLE AS height, p_size / 100.0::DOUBLE AS conf FROM part WHERE p_partkey % 7 <> 0
 UNION ALL SELECT p_partkey || '.png', 2, 'Table', p_brand, NULL, NULL, NULL FROM part WHERE p_partkey % 7 <> 0""", "part")
def s3(spark, at, part):
    block = lambda n, label, text, box, conf: F.struct(F.lit(n).alias("order"), F.lit(label).alias("label"), text.alias("text"), box.alias("bbox_xyxy"), conf.alias("conf"))
    first = block(1, "Text", F.col("p_name"), F.array(*map(F.lit, (1.0, 2.0, 11.0, 6.0))), (F.col("p_size") / 100.0).cast("double"))
    second = block(2, "Table", F.col("p_brand"), F.lit(None).cast("array<double>"), F.lit(None).cast("double"))
    image = F.concat(F.lit("scans/"), F.col("p_partkey").cast("string"), F.lit(".png"))
    good = F.to_json(F.struct(image.alias("image"), F.array(first, second).alias("blocks")))
    part.select(F.when(F.col("p_partkey") % 7 == 0, '{"image": "scans/').otherwise(good)).repartition(8).write.option("lineSep", "\n").text(at)
    own = readers.read_layout_json(spark, at, lines=True)
    return own.select("image", "block_order", "label", "text", "bbox.x", "bbox.height", "conf")


@register("s5_manifest", "SELECT c_custkey || '.png' AS image, 'said \"' || c_name || '\", ' || chr(10) || 'twice' AS ground_truth FROM customer WHERE c_custkey % 5 <> 0", "customer")
def s5(spark, at, customer):
    image = F.when(F.col("c_custkey") % 5 != 0, F.concat(F.col("c_custkey").cast("string"), F.lit(".png"))).otherwise(" ")
    customer.select(image.alias("image"), F.concat(F.lit('said "'), "c_name", F.lit('", \ntwice')).alias("ground_truth")).write.csv(at, header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return readers.read_manifest(spark, at, ("image", "ground_truth")).select("image", "ground_truth")


@register("s6_reference_import", "SELECT district_name, taluka_name, village_name, nullif(trim(local_name), '') AS local_name FROM v_reference WHERE taluka_code <> 'T3'", "v_reference")
def s6(spark, at, reference):
    record = F.struct(F.concat(F.lit(" "), "district_name").alias("district_name"), "taluka_name", "village_name", F.coalesce("local_name", F.lit(" ")).alias("eferfar_local_name"))
    files = reference.groupBy("taluka_code").agg(F.collect_list(record).alias("data"))
    files.select(F.to_json(F.struct(F.when(F.col("taluka_code") == "T3", "error").otherwise("success").alias("status"), "data"))).write.text(at)
    return readers.import_reference(spark, at, lines=True).select("district_name", "taluka_name", "village_name", "local_name")


@register("s7_guarded_load", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderstatus = 'F'", "orders")
def s7(spark, at, orders):
    own = orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    writers.load_table(own, at)
    writers.load_table(own.filter("o_orderstatus = 'F'"), at, replace=True)
    return spark.read.parquet(at)


@register("s8_stage_by_run", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'even' ELSE 'odd' END AS run_id FROM orders WHERE o_orderkey % 2 = 1 OR o_orderkey % 4 = 0", "orders")
def s8(spark, at, orders):
    own = orders.select("o_orderkey")
    for run, kept in (("odd", "o_orderkey % 2 = 1"), ("even", "o_orderkey % 2 = 0"), ("even", "o_orderkey % 4 = 0")):  # a run again replaces itself
        writers.write_stage(own.filter(kept), at, run)
    return spark.read.parquet(at).select("o_orderkey", F.col("run_id").cast("string").alias("run_id"))


@register("s9_report", """WITH p AS (SELECT p_partkey AS image, p_size % 2 = 0 AS exact FROM part) SELECT 'document' AS part, image::VARCHAR AS image, exact FROM p
 UNION ALL SELECT 'summary', count(*)::VARCHAR, bool_and(exact) FROM p""", "part")
def s9(spark, at, part):
    rows = part.select(F.col("p_partkey").alias("image"), F.lit("brand").alias("field"), (F.col("p_size") % 2 == 0).alias("exact"), F.lit(1.0).alias("similarity"))
    overall = rows.agg(F.count(F.lit(1)).alias("documents"), F.min("exact").alias("all_exact"))
    writers.write_report(evaluate.report(overall, rows.groupBy("field").agg(F.count(F.lit(1)).alias("n")), rows), at)
    got = spark.read.schema("part string, content string").json(at)
    get = lambda p: F.get_json_object("content", p)
    doc = F.col("part") == "document"
    return got.select("part", F.when(doc, get("$.image")).otherwise(get("$.documents")).alias("image"), F.when(doc, get("$.fields[0].exact")).otherwise(get("$.all_exact")).cast("boolean").alias("exact"))
