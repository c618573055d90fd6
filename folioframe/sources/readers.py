"""Sources: uploaded files, layout-OCR JSON, word TSV, manifests and reference hierarchies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from folioframe import presets as P
from folioframe.functions.text import blank_to_null

LAYOUT = "image string, width int, height int, blocks array<struct<`order`: int, label: string, type: string, bbox_xyxy: array<double>, conf: double, text: string>>, markdown string, _corrupt_record string"
WORDS = ("block_num", "par_num", "line_num", "word_num", "left", "top", "width", "height")
REFERENCE = {"eferfar_dist_code": "district_code", "district_name": "district_name", "eferfar_taluka_code": "taluka_code", "taluka_name": "taluka_name", "eferfar_village_code": "village_code", "village_name": "village_name", "eferfar_local_name": "local_name", "eferfar_lbtype": "lb_type", "eferfar_code": "eferfar_code", "lgd_discrete_code": "lgd_code"}


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(name, content, size) of files; the content is read only where it is used."""
    f = spark.read.format("binaryFile").load(path)
    return f.select(F.regexp_extract("path", "[^/]+$", 0).alias("name"), "content", F.col("length").alias("size"), F.col("path").alias("file_path"))


def admit_files(df: DataFrame, max_mb: float = 25, allowed: dict = P.ALLOWED_FILES, magic: dict = P.MAGIC_HEX) -> DataFrame:
    """Adds admitted and reason (the first check that fails) to rows (name, content_type, content)."""
    ext = F.lower(F.regexp_extract(F.coalesce("name", F.lit("")), "\\.([^./]+)$", 1))
    size = F.coalesce(F.octet_length("content"), F.lit(0))
    start = F.upper(F.hex(F.substring("content", 1, 8)))
    signed = F.lit(False)
    for e, marks in magic.items():
        hit = F.lit(False)
        for m in marks:
            hit = hit | start.startswith(m)
        signed = F.when(ext == e, hit).otherwise(signed)
    reason = (
        F.when(F.coalesce("name", F.lit("")) == "", "A filename is required.")
        .when(F.length("name") > 255, "Filename exceeds the maximum allowed length.")
        .when(~ext.isin(*allowed), "Unsupported file extension.")
        .when(~F.coalesce("content_type", F.lit("")).isin(*{t for ts in allowed.values() for t in ts}), "Unsupported content type.")
        .when(size == 0, "Uploaded file is empty.")
        .when(size > int(max_mb * 1024 * 1024), "File exceeds the configured maximum upload size.")
        .when(~signed, "File content does not match its format.")
    )
    return df.withColumn("reason", reason).withColumn("admitted", F.col("reason").isNull())


def content_hash(c: Column | str) -> Column:
    return F.sha2(F.col(c) if isinstance(c, str) else c, 256)


def read_layout_json(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """(image, block_order, label, type, bbox, conf, text) of layout-OCR files; malformed files are skipped, images are file names.

    A file is one record, or with ``lines`` holds one a line, so that many small records are read in parallel.
    """
    raw = spark.read.schema(LAYOUT).json(path, multiLine=not lines, mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt_record")
    b = raw.filter("_corrupt_record IS NULL AND image IS NOT NULL").select(F.regexp_extract("image", "[^/\\\\]+$", 0).alias("image"), F.explode("blocks").alias("b"))
    corner = lambda i: F.try_element_at("b.bbox_xyxy", F.lit(i))
    box = F.struct(corner(1).alias("x"), corner(2).alias("y"), (corner(3) - corner(1)).alias("width"), (corner(4) - corner(2)).alias("height"))
    return b.select("image", F.col("b.order").alias("block_order"), F.col("b.label").alias("label"), F.col("b.type").alias("type"), box.alias("bbox"), F.col("b.conf").alias("conf"), F.col("b.text").alias("text"))


def usable_words(raw: DataFrame) -> DataFrame:
    """Words with text and a confidence from 0 on; a confidence that isn't a number counts as -1."""
    w = raw.withColumn("conf", F.coalesce(F.col("conf").try_cast("double"), F.lit(-1.0)))
    return w.filter("trim(coalesce(text, '')) <> '' AND conf >= 0")


def read_word_tsv(spark: SparkSession, path: str) -> DataFrame:
    schema = ", ".join(f"{c} string" for c in ("level", "page_num", *WORDS, "conf", "text"))
    raw = spark.read.schema(schema).csv(path, sep="\t", header=True, quote="")
    return usable_words(raw.withColumns({c: F.col(c).try_cast("int") for c in WORDS}))


def read_manifest(spark: SparkSession, path: str, required: tuple[str, ...]) -> DataFrame:
    """A CSV with a header (a UTF-8 mark before it is ignored), and ``manifest_order``, which ascends with the lines of a file.

    Rows without an image are dropped, missing columns are an error. Values may hold quoted line breaks, so a file is read by one task.
    """
    df = spark.read.csv(path, header=True, multiLine=True, escape='"')
    df = df.toDF(*[c.lstrip("\ufeff") for c in df.columns])
    if missing := [c for c in required if c not in df.columns]:
        raise ValueError(f"columns missing in {path}: {', '.join(missing)}")
    return df.withColumn("manifest_order", F.monotonically_increasing_id()).filter("trim(coalesce(image, '')) <> ''")


def import_reference(spark: SparkSession, path: str, mapping: dict[str, str] = REFERENCE, lines: bool = False) -> DataFrame:
    """The records of hierarchy files whose status is success: renamed, trimmed, blanks null. A file is one object, or with ``lines`` holds one a line."""
    record = ", ".join(f"{k}: string" for k in mapping)
    raw = spark.read.schema(f"status string, data array<struct<{record}>>").json(path, multiLine=not lines)
    rows = raw.filter("status = 'success'").select(F.inline("data"))
    return rows.select(*[blank_to_null(k).alias(v) for k, v in mapping.items()])
