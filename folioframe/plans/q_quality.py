"""Queries of the quality evaluation: recall of reference values, accuracy, error rates."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioframe.functions import similarity as S
from folioframe.functions import text as T
from folioframe.operators import evaluate, tables
from folioframe.plans.views import frame, sql

QUERIES: dict = {}


def register(name: str, oracle: str | None, *views: str):
    def wrap(f):
        QUERIES[name] = (lambda spark, sf_dir: f(*[frame(spark, sf_dir, v) for v in views]), sql(oracle, *views) if oracle else None)
        return f

    return wrap


# DuckDB's edit distance counts bytes, so its SQL writes a pair's distinct characters as single bytes, in the order they occur.
PAIRS = r"""pp AS (SELECT conv_id, turn, trim(regexp_replace(replace(coalesce(ref, ''), chr(8203), ' '), '\s+', ' ', 'g')) AS r, trim(regexp_replace(replace(coalesce(pred, ''), chr(8203), ' '), '\s+', ' ', 'g')) AS p FROM v_pairs),
 pu AS (SELECT *, list_distinct(string_split(r || p, '')) AS u FROM pp), pc AS (SELECT conv_id, turn, r, p, list_aggregate(list_transform(string_split(r, ''), lambda x: chr(list_position(u, x)::INT)), 'string_agg', '') AS rc, list_aggregate(list_transform(string_split(p, ''), lambda x: chr(list_position(u, x)::INT)), 'string_agg', '') AS pd FROM pu)"""
CER = "CASE WHEN r = '' THEN CASE WHEN p = '' THEN 0.0 ELSE 1.0 END WHEN p = '' THEN 1.0 ELSE levenshtein(rc, pd)::DOUBLE / length(r) END::DOUBLE"


@register("n12_cer", f", {PAIRS} SELECT conv_id, turn, {CER} AS cer FROM pc", "v_pairs")
def n12(pairs):
    return pairs.select("conv_id", "turn", S.cer(F.col("ref"), F.col("pred")).alias("cer"))


# A pair has more distinct words than there are single bytes: no SQL.
@register("n13_wer", None, "v_pairs")
def n13(pairs):
    return pairs.select("conv_id", "turn", S.wer(F.col("ref"), F.col("pred")).alias("wer"))


@register("a14_error_rates", None, "v_pairs")
def a14(pairs):
    return evaluate.error_rates(pairs)


@register("a14_mean_cer", f", {PAIRS} SELECT count(*) AS samples, count(*) FILTER (r = '') AS empty_references, round(avg({CER}) FILTER (r <> ''), 9) AS mean_cer FROM pc", "v_pairs")
def a14_cer(pairs):
    return evaluate.error_rates(pairs).select("samples", "empty_references", F.round("mean_cer", 9).alias("mean_cer"))


@register("n9_similarity", f", {PAIRS} SELECT conv_id, turn, CASE WHEN r = '' OR p = '' THEN 0.0 WHEN r = p THEN 1.0 ELSE 1 - levenshtein(rc, pd)::DOUBLE / greatest(length(r), length(p)) END::DOUBLE AS similarity FROM pc", "v_pairs")
def n9(pairs):
    return pairs.select("conv_id", "turn", S.similarity(T.eval_text("ref", "cer"), T.eval_text("pred", "cer")).alias("similarity"))


@register("n9_ratcliff", None, "v_fields")
def n9_ratcliff(fields):
    return fields.select("field_id", S.similarity(F.col("value"), F.lit("Owner 17"), "ratcliff").alias("similarity"))


# Benchmark passages are the reference values; each is looked for in all documents.
def truth_of(benchmark):
    status = F.when(F.col("item_id") % 4 == 3, "unreadable").otherwise("present")
    return benchmark.select("item_id", F.concat(F.lit("f"), F.col("item_id") % 5).alias("field"), F.col("text").alias("value"), status.alias("status"))


NORM = r"trim(regexp_replace(regexp_replace(regexp_replace(lower(trim(coalesce({x}, ''))), '[–—−]', '-', 'g'), '[^\p{{L}}\p{{M}}\p{{N}}_\s/-]', ' ', 'g'), '\s+', ' ', 'g'))"
FOUND = f"t AS (SELECT item_id, 'f' || (item_id % 5) AS field, {NORM.format(x='text')} AS n FROM benchmark WHERE item_id % 4 <> 3 AND trim(coalesce(text, '')) <> ''), d AS (SELECT {NORM.format(x='text')} AS n FROM documents), v AS (SELECT item_id, any_value(field) AS field, count(d.n) AS pages_with FROM t LEFT JOIN d ON t.n <> '' AND contains(d.n, t.n) GROUP BY 1)"


def visible(benchmark, documents):
    """(item_id, field, pages_with): in how many documents each evaluable passage is."""
    own = truth_of(benchmark).filter(T.is_evaluable("status", "value"))
    hits = evaluate.values_in_texts(own, documents.select("doc_id", "text")).groupBy("item_id").agg(F.count(F.lit(1)).alias("pages_with"))
    return own.join(hits, "item_id", "left").select("item_id", "field", F.coalesce("pages_with", F.lit(0)).cast("long").alias("pages_with"))


@register("x16_field_visibility", f"WITH {FOUND} SELECT item_id, pages_with, (SELECT count(*) FROM documents) AS pages FROM v", "benchmark", "documents")
def x16(benchmark, documents):
    return visible(benchmark, documents).select("item_id", "pages_with", F.lit(documents.count()).cast("long").alias("pages"))


# Values of fields in the text of their page, which is here its first value.
@register("x16_fuzzy_visibility", f""", t AS (SELECT page_id, field_name, {NORM.format(x='value')} AS v FROM v_fields WHERE trim(coalesce(value, '')) <> ''), x AS (SELECT page_id, {NORM.format(x="coalesce(first(value ORDER BY field_id), '')")} AS t FROM v_fields GROUP BY 1),
 s AS (SELECT t.page_id AS image, field_name AS field, v, t, v <> '' AND contains(t, v) AS exact FROM t JOIN x ON t.page_id = x.page_id),
 r AS (SELECT image, field, exact, CASE WHEN v = '' THEN 0.0 WHEN exact THEN 1.0 WHEN t = '' THEN 0.0 ELSE 1 - levenshtein(v, t)::DOUBLE / greatest(length(v), length(t)) END::DOUBLE AS similarity FROM s)
 SELECT image, field, exact, similarity, similarity >= 0.8 AS fuzzy FROM r""", "v_fields")
def x16_fuzzy(fields):
    truth = fields.select(F.col("page_id").alias("image"), F.col("field_name").alias("field"), "value", F.lit("present").alias("status"))
    texts = fields.groupBy(F.col("page_id").alias("image")).agg(F.min_by("value", "field_id").alias("text"))
    return evaluate.field_visibility(truth, texts).drop("value")


@register("a12_retrieval_benchmark", f"WITH {FOUND} SELECT CASE WHEN grouping(field) = 1 THEN 'OVERALL' ELSE field END AS field, count(*) AS evaluable, count(*) FILTER (pages_with > 0) AS found, avg((pages_with > 0)::INT) AS recall FROM v GROUP BY ROLLUP (field)", "benchmark", "documents")
def a12(benchmark, documents):
    return evaluate.retrieval_benchmark(visible(benchmark, documents).withColumn("found", F.col("pages_with") > 0))


@register("a12_timing_summary", "SELECT count(*) AS pages, sum(value) AS total_seconds, avg(value) AS mean_seconds, max(value) AS slowest, min(value) AS fastest FROM events", "events")
def a12_timing(events):
    out = evaluate.timing_summary(events.withColumnRenamed("value", "seconds"))
    return out


# Fields against the values of the same document's other run: predictions and truth of one shape.
def scored_fields(fields):
    own = fields.select(F.concat(F.lit("scans/"), F.col("run_id").cast("string")).alias("image"), "field_name", "value", "page_number", "field_id", "confidence")
    pick = lambda lo: own.filter(F.coalesce("confidence", F.lit(0.0)) >= 50 if lo else F.lit(True)).groupBy("image", F.col("field_name").alias("field")).agg(F.min_by("value", "field_id").alias("value"))
    truth = pick(False).withColumn("status", F.when(F.col("field") == "khata_number", "unreadable").otherwise("present"))
    return evaluate.scored(pick(True), truth, numeric=("survey_number",))


HTML = r"trim(regexp_replace(lower(trim(coalesce({x}, ''))), '[^\p{{L}}\p{{M}}\p{{N}}_/.-]+', ' ', 'g'))"
SCORED = f"""own AS (SELECT run_id, field_name AS field, value, field_id, coalesce(confidence, 0) AS c FROM v_fields), t AS (SELECT run_id, field, arg_min(value, field_id) FILTER (value IS NOT NULL) AS v0, first(value ORDER BY field_id) AS value FROM own GROUP BY 1, 2), p AS (SELECT run_id, field, first(value ORDER BY field_id) AS prediction FROM own WHERE c >= 50 GROUP BY 1, 2),
 j AS (SELECT t.run_id, t.field, t.value, p.prediction FROM t LEFT JOIN p ON t.run_id = p.run_id AND t.field = p.field WHERE trim(coalesce(t.value, '')) <> '' AND t.field <> 'khata_number' AND t.run_id IN (SELECT run_id FROM p)),
 n AS (SELECT *, CASE WHEN field = 'survey_number' THEN regexp_extract(replace(coalesce(value, ''), ' ', ''), '[0-9]+(/[0-9]+)*') ELSE {HTML.format(x='value')} END AS a, CASE WHEN field = 'survey_number' THEN regexp_extract(replace(coalesce(prediction, ''), ' ', ''), '[0-9]+(/[0-9]+)*') ELSE {HTML.format(x='prediction')} END AS b FROM j),
 s AS (SELECT *, trim(coalesce(prediction, '')) <> '' AS extracted, a <> '' AND a = b AS exact, CASE WHEN a = '' OR b = '' THEN 0.0 WHEN a = b THEN 1.0 ELSE 1 - levenshtein(a, b)::DOUBLE / greatest(length(a), length(b)) END::DOUBLE AS similarity FROM n)"""


@register("a13_j11_extraction_accuracy", f", {SCORED} SELECT CASE WHEN grouping(field) = 1 THEN 'OVERALL' ELSE field END AS field, count(*) AS evaluable, count(*) FILTER (extracted) AS extracted, count(*) FILTER (exact) AS exact, avg(extracted::INT) AS coverage, avg(exact::INT) AS exact_recall, round(avg(similarity), 9) AS mean_similarity FROM s GROUP BY ROLLUP (field)", "v_fields")
def a13(fields):
    return evaluate.extraction_accuracy(scored_fields(fields)).withColumn("mean_similarity", F.round("mean_similarity", 9))


@register("a13_failures", f", {SCORED} SELECT run_id::VARCHAR AS image, field, value, prediction FROM s WHERE NOT exact", "v_fields")
def a13_failures(fields):
    return evaluate.failures(scored_fields(fields)).select("image", "field", "value", "prediction")


@register("a11_field_benchmark", f", {SCORED} SELECT CASE WHEN grouping(field) = 1 THEN 'OVERALL' ELSE field END AS field, count(*) AS evaluable, avg(exact::INT) AS exact_recall, avg((similarity >= 0.8)::INT) AS fuzzy_recall, round(avg(similarity), 9) AS mean_similarity FROM s GROUP BY ROLLUP (field)", "v_fields")
def a11(fields):
    own = scored_fields(fields).withColumn("fuzzy", F.col("similarity") >= 0.8)
    return evaluate.field_benchmark(own).withColumn("mean_similarity", F.round("mean_similarity", 9))


@register("x15_melt_truth", "SELECT p_partkey AS image, unnest(['p_brand', 'p_type']) AS field, unnest([p_brand, p_type]) AS value, unnest([CASE WHEN p_size % 3 = 0 THEN 'present' ELSE '' END, 'unreadable']) AS status FROM part", "part")
def x15(part):
    wide = part.select(F.col("p_partkey").alias("image"), "p_brand", "p_type", F.when(F.col("p_size") % 3 == 0, "present").otherwise("").alias("p_brand_status"), F.lit("unreadable").alias("p_type_status"))
    return evaluate.melt_truth(wide, ("p_brand", "p_type"))


@register("a15_annotation_progress", "WITH t AS (SELECT p_partkey AS image, unnest([CASE WHEN p_size % 3 = 0 THEN 'present' ELSE '' END, 'unreadable']) AS status FROM part) SELECT CASE WHEN grouping(image) = 1 THEN 'OVERALL' ELSE image::VARCHAR END AS image, count(*) AS fields, count(*) FILTER (status <> '') AS reviewed, count(*) = count(*) FILTER (status <> '') AS complete FROM t GROUP BY ROLLUP (image)", "part")
def a15(part):
    wide = part.select(F.col("p_partkey").alias("image"), "p_brand", "p_type", F.when(F.col("p_size") % 3 == 0, "present").otherwise("").alias("p_brand_status"), F.lit("unreadable").alias("p_type_status"))
    return evaluate.annotation_progress(evaluate.melt_truth(wide, ("p_brand", "p_type")))


@register("j11_u4_unmatched", r"SELECT DISTINCT regexp_extract(url, '[^/\\]+$') AS image FROM pages WHERE regexp_extract(url, '[^/\\]+$') NOT IN (SELECT regexp_extract(url, '[^/\\]+$') FROM pages WHERE page_id % 3 = 0)", "pages")
def j11(pages):
    own = pages.select(F.col("url").alias("image"), "page_id")
    return evaluate.join_truth(own.select("image"), own.filter("page_id % 3 = 0"))[1]


@register("j12_missing_pages", r"SELECT DISTINCT regexp_extract(url, '[^/\\]+$') AS image FROM pages WHERE regexp_extract(url, '[^/\\]+$') NOT IN (SELECT regexp_extract(url, '[^/\\]+$') FROM pages WHERE page_id % 2 = 0)", "pages")
def j12(pages):
    own = pages.select(F.col("url").alias("image"), "page_id")
    return evaluate.missing_pages(own, own.filter("page_id % 2 = 0"))


@register("n10_contained_similarity", f"SELECT field_id, CASE WHEN r = '' THEN 0.0 WHEN contains('owner 17 of the old place', r) THEN 1.0 ELSE 1 - levenshtein(r, 'owner 17 of the old place')::DOUBLE / greatest(length(r), 25) END::DOUBLE AS similarity FROM (SELECT field_id, {NORM.format(x='value')} AS r FROM v_fields)", "v_fields")
def n10(fields):
    return fields.select("field_id", S.contained_similarity(F.col("value"), F.lit("Owner 17, of the OLD place.")).alias("similarity"))


@register("n22_expand_aliases", "SELECT field_id, unnest(CASE value WHEN 'BUILDING' THEN ['BUILDING', 'Bldg'] WHEN 'asia' THEN ['Asia'] ELSE [value] END) AS variant FROM v_fields", "v_fields")
def n22(fields):
    return tables.expand_aliases(fields, aliases={"BUILDING": ("BUILDING", "Bldg"), "asia": ("Asia",)}).select("field_id", "variant")


@register("n25_identity_match", r"""SELECT field_id, coalesce((d <> '' AND (d = '17' OR list_contains(string_split(regexp_replace('see 12/3 and 45', '[^0-9]+', ' ', 'g'), ' '), d))) OR (d = '' AND c <> '' AND contains('thebuildingofasia17', c)), false) AS same FROM (SELECT field_id, regexp_replace(coalesce(value, ''), '[^0-9]', '', 'g') AS d, regexp_replace(lower(trim(coalesce(value, ''))), '[^\p{L}\p{M}\p{N}_]+', '', 'g') AS c FROM v_fields)""", "v_fields")
def n25(fields):
    return fields.select("field_id", S.identity_match(F.col("value"), F.lit("The building of Asia, 17"), F.lit("see 12/3 and 45")).alias("same"))
