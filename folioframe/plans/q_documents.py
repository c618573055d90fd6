"""Queries on documents, OCR blocks, words, tables and files."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioframe import presets as P
from folioframe.functions import text as T
from folioframe.functions.geometry import box, has_box, normalize_bbox, right_of_same_row
from folioframe.functions.similarity import label_score
from folioframe.operators import extract, metrics, runs, tables
from folioframe.operators.store import spread, stored
from folioframe.plans.views import frame, sql
from folioframe.sources import readers

QUERIES: dict = {}


def register(name: str, oracle: str | None, *views: str):
    def wrap(f):
        QUERIES[name] = (lambda spark, sf_dir: f(*[frame(spark, sf_dir, v) for v in views]), sql(oracle, *views) if oracle else None)
        return f

    return wrap


# Blocks are the lines of documents, laid out on a grid; every tenth line is a label, so that extraction finds something.
LABELS = ("Village", "Survey No", "Khata No", "Owner Name", "Area", "Mutation", "भूमापन क्रमांक", "खाते क्रमांक")


def blocks_of(docs):
    lines = docs.select(F.col("doc_id").alias("page_id"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("pos", "line"))
    k, p = (F.col("page_id") * 7 + F.col("pos") * 3) % 10, F.col("pos")
    label = F.element_at(F.array(*map(F.lit, LABELS)), ((F.col("page_id") * 3 + F.floor(p / 3)) % len(LABELS) + 1).cast("int"))
    number = F.concat(((F.col("page_id") + p) % 400).cast("string"), F.lit("/"), (p % 5).cast("string"))
    text = F.when(k == 0, label).when(k == 3, number).when(k == 2, F.concat(label, F.lit(": "), number)).when(k == 1, F.concat(F.lit("Village : "), F.col("line"))).otherwise(F.col("line"))
    b = box((p % 4) * 250, F.floor(p / 4) * 40, 100 + F.length("line") % 5 * 20, 20 + p % 5)
    return lines.select("page_id", (F.col("page_id") * 100000 + p).alias("block_id"), p.alias("block_number"), text.alias("text"), ((F.col("page_id") * 31 + p * 17) % 101).cast("double").alias("confidence"), b.alias("bbox"))


LABEL_SQL = "[" + ", ".join(f"'{x}'" for x in LABELS) + "]"
BLOCKS = f"""l AS (SELECT doc_id AS page_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS pos FROM documents),
k AS (SELECT *, (page_id * 7 + pos * 3) % 10 AS k, ({LABEL_SQL})[(page_id * 3 + pos // 3) % {len(LABELS)} + 1] AS label, ((page_id + pos) % 400) || '/' || (pos % 5) AS number FROM l),
blocks AS (SELECT page_id, page_id * 100000 + pos AS block_id, pos AS block_number, CASE k WHEN 0 THEN label WHEN 3 THEN number WHEN 2 THEN label || ': ' || number WHEN 1 THEN 'Village : ' || line ELSE line END AS text,
 ((page_id * 31 + pos * 17) % 101)::DOUBLE AS confidence, ((pos % 4) * 250)::DOUBLE AS x, (pos // 4 * 40)::DOUBLE AS y, (100 + length(line) % 5 * 20)::DOUBLE AS width, (20 + pos % 5)::DOUBLE AS height FROM k)"""


def b(body: str) -> str:
    return f"WITH {BLOCKS} {body}"


def squeezed(c: str) -> str:
    return rf"regexp_replace(trim(regexp_replace({c}, '\s+', ' ', 'g')), '^[ .,:;|/\-]+|[ .,:;|/\-]+$', '', 'g')"


def tight_list(labels) -> str:
    return ", ".join(f"'{x}'" for x in sorted({"".join(l.split()).lower() for l in labels}))


@register("p8_valid_boxes", b("SELECT block_id, width > 100 AND height > 21 AS ok FROM blocks"), "documents")
def p8(docs):
    own = blocks_of(docs)
    small = box(F.col("bbox.x"), F.col("bbox.y"), F.col("bbox.width") - 100, F.col("bbox.height") - 21)
    return own.select("block_id", has_box(small).alias("ok"))


@register("p11_has_letter", "SELECT doc_id, regexp_matches(coalesce(text, ''), '[A-Za-z\\x{900}-\\x{97F}]') AS lettered FROM documents", "documents")
def p11(docs):
    return docs.select("doc_id", T.has_letter("text").alias("lettered"))


@register("n15_normalize_bbox", """SELECT page_id, CASE page_id % 5 WHEN 4 THEN NULL ELSE (page_id % 40)::DOUBLE END AS x, CASE page_id % 5 WHEN 4 THEN NULL ELSE 3::DOUBLE END AS y, CASE page_id % 5 WHEN 4 THEN NULL ELSE 20::DOUBLE END AS width, CASE page_id % 5 WHEN 4 THEN NULL ELSE 7::DOUBLE END AS height FROM pages""", "pages")
def n15(pages):
    x = (F.col("page_id") % 40).cast("string")
    x2 = (F.col("page_id") % 40 + 20).cast("string")
    k = F.col("page_id") % 5
    shape = F.when(k == 0, F.concat(F.lit('{"x":'), x, F.lit(',"y":3,"width":20,"height":7}'))).when(k == 1, F.concat(F.lit('{"left":'), x, F.lit(',"top":3,"right":'), x2, F.lit(',"bottom":10}')))
    shape = shape.when(k == 2, F.concat(F.lit('{"bbox":{"x":"'), x, F.lit('","y":3,"width":20,"height":7}}'))).when(k == 3, F.concat(F.lit("["), x, F.lit(",3,"), x2, F.lit(",10]"))).otherwise(F.concat(F.lit("["), x2, F.lit(",3,"), x, F.lit(",10]")))
    n = normalize_bbox(shape)
    return pages.select("page_id", n["x"].alias("x"), n["y"].alias("y"), n["width"].alias("width"), n["height"].alias("height"))


@register("w4_n17_next_on_row", b(""", o AS (SELECT *, lead(struct_pack(id := block_id, x := x, y := y, h := height)) OVER (PARTITION BY page_id ORDER BY y, x, block_number) AS n FROM blocks)
 SELECT block_id, n.id AS next_id, n.x - (x + width) BETWEEN 0 AND 1400 AND abs(n.y + n.h / 2 - (y + height / 2)) <= greatest(18.0, 0.9 * least(height, n.h)) AS right_of FROM o WHERE n IS NOT NULL"""), "documents")
def w4(docs):
    own = extract.with_next(extract.in_reading_order(blocks_of(docs))).filter("next_block IS NOT NULL")
    return own.select("block_id", F.col("next_block.block_id").alias("next_id"), right_of_same_row(F.col("bbox"), F.col("next_block.bbox")).alias("right_of"))


CLUSTERED = """c AS (SELECT *, y + height / 2 AS cy FROM blocks), f AS (SELECT *, CASE WHEN cy - lag(cy) OVER w > greatest(18.0, 0.9 * least(height, lag(height) OVER w)) THEN 1 ELSE 0 END AS nw FROM c WINDOW w AS (PARTITION BY page_id ORDER BY cy, x, block_number)),
 r AS (SELECT *, sum(nw) OVER (PARTITION BY page_id ORDER BY cy, x, block_number ROWS UNBOUNDED PRECEDING)::INT AS row_idx FROM f)"""


@register("w5_row_clusters", b(f", {CLUSTERED} SELECT block_id, row_idx, count(*) OVER (PARTITION BY page_id, row_idx) AS row_size FROM r"), "documents")
def w5(docs):
    return extract.cluster_rows(blocks_of(docs)).select("block_id", "row_idx", "row_size")


@register("w5_row_clusters_greedy", None, "documents")
def w5_greedy(docs):
    return extract.cluster_rows_greedy(blocks_of(docs)).select("page_id", "block_id", "row_idx")


@register("j7_l6_area_rows", b(r""", h AS (SELECT * FROM blocks WHERE lower(trim(text)) = 'area'), v AS (SELECT *, regexp_replace(trim(regexp_replace(text, '\s+', ' ', 'g')), '^[ .,:;|/\-]+|[ .,:;|/\-]+$', '', 'g') AS c FROM blocks),
 g AS (SELECT * FROM v WHERE regexp_matches(regexp_replace(c, '\s+', '', 'g'), '^[0-9]+([.,][0-9]+)?$') AND coalesce(try_cast(replace(regexp_replace(c, '\s+', '', 'g'), ',', '.') AS DOUBLE), 0) > 0),
 j AS (SELECT g.block_id, g.c, h.block_id AS header, row_number() OVER (PARTITION BY h.block_id ORDER BY g.y, g.x, g.block_number) AS rn FROM h JOIN g ON h.page_id = g.page_id AND g.block_id <> h.block_id AND g.y > h.y + h.height AND g.y - (h.y + h.height) <= 280 AND g.x BETWEEN h.x - 20 AND h.x + greatest(h.width, 180) + 40)
 SELECT block_id AS evidence_block_id, c AS value FROM j WHERE rn <= 10"""), "documents")
def x6(docs):
    own = extract.extract_area_rows(extract.in_reading_order(blocks_of(docs)))
    return own.select("evidence_block_id", "value")


def columns_of_numbers(docs):
    """Blocks under one another, a word each: every fortieth is an area header, two of three others are amounts, from 0.0 to 99.6."""
    words = docs.select(F.col("doc_id").alias("page_id"), F.posexplode(F.split(F.coalesce("text", F.lit("")), " ")).alias("p", "word"))
    p = F.col("p")
    amount = F.concat(((F.col("page_id") + p * p) % 100).cast("string"), F.when(p % 2 == 0, ".").otherwise(","), (p % 7).cast("string"))
    text = F.when(p % 40 == 0, F.when(p % 80 == 0, "Area").otherwise("Extent :")).when(p % 3 == 0, F.col("word")).otherwise(amount)
    return words.select("page_id", (F.col("page_id") * 1000000 + p).alias("block_id"), p.alias("block_number"), text.alias("text"), F.lit(70.0).alias("confidence"), box(p % 5 * 12, p * 14, F.lit(60), F.lit(12)).alias("bbox"))


@register("x6_l6_area_columns", rf"""WITH w AS (SELECT doc_id AS page_id, unnest(string_split(coalesce(text, ''), ' ')) AS word, generate_subscripts(string_split(coalesce(text, ''), ' '), 1) - 1 AS p FROM documents),
 k AS (SELECT page_id, p, page_id * 1000000 + p AS block_id, p % 5 * 12 AS x, p * 14 AS y, p % 40 = 0 AS header, CASE WHEN p % 3 = 0 THEN word ELSE ((page_id + p * p) % 100) || CASE WHEN p % 2 = 0 THEN '.' ELSE ',' END || (p % 7) END AS text FROM w),
 v AS (SELECT *, {squeezed('text')} AS value FROM k WHERE NOT header), g AS (SELECT * FROM v WHERE regexp_full_match(value, '[0-9]+([.,][0-9]+)?') AND replace(value, ',', '.')::DOUBLE > 0),
 j AS (SELECT g.block_id, value, row_number() OVER (PARTITION BY h.block_id ORDER BY g.y, g.x, g.p) AS rn FROM k h JOIN g ON h.page_id = g.page_id AND g.p BETWEEN h.p + 1 AND h.p + 30 AND g.y - (h.y + 12) BETWEEN 1 AND 280 WHERE h.header)
 SELECT block_id AS evidence_block_id, value FROM j WHERE rn <= 10""", "documents")
def x6_columns(docs):
    return extract.extract_area_rows(extract.in_reading_order(columns_of_numbers(docs))).select("evidence_block_id", "value")


def _numbers_below(docs):
    own = blocks_of(docs)
    headers = own.filter(F.lower(F.trim("text")) == "khata no")
    values = own.filter(F.col("text").rlike("^[0-9]+/[0-9]+$"))
    return extract.top_below(extract.values_below(headers, values, 260, 240), 2).select(F.col("h.block_id").alias("header"), "block_id")


@register("j7_values_below", b(""", h AS (SELECT * FROM blocks WHERE lower(trim(text)) = 'khata no'), g AS (SELECT * FROM blocks WHERE regexp_matches(text, '^[0-9]+/[0-9]+$')),
 j AS (SELECT h.block_id AS header, g.block_id, row_number() OVER (PARTITION BY h.block_id ORDER BY g.y, g.x, g.block_number) AS rn FROM h JOIN g ON h.page_id = g.page_id AND g.y > h.y + h.height AND g.y - (h.y + h.height) <= 260 AND g.x BETWEEN h.x - 20 AND h.x + greatest(h.width, 240) + 40)
 SELECT header, block_id FROM j WHERE rn <= 2"""), "documents")
def j7(docs):
    return _numbers_below(docs)


# A block's text, cut at its first separator.
CUT = rf"""x AS (SELECT block_id, {squeezed('text')} AS c FROM blocks), y AS (SELECT *, strpos(translate(c, '|/-', ':::'), ':') AS cut FROM x),
 z AS (SELECT block_id, lower(replace(substr(c, 1, cut - 1), ' ', '')) AS label, trim(substr(c, cut + 1)) AS rest FROM y WHERE cut > 0)"""


@register("x3_extract_inline_survey", b(rf""", {CUT} SELECT block_id AS evidence_block_id, 'survey_number' AS field_name, rest AS value FROM z WHERE label IN ({tight_list(P.INLINE_LABELS['survey_number'])})
 AND len(list_filter(string_split(rest, '/'), lambda part: NOT regexp_full_match(trim(part), '[0-9]+'))) = 0"""), "documents")
def x3(docs):
    own = extract.extract_inline(extract.in_reading_order(blocks_of(docs)))
    return own.filter("field_name = 'survey_number'").select("evidence_block_id", "field_name", "value")


@register("e2_own_callbacks", b(rf""", {CUT}, s AS (SELECT block_id, 'survey_number' AS field_name, rest AS value, replace(rest, '/', '-') AS normalized_value FROM z WHERE label IN ({tight_list(P.INLINE_LABELS['survey_number'])})
 AND len(list_filter(string_split(rest, '/'), lambda part: NOT regexp_full_match(trim(part), '[0-9]+'))) = 0 AND NOT ends_with(rest, '/0')),
 v AS (SELECT block_id, 'village' AS field_name, {squeezed('rest')} AS value FROM z WHERE label IN ({tight_list(P.INLINE_LABELS['village'])}))
 SELECT block_id AS evidence_block_id, * EXCLUDE (block_id) FROM (SELECT * FROM s UNION ALL SELECT *, substr(replace(value, ' ', '_'), 1, 12) FROM v WHERE length(value) BETWEEN 30 AND 60)"""), "documents")
def e2(docs):
    """Two fields with validators and normalisers of the caller's own in place of the preset's."""
    normalize = {"survey_number": lambda v: F.translate(v, "/", "-"), "village": lambda v: F.substring(F.translate(v, " ", "_"), 1, 12)}
    check = {"survey_number": lambda v: ~v.endswith("/0"), "village": lambda v: F.length(v).between(30, 60)}
    own = extract.extract_inline(extract.in_reading_order(blocks_of(docs)), normalize=normalize, validate=check)
    return own.filter(F.col("field_name").isin(*check)).select("evidence_block_id", "field_name", "value", "normalized_value")


# Every field as it stands on a form of its own, with the label of its name.
FORM_LABELS = {"village": "Village", "taluka": "Tehsil Name", "district": "Dist", "survey_number": "Gat No", "khata_number": "Account No", "area": "Extent", "mutation": "Ferfar No", "registration": "Document No", "owner": "Holder Name"}
# UNIT: an area may lose its unit. SUSPECT: numbers of entries that read like labels are kept.
FORM_SQL = rf""", f AS (SELECT field_id, CASE WHEN field_name = 'registration' AND run_id % 2 = 0 THEN 'classification' ELSE field_name END AS field_name, {squeezed("coalesce(value, '')")} AS c FROM v_fields),
 g AS (SELECT *, CASE WHEN field_name = 'area' AND UNIT THEN trim(regexp_replace(c, ' ha$', '')) ELSE c END AS v FROM f),
 h AS (SELECT field_id, field_name, v AS value, lower(v) AS n FROM g WHERE v <> '')
 SELECT field_id AS page_id, field_name, value FROM h WHERE CASE field_name WHEN 'survey_number' THEN regexp_full_match(value, '[0-9]+( */ *[0-9]+)*') WHEN 'khata_number' THEN regexp_full_match(value, '[0-9]+')
 WHEN 'area' THEN coalesce(try_cast(replace(value, ',', '.') AS DOUBLE), 0) > 0 WHEN 'mutation' THEN SUSPECT OR n NOT IN ('name', 'number', 'no') WHEN 'registration' THEN SUSPECT OR n NOT IN ('name', 'number', 'no') ELSE n NOT IN ('name', 'number', 'no') AND regexp_matches(value, '[A-Za-z]') END"""


def _forms(fields):
    """(page_id, name, label, value): a page a field; of even runs, registrations are classifications."""
    name = F.when((F.col("field_name") == "registration") & (F.col("run_id") % 2 == 0), "classification").otherwise(F.col("field_name"))
    labels = F.create_map(*[F.lit(x) for kv in (FORM_LABELS | {"classification": "Land Use"}).items() for x in kv])
    return fields.select(F.col("field_id").alias("page_id"), name.alias("name"), "value").withColumn("label", labels[F.col("name")])


@register("x3_extract_inline_fields", FORM_SQL.replace("UNIT", "true").replace("SUSPECT", "false"), "v_fields")
def x3_fields(fields):
    text = F.concat("label", F.lit(" : "), F.coalesce("value", F.lit("")))
    own = _forms(fields).select("page_id", F.lit(1).alias("block_id"), F.lit(0).alias("block_number"), text.alias("text"), F.lit(80.0).alias("confidence"), box(F.lit(0), F.lit(0), F.lit(300), F.lit(20)).alias("bbox"))
    return extract.extract_inline(extract.in_reading_order(own)).select("page_id", "field_name", "value")


@register("x4_extract_adjacent_fields", FORM_SQL.replace("UNIT", "false").replace("SUSPECT", "true") + " AND field_name <> 'owner'", "v_fields")
def x4_fields(fields):
    """Owners have no adjacent labels; they stand below their headers."""
    two = F.posexplode(F.array("label", "value")).alias("pos", "text")
    own = _forms(fields).select("page_id", two).select("page_id", F.col("pos").alias("block_id"), F.col("pos").alias("block_number"), "text", F.lit(80.0).alias("confidence"), box(F.col("pos") * 400, F.lit(0), F.lit(300), F.lit(20)).alias("bbox"))
    return extract.extract_adjacent(extract.in_reading_order(own)).select("page_id", "field_name", "value")


@register("x4_extract_adjacent_survey", b(r""", o AS (SELECT *, lead(struct_pack(id := block_id, t := text, x := x, y := y, h := height)) OVER (PARTITION BY page_id ORDER BY y, x, block_number) AS n FROM blocks),
 x AS (SELECT n.id AS evidence_block_id, regexp_replace(trim(regexp_replace(n.t, '\s+', ' ', 'g')), '^[ .,:;|/\-]+|[ .,:;|/\-]+$', '', 'g') AS value FROM o WHERE lower(trim(text)) = 'survey no' AND n.x - (x + width) BETWEEN 0 AND 1400 AND abs(n.y + n.h / 2 - (y + height / 2)) <= greatest(18.0, 0.9 * least(height, n.h)))
 SELECT * FROM x WHERE regexp_matches(value, '^[0-9]+(\s*/\s*[0-9]+)*$')"""), "documents")
def x4(docs):
    own = extract.extract_adjacent(extract.in_reading_order(blocks_of(docs)))
    return own.filter("field_name = 'survey_number'").select("evidence_block_id", "value")


@register("x5_owner_rows", None, "documents")
def x5(docs):
    return extract.extract_owner_rows(extract.in_reading_order(blocks_of(docs)))


@register("j8_w8_x7_table_fields", None, "documents")
def x7(docs):
    return extract.extract_table_fields(extract.in_reading_order(blocks_of(docs)))


@register("l8_u1_x8_extract_fields", None, "documents")
def x8(docs):
    return extract.reading_order(extract.extract_fields(blocks_of(docs)))


@register("j13_link_evidence", None, "documents")
def j13(docs):
    own = blocks_of(docs)
    return extract.link_evidence(extract.extract_inline(extract.in_reading_order(own)), own)


@register("x9_extract_documents", None, "documents")
def x9(docs):
    pages = docs.select(F.col("doc_id").alias("page_id"), (F.col("doc_id") % 50).alias("document_id"))
    made = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(s).alias("status")) for k, s in ((0, "COMPLETED"), (1, "FAILED"))])
    vruns = pages.select("page_id", F.explode(made).alias("r")).select("page_id", (F.col("page_id") * 2 + F.col("r.k")).alias("run_id"), "r.status", F.col("r.k").alias("created_at"))
    blocks = blocks_of(docs).withColumn("run_id", F.col("page_id") * 2)
    fields, per = extract.extract_documents(pages, vruns, blocks)
    return per.join(fields.groupBy("run_id").agg(F.count(F.lit(1)).alias("n_fields")), "run_id", "left")


# Every block; no SQL, as DuckDB's edit distance counts bytes.
@register("j9_label_scores", None, "documents")
def j9(docs):
    s = extract.score_headers(blocks_of(docs), {"holder_name": ("owner name", "holder name")}, least=0.3)
    return s.filter("header_score >= 0.3").select("block_id", "label", F.round("header_score", 9).alias("score"))


@register("n11_label_score", None, "v_fields")
def n11(fields):
    return fields.select("field_id", label_score(T.normalize_label("value"), F.lit("owner name")).alias("score"))


SIGNALS = {"GPL": (("general public license", 8), ("gnu", 3), ("version 3", 2)), "APACHE": (("apache license", 10), ("version 2.0", 2)), "RESERVED": (("all rights reserved", 7),), "COMMON": (("the", 3), ("and", 2), ("licensed", 2))}
WEIGHT = {k: " + ".join(f"CASE WHEN contains(n, '{p}') THEN {w} ELSE 0 END" for p, w in v) for k, v in SIGNALS.items()}


@register("x1_classify", "WITH t AS (SELECT doc_id, trim(regexp_replace(lower(coalesce(text, '')), '\\s+', ' ', 'g')) AS n FROM documents), s AS (SELECT doc_id, " + ", ".join(f"{w} AS {k}" for k, w in WEIGHT.items()) + " FROM t), m AS (SELECT *, greatest(GPL, APACHE, RESERVED, COMMON) AS m FROM s) SELECT doc_id, CASE WHEN m < 7 THEN 'UNKNOWN' WHEN GPL = m THEN 'GPL' WHEN APACHE = m THEN 'APACHE' WHEN RESERVED = m THEN 'RESERVED' ELSE 'COMMON' END AS document_type, CASE WHEN m < 7 THEN least(100.0, m * 8.0) ELSE least(98.0, 55.0 + m * 4.0) END::DOUBLE AS class_confidence FROM m", "documents")
def x1(docs):
    return extract.classify(docs, SIGNALS).select("doc_id", "document_type", F.col("class_confidence").cast("double").alias("class_confidence"))


@register("x2_detect_language", r"""WITH c AS (SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[\x{C0}-\x{FF}]')) AS a, len(regexp_extract_all(coalesce(text, ''), '[A-Za-z]')) AS b FROM documents)
 SELECT doc_id, CASE WHEN a + b = 0 THEN 'unknown' WHEN a::DOUBLE / (a + b) >= 0.35 AND b::DOUBLE / (a + b) >= 0.08 THEN 'both' WHEN a::DOUBLE / (a + b) >= 0.55 THEN 'accented' WHEN b::DOUBLE / (a + b) >= 0.55 THEN 'plain' ELSE 'both' END AS script FROM c""", "documents")
def x2(docs):
    return docs.select("doc_id", extract.detect_language(F.col("text"), "[\\u00C0-\\u00FF]", "[A-Za-z]", ("accented", "plain", "both")).alias("script"))


def words_of(docs):
    w = docs.select(F.col("doc_id").alias("page_id"), F.posexplode(F.split(F.coalesce("text", F.lit("")), " ")).alias("pos", "text"))
    p = F.col("pos")
    conf = F.when(p % 13 == 0, "-1").when(p % 17 == 0, "n/a").otherwise(((F.col("page_id") * 3 + p) % 97).cast("string"))
    cols = {"block_num": F.floor(p / 40).cast("int"), "par_num": F.floor(p / 24).cast("int"), "line_num": F.floor(p / 8).cast("int"), "word_num": p % 8, "left": (p % 8) * 60, "top": F.floor(p / 8).cast("int") * 20, "width": 10 + F.length("text") % 50, "height": 10 + p % 7, "conf": conf}
    return w.select("page_id", "text", *[c.alias(n) for n, c in cols.items()])


WORDS = """w AS (SELECT doc_id AS page_id, unnest(string_split(coalesce(text, ''), ' ')) AS text, generate_subscripts(string_split(coalesce(text, ''), ' '), 1) - 1 AS pos FROM documents),
ww AS (SELECT page_id, text, pos // 40 AS block_num, pos // 24 AS par_num, pos // 8 AS line_num, pos % 8 AS word_num, (pos % 8) * 60 AS l, pos // 8 * 20 AS t, 10 + length(text) % 50 AS wd, 10 + pos % 7 AS ht, CASE WHEN pos % 13 = 0 THEN -1 WHEN pos % 17 = 0 THEN -1 ELSE (page_id * 3 + pos) % 97 END AS conf FROM w),
ok AS (SELECT * FROM ww WHERE trim(text) <> '' AND conf >= 0)"""


@register("s4_usable_words", f"WITH {WORDS} SELECT page_id, count(*) AS words, sum(conf)::DOUBLE AS conf FROM ok GROUP BY 1", "documents")
def s4(docs):
    return readers.usable_words(words_of(docs)).groupBy("page_id").agg(F.count(F.lit(1)).alias("words"), F.sum("conf").alias("conf"))


@register("a8_assemble_lines", f"WITH {WORDS} SELECT page_id, block_num, par_num, line_num, string_agg(text, ' ' ORDER BY word_num) AS text, avg(conf) AS confidence, min(l) AS x, min(t) AS y, max(l + wd) - min(l) AS width, max(t + ht) - min(t) AS height FROM ok GROUP BY 1, 2, 3, 4", "documents")
def a8(docs):
    # Documents are dealt by their ids before they become words, so that the words of a line are in one task already and none is shuffled.
    return metrics.assemble_lines(readers.usable_words(words_of(docs.select("doc_id", "text").repartition("doc_id"))))


@register("a9_assemble_text", b("SELECT page_id, md5(string_agg(text, chr(10) ORDER BY block_number)) AS digest, avg(confidence) AS confidence FROM blocks GROUP BY 1"), "documents")
def a9(docs):
    return metrics.assemble_text(blocks_of(docs)).select("page_id", F.md5("text").alias("digest"), "confidence")


@register("w9_best_pass", r"""WITH p AS (SELECT doc_id AS page_id, k AS pass_no, CASE k WHEN 0 THEN 4 WHEN 1 THEN 6 ELSE 11 END AS psm, CASE WHEN k = 2 THEN 'gray' ELSE 'plain' END AS variant, ((doc_id * 7 + k * 11) % 9)::DOUBLE AS confidence, CASE k WHEN 0 THEN text WHEN 1 THEN upper(text) || ' survey owner 0000' ELSE coalesce(text, '') || ' [[ ]] 7/12' END AS text FROM documents, range(3) r(k)),
 s AS (SELECT page_id, pass_no, confidence + 3 * len(list_filter(['गाव नमुना', '७/१२', '7/12', 'सर्वे', 'गट', 'खातेदार', 'फेरफार', 'जिल्हा', 'तालुका', 'village', 'survey', 'owner', 'property card', 'mutation'], lambda x: contains(lower(coalesce(text, '')), x))) + least(6.0, len(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9\x{900}-\x{97F}]')) / 500) + CASE WHEN psm = 4 THEN 1.0 ELSE 0.0 END + CASE WHEN variant = 'gray' THEN 0.5 ELSE 0.0 END - 0.08 * len(regexp_extract_all(coalesce(text, ''), '[\[\]{}]{2,}|[oO0]{4,}')) AS score FROM p)
 SELECT page_id, pass_no FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY score DESC, pass_no) AS rn FROM s) WHERE rn = 1""", "documents")
def w9(docs):
    k = F.col("k")
    p = docs.select("doc_id", "text", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("k"))
    text = F.when(k == 0, F.col("text")).when(k == 1, F.concat(F.upper("text"), F.lit(" survey owner 0000"))).otherwise(F.concat(F.coalesce("text", F.lit("")), F.lit(" [[ ]] 7/12")))
    p = p.select(F.col("doc_id").alias("page_id"), k.alias("pass_no"), F.when(k == 0, 4).when(k == 1, 6).otherwise(11).alias("psm"), F.when(k == 2, "gray").otherwise("plain").alias("variant"), ((F.col("doc_id") * 7 + k * 11) % 9).cast("double").alias("confidence"), text.alias("text"))
    return tables.best_pass(p).select("page_id", "pass_no")


@register("s1_admit_files", r"""WITH x AS (SELECT file_id, name, content_type, body, lower(regexp_extract(name, '\.([^./]+)$', 1)) AS ext FROM v_uploads)
 SELECT file_id, CASE WHEN name = '' THEN 'A filename is required.' WHEN ext NOT IN ('pdf', 'jpg', 'jpeg', 'png', 'tif', 'tiff') THEN 'Unsupported file extension.' WHEN content_type <> 'application/pdf' THEN 'Unsupported content type.' WHEN body = '' THEN 'Uploaded file is empty.'
 WHEN NOT CASE WHEN ext = 'pdf' THEN starts_with(body, '%PDF-') ELSE false END THEN 'File content does not match its format.' END AS reason FROM x""".replace("WITH x", ", x"), "v_uploads")
def s1(uploads):
    return readers.admit_files(uploads.withColumn("content", F.encode("body", "UTF-8"))).select("file_id", "reason")


@register("s2_content_hash", "SELECT page_id, sha256(html) AS sha256 FROM pages", "pages")
def s2(pages):
    return pages.select("page_id", readers.content_hash(F.encode("html", "UTF-8")).alias("sha256"))


@register("j5_new_or_existing", """SELECT file_id, CASE WHEN h IN (SELECT sha256(body) FROM v_incoming WHERE file_id % 3 = 0) THEN 'ALREADY_EXISTS' WHEN row_number() OVER (PARTITION BY h ORDER BY file_id) > 1 THEN 'DUPLICATE_IN_BATCH' ELSE 'NEW' END AS outcome FROM (SELECT file_id, sha256(body) AS h FROM v_incoming WHERE file_id % 3 <> 0)""", "v_incoming")
def j5(incoming):
    hashed = incoming.select("file_id", readers.content_hash(F.encode("body", "UTF-8")).alias("sha256"))
    return runs.split_new_existing(hashed.filter("file_id % 3 <> 0"), hashed.filter("file_id % 3 = 0")).select("file_id", "outcome")


@register("n21_clean_html", r"""SELECT doc_id AS table_id, trim(regexp_replace(replace(replace(regexp_replace(html, '(?i)<br\s*/?>', ' ', 'g'), '&#8377;', '₹'), '&amp;', '&'), '\s+', ' ', 'g')) AS text FROM v_grids""", "v_grids")
def n21(grids):
    return grids.select(F.col("doc_id").alias("table_id"), T.clean_html_cell("html").alias("text"))


def order_tables(lineitem):
    """A table an order: a heading over two columns, a row a line; the first line's flag spans two rows."""
    own = lineitem.groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_returnflag"))).alias("r"))
    flag = lambda x, i: F.when(i == 0, F.concat(F.lit('<td rowspan="2">'), x["l_returnflag"], F.lit("</td>"))).when(i == 1, "").otherwise(F.concat(F.lit("<td>&lt;"), x["l_returnflag"], F.lit("&gt;<br></td>")))
    row = lambda x, i: F.concat(F.lit("<tr><td>"), x["l_partkey"].cast("string"), F.lit("/"), x["l_linenumber"].cast("string"), F.lit("</td><td>"), x["l_suppkey"].cast("string"), F.lit("</td>"), flag(x, i), F.lit("</tr>"))
    head = "<table><tr><th>भूमापन क्रमांक</th><th colspan='2'>खाते क्रमांक</th></tr>"
    return own.select("doc_id", F.concat(F.lit(head), F.array_join(F.transform("r", row), ""), F.lit("</table>")).alias("html"))


LINES = """r AS (SELECT l_orderkey AS doc_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_returnflag) AS i, l_partkey || '/' || l_linenumber AS a, l_suppkey::VARCHAR AS b, l_returnflag AS f FROM lineitem)"""


@register("x10_html_cells", f"""WITH {LINES}, h AS (SELECT DISTINCT doc_id FROM r) SELECT doc_id, 0 AS row, 0 AS col, 'भूमापन क्रमांक' AS text FROM h UNION ALL SELECT doc_id, 0, c, 'खाते क्रमांक' FROM h, (VALUES (1), (2)) v(c) UNION ALL SELECT doc_id, i::INT, 0, a FROM r UNION ALL SELECT doc_id, i::INT, 1, b FROM r
 UNION ALL SELECT doc_id, i::INT, 2, CASE WHEN i = 1 THEN f WHEN i = 2 THEN lag(f) OVER (PARTITION BY doc_id ORDER BY i) ELSE '<' || f || '>' END FROM r""", "lineitem")
def x10(lineitem):
    return tables.html_table_cells(order_tables(lineitem)).select("doc_id", "row", "col", "text")


# The navigation lists of the pages as tables, a list entry a row, with an outer table around all of the page.
@register("x10_page_tables", r"""WITH p AS (SELECT page_id AS doc_id, unnest(regexp_extract_all(html, '(?s)<li>(.*?)</li>', 1)) AS li, generate_subscripts(regexp_extract_all(html, '(?s)<li>(.*?)</li>', 1), 1) - 1 AS row FROM pages)
 SELECT doc_id, 1 AS table_no, row::INT AS row, 0 AS col, trim(regexp_replace(regexp_replace(li, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS text FROM p""", "pages")
def x10_pages(pages):
    html = F.col("html")
    for old, new in (("<ul>", "<table>"), ("</ul>", "</table>"), ("<li>", "<tr><td>"), ("</li>", "</td></tr>")):
        html = F.replace(html, F.lit(old), F.lit(new))
    own = pages.select(F.col("page_id").alias("doc_id"), F.concat(F.lit("<TABLE class=page><tr><td>x</td>"), html, F.lit("</tr></TABLE>")).alias("html"))
    return tables.html_table_cells(own).filter("table_no = 1").select("doc_id", "table_no", "row", "col", "text")


@register("a18_table_summary", "SELECT l_orderkey AS doc_id, 1 AS tables, count(*) + 1 AS rows, 3 AS columns FROM lineitem GROUP BY 1", "lineitem")
def a18(lineitem):
    return tables.table_summary(tables.html_table_cells(order_tables(lineitem)))


@register("x11_w12_grid_lookup", f"WITH {LINES} SELECT doc_id, 'survey_gat_number' AS field, 1::DOUBLE AS header_score, a AS value FROM r WHERE i = 1 UNION ALL SELECT doc_id, 'account_number', 1::DOUBLE, b FROM r WHERE i = 1", "lineitem")
def x11(lineitem):
    own = tables.html_grid_lookup(order_tables(lineitem), {k: P.GRID_ALIASES[k] for k in ("survey_gat_number", "account_number")})
    return own.select("doc_id", "field", "header_score", "value")


@register("x12_header_row_lookup", f"WITH {LINES} SELECT doc_id, 'survey_gat_number' AS field, a AS value FROM r WHERE i = 1 UNION ALL SELECT doc_id, 'account_number', b FROM r WHERE i = 1", "lineitem")
def x12(lineitem):
    own = tables.html_header_row_lookup(order_tables(lineitem), {k: P.GRID_ALIASES[k] for k in ("survey_gat_number", "account_number")})
    return own.select("doc_id", "field", "value")


# What the seven fields of an order read, by field.
GRID_VALUES = {"survey_gat_number": "o_custkey || '/' || o_orderkey % 9", "sub_division": "(o_orderkey % 40)::VARCHAR", "account_number": "(o_custkey * 3)::VARCHAR", "land_tenure": "o_orderpriority", "holder_name": "'Holder ' || o_custkey % 70", "local_field_name": "'Plot ' || o_orderkey % 300", "cultivable_area": "(o_orderkey % 12) || '.' || o_custkey % 9"}
GRID_ROWS = " UNION ALL ".join(f"SELECT o_orderkey AS doc_id, '{k}' AS field, {v} AS value FROM orders" for k, v in GRID_VALUES.items())


def _grid_html(orders, place):
    """(doc_id, html) with the cells that ``place`` makes of a field's heading (the last of its aliases but for the survey number's) and its value."""
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    said = {"survey_gat_number": F.concat_ws("/", c, o % 9), "sub_division": (o % 40).cast("string"), "account_number": (c * 3).cast("string"), "land_tenure": F.col("o_orderpriority"), "holder_name": F.concat(F.lit("Holder "), c % 70), "local_field_name": F.concat(F.lit("Plot "), o % 300), "cultivable_area": F.concat_ws(".", o % 12, c % 9)}
    heads = {k: P.GRID_ALIASES[k][0 if k == "survey_gat_number" else -1] for k in said}
    row = lambda *cells: [F.lit("<tr>"), *[x for cell in cells for x in (F.lit("<td>"), F.lit(cell) if isinstance(cell, str) else cell, F.lit("</td>"))], F.lit("</tr>")]
    parts = [x for table in place(heads, said) for x in (F.lit("<table>"), *[y for r in table for y in row(*r)], F.lit("</table>"))]
    return spread(orders.select("o_orderkey", "o_custkey", "o_orderpriority")).select(o.alias("doc_id"), F.concat(*parts).alias("html"))


def _scattered(heads, said):
    """Four fields over their values, a holder to the right of its heading, a field's name two columns on and one row down, an area under a blank cell."""
    top = ("survey_gat_number", "sub_division", "account_number", "land_tenure")
    yield [[heads[k] for k in top], [said[k] for k in top]]
    yield [[heads["holder_name"], said["holder_name"]]]
    yield [[heads["local_field_name"], "", ""], ["", "", said["local_field_name"]]]
    yield [[heads["cultivable_area"]], [""], [said["cultivable_area"]]]


def _in_a_row(heads, said):
    """A title, all headings in one row, a blank row, the values."""
    yield [["7/12"], list(heads.values()), [""] * len(heads), list(said.values())]


@register("x11_w12_grid_all_fields", GRID_ROWS, "orders")
def x11_all(orders):
    return tables.html_grid_lookup(_grid_html(orders, _scattered)).select("doc_id", "field", "value")


@register("x12_header_row_all_fields", GRID_ROWS, "orders")
def x12_all(orders):
    return tables.html_header_row_lookup(_grid_html(orders, _in_a_row)).select("doc_id", "field", "value")


@register("x13_positional_fields", "SELECT doc_id, 'survey_number' AS field, n || '/' || doc_id % 9 AS value FROM v_grids UNION ALL SELECT doc_id, 'subdivision', (n * 3)::VARCHAR FROM v_grids UNION ALL SELECT doc_id, 'land_tenure', trim(tenure) || ' c' FROM v_grids", "v_grids")
def x13(grids):
    # Dealt to all tasks: the orders' one file is small, and their tables are much work.
    return tables.positional_fields(tables.html_table_cells(spread(grids.select("doc_id", "html")))).select("doc_id", "field", "value")


@register("w11_main_table", "SELECT DISTINCT l_orderkey AS doc_id, 1 AS table_no, 8 AS table_score FROM lineitem", "lineitem")
def w11(lineitem):
    own = order_tables(lineitem).withColumn("html", F.concat(F.lit("<table><tr><td>खाते क्रमांक</td></tr></table>"), "html"))
    return tables.main_table(tables.html_tables(own)).select("doc_id", "table_no", "table_score")


@register("x14_harvest", f"WITH {LINES} SELECT doc_id, 'survey_gat_number' AS field, a AS candidate FROM r WHERE i = 1 UNION ALL SELECT doc_id, 'sub_division', b FROM r WHERE i = 1 UNION ALL SELECT doc_id, 'land_tenure', f FROM r WHERE i = 1 UNION ALL SELECT DISTINCT doc_id, 'account_number', 'खाते क्रमांक' FROM r", "lineitem")
def x14(lineitem):
    return tables.harvest_candidates(tables.html_table_cells(order_tables(lineitem), beside=tables.HARVEST_LABELS))


# Truth of an order: its first part number and its customer; every third truth isn't among the candidates but in the text.
@register("x14_improved_match", f"""WITH {LINES}, t AS (SELECT doc_id, 'survey_gat_number' AS field, a AS v FROM r WHERE i = 1), k AS (SELECT *, doc_id % 3 AS k FROM t)
 SELECT doc_id, field, CASE k WHEN 0 THEN 1.0 WHEN 1 THEN 0.95 ELSE 0.0 END::DOUBLE AS score, k < 2 AS matched FROM k""", "lineitem")
def x14_match(lineitem):
    cells = tables.html_table_cells(order_tables(lineitem), beside=tables.HARVEST_LABELS)
    own = stored(tables.harvest_candidates(cells).filter("field = 'survey_gat_number'"))
    k = F.col("doc_id") % 3
    truth = own.select("doc_id", "field", F.col("candidate").alias("variant"))
    texts = own.select("doc_id", F.concat(F.lit("no. "), F.when(k == 1, F.regexp_replace("candidate", "[^0-9]", "")).otherwise("-"), F.lit(" of it")).alias("text"))
    return tables.improved_match(truth, own.filter(k == 0), texts).select("doc_id", "field", "score", "matched")


@register("w10_best_artifact", "SELECT image, file FROM (SELECT url AS image, page_id AS file, row_number() OVER (PARTITION BY regexp_extract(url, '[a-z]+\\.example', 0) ORDER BY page_id % 4 DESC, page_id % 3 DESC, page_id) AS rn FROM pages) WHERE rn = 1", "pages")
def w10(pages):
    own = pages.select(F.regexp_extract("url", "[a-z]+\\.example", 0).alias("image"), F.col("url"), F.col("page_id").alias("file"), (F.col("page_id") % 4).alias("n_fields"), (F.col("page_id") % 3).alias("n_tables"))
    return tables.best_artifact(own).select(F.col("url").alias("image"), "file")
