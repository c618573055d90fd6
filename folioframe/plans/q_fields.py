"""Queries on runs, fields, results, reviews and records."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioframe import presets as P
from folioframe.functions import text as T
from folioframe.functions.geometry import method_confidence, table_confidence, unit_confidence
from folioframe.operators import match, metrics, review, runs, validate
from folioframe.operators.store import stored
from folioframe.plans.views import frame, sql

QUERIES: dict = {}


def register(name: str, oracle: str | None, *views: str):
    """Registers a function of the frames of ``views``, in that order."""

    def wrap(f):
        QUERIES[name] = (lambda spark, sf_dir: f(*[frame(spark, sf_dir, v) for v in views]), sql(oracle, *views) if oracle else None)
        return f

    return wrap


LATEST = """latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY created_at DESC, run_id DESC) AS rn FROM v_runs WHERE status = 'COMPLETED') WHERE rn = 1)"""
LATEST_DONE = """latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY completed_at DESC NULLS LAST, created_at DESC, run_id DESC) AS rn FROM v_runs WHERE status = 'COMPLETED') WHERE rn = 1)"""


@register("latest_run_quality", f", {LATEST} SELECT document_id, count(*) AS n_fields, count(*) FILTER (validation_status <> 'PASS') AS to_review, avg(confidence) AS mean_confidence FROM v_fields WHERE run_id IN (SELECT run_id FROM latest) GROUP BY 1", "v_fields", "v_runs")
def latest_run_quality(fields, vruns):
    own = runs.only_latest(fields, vruns)
    return own.groupBy("document_id").agg(F.count(F.lit(1)).alias("n_fields"), F.count_if(F.col("validation_status") != "PASS").alias("to_review"), F.avg("confidence").alias("mean_confidence"))


@register("w1_latest_run", f", {LATEST} SELECT document_id, run_id, created_at FROM latest", "v_runs")
def w1(vruns):
    return runs.latest_run(vruns).select("document_id", "run_id", "created_at")


@register("w2_latest_completed", f", {LATEST_DONE} SELECT document_id, run_id, completed_at FROM latest", "v_runs")
def w2(vruns):
    return runs.latest_run(vruns, order="completed").select("document_id", "run_id", "completed_at")


@register("w3_latest_any_status", "SELECT document_id, run_id, status FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY created_at DESC, run_id DESC) AS rn FROM v_runs) WHERE rn = 1", "v_runs")
def w3(vruns):
    return runs.latest_run(vruns, status=None).select("document_id", "run_id", "status")


FIRSTS = """firsts AS (SELECT run_id, field_name, v FROM (SELECT *, row_number() OVER (PARTITION BY run_id, field_name ORDER BY created_at, field_id) AS rn FROM (SELECT *, trim(coalesce(value, '')) AS v FROM v_fields) WHERE v <> '') WHERE rn = 1)"""


@register("w6_first_values", f", {FIRSTS} SELECT run_id, max(v) FILTER (field_name = 'village') AS village, max(v) FILTER (field_name = 'taluka') AS taluka, max(v) FILTER (field_name = 'district') AS district FROM firsts WHERE field_name IN ('village', 'taluka', 'district') GROUP BY 1", "v_fields")
def w6(fields):
    return runs.first_values(fields, ("village", "taluka", "district"))


@register("w7_dedup_strongest", "SELECT run_id, field_name, value, field_id, confidence FROM (SELECT *, row_number() OVER (PARTITION BY run_id, field_name, value ORDER BY confidence DESC NULLS LAST, page_number, field_id) AS rn FROM v_fields) WHERE rn = 1", "v_fields")
def w7(fields):
    own = fields.withColumns({"normalized_value": F.col("value"), "position": F.col("page_number")})
    return runs.dedup_strongest(own, "run_id").select("run_id", "field_name", "value", "field_id", "confidence")


@register("j1_lineage_join", "SELECT f.field_id, p.page_number, d.original_filename FROM v_fields f JOIN v_pages p ON f.page_id = p.page_id JOIN v_documents d ON p.document_id = d.document_id", "v_fields", "v_pages", "v_documents")
def j1(fields, pages, docs):
    return runs.with_document(fields.select("field_id", "page_id"), pages, docs.drop("status", "created_at")).select("field_id", "page_number", "original_filename")


@register("j2_results_with_fields", "SELECT r.field_id, f.field_name, r.rule_name, r.status FROM v_results r JOIN v_fields f ON r.field_id = f.field_id", "v_results", "v_fields")
def j2(results, fields):
    return runs.results_with_fields(results.drop("field_name"), fields).select("field_id", "field_name", "rule_name", "status")


@register("j3_audit_with_document", "SELECT a.action_id, a.action, d.original_filename FROM v_actions a JOIN v_documents d ON a.document_id = d.document_id", "v_actions", "v_documents")
def j3(actions, docs):
    return runs.audit_with_document(actions, docs.select("document_id", "original_filename")).select("action_id", "action", "original_filename")


@register("j4_fields_of_latest_run", f", {LATEST_DONE} SELECT field_id, run_id, document_id FROM v_fields WHERE run_id IN (SELECT run_id FROM latest)", "v_fields", "v_runs")
def j4(fields, vruns):
    return runs.only_latest(fields, vruns, order="completed").select("field_id", "run_id", "document_id")


@register("a1_workspace_summary", f""", {LATEST_DONE}, d AS (SELECT count(*) AS total_documents, count(*) FILTER (upper(status) IN ('PROCESSED', 'VALIDATED', 'COMPLETED', 'VERIFIED', 'VALIDATION_REQUIRED')) AS processed_documents,
 count(*) FILTER (upper(status) IN ('UPLOADED', 'PENDING', 'PROCESSING', 'OCR_PROCESSING', 'EXTRACTING', 'VALIDATING')) AS pending_documents, count(*) FILTER (upper(status) IN ('FAILED', 'ERROR')) AS failed_documents FROM v_documents),
 f AS (SELECT count(*) FILTER (validation_status IN ('REVIEW', 'WARNING', 'FLAGGED')) AS fields_needing_review, count(*) AS total_extracted_fields, avg(confidence) AS average_confidence FROM v_fields WHERE run_id IN (SELECT run_id FROM latest)),
 r AS (SELECT count(*) FILTER (status = 'PASS') AS validation_passed, count(*) FILTER (status IN ('REVIEW', 'WARNING')) AS validation_review, count(*) FILTER (status IN ('FAIL', 'FAILED')) AS validation_failed FROM v_results WHERE run_id IN (SELECT run_id FROM latest))
 SELECT * FROM d, f, r""", "v_documents", "v_fields", "v_runs", "v_results")
def a1(docs, fields, vruns, results):
    return metrics.workspace_summary(docs, fields, vruns, results, vruns)


@register("a2_status_counts", "SELECT upper(status) AS status, count(*) AS n FROM v_documents GROUP BY 1", "v_documents")
def a2(docs):
    return metrics.status_counts(docs)


@register("a3_validation_summary", """SELECT l.document_id, count(*) AS total, count(*) FILTER (r.status = 'PASS') AS passed, count(*) FILTER (r.status = 'WARNING') AS warnings, count(*) FILTER (r.status = 'REVIEW') AS review
 FROM v_results r JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY created_at DESC, run_id DESC) AS rn FROM v_runs) WHERE rn = 1) l ON r.run_id = l.run_id GROUP BY 1""", "v_results", "v_runs")
def a3(results, vruns):
    return metrics.validation_summary(results.drop("document_id"), vruns)


@register("a4_document_metrics", """SELECT document_id, count(*) FILTER (validation_status = 'PASS') AS pass_count, count(*) FILTER (validation_status IN ('WARNING', 'REVIEW', 'FAIL')) AS review_count,
 avg(greatest(0.0, least(1.0, CASE WHEN confidence > 1 THEN confidence / 100 ELSE confidence END))) FILTER (confidence IS NOT NULL) AS mean_confidence FROM v_fields GROUP BY 1""", "v_fields")
def a4(fields):
    return metrics.document_metrics(fields)


@register("a5_run_confidence", "SELECT run_id, avg(confidence) AS confidence FROM v_fields GROUP BY 1", "v_fields")
def a5(fields):
    return runs.run_confidence(fields)


@register("a6_strongest_status", """SELECT f.field_id, CASE max(CASE r.status WHEN 'WARNING' THEN 1 WHEN 'REVIEW' THEN 2 ELSE 0 END) WHEN 1 THEN 'WARNING' WHEN 2 THEN 'REVIEW' ELSE 'PASS' END AS validation_status
 FROM v_fields f LEFT JOIN v_results r ON f.field_id = r.field_id GROUP BY 1""", "v_results", "v_fields")
def a6(results, fields):
    return validate.strongest_status(results, fields)


@register("a7_document_status", """SELECT coalesce(o.document_id, r.document_id) AS document_id, CASE WHEN coalesce(failed, false) THEN 'FAILED' WHEN coalesce(bad, false) THEN 'VALIDATION_REQUIRED' ELSE 'PROCESSED' END AS document_status
 FROM (SELECT document_id, bool_or(status = 'FAILED') AS failed FROM v_runs GROUP BY 1) o FULL JOIN (SELECT document_id, bool_or(status IN ('REVIEW', 'WARNING', 'FAIL')) AS bad FROM v_results GROUP BY 1) r ON o.document_id = r.document_id""", "v_results", "v_runs")
def a7(results, vruns):
    return metrics.document_status(results, vruns)


@register("a10_duplicate_consistency", """, u AS (SELECT *, CASE WHEN field_name = 'khata_number' THEN regexp_replace(n, '\\s+', '', 'g') ELSE n END AS k FROM (SELECT *, trim(regexp_replace(lower(v), '[\\s,;:]+', ' ', 'g')) AS n FROM
  (SELECT *, trim(coalesce(value, '')) AS v FROM v_fields WHERE field_name IN ('village', 'taluka', 'district', 'khata_number')) WHERE v <> '')),
 c AS (SELECT document_id, field_name, k, arg_min(field_id, (created_at, field_id)) AS field_id, arg_min(v, (created_at, field_id)) AS value, min((created_at, field_id)) AS ord, count(*) AS n, avg(confidence) AS confidence FROM u GROUP BY 1, 2, 3),
 w AS (SELECT *, count(*) OVER p AS kk, sum(n) OVER p AS nn, string_agg(value || ' (' || n || CASE WHEN n = 1 THEN ' occurrence)' ELSE ' occurrences)' END, '; ' ORDER BY ord) OVER (PARTITION BY document_id, field_name) AS shown FROM c WINDOW p AS (PARTITION BY document_id, field_name))
 SELECT field_id, document_id, field_name, 'consistency_' || field_name || CASE WHEN kk = 1 THEN '_duplicates' ELSE '_conflict' END AS rule_name, CASE WHEN kk = 1 THEN 'PASS' ELSE 'REVIEW' END AS status,
 CASE WHEN kk = 1 THEN 'All ' || nn || ' extracted ' || replace(field_name, '_', ' ') || ' values are consistent.' ELSE 'Conflicting ' || replace(field_name, '_', ' ') || ' values were extracted: ' || shown || '. Human review is required to determine the correct value.' END AS message, confidence FROM w WHERE nn >= 2""", "v_fields")
def a10(fields):
    return validate.duplicate_consistency(fields)


@register("v10_duplicate_consistency_fuzzy", None, "v_fields")
def v10(fields):
    return validate.duplicate_consistency_fuzzy(fields)


@register("a16_pipeline_summary", """SELECT p.document_id, p.pages, coalesce(f.fields, 0) AS fields, coalesce(r.results, 0) AS results, coalesce(r.needs_review, false) AS needs_review FROM (SELECT document_id, count(DISTINCT page_id) AS pages FROM v_pages GROUP BY 1) p
 LEFT JOIN (SELECT document_id, count(*) AS fields FROM v_fields GROUP BY 1) f ON p.document_id = f.document_id LEFT JOIN (SELECT document_id, count(*) AS results, bool_or(status <> 'PASS') AS needs_review FROM v_results GROUP BY 1) r ON p.document_id = r.document_id""", "v_pages", "v_fields", "v_results")
def a16(pages, fields, results):
    return metrics.pipeline_summary(pages, fields, results)


@register("a19_review_summary", f", {LATEST_DONE} SELECT count(*) AS total, count(*) FILTER (validation_status = 'REVIEW') AS review_required FROM v_fields WHERE validation_status IN ('REVIEW', 'WARNING', 'FLAGGED') AND run_id IN (SELECT run_id FROM latest)", "v_fields", "v_runs")
def a19(fields, vruns):
    return metrics.review_summary(review.review_queue(fields, vruns))


@register("a20_stage_progress", """SELECT d.document_id, 'complete' AS document, CASE WHEN coalesce(n, 0) > 0 THEN 'complete' ELSE 'pending' END AS ocr, CASE WHEN coalesce(n, 0) > 0 THEN 'complete' ELSE 'pending' END AS extraction, coalesce(n, 0) AS n_fields,
 CASE WHEN v.document_id IS NULL THEN 'pending' WHEN coalesce(bad, 0) > 0 THEN 'warning' ELSE 'complete' END AS validation FROM v_documents d LEFT JOIN (SELECT document_id, count(*) AS n, count(*) FILTER (validation_status IN ('WARNING', 'REVIEW', 'FAIL')) AS bad FROM v_fields GROUP BY 1) f ON d.document_id = f.document_id
 LEFT JOIN (SELECT DISTINCT document_id FROM v_runs WHERE status <> 'FAILED') v ON d.document_id = v.document_id""", "v_documents", "v_fields", "v_runs")
def a20(docs, fields, vruns):
    return metrics.stage_progress(docs, fields, vruns.filter("status <> 'FAILED'"))


@register("l1_recent_documents", "SELECT document_id, created_at FROM v_documents ORDER BY created_at DESC, document_id DESC LIMIT 5", "v_documents")
def l1(docs):
    return metrics.recent(docs).select("document_id", "created_at")


@register("l2_notifications", f""", {LATEST_DONE} SELECT field_id, validation_status AS severity, CASE validation_status WHEN 'REVIEW' THEN 'Field requires review' ELSE 'Field has a validation warning' END AS title FROM v_fields WHERE validation_status IN ('REVIEW', 'WARNING', 'FLAGGED')
 AND run_id IN (SELECT run_id FROM latest) ORDER BY created_at DESC, field_id LIMIT 50""", "v_fields", "v_runs")
def l2(fields, vruns):
    return review.notifications(review.review_queue(fields, vruns)).select("field_id", "severity", "title")


@register("l3_audit_feed", "SELECT action_id, action FROM v_actions ORDER BY ts DESC, action_id DESC LIMIT 200", "v_actions")
def l3(actions):
    return metrics.audit_feed(actions).select("action_id", "action")


@register("l4_audit_history", "SELECT action_id, action FROM v_actions WHERE document_id = 7", "v_actions")
def l4(actions):
    return metrics.audit_history(actions, 7).select("action_id", "action")


@register("l5_document_fields", "SELECT document_id, field_id, row_number() OVER (PARTITION BY document_id ORDER BY page_number, created_at, field_id) AS place FROM v_fields", "v_fields")
def l5(fields):
    return metrics.document_fields(fields).select("document_id", "field_id", "place")


@register("l9_document_pages", "SELECT document_id, page_id, row_number() OVER (PARTITION BY document_id ORDER BY page_number, page_id) AS place FROM v_pages", "v_pages")
def l9(pages):
    return metrics.document_pages(pages).select("document_id", "page_id", "place")


@register("r6_review_queue", f", {LATEST_DONE} SELECT field_id, validation_status FROM v_fields WHERE validation_status IN ('REVIEW', 'WARNING', 'FLAGGED') AND run_id IN (SELECT run_id FROM latest)", "v_fields", "v_runs")
def r6(fields, vruns):
    return review.review_queue(fields, vruns).select("field_id", "validation_status")


VALID_ACTIONS = "ok AS (SELECT * FROM v_actions WHERE action <> 'EDIT' OR trim(coalesce(new_value, '')) <> '')"
DECIDED = "CASE {a} WHEN 'ACCEPT' THEN 'ACCEPTED' WHEN 'VERIFY' THEN 'VERIFIED' WHEN 'FLAG' THEN 'FLAGGED' WHEN 'REJECT' THEN 'REJECTED' WHEN 'EDIT' THEN 'EDITED' END"


@register("r4_apply_reviews", f""", {VALID_ACTIONS}, l AS (SELECT field_id, arg_max(action, (ts, action_id)) AS a, arg_max(trim(new_value), (ts, action_id)) FILTER (action = 'EDIT') AS v FROM ok GROUP BY 1)
 SELECT f.field_id, coalesce(v, value) AS value, coalesce(lower(v), normalized_value) AS normalized_value, coalesce({DECIDED.format(a='a')}, validation_status) AS validation_status FROM v_review_fields f LEFT JOIN l ON f.field_id = l.field_id""", "v_review_fields", "v_actions")
def r4(fields, actions):
    return review.apply_reviews(fields, actions)[0]


@register("r4_audit_rows", f""", {VALID_ACTIONS}, j AS (SELECT ok.*, f.value AS start, CASE WHEN action = 'EDIT' THEN trim(new_value) END AS e FROM ok JOIN v_review_fields f ON ok.field_id = f.field_id)
 SELECT action_id, field_id, action, coalesce(last_value(e IGNORE NULLS) OVER (PARTITION BY field_id ORDER BY ts, action_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), start) AS old_value,
 coalesce(last_value(e IGNORE NULLS) OVER (PARTITION BY field_id ORDER BY ts, action_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), start) AS new_value, {DECIDED.format(a='action')} AS decision, reason, ts FROM j""", "v_review_fields", "v_actions")
def r4_audit(fields, actions):
    return review.audit_rows(fields, actions)


@register("r5_review_policy", """, a AS (SELECT action_id, CASE action WHEN 'ACCEPT' THEN ' approve' WHEN 'REJECT' THEN 'REJECT' WHEN 'EDIT' THEN 'CORRECT' ELSE action END AS action, new_value, reason FROM v_actions), u AS (SELECT *, upper(trim(action)) AS x FROM a),
 e AS (SELECT *, CASE WHEN x NOT IN ('APPROVE', 'CORRECT', 'REJECT') THEN 'Unsupported review action: ' || x WHEN x = 'CORRECT' AND trim(coalesce(new_value, '')) = '' THEN 'A corrected value is required for CORRECT.' END AS error FROM u)
 SELECT action_id, CASE WHEN error IS NULL THEN x <> 'REJECT' END AS accepted, CASE WHEN error IS NULL THEN true END AS requires_revalidation, CASE WHEN error IS NULL THEN true END AS audit_required,
 CASE WHEN error IS NULL THEN coalesce(nullif(reason, ''), CASE x WHEN 'APPROVE' THEN 'Reviewer approved the extracted value.' WHEN 'CORRECT' THEN 'Reviewer corrected the extracted value.' ELSE 'Reviewer rejected the extracted value.' END) END AS reason, error FROM e""", "v_actions")
def r5(actions):
    a = F.col("action")
    own = actions.withColumn("action", F.when(a == "ACCEPT", " approve").when(a == "EDIT", "CORRECT").otherwise(a))
    return review.review_policy(own.select("action_id", "action", "new_value", "reason")).select("action_id", "accepted", "requires_revalidation", "audit_required", "reason", "error")


@register("t3_review_counts", """SELECT time_bucket(INTERVAL 30 SECOND, ts) AS start, action AS status, count(*) AS n FROM v_actions GROUP BY 1, 2""", "v_actions")
def t3(actions):
    return actions.groupBy(F.window("ts", "30 seconds"), F.col("action").alias("status")).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "status", "n")


# The batch twins of streams: counts by current status after all reviews, and each upload against all that came before.
@register("t3_status_counts", f""", {VALID_ACTIONS}, l AS (SELECT field_id, arg_max(action, (ts, action_id)) AS a FROM ok GROUP BY 1)
 SELECT coalesce({DECIDED.format(a='a')}, validation_status) AS status, count(*) AS n FROM v_review_fields f LEFT JOIN l ON f.field_id = l.field_id GROUP BY 1""", "v_review_fields", "v_actions")
def t3_status(fields, actions):
    return review.apply_reviews(fields, actions)[0].groupBy(F.col("validation_status").alias("status")).agg(F.count(F.lit(1)).alias("n"))


@register("t1_upload_status", """, u AS (SELECT file_id, sha256(coalesce(body, '')) AS sha256 FROM v_incoming)
 SELECT file_id, sha256, CASE WHEN row_number() OVER (PARTITION BY sha256 ORDER BY file_id) = 1 THEN 'NEW' ELSE 'ALREADY_EXISTS' END AS status, min(file_id) OVER (PARTITION BY sha256) AS first_id FROM u""", "v_incoming")
def t1_status(incoming):
    own = incoming.select("file_id", F.sha2(F.coalesce("body", F.lit("")), 256).alias("sha256"))
    return runs.upload_status(own, own.select("sha256", F.col("file_id").alias("first_id")).limit(0))


@register("p9_status_buckets", "SELECT document_id, CASE WHEN upper(status) IN ('PROCESSED', 'VALIDATED', 'COMPLETED', 'VERIFIED', 'VALIDATION_REQUIRED') THEN 'processed' WHEN upper(status) IN ('FAILED', 'ERROR') THEN 'failed' ELSE 'pending' END AS bucket FROM v_documents", "v_documents")
def p9(docs):
    return docs.select("document_id", T.status_bucket("status").alias("bucket"))


FOLD = "translate(coalesce(value, ''), '०१२३४५६७८९', '0123456789')"
SQUEEZE = "trim(regexp_replace({x}, '[\\s\\x{{A0}}]+', ' ', 'g'))"
CLEAN = "regexp_replace(" + SQUEEZE.format(x="coalesce(value, '')") + ", '^[ .,:;|/\\-]+|[ .,:;|/\\-]+$', '', 'g')"
LABEL = SQUEEZE.format(x="regexp_replace(regexp_replace(lower(trim(" + FOLD + ")), '[/|.:,;()\\[\\]{{}}#\\\\]', ' ', 'g'), '-', ' ', 'g')").replace("{{", "{").replace("}}", "}")
GENERIC = ", ".join(f"'{x}'" for x in P.GENERIC_HEADERS)


@register("p1_p4_text_validity", f""", x AS (SELECT field_id, field_name, {CLEAN} AS c, {LABEL} AS n FROM v_fields),
 y AS (SELECT *, n IN ({GENERIC}) OR (n <> '' AND len(list_filter(string_split(n, ' '), lambda w: w NOT IN ({", ".join(f"'{w}'" for w in P.LABEL_WORDS)}))) = 0) AS is_label FROM x)
 SELECT field_id, is_label AS looks_like_label, length(c) BETWEEN 1 AND 120 AND n <> '' AND NOT is_label AND NOT regexp_matches(c, '(?i)({"|".join(P.LABELS_IN_VALUE)})\\s*[:|/-]') AND (field_name NOT IN ('village', 'taluka', 'district', 'owner', 'classification') OR regexp_matches(c, '[A-Za-z]')) AS valid FROM y""", "v_fields")
def p1(fields):
    return fields.select("field_id", T.looks_like_label("value").alias("looks_like_label"), T.valid_text("value", F.col("field_name")).alias("valid"))


@register("p2_p3_number_validity", f"""SELECT field_id, regexp_matches({CLEAN}, '^[0-9]+(\\s*/\\s*[0-9]+)*$') AS survey, regexp_matches(regexp_replace(coalesce(value, ''), '\\s+', '', 'g'), '^[0-9]+([.,][0-9]+)?$') AND coalesce(try_cast(replace(regexp_replace(coalesce(value, ''), '\\s+', '', 'g'), ',', '.') AS DOUBLE), 0) > 0 AS positive FROM v_fields""", "v_fields")
def p2(fields):
    return fields.select("field_id", T.valid_survey("value").alias("survey"), T.valid_positive("value").alias("positive"))


@register("p5_table_value_validity", """, x AS (SELECT field_id, CASE field_name WHEN 'khata_number' THEN 'account_number' WHEN 'area' THEN 'cultivable_area' WHEN 'owner' THEN 'holder_name' ELSE field_name END AS f, regexp_replace(trim(regexp_replace(coalesce(value, ''), '[\\s]+', ' ', 'g')), '^[ .,:;|/]+|[ .,:;|/]+$', '', 'g') AS c FROM v_fields)
 SELECT field_id, length(c) BETWEEN 1 AND 180 AND lower(c) NOT IN ('name', 'number', 'no') AND CASE f WHEN 'survey_number' THEN regexp_matches(c, '^[0-9]+(\\s*/\\s*[0-9]+)*$') WHEN 'account_number' THEN regexp_matches(c, '^[0-9]+$') WHEN 'cultivable_area' THEN regexp_matches(c, '^[0-9]+([.,][0-9]+)?$') WHEN 'holder_name' THEN regexp_matches(c, '[A-Za-z]') ELSE true END AS valid FROM x""", "v_fields")
def p5(fields):
    n = F.col("field_name")
    f = F.when(n == "khata_number", "account_number").when(n == "area", "cultivable_area").when(n == "owner", "holder_name").otherwise(n)
    return fields.select("field_id", T.valid_table_value(f, F.col("value")).alias("valid"))


@register("p6_p7_evaluable", """, x AS (SELECT field_id, value, CASE l.page_number % 4 WHEN 0 THEN 'present' WHEN 1 THEN ' Present ' WHEN 2 THEN 'unreadable' ELSE '' END AS s FROM v_fields l)
 SELECT field_id, trim(coalesce(value, '')) <> '' AND lower(trim(s)) = 'present' AS strict, trim(coalesce(value, '')) <> '' AND lower(trim(s)) NOT IN ('not_visible', 'unreadable', 'empty', '') AS lenient FROM x""", "v_fields")
def p6(fields):
    k = F.col("page_number") % 4
    s = F.when(k == 0, "present").when(k == 1, " Present ").when(k == 2, "unreadable").otherwise("")
    return fields.select("field_id", T.is_evaluable(s, F.col("value")).alias("strict"), T.is_evaluable(s, F.col("value"), lenient=True).alias("lenient"))


@register("p10_suspicious_fields", f""", x AS (SELECT *, trim(regexp_replace(lower(trim(coalesce(value, ''))), '\\s+', ' ', 'g')) AS v FROM v_fields)
 SELECT field_id, 'REVIEW' AS status, least(coalesce(confidence, 0.0), 25.0) AS confidence FROM x WHERE v IN ({", ".join(f"'{w}'" for w in P.SUSPICIOUS_VALUES)}) OR (field_name IN ('mutation', 'registration') AND v IN ({", ".join(f"'{w}'" for w in P.SUSPICIOUS_LABELS)})) OR method LIKE '%\\_suspect' ESCAPE '\\'""", "v_fields")
def p10(fields):
    return validate.suspicious_fields(fields).select("field_id", "status", "confidence")


@register("n1_n4_normalisers", f"SELECT field_id, {FOLD} AS folded, {CLEAN} AS cleaned, {LABEL} AS label, regexp_replace({FOLD}, '\\s+', '', 'g') AS number, lower(regexp_replace(" + SQUEEZE.format(x=FOLD) + ", '^[.,;:()\\[\\]{}]+|[.,;:()\\[\\]{}]+$', '', 'g')) AS text FROM v_fields", "v_fields")
def n1(fields):
    return fields.select("field_id", T.fold_digits("value").alias("folded"), T.clean_candidate("value").alias("cleaned"), T.normalize_label("value").alias("label"), T.normalize_value("value", "number").alias("number"), T.normalize_value("value").alias("text"))


@register("n5_n8_normalisers", r"""SELECT field_id, trim(regexp_replace(regexp_replace(lower(coalesce(value, '')), '[^\p{L}\p{M}\p{N}_\s./-]', ' ', 'g'), '\s+', ' ', 'g')) AS entity, regexp_replace(regexp_replace(coalesce(value, ''), '[^0-9./]', '', 'g'), '\.+$', '') AS number,
 regexp_replace(regexp_replace(coalesce(value, ''), '[^0-9.]', '', 'g'), '\.+$', '') AS legacy, trim(regexp_replace(regexp_replace(lower(trim(coalesce(value, ''))), '[^\p{L}\p{M}\p{N}_\s/-]', ' ', 'g'), '\s+', ' ', 'g')) AS benchmark,
 regexp_replace(lower(trim(coalesce(value, ''))), '[^\p{L}\p{M}\p{N}_]+', '', 'g') AS compact, regexp_replace(coalesce(value, ''), '[^0-9]', '', 'g') AS digits, trim(regexp_replace(regexp_replace(lower(coalesce(value, '')), '[.,;:()\[\]{}]', '', 'g'), '\s+', ' ', 'g')) AS reference FROM v_fields""", "v_fields")
def n5(fields):
    made = {"entity": T.entity_text("value"), "number": T.entity_number("value"), "legacy": T.entity_number("value", legacy=True), "benchmark": T.eval_text("value"), "compact": T.eval_text("value", "compact"), "digits": T.eval_text("value", "digits"), "reference": T.reference_name("value")}
    return T.apart(fields.select("field_id", "value"), **made).drop("value")


@register("n14_n16_numbers_and_dates", r"""SELECT field_id, try_cast(replace(regexp_extract(coalesce(value, ''), '[0-9]+([.,][0-9]+)?'), ',', '.') AS DOUBLE) AS number,
 CASE WHEN regexp_matches(value, '[0-9]{1,2}[/-][0-9]{1,2}[/-][0-9]{4}') THEN try_cast(regexp_extract(value, '([0-9]{1,2})[/-]([0-9]{1,2})[/-]([0-9]{4})', 3) || '-' || lpad(regexp_extract(value, '([0-9]{1,2})[/-]([0-9]{1,2})[/-]([0-9]{4})', 2), 2, '0') || '-' || lpad(regexp_extract(value, '([0-9]{1,2})[/-]([0-9]{1,2})[/-]([0-9]{4})', 1), 2, '0') AS DATE) END AS day, nullif(trim(value), '') AS blank_null FROM v_fields""", "v_fields")
def n14(fields):
    return fields.select("field_id", T.first_number("value").alias("number"), T.date_from_text("value").alias("day"), T.blank_to_null("value").alias("blank_null"))


@register("n18_n20_confidences", """SELECT field_id, CASE WHEN confidence IS NOT NULL THEN greatest(0.0, least(1.0, CASE WHEN confidence > 1 THEN confidence / 100 ELSE confidence END)) END AS unit,
 least(100.0, greatest(0.0, least(100.0, coalesce(confidence, 0.0))) + CASE method WHEN 'regex_label' THEN 4.0 WHEN 'owner_table_row' THEN 1.5 ELSE 0.0 END) AS by_method, greatest(0.0, least(100.0, 0.65 * coalesce(confidence, 0.0) + 25 * 0.8::DOUBLE + 10 * (page_number / 10.0)::DOUBLE)) AS by_table FROM v_fields""", "v_fields")
def n18(fields):
    c = F.col("confidence")
    return fields.select("field_id", unit_confidence(c).alias("unit"), method_confidence(c, F.col("method")).alias("by_method"), table_confidence(c, F.lit(0.8), F.col("page_number") / 10).alias("by_table"))


@register("n23_rename", "SELECT field_id, CASE field_name WHEN 'owner' THEN 'holder' WHEN 'area' THEN 'extent' ELSE field_name END AS name FROM v_fields", "v_fields")
def n23(fields):
    return fields.select("field_id", T.rename_field("field_name", {"owner": "holder", "area": "extent"}).alias("name"))


RULE_SQL = """SELECT field_id, 'required_value' AS rule_name, CASE WHEN trim(coalesce(value, '')) <> '' THEN 'PASS' ELSE 'REVIEW' END AS status, confidence FROM v_fields WHERE field_name IN ('survey_number', 'village')
 UNION ALL SELECT field_id, 'survey_number_format', CASE WHEN regexp_matches(trim(coalesce(value, '')), '^[0-9]+(/[0-9]+)*$') THEN 'PASS' ELSE 'REVIEW' END, confidence FROM v_fields WHERE field_name = 'survey_number'
 UNION ALL SELECT field_id, 'seven_twelve_numeric_format', CASE WHEN regexp_matches(trim(coalesce(value, '')), '^(-|[0-9]+(/[0-9]+)*)$') THEN 'PASS' ELSE 'REVIEW' END, confidence FROM v_fields WHERE field_name = 'khata_number'
 UNION ALL SELECT field_id, 'seven_twelve_area_format', CASE WHEN coalesce(try_cast(replace(trim(coalesce(value, '')), ',', '.') AS DOUBLE) > 0, false) THEN 'PASS' ELSE 'REVIEW' END, confidence FROM v_fields WHERE field_name = 'area'
 UNION ALL SELECT field_id, 'seven_twelve_text_value', CASE WHEN lower(trim(coalesce(value, ''))) IN ('name', 'number') OR length(trim(coalesce(value, ''))) < 2 THEN 'REVIEW' ELSE 'PASS' END, CASE WHEN lower(trim(coalesce(value, ''))) IN ('name', 'number') OR length(trim(coalesce(value, ''))) < 2 THEN least(coalesce(confidence, 0.0), 35.0) ELSE confidence END FROM v_fields WHERE field_name = 'owner'
 UNION ALL SELECT field_id, 'confidence_threshold', CASE WHEN confidence IS NULL OR confidence < 50 THEN 'REVIEW' WHEN confidence < 75 THEN 'WARNING' ELSE 'PASS' END, confidence FROM v_fields"""


@register("v1_v6_v14_rules", RULE_SQL, "v_fields")
def v14(fields):
    return validate.apply_rules(fields).select("field_id", "rule_name", "status", "confidence")


# The format rules read the normalised value first; whether a required value is there is asked of the value as read.
FIRST_RULE, *OTHER_RULES = RULE_SQL.split(" UNION ALL ")
NORMALIZED_SQL = " UNION ALL ".join([FIRST_RULE, *(r.replace("coalesce(value, '')", "coalesce(nullif(normalized_value, ''), value, '')") for r in OTHER_RULES)]).replace("FROM v_fields", "FROM v_normalized")


@register("v2_v5_normalized_rules", NORMALIZED_SQL, "v_normalized")
def v2_normalized(fields):
    return validate.apply_rules(fields).select("field_id", "rule_name", "status", "confidence")


@register("v6_confidence_messages", """SELECT field_id, CASE WHEN confidence IS NULL THEN 'No extraction confidence is available.' WHEN confidence < 50 THEN printf('Extraction confidence is low (%.2f%%). Human review is recommended.', confidence) WHEN confidence < 75 THEN printf('Extraction confidence is moderate (%.2f%%).', confidence) ELSE printf('Extraction confidence is high (%.2f%%).', confidence) END AS message FROM v_fields""", "v_fields")
def v6(fields):
    return validate.apply_rules(fields, (validate.confidence_threshold,)).select("field_id", "message")


@register("v11_area_checks", """, x AS (SELECT field_id, confidence, try_cast(replace(regexp_extract(trim(coalesce(value, '')), '[0-9]+([.,][0-9]+)?'), ',', '.') AS DOUBLE) AS n FROM v_fields WHERE field_name = 'area')
 SELECT field_id, CASE WHEN n IS NULL THEN 'consistency_area_numeric' ELSE 'consistency_area_positive' END AS rule_name, CASE WHEN n > 0 THEN 'PASS' ELSE 'REVIEW' END AS status, CASE WHEN n IS NULL THEN 'Area could not be interpreted as a numeric value.' WHEN n > 0 THEN 'Area value ' || printf('%g', n) || ' is positive and numerically valid.' ELSE 'Area value ' || printf('%g', n) || ' is not positive.' END AS message FROM x""", "v_fields")
def v11(fields):
    return validate.area_checks(fields).select("field_id", "rule_name", "status", "message")


FIRST_OF = """firsts AS (SELECT document_id, field_name, field_id, v, confidence FROM (SELECT *, row_number() OVER (PARTITION BY document_id, field_name ORDER BY created_at, field_id) AS rn FROM (SELECT *, trim(coalesce(value, '')) AS v FROM v_fields) WHERE v <> '') WHERE rn = 1)"""
DAY = r"try_cast(regexp_extract({v}, '([0-9]{{1,2}})[/-]([0-9]{{1,2}})[/-]([0-9]{{4}})', 3) || '-' || lpad(regexp_extract({v}, '([0-9]{{1,2}})[/-]([0-9]{{1,2}})[/-]([0-9]{{4}})', 2), 2, '0') || '-' || lpad(regexp_extract({v}, '([0-9]{{1,2}})[/-]([0-9]{{1,2}})[/-]([0-9]{{4}})', 1), 2, '0') AS DATE)"


@register("v12_date_order", f""", {FIRST_OF}, d AS (SELECT m.document_id, m.field_id, m.confidence, {DAY.format(v='m.v')} AS md, {DAY.format(v='r.v')} AS rd FROM firsts m JOIN firsts r ON m.document_id = r.document_id AND m.field_name = 'mutation' AND r.field_name = 'registration')
 SELECT document_id, field_id, CASE WHEN md < rd THEN 'REVIEW' ELSE 'PASS' END AS status, confidence FROM d WHERE md IS NOT NULL AND rd IS NOT NULL""", "v_fields")
def v12(fields):
    return validate.date_order(fields).select("document_id", "field_id", "status", "confidence")


NAME = "trim(regexp_replace(regexp_replace(lower(coalesce({x}, '')), '[.,;:()\\[\\]{{}}]', '', 'g'), '\\s+', ' ', 'g'))"
REF_NAMES = f"rn AS (SELECT DISTINCT district_name, taluka_name, village_name, {NAME.format(x='n')} AS n, {NAME.format(x='taluka_name')} AS t, {NAME.format(x='district_name')} AS d FROM (SELECT *, unnest([village_name, local_name]) AS n FROM v_reference) WHERE n IS NOT NULL)"


@register("j6_match_reference", f""", {REF_NAMES}, c AS (SELECT claim_id, {NAME.format(x='village')} AS n, {NAME.format(x='taluka')} AS t, {NAME.format(x='district')} AS d FROM v_claims),
 m AS (SELECT c.claim_id, rn.taluka_name, rn.district_name, c.t <> '' AND c.t = rn.t AS tm, c.d <> '' AND c.d = rn.d AS dm FROM c JOIN rn ON c.n = rn.n),
 m2 AS (SELECT * FROM (SELECT *, bool_or(tm) OVER (PARTITION BY claim_id) AS any_t FROM m) WHERE tm OR NOT any_t), m3 AS (SELECT * FROM (SELECT *, bool_or(dm) OVER (PARTITION BY claim_id) AS any_d FROM m2) WHERE dm OR NOT any_d),
 g AS (SELECT claim_id, count(*) AS k, max(taluka_name) AS taluka_name FROM m3 GROUP BY 1)
 SELECT c.claim_id, CASE WHEN k IS NULL THEN 'NOT_FOUND' WHEN k > 1 THEN 'AMBIGUOUS' ELSE 'MATCHED' END AS match_status, CASE WHEN k = 1 THEN taluka_name END AS matched_taluka FROM c LEFT JOIN g ON c.claim_id = g.claim_id""", "v_claims", "v_reference")
def j6(claims, ref):
    return match.match_reference(claims, ref, parent="taluka", grandparent="district").select("claim_id", "match_status", F.col("ref.taluka_name").alias("matched_taluka"))


@register("v7_v8_village_rules", f""", {REF_NAMES}, f AS (SELECT field_id, {NAME.format(x='value')} AS n FROM v_fields WHERE field_name = 'village' AND value <> ''), k AS (SELECT f.field_id, count(rn.n) AS k FROM f LEFT JOIN rn ON f.n = rn.n GROUP BY 1)
 SELECT field_id, unnest(['village_reference_match', 'location_hierarchy']) AS rule_name, CASE WHEN k = 1 THEN 'PASS' ELSE 'REVIEW' END AS status, CASE WHEN k = 1 THEN 100.0 WHEN k > 1 THEN 50.0 ELSE 0.0 END::DOUBLE AS confidence FROM k""", "v_fields", "v_reference")
def v7(fields, ref):
    return validate.village_rules(fields, ref).select("field_id", "rule_name", "status", "confidence")


@register("v13_location_consistency", f""", {REF_NAMES}, {FIRST_OF}, p AS (SELECT document_id, max(v) FILTER (field_name = 'village') AS v, max(field_id) FILTER (field_name = 'village') AS vf, max(v) FILTER (field_name = 'taluka') AS t, max(field_id) FILTER (field_name = 'taluka') AS tf, max(v) FILTER (field_name = 'district') AS d, max(field_id) FILTER (field_name = 'district') AS df FROM firsts GROUP BY 1),
 q AS (SELECT *, {NAME.format(x='v')} AS nv, {NAME.format(x='t')} AS nt, {NAME.format(x='d')} AS nd FROM p WHERE v IS NOT NULL), m AS (SELECT q.document_id, rn.t AS rt, rn.d AS rd, nt <> '' AND nt = rn.t AS tm, nd <> '' AND nd = rn.d AS dm FROM q JOIN rn ON q.nv = rn.n),
 m2 AS (SELECT * FROM (SELECT *, bool_or(tm) OVER (PARTITION BY document_id) AS any_t FROM m) WHERE tm OR NOT any_t), m3 AS (SELECT * FROM (SELECT *, bool_or(dm) OVER (PARTITION BY document_id) AS any_d FROM m2) WHERE dm OR NOT any_d),
 g AS (SELECT document_id, count(*) AS k, max(rt) AS rt, max(rd) AS rd FROM m3 GROUP BY 1), j AS (SELECT q.*, coalesce(k, 0) AS k, rt, rd FROM q LEFT JOIN g ON q.document_id = g.document_id)
 SELECT document_id, vf AS field_id, 'consistency_reference_location' AS rule_name, 'REVIEW' AS status FROM j WHERE k <> 1
 UNION ALL SELECT document_id, tf, CASE WHEN nt = rt THEN 'consistency_taluka_reference' ELSE 'consistency_taluka_reference_conflict' END, CASE WHEN nt = rt THEN 'PASS' ELSE 'REVIEW' END FROM j WHERE k = 1 AND t IS NOT NULL
 UNION ALL SELECT document_id, df, CASE WHEN nd = rd THEN 'consistency_district_reference' ELSE 'consistency_district_reference_conflict' END, CASE WHEN nd = rd THEN 'PASS' ELSE 'REVIEW' END FROM j WHERE k = 1 AND d IS NOT NULL""", "v_fields", "v_reference")
def v13(fields, ref):
    return validate.location_consistency(fields, ref).select("document_id", "field_id", "rule_name", "status")


@register("u2_distinct_results", "SELECT field_name, rule_name, status, message, count(*) AS n FROM (SELECT DISTINCT field_id, document_id, field_name, rule_name, status, message FROM (SELECT * FROM v_results UNION ALL SELECT * FROM v_results)) GROUP BY 1, 2, 3, 4", "v_results")
def u2(results):
    return validate.distinct_results(validate.all_results(results, results)).groupBy("field_name", "rule_name", "status", "message").agg(F.count(F.lit(1)).alias("n"))


@register("v15_validate_documents", None, "v_fields", "v_runs", "v_reference")
def v15(fields, vruns, ref):
    results, status, _ = validate.validate_documents(runs.only_latest(fields, vruns), ref)
    return results.join(status.withColumnRenamed("validation_status", "field_status"), "field_id")


def calibrated(fields):
    pn, regex = F.col("page_number"), F.col("method") == "regex_label"
    own = fields.select("field_id", F.col("confidence").alias("extraction_confidence"), F.lit(None).cast("double").alias("ocr_confidence"), F.when(pn <= 5, pn / 7).alias("entity_match_score"), "validation_status", ((pn == 3) & regex).alias("has_conflict"), ((pn == 2) & regex).alias("requires_review"))
    return validate.calibrate(own)


# Every row, those at the limits of the bands too: the score is rounded before it is banded.
@register("r1_calibrate", """, x AS (SELECT field_id, CASE WHEN confidence IS NOT NULL THEN greatest(0.0, least(1.0, CASE WHEN confidence > 1 THEN confidence / 100 ELSE confidence END)) END AS x, CASE WHEN page_number > 5 THEN NULL ELSE page_number / 7.0 END::DOUBLE AS e, validation_status AS s, page_number = 3 AND method = 'regex_label' AS c, page_number = 2 AND method = 'regex_label' AS r FROM v_fields),
 y AS (SELECT *, (CASE WHEN x IS NOT NULL THEN 0.45 ELSE 0 END + CASE WHEN e IS NOT NULL THEN 0.20 ELSE 0 END)::DOUBLE AS w FROM x),
 z AS (SELECT *, round(greatest(0.0, least(1.0, CASE WHEN w > 0 THEN (coalesce(x * 0.45, 0) + coalesce(e * 0.20, 0)) / w ELSE 0 END + CASE s WHEN 'PASS' THEN 0.10 WHEN 'WARNING' THEN -0.10 ELSE -0.25 END + CASE WHEN c THEN -0.35 ELSE 0 END + CASE WHEN r THEN -0.20 ELSE 0 END)), 9)::DOUBLE AS score FROM y)
 SELECT field_id, score, CASE WHEN c OR r THEN 'CONFLICT' WHEN score >= 0.85 THEN 'HIGH' WHEN score >= 0.65 THEN 'MEDIUM' ELSE 'LOW' END AS band FROM z""", "v_fields")
def r1(fields):
    return calibrated(fields).select("field_id", "score", "band")


ENTITY = r"trim(regexp_replace(regexp_replace(lower(coalesce({x}, '')), '[^\p{{L}}\p{{M}}\p{{N}}_\s./-]', ' ', 'g'), '\s+', ' ', 'g'))"
DIGITS = r"regexp_replace(regexp_replace(coalesce({x}, ''), '[^0-9./]', '', 'g'), '\.+$', '')"
NORMED = "nr AS (SELECT record_id, " + ", ".join(f"{(DIGITS if f in P.ENTITY_NUMERIC else ENTITY).format(x=f)} AS {f}" for f in P.ENTITY_WEIGHTS) + " FROM v_records)"
SIMS = ", ".join(f"CASE WHEN a.{f} <> '' AND b.{f} <> '' THEN CASE WHEN a.{f} = b.{f} THEN 1.0 ELSE 1 - levenshtein(a.{f}, b.{f})::DOUBLE / greatest(length(a.{f}), length(b.{f})) END END::DOUBLE AS {f}" for f in P.ENTITY_WEIGHTS)
HAVE = " + ".join(f"CASE WHEN {f} IS NOT NULL THEN {w} ELSE 0 END" for f, w in P.ENTITY_WEIGHTS.items())
TOTAL = " + ".join(f"coalesce({f} * {w}, 0)" for f, w in P.ENTITY_WEIGHTS.items())
BLOCKS = (("survey_number", "khata_number"), ("survey_number", "village"), ("khata_number", "village"), ("village", "taluka", "area"))
ON = " OR ".join("(" + " AND ".join(f"a.{k} = b.{k} AND a.{k} <> ''" for k in keys) + ")" for keys in BLOCKS)
MATCHES = f"{NORMED}, s AS (SELECT a.record_id AS record_a, b.record_id AS record_b, {SIMS} FROM nr a JOIN nr b ON a.record_id < b.record_id), t AS (SELECT record_a, record_b, round(({TOTAL})::DOUBLE / ({HAVE})::DOUBLE, 9) AS score FROM s), mt AS (SELECT *, CASE WHEN score >= 0.82 THEN 'POSSIBLE_DUPLICATE' WHEN score >= 0.62 THEN 'POSSIBLE_MATCH' ELSE 'NO_MATCH' END AS decision FROM t)"


@register("r3_resolve_entities", f", {MATCHES} SELECT record_a, record_b, score, decision FROM mt WHERE decision <> 'NO_MATCH'", "v_records")
def r3(records):
    # Stored, as a sort would work its rows out twice.
    return match.rank_matches(stored(match.resolve_entities(records).select("record_a", "record_b", "score", "decision")))


@register("r3_duplicates", f", {MATCHES} SELECT record_a, record_b, score FROM mt WHERE decision = 'POSSIBLE_DUPLICATE'", "v_records")
def r3_duplicates(records):
    """No pairs but those that agree in a field that two duplicates must share."""
    return match.resolve_entities(records, least=P.DUPLICATE_SCORE).select("record_a", "record_b", "score")


@register("r2_compare_pairs_ratcliff", None, "v_records")
def r2(records):
    return match.resolve_entities(records, BLOCKS, include_no_match=True, method="ratcliff")


@register("a17_match_counters", f", {MATCHES.replace('a.record_id < b.record_id', f'a.record_id < b.record_id AND ({ON})')} SELECT (SELECT count(*) FROM v_records) AS records, count(*) AS comparisons, count(*) FILTER (decision <> 'NO_MATCH') AS flagged FROM mt", "v_records")
def a17(records):
    return match.count_matches(records, BLOCKS)


@register("j10_block_sizes", "SELECT village, taluka, count(*) AS records, count(*) * (count(*) - 1) // 2 AS pairs FROM v_records GROUP BY 1, 2", "v_records")
def j10(records):
    return match.block_sizes(records, ("village", "taluka"))
