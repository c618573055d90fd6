"""Record operators on small fixtures with known answers."""

import datetime as dt
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from folioframe.functions import geometry as G
from folioframe.functions import similarity as S
from folioframe.functions import text as T
from folioframe.operators import extract, match, metrics, review, runs, tables, validate

BOX = "struct<x: double, y: double, width: double, height: double>"


def one(spark, column, **values):
    return spark.range(1).select(column.alias("c")).first().c


def lit(spark, f, *args):
    return spark.range(1).select(f(*[F.lit(a) for a in args]).alias("c")).first().c


@pytest.fixture(scope="module")
def page(spark):
    """Five headers over five values, and two more headers with a value under each."""
    cells = [("भूमापन क्रमांक", 0, 100), ("भूमापन क्रमांकाचा उपविभाग", 300, 100), ("भू-धारणा पद्धती", 600, 100), ("भोगवटादाराचे नाव", 900, 100), ("खाते क्रमांक", 1200, 100),
             ("१२४/३", 0, 150), ("-", 300, 150), ("भोगवटादार वर्ग-१", 600, 150), ("Asha Patil", 900, 150), ("४५", 1200, 150),
             ("शेताचे स्थानिक नाव", 0, 210), ("Vadache Shet", 0, 260), ("लागवडीयोग्य क्षेत्र", 0, 320), ("२.५०", 0, 370)]
    rows = [(1, i, y + x, t, 90.0, (float(x), float(y), 180.0, 24.0)) for i, (t, x, y) in enumerate(cells)]
    return spark.createDataFrame(rows, f"page_id int, block_id int, block_number int, text string, confidence double, bbox {BOX}")


def test_golden_table_page(page):
    got = {r.field_name: r.normalized_value for r in extract.extract_table_fields(extract.in_reading_order(page)).collect()}
    assert got["survey_number"] == "124/3" and got["subdivision"] == "-" and got["khata_number"] == "45" and got["area"] == "2.50"
    assert got["owner"] == "asha patil" and got["local_field_name"] == "vadache shet" and got["land_tenure"]
    every = {r.field_name for r in extract.extract_fields(page).collect()}
    assert set(got) <= every


def test_row_clusters_agree_on_a_grid(page):
    gaps = {(r.block_id, r.row_idx) for r in extract.cluster_rows(page).collect()}
    assert gaps == {(r.block_id, r.row_idx) for r in extract.cluster_rows_greedy(page).collect()}


def blocks(spark, rows):
    data = [(1, i, i, t, 80.0, (float(x), float(y), float(w), 20.0)) for i, (t, x, y, w) in enumerate(rows)]
    return extract.in_reading_order(spark.createDataFrame(data, f"page_id int, block_id int, block_number int, text string, confidence double, bbox {BOX}"))


def test_inline_adjacent_owner_and_area(spark):
    b = blocks(spark, [("Survey No: १२/४", 0, 0, 100), ("VILLAGE : Wagholi.", 0, 50, 100), ("Village: Taluka: x", 0, 90, 100), ("Khata No", 0, 140, 80), ("77", 120, 140, 40), ("Mutation", 0, 190, 80), ("फेरफार माहिती", 120, 190, 80),
                       ("Owner Name", 400, 0, 100), ("Ram Rao", 410, 40, 80), ("name", 410, 70, 60), ("Sita Bai", 405, 100, 80), ("Third One", 405, 140, 80), ("Area", 800, 0, 60), ("1,5", 800, 40, 40), ("0", 800, 80, 40), ("Area: 2.5 ha", 0, 240, 100)])
    inline = {(r.field_name, r.normalized_value) for r in extract.extract_inline(b).collect()}
    assert inline == {("survey_number", "12/4"), ("village", "wagholi"), ("area", "2.5")}
    near = {r.field_name: r for r in extract.extract_adjacent(b).collect()}
    assert near["khata_number"].normalized_value == "77" and near["khata_number"].confidence == 82.5
    assert near["mutation"].method.endswith("_suspect") and near["mutation"].confidence == 25
    assert [r.value for r in extract.extract_owner_rows(b).orderBy("position").collect()] == ["Ram Rao", "Sita Bai"]
    assert [r.value for r in extract.extract_area_rows(b).collect()] == ["1,5"]


def test_classify(spark):
    docs = spark.createDataFrame([("गाव नमुना ७/१२ सर्वे नं", ), ("ferfar  MUTATION", ), ("nothing", ), (None, ), ("8a cts", )], "text string")
    got = [(r.document_type, r.class_confidence, len(r.matched_signals)) for r in extract.classify(docs).collect()]
    assert got == [("7_12", 98.0, 4), ("FERFAR", 98.0, 2), ("UNKNOWN", 0.0, 0), ("UNKNOWN", 0.0, 0), ("8A", 87.0, 1)]
    assert [lit(spark, extract.detect_language, x) for x in ("", "123", "गाव", "abc", "गाव abc")] == ["unknown", "unknown", "mar", "eng", "mar+eng"]


@pytest.mark.parametrize("raw,want", [("०१-२/x", "01-2/x"), (None, ""), ("", "")])
def test_fold_digits(spark, raw, want):
    assert spark.createDataFrame([(raw,)], "v string").select(T.fold_digits("v")).first()[0] == want


def test_normalisers(spark):
    assert lit(spark, T.clean_candidate, " \n a  b . |") == "a b"
    assert lit(spark, T.normalize_label, "Survey  No. / (१२)-B") == "survey no 12 b"
    assert lit(spark, T.entity_text, "Gat no. गट; Gatha​ x") == "survey no. survey gatha x"
    assert lit(spark, T.entity_number, "124/3.") == "124/3" and one(spark, T.entity_number(F.lit("124/3."), legacy=True)) == "1243"
    assert lit(spark, T.reference_name, " Pune.  (City) ") == "pune city"
    assert lit(spark, T.clean_html_cell, "a<br/>b&nbsp;&amp;lt; c") == "a b &lt; c"
    assert [lit(spark, T.first_number, x) for x in ("x 2,5 ha", "none", "०७")] == [2.5, None, 7.0]
    assert [lit(spark, T.date_from_text, x) for x in ("on 3/04/2020", "2020-4-3", "31/2/2020", "x")] == [dt.date(2020, 4, 3), dt.date(2020, 4, 3), None, None]


def test_predicates(spark):
    ok = lambda v, f="village": lit(spark, lambda c: T.valid_text(c, f), v)
    assert ok("Wagholi") and not ok("") and not ok("name number") and not ok("12") and ok("12", "mutation") and not ok("x" * 121) and not ok("Taluka: Haveli") and not ok("गट क्रमांक")
    assert lit(spark, T.valid_survey, "१२ / ३") and not lit(spark, T.valid_survey, "12/x")
    assert lit(spark, T.valid_positive, "0,5") and not lit(spark, T.valid_positive, "0.0") and not lit(spark, T.valid_positive, "5 ha")
    assert one(spark, T.valid_table_value("subdivision", F.lit("-"))) and not one(spark, T.valid_table_value("holder_name", F.lit("क्रमांक पद्धती")))
    assert [lit(spark, T.status_bucket, x) for x in ("verified", "FAILED", "?")] == ["processed", "failed", None]


def test_similarities_and_error_rates(spark):
    assert lit(spark, S.cer, "abcd", "abxd") == 0.25 and lit(spark, S.cer, "", "") == 0 and lit(spark, S.cer, " ", "x") == 1
    assert lit(spark, S.wer, "a b c d", "a x c") == 0.5 and lit(spark, S.wer, "a b", "") == 1.0
    assert lit(spark, S.contained_similarity, "Old Place", "the old, place here") == 1.0
    df = spark.createDataFrame([("kitten", "sitting"), ("", "x"), ("same", "same")], "a string, b string")
    got = [r[0] for r in df.select(S.similarity(F.col("a"), F.col("b"), "ratcliff")).collect()]
    assert got == [SequenceMatcher(None, "kitten", "sitting").ratio(), 0.0, 1.0]
    assert df.select(T.nfkc(F.lit("ﬁ")).alias("x")).first().x == "fi"
    assert lit(spark, S.label_score, "owner name", "owner name") == 1 and lit(spark, S.label_score, "the owner name", "owner name") == 0.94
    assert lit(spark, S.identity_match, "12", "x12", "") and lit(spark, S.identity_match, "12", "", "a 12 b") and not lit(spark, S.identity_match, "12", "", "a 123 b")


def test_boxes_and_confidences(spark):
    shapes = ['{"x":1,"y":2,"width":3,"height":4}', '{"left":1,"top":2,"right":4,"bottom":6}', '{"bbox":[1,2,4,6]}', '{"bounding_box":{"x1":1,"y1":2,"x2":4,"y2":6}}', "[1,2,4,6]", "[4,2,1,6]", '{"x":1}', "junk", None]
    got = [r[0] for r in spark.createDataFrame([(s,) for s in shapes], "s string").select(G.normalize_bbox(F.col("s"))).collect()]
    assert [tuple(b) if b else None for b in got] == [(1, 2, 3, 4)] * 5 + [None] * 4
    assert [lit(spark, G.unit_confidence, x) for x in (1.0, 1.01, 85.0, -3.0, 400.0)] == [1.0, 0.0101, 0.85, 0.0, 1.0]
    assert lit(spark, G.method_confidence, 99.0, "regex_label") == 100 and lit(spark, G.table_confidence, 90.0, 1.0, 1.0) == 93.5


def test_latest_run_orders(spark):
    rows = [(1, 9, "COMPLETED", 1, 5), (2, 9, "COMPLETED", 2, None), (3, 9, "FAILED", 3, None), (4, 9, "COMPLETED", 2, 4), (5, 8, "RUNNING", 1, None)]
    r = spark.createDataFrame(rows, "run_id int, document_id int, status string, created_at int, completed_at int")
    assert [x.run_id for x in runs.latest_run(r).collect()] == [4]
    assert [x.run_id for x in runs.latest_run(r, order="completed").collect()] == [1]
    assert sorted(x.run_id for x in runs.latest_run(r, status=None).collect()) == [3, 5]


def fields(spark, rows):
    data = [(i, 1, 1, n, v, None, c, m, i) for i, (n, v, c, m) in enumerate(rows)]
    return spark.createDataFrame(data, "field_id int, document_id int, run_id int, field_name string, value string, normalized_value string, confidence double, method string, created_at int")


def test_rules_status_and_consistency(spark):
    f = fields(spark, [("village", "Wagholi", 90.0, ""), ("village", "WAGHOLI ", 40.0, ""), ("taluka", "Haveli", None, ""), ("taluka", "Mulshi", 80.0, ""), ("survey_number", "12-x", 80.0, ""), ("area", "0", 80.0, ""), ("area", "abc", 60.0, ""), ("owner", "name", 80.0, ""), ("mutation", "फेरफार माहिती", 80.0, "x_suspect"), ("khata_number", "४५", 80.0, ""), ("village", " ", 99.0, "")])
    got = {(r.field_id, r.rule_name): r for r in validate.all_results(validate.apply_rules(f), validate.suspicious_fields(f), validate.duplicate_consistency(f), validate.area_checks(f)).collect()}
    assert got[(0, "required_value")].status == "PASS" and got[(10, "required_value")].status == "REVIEW"
    assert got[(4, "survey_number_format")].status == "REVIEW" and got[(9, "seven_twelve_numeric_format")].status == "PASS"
    assert got[(7, "seven_twelve_text_value")].confidence == 35 and got[(8, "field_value_suspicious")].confidence == 25
    assert got[(5, "consistency_area_positive")].message == "Area value 0 is not positive." and got[(6, "consistency_area_numeric")].status == "REVIEW"
    assert got[(0, "consistency_village_duplicates")].confidence == 65 and got[(2, "consistency_taluka_conflict")].status == got[(3, "consistency_taluka_conflict")].status == "REVIEW"
    assert got[(6, "confidence_threshold")].message == "Extraction confidence is moderate (60.00%)."
    results = validate.apply_rules(f)
    status = {r.field_id: r.validation_status for r in validate.strongest_status(results.filter("field_id < 3"), f).collect()}
    assert status[0] == "PASS" and status[1] == "REVIEW" and status[9] == "PASS"


def test_fuzzy_clusters_and_dates(spark):
    f = fields(spark, [("village", "Wagholi Budruk", 90.0, ""), ("village", "Wagholi Budrukh", 80.0, ""), ("mutation", "no 3 of 01/02/2020", 70.0, ""), ("registration", "2020-03-01", 70.0, "")])
    assert [r.rule_name for r in validate.duplicate_consistency_fuzzy(f).collect()] == ["consistency_village_duplicates"]
    assert {r.rule_name for r in validate.duplicate_consistency(f).collect()} == {"consistency_village_conflict"}
    r = validate.date_order(f).first()
    assert r.status == "REVIEW" and "01/02/2020" in r.message and "01/03/2020" in r.message


REF = "district_name string, taluka_name string, village_name string, local_name string"


def test_reference_match_and_locations(spark):
    ref = spark.createDataFrame([("Pune", "Haveli", "Wagholi", None), ("Pune", "Mulshi", "Wagholi", "Vagholi"), ("Satara", "Karad", "Oglewadi", None)], REF)
    claims = spark.createDataFrame([(1, "wagholi", None, None), (2, "Wagholi", "haveli.", None), (3, "Wagholi", "Nope", "Pune"), (4, "VAGHOLI", None, None), (5, "x", None, None), (6, None, None, None)], "claim_id int, village string, t string, d string")
    got = {r.claim_id: r for r in match.match_reference(claims, ref, parent="t", grandparent="d").collect()}
    assert [got[i].match_status for i in range(1, 7)] == ["AMBIGUOUS", "MATCHED", "AMBIGUOUS", "MATCHED", "NOT_FOUND", "NOT_FOUND"]
    assert got[2].ref.taluka_name == "Haveli" and got[1].ref is None
    f = fields(spark, [("village", "Wagholi", 1.0, ""), ("taluka", "Haveli", 1.0, ""), ("district", "Satara", 1.0, "")])
    rules = {r.rule_name: r.status for r in validate.location_consistency(f, ref).collect()}
    assert rules == {"consistency_taluka_reference": "PASS", "consistency_district_reference_conflict": "REVIEW"}
    assert {r.rule_name: r.confidence for r in validate.village_rules(f, ref).collect()} == {"village_reference_match": 50.0, "location_hierarchy": 50.0}
    results, status, conf = validate.validate_documents(f, ref)
    assert results.count() == results.distinct().count() and status.count() == 3 and conf.count() == 1


def test_entity_resolution(spark):
    rows = [(1, 1, "Ram Rao", "124/3", "5", "W", "H", "P", "1.5"), (2, 2, "Ram Rao", "124/3", "5", "W", "H", "P", "1.5"), (3, 3, "Zz", "9", "7", "W", "Q", "P", "8"), (4, 4, None, "", None, None, None, None, None)]
    rec = spark.createDataFrame(rows, "record_id int, document_id int, owner string, survey_number string, khata_number string, village string, taluka string, district string, area string").withColumn("k", F.lit(1))
    every = {(r.record_a, r.record_b): r for r in match.resolve_entities(rec, (("k",),), include_no_match=True).collect()}
    assert len(every) == 6 and every[(1, 2)].decision == "POSSIBLE_DUPLICATE" and every[(1, 2)].score == pytest.approx(1.0) and len(every[(1, 2)].reasons) == 6
    assert every[(1, 3)].decision == "NO_MATCH" and every[(1, 4)].decision == "INSUFFICIENT_DATA" and every[(1, 4)].compared_fields == {}
    kept = match.resolve_entities(rec, (("k",),))
    assert kept.filter("decision = 'NO_MATCH'").count() == 0
    c = match.match_counters(rec, match.resolve_entities(rec, (("k",),), include_no_match=True)).first()
    assert (c.records, c.comparisons, c.flagged) == (4, 6, 1)


def test_calibration(spark):
    rows = [(90.0, 0.9, None, "PASS", False, False), (None, None, None, None, None, None), (0.7, None, 0.7, "WARNING", False, False), (95.0, 95.0, 0.9, "PASS", True, False)]
    got = validate.calibrate(spark.createDataFrame(rows, "extraction_confidence double, ocr_confidence double, entity_match_score double, validation_status string, has_conflict boolean, requires_review boolean")).collect()
    assert [r.band for r in got] == ["HIGH", "LOW", "LOW", "CONFLICT"] and [r.automation_allowed for r in got] == [True, False, False, False]
    assert got[1].score == 0 and got[0].score == pytest.approx(1.0) and "Cross-record similarity warrants review." in got[2].reasons


def test_review_fold(spark):
    f = spark.createDataFrame([("a", "Old", "old", "PENDING"), ("b", "B", "b", "PENDING")], "field_id string, value string, normalized_value string, validation_status string")
    acts = spark.createDataFrame([(1, "a", "EDIT", " New ", None, 1), (2, "a", "EDIT", " ", None, 2), (3, "a", "ACCEPT", None, "ok", 2), (4, "a", "EDIT", "Last", None, 3), (5, "b", "BOGUS", None, None, 1)], "action_id int, field_id string, action string, new_value string, reason string, ts int")
    out, audit = review.apply_reviews(f, acts)
    got = {r.field_id: (r.value, r.normalized_value, r.validation_status) for r in out.collect()}
    assert got == {"a": ("Last", "last", "EDITED"), "b": ("B", "b", "PENDING")}
    assert [(r.action_id, r.old_value, r.new_value, r.decision) for r in audit.orderBy("action_id").collect()] == [(1, "Old", "New", "EDITED"), (3, "New", "New", "ACCEPTED"), (4, "New", "Last", "EDITED")]
    p = spark.createDataFrame([("approve ", None, None), ("CORRECT", " ", None), ("REJECT", None, "why"), ("x", None, None)], "action string, new_value string, reason string")
    got = review.review_policy(p).collect()
    assert [r.accepted for r in got] == [True, None, False, None] and got[2].reason == "why" and got[1].error and got[3].error == "Unsupported review action: X"


def test_html_grids(spark):
    html = "<table><tr><th rowspan='2'>खाते क्रमांक</th><th colspan=2>A &amp; B</th></tr><tr><td>४५</td><td></td></tr><tr><td>1<td>2</table> <TABLE><tr><td>z</td></tr></TABLE>"
    cells = tables.html_table_cells(spark.createDataFrame([(1, html), (2, None), (3, "no table")], "doc_id int, html string"))
    got = {(r.table_no, r.row, r.col): r.text for r in cells.collect()}
    assert got == {(0, 0, 0): "खाते क्रमांक", (0, 1, 0): "खाते क्रमांक", (0, 0, 1): "A & B", (0, 0, 2): "A & B", (0, 1, 1): "४५", (0, 1, 2): "", (0, 2, 0): "1", (0, 2, 1): "2", (1, 0, 0): "z"}
    hit = tables.grid_lookup(cells, {"account_number": ("खाते क्रमांक",)}).collect()
    assert [(h.value, h.value_row, h.value_col) for h in hit] == [("1", 2, 0)]
    s = tables.table_summary(cells).first()
    assert (s.tables, s.rows, s.columns) == (2, 4, 3)
    truth = spark.createDataFrame([(1, "account_number", "45"), (1, "land_tenure", "Class one"), (1, "village", "q")], "doc_id int, field string, variant string")
    cands = spark.createDataFrame([(1, "account_number", "४५ "), (1, "land_tenure", "x")], "doc_id int, field string, candidate string")
    texts = spark.createDataFrame([(1, "the class  ONE text")], "doc_id int, text string")
    assert {r.field: r.score for r in tables.improved_match(truth, cands, texts).collect()} == {"account_number": 1.0, "land_tenure": 0.95, "village": 0.0}


def test_text_assembly(spark):
    w = spark.createDataFrame([(1, 0, 0, 0, 1, 50, 5, 20, 10, 80.0, "b"), (1, 0, 0, 0, 0, 0, 0, 30, 12, 60.0, "a")], "page_id int, block_num int, par_num int, line_num int, word_num int, left int, top int, width int, height int, conf double, text string")
    r = metrics.assemble_lines(w).first()
    assert (r.text, r.confidence, r.x, r.y, r.width, r.height) == ("a b", 70.0, 0, 0, 70, 15)


def test_evaluation_of_texts(spark):
    from folioframe.operators import evaluate

    wide = spark.createDataFrame([("a/p1.png", "Old Place", "present", "12", "unreadable"), ("p2.png", "missing", "present", None, "present")], "image string, village string, village_status string, area string, area_status string")
    truth = evaluate.melt_truth(wide, ("village", "area"))
    assert truth.count() == 4
    texts = spark.createDataFrame([("a/p1.png", "the OLD, place"), ("p2.png", "nothing here")], "image string, text string")
    seen = evaluate.field_visibility(truth, texts)
    got = {r.image: (r.exact, r.similarity) for r in seen.collect()}
    assert got["a/p1.png"] == (True, 1.0) and got["p2.png"][0] is False and 0 < got["p2.png"][1] < 0.5
    per = evaluate.field_benchmark(seen)
    assert {r.field: (r.evaluable, r.exact_recall) for r in per.collect()} == {"village": (2, 0.5), "OVERALL": (2, 0.5)}
    t = evaluate.timing_summary(spark.createDataFrame([("a", 2.0), ("b", 4.0)], "image string, seconds double")).first()
    assert (t.pages, t.total_seconds, t.mean_seconds, t.slowest) == (2, 6.0, 3.0, 4.0)
    rep = evaluate.report(per.filter("field = 'OVERALL'"), per, seen)
    assert sorted(r.part for r in rep.collect()) == ["document", "document", "summary"]
    preds = spark.createDataFrame([("x/p1.png", "village", "old place"), ("p9.png", "village", "z")], "image string, field string, value string")
    acc = {r.field: r for r in evaluate.extraction_accuracy(evaluate.scored(preds, truth)).collect()}
    assert acc["OVERALL"].evaluable == 1 and acc["OVERALL"].exact == 1
    joined, lost = evaluate.join_truth(preds.select("image"), truth)
    assert joined.count() == 2 and [r.image for r in lost.collect()] == ["p9.png"]
