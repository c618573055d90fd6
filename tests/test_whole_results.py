"""No result and no score at a limit is left out."""

from folioframe.operators import validate
from folioframe.plans import q_fields as Q


def test_strongest_of_all_rules_and_default(spark):
    results = spark.createDataFrame([(1, "rule_1", "REVIEW"), (1, "rule_0", "WARNING"), (2, "rule_1", "WARNING")], "field_id int, rule_name string, status string")
    got = Q.a6(results, spark.createDataFrame([(1,), (2,), (3,)], "field_id int")).collect()
    assert {r.field_id: r.validation_status for r in got} == {1: "REVIEW", 2: "WARNING", 3: "PASS"}


def test_scores_at_the_limits_are_banded_whole(spark):
    # 0.75 + 0.1, 0.55 + 0.1 and one a bit below.
    rows = [(x, None, None, "PASS", False, False) for x in (0.75, 0.55, 0.7499, 0.5499)]
    df = spark.createDataFrame(rows, "extraction_confidence double, ocr_confidence double, entity_match_score double, validation_status string, has_conflict boolean, requires_review boolean")
    assert [r.band for r in validate.calibrate(df).collect()] == ["HIGH", "MEDIUM", "MEDIUM", "LOW"]
