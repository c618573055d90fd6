"""Field rules, cross-field consistency, reference checks, strongest status and confidence calibration.

Fields are rows (field_id, document_id, run_id, field_name, value, normalized_value, confidence, method, created_at). Rules
give rows (field_id, document_id, field_name, rule_name, status, message, confidence).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from folioframe import presets as P
from folioframe.functions.geometry import unit_confidence
from folioframe.functions.text import consistency_text, date_from_text, first_number, fold_digits, reference_name
from folioframe.operators.match import match_reference

RESULTS = ("field_id", "document_id", "field_name", "rule_name", "status", "message", "confidence")
RANK = {"PASS": 0, "WARNING": 1, "REVIEW": 2}


def outcome(rule: str | Column, status: str | Column, message: str | Column, confidence: Column) -> Column:
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.struct(lit(rule).alias("rule_name"), lit(status).alias("status"), lit(message).alias("message"), confidence.cast("double").alias("confidence"))


_value = lambda: F.trim(F.coalesce(F.nullif("normalized_value", F.lit("")), "value", F.lit("")))
_given = lambda: F.trim(F.coalesce(F.nullif("value", F.lit("")), "normalized_value", F.lit("")))


def required_value(required: tuple[str, ...] = P.REQUIRED_FIELDS) -> Column:
    there = F.trim(F.coalesce("value", F.lit(""))) != ""
    return F.when(F.col("field_name").isin(*required), outcome("required_value", F.when(there, "PASS").otherwise("REVIEW"), F.when(there, "Required field contains a value.").otherwise("Required field is empty and requires review."), F.col("confidence")))


def survey_number_format() -> Column:
    v = fold_digits(_value())
    ok = v.rlike("^[0-9]+(/[0-9]+)*$")
    message = F.when(v == "", "Survey number is empty.").when(ok, "Survey number matches the expected numeric format.").otherwise("Survey number does not match the expected numeric/subdivision format.")
    return F.when(F.col("field_name") == "survey_number", outcome("survey_number_format", F.when(ok, "PASS").otherwise("REVIEW"), message, F.col("confidence")))


def numeric_format(names: tuple[str, ...] = ("subdivision", "khata_number")) -> Column:
    ok = fold_digits(_value()).rlike("^(-|[0-9]+(/[0-9]+)*)$")
    return F.when(F.col("field_name").isin(*names), outcome("seven_twelve_numeric_format", F.when(ok, "PASS").otherwise("REVIEW"), F.when(ok, "7/12 numeric field matches the expected format.").otherwise("7/12 numeric field has an unexpected format and requires review."), F.col("confidence")))


def area_format() -> Column:
    ok = F.coalesce(F.replace(fold_digits(_value()), F.lit(","), F.lit(".")).try_cast("double") > 0, F.lit(False))
    return F.when(F.col("field_name") == "area", outcome("seven_twelve_area_format", F.when(ok, "PASS").otherwise("REVIEW"), F.when(ok, "Area value is a positive numeric value.").otherwise("Area value is not a positive numeric value."), F.col("confidence")))


def text_value(names: tuple[str, ...] = ("land_tenure", "local_field_name", "owner"), generic: tuple[str, ...] = P.SANITY_GENERIC) -> Column:
    v = _value()
    bad = F.lower(v).isin(*generic) | (F.length(v) < 2)
    conf = F.when(bad, F.least(F.coalesce("confidence", F.lit(0.0)), F.lit(35.0))).otherwise(F.col("confidence"))
    return F.when(F.col("field_name").isin(*names), outcome("seven_twelve_text_value", F.when(bad, "REVIEW").otherwise("PASS"), F.when(bad, "7/12 text field resembles a header/label rather than a value.").otherwise("7/12 text field contains a non-empty candidate value."), conf))


def confidence_threshold(review: float = 50.0, warning: float = 75.0) -> Column:
    c = F.col("confidence")
    status = F.when(c.isNull() | (c < review), "REVIEW").when(c < warning, "WARNING").otherwise("PASS")
    message = F.when(c.isNull(), "No extraction confidence is available.").when(c < review, F.format_string("Extraction confidence is low (%.2f%%). Human review is recommended.", c)).when(c < warning, F.format_string("Extraction confidence is moderate (%.2f%%).", c)).otherwise(F.format_string("Extraction confidence is high (%.2f%%).", c))
    return outcome("confidence_threshold", status, message, c)


def suspicious_value(values: tuple[str, ...] = P.SUSPICIOUS_VALUES, labels: tuple[str, ...] = P.SUSPICIOUS_LABELS) -> Column:
    v = F.trim(F.regexp_replace(F.lower(_given()), "\\s+", " "))
    odd = v.isin(*values) | (F.col("field_name").isin("mutation", "registration") & v.isin(*labels)) | F.lower(F.coalesce("method", F.lit(""))).endswith("_suspect")
    message = F.concat(F.lit("Extracted value '"), F.coalesce("value", F.lit("None")), F.lit("' appears to be a document/table header or label rather than a field value. Human review is required before it can be trusted."))
    return F.when(odd, outcome("field_value_suspicious", "REVIEW", message, F.least(F.coalesce("confidence", F.lit(0.0)), F.lit(25.0))))


#: Rule registry: functions that give a struct column, null where the rule doesn't apply.
RULES: tuple[Callable[[], Column], ...] = (required_value, survey_number_format, numeric_format, area_format, text_value, confidence_threshold)


def apply_rules(fields: DataFrame, rules: tuple[Callable[[], Column], ...] = RULES) -> DataFrame:
    own = fields.withColumn("_o", F.explode(F.array_compact(F.array(*[r() for r in rules]))))
    return own.select("field_id", "document_id", "field_name", "_o.*")


def suspicious_fields(fields: DataFrame) -> DataFrame:
    return apply_rules(fields, (suspicious_value,))


def area_value() -> Column:
    n = first_number(_given())
    shown = F.regexp_replace(F.format_string("%.4f", n), "\\.?0+$", "")
    ok = n > 0
    rule = F.when(n.isNull(), "consistency_area_numeric").otherwise("consistency_area_positive")
    message = F.when(n.isNull(), "Area could not be interpreted as a numeric value.").when(ok, F.concat(F.lit("Area value "), shown, F.lit(" is positive and numerically valid."))).otherwise(F.concat(F.lit("Area value "), shown, F.lit(" is not positive.")))
    return F.when(F.col("field_name") == "area", outcome(rule, F.when(ok, "PASS").otherwise("REVIEW"), message, F.col("confidence")))


def area_checks(fields: DataFrame) -> DataFrame:
    return apply_rules(fields.filter("field_name = 'area'"), (area_value,))


def _cluster_results(clusters: DataFrame) -> DataFrame:
    """clusters: (document_id, field_name, cluster order, first field, value, n, confidence) -> PASS on one, REVIEW on each of several."""
    w = W.partitionBy("document_id", "field_name")
    name = F.replace("field_name", F.lit("_"), F.lit(" "))
    c = clusters.withColumns({"_k": F.count(F.lit(1)).over(w), "_n": F.sum("n").over(w), "_all": F.array_sort(F.collect_list(F.struct("ord", "value", "n")).over(w))})
    shown = F.array_join(F.transform("_all", lambda x: F.concat(x["value"], F.lit(" ("), x["n"].cast("string"), F.when(x["n"] == 1, " occurrence)").otherwise(" occurrences)"))), "; ")
    one = F.col("_k") == 1
    message = F.when(one, F.concat(F.lit("All "), F.col("_n").cast("string"), F.lit(" extracted "), name, F.lit(" values are consistent."))).otherwise(F.concat(F.lit("Conflicting "), name, F.lit(" values were extracted: "), shown, F.lit(". Human review is required to determine the correct value.")))
    rule = F.concat(F.lit("consistency_"), F.col("field_name"), F.when(one, "_duplicates").otherwise("_conflict"))
    return c.filter("_n >= 2").select("field_id", "document_id", "field_name", rule.alias("rule_name"), F.when(one, "PASS").otherwise("REVIEW").alias("status"), message.alias("message"), "confidence")


def _single_valued(fields: DataFrame, names: tuple[str, ...]) -> DataFrame:
    own = fields.filter(F.col("field_name").isin(*names)).withColumn("_v", _given()).filter("_v <> ''")
    n = consistency_text("_v")
    key = F.when(F.col("field_name") == "khata_number", F.regexp_replace(n, "\\s+", "")).otherwise(n)
    return own.withColumn("_k", key)


def duplicate_consistency(fields: DataFrame, names: tuple[str, ...] = P.SINGLE_VALUED) -> DataFrame:
    """Single-valued fields with two values or more in a document: equal after normalising passes, else each value is reviewed."""
    own = _single_valued(fields, names)
    first = lambda c: F.min_by(c, F.struct("created_at", "field_id"))
    clusters = own.groupBy("document_id", "field_name", "_k").agg(F.min(F.struct("created_at", "field_id")).alias("ord"), first("field_id").alias("field_id"), first("_v").alias("value"), F.count(F.lit(1)).alias("n"), F.avg("confidence").alias("confidence"))
    return _cluster_results(clusters)


def duplicate_consistency_fuzzy(fields: DataFrame, names: tuple[str, ...] = P.SINGLE_VALUED, least: float = 0.92) -> DataFrame:
    """As above, but values at least ``least`` similar to the first of a cluster join it. Distinct values of one document's field are a group."""

    @F.pandas_udf("array<int>")
    def cluster(groups):
        import pandas as pd
        from difflib import SequenceMatcher

        known: dict[tuple[str, str], bool] = {}

        def near(k: str, h: str) -> bool:
            if (k, h) not in known:
                m = SequenceMatcher(None, k, h)  # the quick ratios are upper bounds
                if len(known) > 100_000:
                    known.clear()
                known[k, h] = m.real_quick_ratio() >= least and m.quick_ratio() >= least and m.ratio() >= least
            return known[k, h]

        def put(keys) -> list[int]:
            heads: list[str] = []
            at = []
            for k in keys:
                i = next((i for i, h in enumerate(heads) if near(k, h)), len(heads))
                heads += [k] if i == len(heads) else []
                at.append(i)
            return at

        return pd.Series([None if keys is None else put(keys) for keys in groups])

    first = lambda c: F.min_by(c, F.struct("created_at", "field_id"))
    sums = (F.sum("n").alias("n"), F.sum("_s").alias("_s"), F.sum("_m").alias("_m"))
    each = _single_valued(fields, names).withColumns({"n": F.lit(1), "_s": F.col("confidence").cast("double"), "_m": F.col("confidence").isNotNull().cast("int")})
    each = each.groupBy("document_id", "field_name", "_k").agg(F.min(F.struct("created_at", "field_id")).alias("ord"), first("field_id").alias("field_id"), first("_v").alias("value"), *sums)
    groups = each.groupBy("document_id", "field_name").agg(F.array_sort(F.collect_list(F.struct(F.col("ord.created_at").isNull().alias("last"), "ord", "_k", "field_id", "value", "n", "_s", "_m"))).alias("_g"))
    # Numbers of accounts are equal or not, and one value is a cluster; only the others are compared in Python.
    compared = (F.col("field_name") != "khata_number") & (F.size("_g") > 1)
    at = F.coalesce(cluster(F.when(compared, F.transform("_g", lambda g: g["_k"]))), F.transform("_g", lambda g, i: i))
    put = groups.withColumn("_c", at).select("document_id", "field_name", F.inline(F.arrays_zip("_g", "_c"))).select("document_id", "field_name", "_c", "_g.*")
    put = put.groupBy("document_id", "field_name", "_c").agg(F.min("ord").alias("ord"), F.min_by("field_id", "ord").alias("field_id"), F.min_by("value", "ord").alias("value"), *sums)
    return _cluster_results(put.withColumn("confidence", F.when(F.col("_m") > 0, F.col("_s") / F.col("_m"))))


#: Fields whose first value in a document other checks need; all are found in one pass.
FIRSTS = ("mutation", "registration", "village", "taluka", "district")


def _firsts(fields: DataFrame) -> DataFrame:
    """Per document the first field with a value of each of FIRSTS: structs of id, value, confidence."""
    own = fields.withColumn("_v", _given()).filter(F.col("_v") != "").filter(F.col("field_name").isin(*FIRSTS))
    pick = lambda n: F.min_by(F.when(F.col("field_name") == n, F.struct("field_id", F.col("_v").alias("value"), "confidence")), F.when(F.col("field_name") == n, F.struct("created_at", "field_id"))).alias(n)
    return own.groupBy("document_id").agg(*map(pick, FIRSTS))


def date_order(fields: DataFrame, firsts: DataFrame | None = None) -> DataFrame:
    """The first mutation's date must not lie before the first registration's."""
    f = (_firsts(fields) if firsts is None else firsts).withColumns({"_m": date_from_text("mutation.value"), "_r": date_from_text("registration.value")}).filter("_m IS NOT NULL AND _r IS NOT NULL")
    early = F.col("_m") < F.col("_r")
    day = lambda c: F.date_format(c, "dd/MM/yyyy")
    message = F.when(early, F.concat(F.lit("Mutation date "), day("_m"), F.lit(" occurs before registration date "), day("_r"), F.lit(". Review the source record."))).otherwise("Mutation date is on or after the registration date.")
    return f.select("mutation.field_id", "document_id", F.lit("mutation").alias("field_name"), F.lit("consistency_mutation_registration_date").alias("rule_name"), F.when(early, "REVIEW").otherwise("PASS").alias("status"), message.alias("message"), "mutation.confidence")


def village_rules(fields: DataFrame, ref: DataFrame) -> DataFrame:
    """village_reference_match and location_hierarchy: the village by its name alone."""
    own = fields.filter("field_name = 'village' AND value IS NOT NULL AND value <> ''")
    m = match_reference(own, ref, name="value")
    s, quoted = F.col("match_status"), F.concat(F.lit("Village '"), F.col("value"), F.lit("'"))
    status, conf = F.when(s == "MATCHED", "PASS").otherwise("REVIEW"), F.when(s == "MATCHED", 100.0).when(s == "AMBIGUOUS", 50.0).otherwise(0.0)
    name = F.concat(quoted, F.when(s == "MATCHED", " matched the reference dataset.").when(s == "AMBIGUOUS", " matched multiple reference records. Additional location context is required.").otherwise(" was not found in the available reference dataset."))
    chain = F.concat_ws(" → ", F.coalesce("ref.district_name", F.lit("Unknown district")), F.coalesce("ref.taluka_name", F.lit("Unknown taluka")), F.coalesce("ref.village_name", "ref.local_name", "value"))
    place = F.concat(quoted, F.when(s == "MATCHED", F.concat(F.lit(" resolves to the reference location hierarchy: "), chain, F.lit("."))).when(s == "AMBIGUOUS", " has multiple possible reference matches.").otherwise(" could not be established against the reference location hierarchy."))
    return apply_rules(m, (lambda: outcome("village_reference_match", status, name, conf), lambda: outcome("location_hierarchy", status, place, conf)))


def location_consistency(fields: DataFrame, ref: DataFrame, firsts: DataFrame | None = None) -> DataFrame:
    """The first village with taluka and district as context; a resolved village's parents are compared with the extracted ones."""
    f = (_firsts(fields) if firsts is None else firsts).filter("village IS NOT NULL")
    f = f.withColumns({"village_name": F.col("village.value"), "taluka_name": F.col("taluka.value"), "district_name": F.col("district.value")})
    m = match_reference(f, ref, name="village_name", parent="taluka_name", grandparent="district_name")
    s = F.col("match_status")
    quoted = F.concat(F.lit("Village '"), F.col("village_name"), F.lit("'"))
    lost = F.when(s != "MATCHED", F.struct(F.col("village.field_id").alias("field_id"), F.lit("village").alias("field_name"), outcome("consistency_reference_location", "REVIEW", F.concat(quoted, F.when(s == "AMBIGUOUS", " matched multiple reference records. Additional location context is required.").otherwise(" was not found in the available reference dataset.")), F.when(s == "AMBIGUOUS", 50.0).otherwise(0.0)).alias("o")))

    def parent(name: str) -> Column:
        actual, expected = F.col(f"{name}_name"), F.col(f"ref.{name}_name")
        same = reference_name(actual) == reference_name(expected)
        rule = F.when(same, f"consistency_{name}_reference").otherwise(f"consistency_{name}_reference_conflict")
        message = F.when(same, f"{name.title()} is consistent with the reference village hierarchy.").otherwise(F.concat(F.lit(f"Extracted {name} '"), actual, F.lit("' does not match the reference hierarchy value '"), expected, F.lit("' for village '"), F.col("village_name"), F.lit("'.")))
        o = outcome(rule, F.when(same, "PASS").otherwise("REVIEW"), message, F.when(same, 100.0).otherwise(0.0))
        return F.when((s == "MATCHED") & actual.isNotNull() & (reference_name(expected) != ""), F.struct(F.col(f"{name}.field_id").alias("field_id"), F.lit(name).alias("field_name"), o.alias("o")))

    return m.select("document_id", F.explode(F.array_compact(F.array(lost, parent("taluka"), parent("district")))).alias("x")).select("x.field_id", "document_id", "x.field_name", "x.o.*")


def all_results(*parts: DataFrame) -> DataFrame:
    out = parts[0].select(*RESULTS)
    for p in parts[1:]:
        out = out.unionByName(p.select(*RESULTS))
    return out


def distinct_results(results: DataFrame) -> DataFrame:
    """One row for each (field, rule, status, message), with the highest confidence."""
    return results.groupBy("field_id", "document_id", "field_name", "rule_name", "status", "message").agg(F.max("confidence").alias("confidence")).select(*RESULTS)


def strongest_status(results: DataFrame, fields: DataFrame) -> DataFrame:
    """(field_id, validation_status): REVIEW over WARNING over PASS; PASS where there is no result."""
    rank = F.coalesce(F.create_map(*[F.lit(x) for kv in RANK.items() for x in kv])[F.col("status")], F.lit(0))
    top = results.groupBy("field_id").agg(F.max(rank).alias("_r"))
    return fields.select("field_id").join(top, "field_id", "left").select("field_id", F.element_at(F.array(*map(F.lit, RANK)), F.coalesce("_r", F.lit(0)) + 1).alias("validation_status"))


def validate_documents(fields: DataFrame, ref: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(results, status of fields, mean confidence of documents) of the fields of one run a document.

    All rules of a field are one pass over the fields; the firsts of a document, one aggregation, serve dates and places alike.
    """
    firsts = _firsts(fields)
    results = distinct_results(all_results(apply_rules(fields, (*RULES, suspicious_value, area_value)), village_rules(fields, ref), duplicate_consistency(fields), date_order(fields, firsts), location_consistency(fields, ref, firsts)))
    return results, strongest_status(results, fields), results.groupBy("document_id").agg(F.avg("confidence").alias("confidence"))


def calibrate(df: DataFrame) -> DataFrame:
    """Adds score, band, automation_allowed and reasons from extraction_confidence, ocr_confidence, entity_match_score, validation_status, has_conflict, requires_review."""
    df = df.withColumns({"_x": unit_confidence(F.col("extraction_confidence")), "_o": unit_confidence(F.col("ocr_confidence")), "_e": unit_confidence(F.col("entity_match_score"))})
    parts = {"_x": 0.45, "_o": 0.25, "_e": 0.20}
    zero = F.lit(0.0)
    have = sum((F.when(F.col(c).isNotNull(), w).otherwise(zero) for c, w in parts.items()), zero)
    base = F.when(have > 0, sum((F.coalesce(F.col(c) * w, zero) for c, w in parts.items()), zero) / have).otherwise(0.0)
    s = F.upper(F.coalesce("validation_status", F.lit("")))
    good, warn, bad = s.isin("PASS", "VALID", "APPROVED"), s.isin("WARNING", "WARN"), s.isin("REVIEW", "FAILED", "FAIL", "INVALID")
    clash, flagged = F.coalesce("has_conflict", F.lit(False)), F.coalesce("requires_review", F.lit(False))
    score = base + F.when(good, 0.10).when(warn, -0.10).when(bad, -0.25).otherwise(0.0) + F.when(clash, -0.35).otherwise(0.0) + F.when(flagged, -0.20).otherwise(0.0)
    # Rounded before banding: sums of tenths may miss a band's limit by their last bit.
    df = df.withColumn("score", F.round(F.greatest(zero, F.least(F.lit(1.0), score)), 9))
    band = F.when(clash | flagged, "CONFLICT").when(F.col("score") >= 0.85, "HIGH").when(F.col("score") >= 0.65, "MEDIUM").otherwise("LOW")
    df = df.withColumn("band", band)
    reasons = F.array_compact(F.array(
        F.when(F.col("_x") < 0.65, "Extraction confidence is low."),
        F.when(F.col("_o") < 0.65, "OCR confidence is low."),
        F.when(F.col("_e") >= 0.85, "Cross-record similarity is high.").when(F.col("_e") >= 0.62, "Cross-record similarity warrants review."),
        F.when(have == 0, "No quantitative confidence signal was available."),
        F.when(good, "Validation status is positive.").when(warn, "Validation produced a warning.").when(bad, "Validation requires human review."),
        F.when(clash, "A cross-record or field conflict was detected."),
        F.when(flagged, "The record is already marked for human review."),
        F.when(F.col("band") == "MEDIUM", "Manual review is recommended before automation.").when(F.col("band") == "LOW", "Human review is required."),
    ))
    return df.withColumns({"automation_allowed": F.col("band") == "HIGH", "reasons": reasons}).drop("_x", "_o", "_e")

