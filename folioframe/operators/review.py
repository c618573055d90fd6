"""Human review: actions on fields, the review policy and the review queue."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from folioframe import presets as P
from folioframe.operators.runs import only_latest

DECISIONS = {"ACCEPT": "ACCEPTED", "VERIFY": "VERIFIED", "FLAG": "FLAGGED", "REJECT": "REJECTED", "EDIT": "EDITED"}


def valid_actions(actions: DataFrame) -> DataFrame:
    """Known actions; an EDIT needs a value that isn't blank."""
    return actions.filter(F.col("action").isin(*DECISIONS) & ((F.col("action") != "EDIT") | (F.trim(F.coalesce("new_value", F.lit(""))) != "")))


def audit_rows(fields: DataFrame, actions: DataFrame) -> DataFrame:
    """One row an action: (action_id, field_id, action, old_value, new_value, decision, reason, ts), values as the fold in (ts, action_id) order leaves them."""
    own = valid_actions(actions).join(fields.select("field_id", F.col("value").alias("_start")), "field_id")
    w = W.partitionBy("field_id").orderBy("ts", "action_id")
    edited = F.when(F.col("action") == "EDIT", F.trim("new_value"))
    after = F.coalesce(F.last(edited, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0)), "_start")
    before = F.coalesce(F.last(edited, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1)), "_start")
    decision = F.create_map(*[F.lit(x) for kv in DECISIONS.items() for x in kv])[F.col("action")]
    return own.select("action_id", "field_id", "action", before.alias("old_value"), after.alias("new_value"), decision.alias("decision"), "reason", "ts")


def last_decisions(actions: DataFrame) -> DataFrame:
    """(field_id, decision, edited) of each field with a valid action: what its last action decided, and the value of its last EDIT.

    On a stream this is a keyed state: one row a field, whatever the number of actions.
    """
    edit = F.col("action") == "EDIT"
    status = F.create_map(*[F.lit(x) for kv in DECISIONS.items() for x in kv])
    last = valid_actions(actions).groupBy("field_id").agg(F.max_by("action", F.struct("ts", "action_id")).alias("_a"), F.max_by(F.when(edit, F.trim("new_value")), F.when(edit, F.struct("ts", "action_id"))).alias("edited"))
    return last.select("field_id", status[F.col("_a")].alias("decision"), "edited")


def with_decisions(fields: DataFrame, decisions: DataFrame) -> DataFrame:
    out = fields.join(decisions.withColumnsRenamed({"decision": "_d", "edited": "_v"}), "field_id", "left")
    out = out.withColumns({"value": F.coalesce("_v", "value"), "normalized_value": F.coalesce(F.lower("_v"), "normalized_value"), "validation_status": F.coalesce("_d", "validation_status")})
    return out.select(*fields.columns)


def apply_reviews(fields: DataFrame, actions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(fields, audit): the last action decides a field's status, the last EDIT its value; normalised is the lower-cased value."""
    return with_decisions(fields, last_decisions(actions)), audit_rows(fields, actions)


def review_policy(actions: DataFrame) -> DataFrame:
    """Adds accepted, requires_revalidation, audit_required, reason and error of APPROVE, CORRECT and REJECT."""
    a = F.upper(F.trim(F.coalesce("action", F.lit(""))))
    error = F.when(~a.isin("APPROVE", "CORRECT", "REJECT"), F.concat(F.lit("Unsupported review action: "), a)).when((a == "CORRECT") & (F.trim(F.coalesce("new_value", F.lit(""))) == ""), "A corrected value is required for CORRECT.")
    said = F.when(a == "APPROVE", "Reviewer approved the extracted value.").when(a == "CORRECT", "Reviewer corrected the extracted value.").otherwise("Reviewer rejected the extracted value.")
    ok = error.isNull()
    return actions.withColumns({"accepted": F.when(ok, a != "REJECT"), "requires_revalidation": F.when(ok, True), "audit_required": F.when(ok, True), "reason": F.when(ok, F.coalesce(F.nullif("reason", F.lit("")), said)), "error": error})


def review_queue(fields: DataFrame, runs: DataFrame, statuses: tuple[str, ...] = P.REVIEW_STATUSES) -> DataFrame:
    """Fields of the newest completed run of each document that wait for review."""
    return only_latest(fields.filter(F.col("validation_status").isin(*statuses)), runs, order="completed")


def notifications(queue: DataFrame, n: int = 50) -> DataFrame:
    s = F.upper("validation_status")
    severity = F.when(s.isin("FLAGGED", "REVIEW"), s).otherwise("WARNING")
    title = F.when(s == "FLAGGED", "Field has been flagged").when(s == "REVIEW", "Field requires review").otherwise("Field has a validation warning")
    return queue.withColumns({"severity": severity, "title": title}).orderBy(F.col("created_at").desc(), "field_id").limit(n)
