"""Pairs that score ``least``, where no field has to be equal: parts of the records meet as matrices."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioframe.functions.similarity import edit_similarities, similarity
from folioframe.operators import match


def test_edit_similarities_are_sparks(spark):
    rng = random.Random(3)
    words = ["", "a", "customer 1", "गाव ७", "a😀b", "x" * 70, *["customer " + "".join(rng.choices("0123é", k=rng.randint(0, 7))) for _ in range(30)]]
    i, j = (x.ravel() for x in np.meshgrid(range(len(words)), range(len(words))))
    own = spark.createDataFrame([(k, words[x], words[y]) for k, (x, y) in enumerate(zip(i.tolist(), j.tolist(), strict=True))], "k int, a string, b string")
    said = own.select("k", F.when((F.col("a") != "") & (F.col("b") != ""), similarity(F.col("a"), F.col("b"))).alias("s")).orderBy("k").collect()
    got = edit_similarities(words, words, i, j)
    assert [r.s for r in said] == [None if np.isnan(x) else x for x in got]
    assert len(edit_similarities([], [], i[:0], j[:0])) == 0


@pytest.mark.parametrize("kind", ["long", "string"])
def test_low_thresholds_meet_by_parts_and_lose_nothing(spark, monkeypatch, kind):
    rng = random.Random(5)
    rows = [(k, rng.choice(["", "owner of long name ", "holder of long name "]) + str(rng.randrange(90)), f"{rng.randrange(9)}/{rng.randrange(3)}", str(200000 + rng.randrange(5)), rng.choice(["Abcdef", "Abcdeg", "Xyzuvw", None]), "Taluka", rng.choice(["D", ""]), f"{rng.randrange(4)}.5") for k in range(150)]
    own = spark.createDataFrame(rows, "record_id long, owner string, survey_number string, khata_number string, village string, taluka string, district string, area string").withColumn("record_id", F.col("record_id").cast(kind))
    met, real = [], match.pairs_of_parts
    monkeypatch.setattr(match, "pairs_of_parts", lambda *a, **k: met.append(1) or real(*a, crowd=40, **k))
    # Owners have more values than are numbered, so their edits are counted in the tasks.
    found = match.resolve_entities(own, few=30)
    got = {(r.record_a, r.record_b): (r.score, r.decision, dict(r.compared_fields)) for r in found.collect()}
    assert met, "every pair was a row of a join"
    every = match.resolve_entities(own, include_no_match=True).filter(f"score >= {match.P.MATCH_SCORE}").collect()
    assert len(every) > 100
    assert got == {(r.record_a, r.record_b): (r.score, r.decision, dict(r.compared_fields)) for r in every}
