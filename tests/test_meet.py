"""Pairs that meet in a task as arrays: none is lost, repeated or made a row without need."""

import random

import pytest
from pyspark.sql import functions as F

from folioframe.functions.similarity import edit_similarities, sequence_edits
from folioframe.operators import match
from folioframe.plans import q_fields as FI
from folioframe.plans.views import frame

FIELDS = "record_id long, owner string, survey_number string, khata_number string, village string, taluka string, district string, area string"


def people(seed, n):
    rng = random.Random(seed)
    return [(k, rng.choice(["", "Owner of land "]) + str(rng.randrange(40)), f"{rng.randrange(6)}/{rng.randrange(3)}", str(rng.randrange(4)), rng.choice(["Abcdef", "Abcdeg", "Xyzuvw", None]), rng.choice(["t1", "t2", ""]), "d", f"{rng.randrange(4)}.5") for k in range(n)]


@pytest.mark.parametrize("crowd", [5, 3000])
def test_pairs_are_counted_where_they_meet(spark, monkeypatch, crowd):
    """The counts of all compared pairs, though no pair but the undecided ones is a row; large keys are split."""
    own, rows, real = spark.createDataFrame(people(4, 120), FIELDS), [], match.pairs_in_blocks
    monkeypatch.setattr(match, "pairs_in_blocks", lambda *a, **k: rows.append(real(*a, **k, crowd=crowd)) or rows[-1])
    got = match.count_matches(own, FI.BLOCKS, few=30).first()
    want = match.match_counters(own, match.resolve_entities(own, FI.BLOCKS, include_no_match=True)).first()
    assert (got.records, got.comparisons, got.flagged) == (want.records, want.comparisons, want.flagged) and 0 < got.flagged < got.comparisons
    assert rows[0].filter("a IS NOT NULL").count() < got.comparisons / 20
    assert match.count_matches(own.limit(0), FI.BLOCKS).first()["comparisons"] == 0


def test_a17_makes_no_row_of_a_pair(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(match, "candidate_pairs", None)
    got = FI.a17(frame(spark, sf_dir, "v_records")).first()
    assert got.comparisons > got.flagged > 0


@pytest.mark.parametrize("least,keys", [(0.62, ()), (0.62, ("survey_number",)), (0.82, ("survey_number", "khata_number", "village"))])
def test_parts_of_near_keys_hold_every_pair_once(spark, least, keys):
    """Parts of records whose keys are near: one key with more records than a part, values that are missing, pairs of one part and of two."""
    rows = people(8, 150) + [(1000 + k, f"Owner of land {k}", "1/1", "2", "Abcdef", "t1", "d", "0.5") for k in range(40)]
    r, sizes, alike = match.numbered(match.normalized_records(spark.createDataFrame(rows, FIELDS)), match.P.ENTITY_WEIGHTS, "levenshtein", 30)
    pairs = match.pairs_of_parts(r, len(rows), sizes, alike, least, match.P.ENTITY_WEIGHTS, crowd=25, keys=keys, near=0.1)
    got = sorted((x.record_a, x.record_b, x.score) for x in match.compare_pairs(pairs).filter(F.col("score") >= least).collect())
    every = match.compare_pairs(match.candidate_pairs(r, ((),)))
    assert got == sorted((x.record_a, x.record_b, x.score) for x in every.filter(F.col("score") >= least).collect()) and len(got) > 300


def test_edits_of_texts_of_any_length():
    rng = random.Random(1)
    for most in (0, 5, 400):
        text = lambda: rng.choice(["", "x ", "x é"]) + "".join(rng.choices("01ab😀\0", k=rng.randint(0, most))) + rng.choice(["", " y"])  # noqa: B023, E731
        a, b = [text() for _ in range(12)], [text() for _ in range(12)]
        i, j = [k // 12 for k in range(144)], [k % 12 for k in range(144)]
        import numpy as np

        said = edit_similarities(a, b, np.array(i), np.array(j))
        assert [None if np.isnan(s) else s for s in said] == [1 - sequence_edits(a[p], b[q]) / max(len(a[p]), len(b[q])) if a[p] and b[q] else None for p, q in zip(i, j, strict=True)]


def test_matching_blocks_of_many_pairs_are_difflibs():
    from difflib import SequenceMatcher

    import numpy as np

    from folioframe.functions.similarity import ratcliff_ratios

    rng = random.Random(2)
    for letters, most in (("01", 9), ("01", 40), ("ab😀é ", 20), ("abc", 260)):
        texts = ["", *[rng.choice(["", "customer "]) + "".join(rng.choices(letters, k=rng.randint(0, most))) for _ in range(14)]]
        i, j = (at.ravel() for at in np.meshgrid(range(15), range(15)))
        said = ratcliff_ratios(texts, texts)(i, j)
        assert [None if np.isnan(s) else s for s in said] == [SequenceMatcher(None, texts[p], texts[q]).ratio() if texts[p] and texts[q] else None for p, q in zip(i, j, strict=True)]


def test_pairs_of_blocks_meet_as_arrays(spark, monkeypatch):
    """Every pair of a block once, with all that compare_pairs gives, though owners are compared in no Python call a pair."""
    # Ids in no order of the rows, and texts whose matching blocks are others the other way round.
    rng = random.Random(3)
    ids = rng.sample(range(5000), 1100)
    own = spark.createDataFrame([(k, "".join(rng.choices("ab c", k=9)), *r[2:]) for k, r in zip(ids, people(9, 1100), strict=True)], FIELDS)
    blocks = (("survey_number", "khata_number", "area"), ("village", "khata_number", "taluka"))
    want = match.compare_pairs(match.candidate_pairs(match.normalized_records(own), blocks), method="ratcliff")
    met, real = [], match.pairs_in_blocks
    monkeypatch.setattr(match, "pairs_in_blocks", lambda *a, **k: met.append(1) or real(*a, **k, crowd=30))
    got = match.resolve_entities(own, blocks, include_no_match=True, method="ratcliff", few=20)
    rows = lambda df: sorted((r.record_a, r.record_b, r.score, r.decision, tuple(r.reasons), tuple(sorted((k, round(v, 9)) for k, v in r.compared_fields.items()))) for r in df.collect())
    said = rows(got)
    assert met and said == rows(want) and len(said) > 1000
