"""Queries that SQL can't express, over whole tables of sf0.001, against plain Python."""

from collections import Counter, defaultdict
from difflib import SequenceMatcher

import pytest

from folioframe import presets as P
from folioframe.operators import match, runs, validate
from folioframe.plans import q_documents as D
from folioframe.plans import q_fields as FI
from folioframe.plans import q_quality as Q
from folioframe.plans.views import frame
from tests import brute_extract as B


@pytest.fixture(scope="module")
def fields(spark, sf_dir):
    return frame(spark, sf_dir, "v_fields").cache()


def ratio(a, b):
    return 0.0 if not a or not b else 1.0 if a == b else SequenceMatcher(None, a, b).ratio()


def test_n11_label_score(fields):
    values = {r.field_id: r.value for r in fields.collect()}
    for r in D.n11(fields).collect():
        assert r.score == pytest.approx(B.label_score(B.label_of(values[r.field_id]), "owner name"))


def test_j9_label_scores(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = {}
    for b in D.blocks_of(docs).select("block_id", "text").collect():
        n = B.label_of(b.text, "–—-")
        for label in ("owner name", "holder name"):
            s = B.label_score(n, label) if n and B.could(n, label, 0.3) else 0.0
            if s >= 0.3:
                want[b.block_id, label] = s
    got = {(r.block_id, r.label): r.score for r in D.j9(docs).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want) and len(want) > 50


def test_n9_ratcliff(fields):
    values = {r.field_id: r.value for r in fields.collect()}
    for r in Q.n9_ratcliff(fields).collect():
        assert r.similarity == pytest.approx(ratio(values[r.field_id] or "", "Owner 17"))


def test_w5_row_clusters_greedy(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    pages = defaultdict(list)
    for b in D.blocks_of(docs).collect():
        pages[b.page_id].append((b.bbox.y + b.bbox.height / 2, b.bbox.x, b.block_id, b.bbox.height))
    want = {}
    for own in pages.values():
        rows = []  # members of each row: (centre, height)
        for cy, _, block, h in sorted(own):
            near = [(abs(cy - sum(c for c, _ in r) / len(r)), i) for i, r in enumerate(rows) if abs(cy - sum(c for c, _ in r) / len(r)) <= max(18.0, 0.9 * min(h, max(x for _, x in r)))]
            if not near:
                rows.append([])
            i = min(near)[1] if near else len(rows) - 1
            rows[i].append((cy, h))
            want[block] = i
    assert {r.block_id: r.row_idx for r in D.w5_greedy(docs).collect()} == want


def records_of(spark, sf_dir):
    recs = [r.asDict() for r in match.normalized_records(frame(spark, sf_dir, "v_records")).collect()]
    return {r["record_id"]: {f: r[f"_n_{f}"] for f in P.ENTITY_WEIGHTS} for r in recs}


def score(a, b, sim):
    sims = {f: sim(a[f], b[f]) for f in P.ENTITY_WEIGHTS if a[f] and b[f]}
    return sum(P.ENTITY_WEIGHTS[f] * s for f, s in sims.items()) / sum(P.ENTITY_WEIGHTS[f] for f in sims) if sims else 0.0


def test_r2_compare_pairs_ratcliff(spark, sf_dir):
    recs = records_of(spark, sf_dir)
    ids = sorted(recs)
    want = {(x, y): score(recs[x], recs[y], ratio) for i, x in enumerate(ids) for y in ids[i + 1 :] if any(all(recs[x][k] and recs[x][k] == recs[y][k] for k in keys) for keys in FI.BLOCKS)}
    got = FI.r2(frame(spark, sf_dir, "v_records")).collect()
    assert len(got) == len(want) > 20
    for r in got:
        s = want[r.record_a, r.record_b]
        assert r.score == pytest.approx(s) and r.decision == ("POSSIBLE_DUPLICATE" if s >= 0.82 else "POSSIBLE_MATCH" if s >= 0.62 else "NO_MATCH")


def test_large_blocks_are_split_without_losing_or_repeating_pairs(spark, sf_dir):
    recs = match.normalized_records(frame(spark, sf_dir, "v_records"))
    pairs = lambda crowd: Counter((r.a.record_id, r.b.record_id) for r in match.candidate_pairs(recs, (("district",), ("village",)), crowd=crowd).collect())
    whole, split = pairs(10_000), pairs(7)
    assert whole == split and max(whole.values()) == 1 and len(whole) > 1000


def test_v10_fuzzy(fields):
    groups = defaultdict(list)
    for r in validate._single_valued(fields, P.SINGLE_VALUED).collect():
        groups[r.document_id, r.field_name].append(r)
    want = Counter()
    for (doc, name), rows in groups.items():
        if len(rows) < 2:
            continue
        firsts = {}
        for r in sorted(rows, key=lambda r: (r.created_at, r.field_id)):
            firsts.setdefault(r["_k"], r)
        heads, of = [], {}
        for k in firsts:
            near = next((h for h in heads if h == k or (name != "khata_number" and SequenceMatcher(None, k, h).ratio() >= 0.92)), None)
            of[k] = near or k
            heads += [] if near else [k]
        for h in heads:
            want[doc, name, firsts[h].field_id, "PASS" if len(heads) == 1 else "REVIEW"] += 1
    got = Counter((r.document_id, r.field_name, r.field_id, r.status) for r in validate.duplicate_consistency_fuzzy(fields).collect())
    assert got == want and len(want) > 100


def test_v15_is_its_parts(spark, sf_dir, fields):
    """The parts are held against SQL each for itself."""
    own = runs.only_latest(fields, frame(spark, sf_dir, "v_runs")).cache()
    ref = frame(spark, sf_dir, "v_reference")
    parts = [validate.apply_rules(own), validate.suspicious_fields(own), validate.village_rules(own, ref), validate.duplicate_consistency(own), validate.area_checks(own), validate.date_order(own), validate.location_consistency(own, ref)]
    want = {}
    for part in parts:
        for r in part.collect():
            k = (r.field_id, r.document_id, r.field_name, r.rule_name, r.status, r.message)
            want[k] = max([c for c in (want.get(k), r.confidence) if c is not None], default=None)
    results, status, means = validate.validate_documents(own, ref)
    got = {(r.field_id, r.document_id, r.field_name, r.rule_name, r.status, r.message): r.confidence for r in results.collect()}
    assert got == want and len(want) > 500
    rank = {"PASS": 0, "WARNING": 1, "REVIEW": 2}
    top = defaultdict(int)
    for f, _, _, _, s, _ in want:
        top[f] = max(top[f], rank.get(s, 0))
    assert all(rank[r.validation_status] == top[r.field_id] for r in status.collect())
    mean = defaultdict(list)
    for (_, d, *_), c in want.items():
        mean[d] += [] if c is None else [c]
    assert all(r.confidence == pytest.approx(sum(mean[r.document_id]) / len(mean[r.document_id])) for r in means.collect() if mean[r.document_id])


def test_recall_of_blocks(spark, sf_dir):
    """What pairs of the keys find of all pairs' possible duplicates; the README gives the figure."""
    recs = records_of(spark, sf_dir)
    sim = lambda a, b: 1.0 if a == b else 1 - B.edits(a, b) / max(len(a), len(b))
    ids = sorted(recs)
    strong = [(x, y) for i, x in enumerate(ids) for y in ids[i + 1 :] if score(recs[x], recs[y], sim) >= P.DUPLICATE_SCORE]
    held = [p for p in strong if any(all(recs[p[0]][k] and recs[p[0]][k] == recs[p[1]][k] for k in keys) for keys in FI.BLOCKS)]
    print(f"{len(held)} of {len(strong)} pairs from {P.DUPLICATE_SCORE} on share a block")
    assert strong and len(held) / len(strong) >= 0.9
