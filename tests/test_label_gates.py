"""Blocks below headers without all pairs of a page, and looks at texts that come before their normalisers."""

import random

from pyspark.sql import functions as F

from folioframe import presets as P
from folioframe.functions import text as T
from folioframe.operators import extract

BLOCK = "page_id int, block_id string, block_number int, text string, bbox struct<x:double,y:double,width:double,height:double>"


def test_values_below_are_those_of_all_pairs(spark):
    rng = random.Random(4)
    rows = [(p, f"{p}.{i}", i, "Area" if i % 9 == 0 else "7", (float(rng.randrange(300)), rng.choice([-700.0, 0.0, 40.1, 1e9]) + rng.randrange(0, 900, 20) + rng.choice([0, 0.1, 1e-9]), 30.0, 20.0)) for p in range(3) for i in range(160)]
    rows += [(0, "far", 900, "7", (0.0, float("inf"), 1.0, 1.0)), (0, "none", 901, "7", None)]
    df = spark.createDataFrame(rows, BLOCK)
    got = extract.values_below(df.filter("text = 'Area'"), df, 280, 180)
    assert "_band" in got._jdf.queryExecution().optimizedPlan().toString()
    want = set()
    for p, i, _, t, b in rows:
        for q, j, _, _, c in rows:
            if p == q and i != j and t == "Area" and b and c and 0 < c[1] - (b[1] + b[3]) <= 280 and b[0] - 20 <= c[0] <= b[0] + max(b[2], 180) + 40:
                want.add((i, j))
    found = [(r.h.block_id, r.block_id) for r in got.collect()]
    assert len(found) == len(set(found)) and set(found) == want and len(want) > 300


def odd_texts():
    rng = random.Random(8)
    labels = [x for d in (P.ADJACENT_LABELS, P.INLINE_LABELS, P.TABLE_LABELS) for xs in d.values() for x in xs] + list(P.OWNER_HEADERS)
    marks = [" ", "  ", " ", ":", " : ", "/", "-", "—", ".", "\n", "#", "(", "x", "", "", ""]
    out = [None, "", " ", "7", "१२.५", " 12,5 /", " 7 . 5", "o", "e n", "न", "er name", "12/3", "quick " * 60, "K: 3"]
    for x in labels:
        y = x.replace(" ", rng.choice(marks[:8] + ["- "]))
        out += [x, x.upper(), y, rng.choice(marks) + y + rng.choice(marks), f"{rng.choice(marks)}{y}{rng.choice(marks)}: {rng.choice(['7', 'some place', '7/12'])}", "a long line of words before " + y + " and many words that follow it, far too many to be alike", y[: rng.randrange(len(y) + 1)], x + "s"]
    return out


def test_no_look_leaves_out_what_its_normaliser_finds(spark):
    df = spark.createDataFrame([(x,) for x in odd_texts()], "text string")
    adjacent = [x for xs in P.ADJACENT_LABELS.values() for x in xs]
    tight = {"".join(x.split()).lower() for xs in P.INLINE_LABELS.values() for x in xs}
    squeezed = F.regexp_replace(F.lower(T.clean_candidate("text")), "\\s+", "")
    said = T.any_of([squeezed.startswith(x + s) for x in tight for s in ":|/-"])
    known = [r.label for r in spark.range(1).select(F.inline(extract.label_list(P.TABLE_LABELS))).collect()]
    n = T.normalize_label("text", "–—-")
    shares = T.any_of([(n != "") & (F.arrays_overlap(F.split(n, " "), F.array(*map(F.lit, x.split()))) | n.contains(F.lit(x)) | F.lit(x).contains(n)) for x in known])
    pairs = {
        "label": (T.may_be_label("text", adjacent), T.normalize_label("text").isin(*adjacent)),
        "inline": (T.may_begin_with_label("text", tight), said),
        "table": (T.may_share_label("text", known), shares),
        "number": (T.may_be_number("text"), T.valid_positive(T.clean_candidate("text"))),
    }
    for name, (look, whole) in pairs.items():
        got = df.select("text", F.coalesce(look, F.lit(False)).alias("look"), whole.alias("whole")).collect()
        assert not [r.text for r in got if r.whole and not r.look], name
        assert any(r.whole for r in got) and any(not r.look for r in got), name
        assert not next(r.look for r in got if r.text and r.text.startswith("quick quick")), name


def test_label_lists_of_long_texts_are_those_of_all_labels(spark):
    rows = [(1, str(i), i, x, None) for i, x in enumerate(odd_texts())]
    df = spark.createDataFrame(rows, BLOCK)
    key = lambda d: sorted((r.block_id, r.label_field, r.label, round(r.header_score, 9)) for r in d.collect() if r.header_score >= 0.7)
    for method in ("levenshtein", "ratcliff"):
        got = key(extract.score_headers(df, P.TABLE_LABELS, method, least=0.7))
        assert got == key(extract.score_headers(df, P.TABLE_LABELS, method)) and len(got) > 100
