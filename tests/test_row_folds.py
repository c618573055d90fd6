"""Rows by running means against plain Python on skewed pages, and the index of label words against all labels."""

import random

from pyspark.sql import functions as F

from folioframe import presets as P
from folioframe.operators import extract


def brute_rows(blocks):
    out, rows = {}, []
    for cy, x, i, h in sorted((y + h / 2, x, i, h) for i, x, y, h in blocks):
        near = min(((abs(cy - r[0]), k) for k, r in enumerate(rows) if abs(cy - r[0]) <= max(18.0, 0.9 * min(h, r[1]))), default=None)
        if near is None:
            rows.append([cy, h, 1])
            out[i] = len(rows) - 1
        else:
            r = rows[near[1]]
            r[2] += 1
            r[0] += (cy - r[0]) / r[2]
            r[1] = max(r[1], h)
            out[i] = near[1]
    return out


def test_skewed_pages(spark):
    rng = random.Random(6)
    rows, want = [], {}
    for page in range(6):
        blocks = [(f"b{page}.{i}", 40 * (i % 7) + rng.randrange(5), 30 * (i // 7) + (i % 7) * (page * 3) + rng.randrange(8), rng.choice([10, 22, 30, 70])) for i in range(120)]
        want |= brute_rows(blocks)
        rows += [(page, i, (float(x), float(y), 20.0, float(h)), n) for n, (i, x, y, h) in enumerate(blocks)]
    rows += [(9, "none", None, 0)]
    df = spark.createDataFrame(rows, "page_id int, block_id string, bbox struct<x:double,y:double,width:double,height:double>, block_number int")
    got = extract.cluster_rows_greedy(df.repartition(3)).collect()
    assert {r.block_id: r.row_idx for r in got} == want
    size = {}
    for r in got:
        size[r.page_id, r.row_idx] = size.get((r.page_id, r.row_idx), 0) + 1
    assert all(r.row_size == size[r.page_id, r.row_idx] for r in got)
    # The chain of gaps gives other rows here: the two differ where centres drift.
    assert {r.block_id: r.row_idx for r in extract.cluster_rows(df.filter("bbox IS NOT NULL")).collect()} != want


def test_word_index_finds_every_label_that_scores(spark):
    rng = random.Random(3)
    labels = [x for xs in P.TABLE_LABELS.values() for x in xs]
    texts = set(labels)
    for x in labels:
        w = x.split(" ")
        texts |= {x[1:], x[:-2], x + "x", "a" + x + " b", " ".join(w[::-1]), " ".join([*w, "zz"]), w[0], w[-1][1:], x.replace("a", "o", 1), "".join(rng.sample(x, len(x)))}
    df = spark.createDataFrame([(i, t) for i, t in enumerate(sorted(texts))], "block_id int, text string")
    every = extract.score_headers(df).filter("header_score >= 0.7")
    few = extract.score_headers(df, least=0.7).filter("header_score >= 0.7")
    cols = ["block_id", "label_field", "label", F.round("header_score", 9)]
    assert every.count() > 100 and sorted(map(tuple, few.select(cols).collect())) == sorted(map(tuple, every.select(cols).collect()))
