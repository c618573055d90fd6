"""Exact dedup against plain groups: nulls, ties, repeated rows, one text with most rows, clashing columns, very long texts."""

import hashlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from folioframe.llm import exact


def brute(rows, largest, normal=lambda t: t):
    groups = defaultdict(list)
    for i, t in rows:
        groups[normal(t or "")].append(i)
    out = Counter()
    for t, ids in groups.items():
        known = [i for i in ids if i is not None]
        best = (max if largest else min)(known, default=None)
        sha = hashlib.sha256(t.encode()).hexdigest()
        for i, n in Counter(ids).items():
            out[i, best, len(ids), True, sha] += i == best
            out[i, best, len(ids), False, sha] += n - (i == best)
    return +out


def long_rows():
    base = "lorem ipsum " * 170_000  # 2 MB
    return [(1, base + "a"), (2, base + "b"), (3, base + "a")]


@pytest.mark.parametrize("largest", [False, True])
@pytest.mark.parametrize("parts", [4, 5000])
def test_rows_are_those_of_plain_groups(spark, messy_docs, largest, parts, monkeypatch):
    monkeypatch.setattr(exact, "PARTS", parts)
    rows = [(r.doc_id if r.doc_id % 4 else None, r.text) for r in messy_docs.collect()]
    rows += rows[::3] + [(i % 50, "hot") for i in range(300)] + [(None, "hot"), (None, "nobody"), (None, "nobody")] + long_rows()
    df = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in rows], "doc_id int, text string, _t int, _h int, kept int").repartition(3)
    got = Counter(map(tuple, exact.exact_duplicates(df, largest=largest).collect()))
    assert got == brute(rows, largest)


def test_normalised_texts_and_whole_rows(spark):
    rows = [(5, "A b", "x"), (2, "a B", "y"), (9, "c", "z"), (9, None, "u"), (1, "", "v")]
    df = spark.createDataFrame(rows, "doc_id int, text string, _best string")
    got = exact.exact_duplicates(df, normalise=F.lower)
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got.collect()) == brute([r[:2] for r in rows], False, str.lower)
    kept = exact.unique_rows(df, normalise=F.lower)
    assert kept.columns == df.columns and sorted(map(tuple, kept.collect()), key=str) == sorted([(2, "a B", "y"), (9, "c", "z"), (1, "", "v")], key=str)
    assert exact.exact_duplicates(df.limit(0)).count() == 0 and exact.unique_rows(df.limit(0)).count() == 0


def test_texts_are_exchanged_once(spark, sf_dir):
    """The window takes the range partitioning as it is."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    plan = exact._runs(docs, None, True)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("rangepartitioning(") == 1 and plan.count("hashpartitioning(_t") == 0 and plan.count("Exchange hashpartitioning(") == 1
