"""Spelling variants against all pairs of words in plain Python."""

import random
import re
import zlib
from collections import Counter

import pytest

from folioframe.llm import variants


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    a, b = sorted((a, b), key=len)
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def brute(counts):
    out = {}
    for w, n in counts.items():
        others = [x for x in counts if near(w, x)]
        best = min(others, key=lambda x: (-counts[x], x), default=None)
        form = best if best is not None and counts[best] >= 2 * n else None
        out[w] = (form, n, len(others), counts[form] if form is not None else None)
    root = lambda w: w if out[w][0] is None else root(out[w][0])
    return {(w, f, root(w), n, k, m) for w, (f, n, k, m) in out.items()}


def brute_vocabulary(docs):
    c = Counter()
    for d, t in docs:
        for r in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            r = re.sub("[A-Z]", lambda m: m[0].lower(), r)
            h = zlib.crc32(f"{'' if d is None else d}:{r}".encode())
            if h % 97 == 0:
                r = r[: h % len(r)] + r[h % len(r) + 1 :]
            c[r] += 1
    return {w: n for w, n in c.items() if len(w) >= 5 and n >= 3}


def words_of(seed, alphabet, most, n):
    rng = random.Random(seed)
    return {"".join(rng.choice(alphabet) for _ in range(rng.randrange(0, most))): rng.choice([1, 2, 3, 5, 8, 20, 100, 1000]) for _ in range(n)}


@pytest.mark.parametrize("counts", [words_of(1, "ab", 7, 300), words_of(2, "abcéß", 5, 400), words_of(3, "aZ日𝒳", 4, 150), {"": 1, "a": 2, "aa": 4, "aaa": 8, "aaaa": 16, "aaaab": 40, "zzzz": 3}])
def test_all_pairs(spark, counts):
    df = spark.createDataFrame([(w, n, "x", 1) for w, n in counts.items()] + [(None, 9, "y", 1)], "word string, n int, rank string, p int").repartition(5)
    got = variants.spelling_variants(df).collect()
    assert len(got) == len(counts) and {tuple(r) for r in got} == brute(counts)


def test_vocabulary_of_messy_texts(spark, messy_docs):
    docs = [(r.doc_id if r.doc_id % 5 else None, r.text) for r in messy_docs.collect()]
    docs += [(i, "Größe GRößE naïveté straße Straße strasse ÀÉÎ×÷Àÿ colour color Colours " * 3) for i in range(500)]
    docs += [(7, ("q" * 300_000 + "w ") * 2 + "q" * 300_000 + "w " + ("q" * 299_999 + "w ") * 6)]
    df = spark.createDataFrame([(*d, 1, "z") for d in docs], "doc_id int, text string, n int, word string").repartition(3)
    vocabulary = variants.vocabulary(df)
    want = brute_vocabulary(docs)
    assert {r.word: r.n for r in vocabulary.collect()} == want
    got = {tuple(r) for r in variants.spelling_variants(vocabulary).collect()}
    assert got == brute(want)
    assert variants.spelling_variants(variants.vocabulary(df.limit(0))).count() == 0


def test_nodes_go_on_across_partitions(spark):
    """Equal prefixes have equal numbers, other prefixes others, however the words are dealt."""
    counts = words_of(4, "ab", 12, 900)
    df = spark.createDataFrame(list(counts.items()), "word string, n int")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = variants.trie_nodes(df.repartition(7), variants.F.col("word")).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert [r.word for r in sorted(rows, key=lambda r: r.rank)] == sorted(counts)
    seen = {}
    for r in rows:
        for d, node in enumerate(r.nodes):
            assert seen.setdefault(r.word[:d], node) == node
    assert len(set(seen.values())) == len(seen)
