import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from folioframe.llm import nearcopies, simhash
from tests.llm.brute import ascii_lower, words


def brute_groups(texts):
    sets = {}
    for i, t in texts.items():
        w = words(ascii_lower(t or ""))
        sets[i] = {tuple(w[j : j + 5]) for j in range(max(len(w) - 4, 1))}
    root = {i: i for i in texts}
    for i in sorted(texts):
        stack = [i] if root[i] == i else []
        while stack:
            a = stack.pop()
            for b in texts:
                if root[b] == b and b > i and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                    root[b] = i
                    stack.append(b)
    return root


def near_copies(seed=5, groups=6, copies=30):
    rng = random.Random(seed)
    texts = []
    for _ in range(groups):
        base = [f"w{rng.randrange(5000)}" for _ in range(150)]
        for _ in range(copies):
            w = list(base)
            for _ in range(rng.randrange(6)):
                w[rng.randrange(len(w))] = f"x{rng.randrange(5000)}"
            texts.append(" ".join(w))
    rng.shuffle(texts)
    return dict(enumerate([*texts, "", " \n", "one", "One", "two words"]))


@pytest.mark.parametrize(("nearest", "crowd"), [(1, 8), (4, 2048)])
def test_groups_are_those_of_all_pairs(spark, nearest, crowd):
    texts = near_copies()
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    got = nearcopies.near_copy_groups(docs, nearest=nearest, crowd=crowd).collect()
    own, root = {r.doc_id: r.component_id for r in got}, brute_groups(texts)
    assert all(root[c] == root[i] for i, c in own.items())  # nothing is linked that isn't alike
    assert sum(own[i] == root[i] for i in texts) >= 0.97 * len(texts)


def test_rows_are_kept_each_for_itself(spark, messy_docs):
    """Null and repeated ids, equal rows, columns of any name."""
    rows = [(1, "a b c d e f g", 0), (2, "a b c d e f g", 1), (1, "quite another text than that", 2), (None, "same thing here", 3), (None, "same thing here", 4), (None, "and one more of them", 5), (7, None, 6), (8, "", 7), (9, "only one", 8), (9, "only one", 9)]
    df = spark.createDataFrame([(*r, "x", "y", "z", True) for r in rows], "doc_id long, text string, tag int, _gone string, l string, k string, stay boolean")
    for keep in (nearcopies.keep_one, simhash.keep_one):
        got = keep(df)
        assert got.columns == df.columns
        tags = sorted(r.tag for r in got.collect())
        assert len(tags) == 6 and {0, 2, 5, 6} <= set(tags) and len({3, 4} & set(tags)) == 1 and len({8, 9} & set(tags)) == 1
    ids = {(r.doc_id, r.component_id) for r in simhash.simhash_groups(df).collect()}
    assert (None, None) in ids and (2, 1) in ids and (8, 7) in ids
    assert len({r.component for r in simhash.simhash_groups(df).collect() if r.doc_id is None}) == 2


def test_soft_decoding_finds_the_best_codewords():
    rng = np.random.default_rng(3)
    sums = rng.normal(size=(50, 23)).round(3)
    signs = 2 * simhash.golay_codewords() - 1
    want = np.argsort(-(sums @ signs.T), axis=1, kind="stable")[:, :2]
    got = nearcopies.soft_indices(sums)
    # Complements are numbered from 2048 on.
    code = np.where(got[..., None] < 2048, signs[got % 2048], -signs[got % 2048])
    assert (code == signs[want]).all()


def test_nearest_in_a_key():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2, 192)
    bits = np.array([np.where(rng.random(192) < 0.06, 1 - base, base) for _ in range(300)] + [rng.integers(0, 2, 192) for _ in range(300)], np.uint8)
    fp = np.frombuffer(np.packbits(bits, axis=1).tobytes(), np.uint64).reshape(-1, 3)
    a, b, complete = nearcopies.near_in_key(fp, np.full(600, 50), 4)
    assert not complete and (a < b).all() and b.max() < 300 and set(b) | set(a) == set(range(300))
    assert ((bits[a] != bits[b]).sum(1) <= nearcopies.FAR).all()
    assert nearcopies.near_in_key(fp[300:], np.full(300, 50), 4)[2]


def test_messy(messy_docs, no_docs):
    texts = {r.doc_id: r.text for r in messy_docs.collect()}
    assert {r.doc_id: r.component_id for r in nearcopies.near_copy_groups(messy_docs).collect()} == brute_groups(texts)
    assert nearcopies.keep_one(no_docs).count() == 0


def test_stage_drops_near_copies(spark):
    texts = near_copies(groups=2)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id for r in dict(corpus_pipeline.STAGES)["near_duplicates"](spark, docs, "").collect()}
    want = set(brute_groups(texts).values())
    assert want <= got and len(got) <= len(want) + 2


def test_prefix_join_loses_no_alike_pair(spark):
    """Sets of all sizes from one shingle on, with shared passages and rare words of their own, each with a label of its own."""
    rng = random.Random(8)
    texts = []
    for base in range(60):
        w = [f"b{base % 20}_{i}" for i in range(rng.randrange(1, 70))]
        for _ in range(8):
            own = list(w)
            for _ in range(rng.randrange(3)):
                own[rng.randrange(len(own))] = f"x{rng.randrange(10**6)}"
            texts.append(" ".join(own + [f"t{i}" for i in range(rng.choice([0, 0, 6, 30]))] + [f"y{rng.randrange(10**6)}"] * rng.randrange(4)))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    classes = nearcopies.sketches(docs).groupBy("class").agg(F.min("row").alias("row"), F.min("size").alias("size"), F.min("doc_id").alias("doc_id"))
    classes = classes.withColumn("label", classes["class"])
    ids = {r["class"]: r.doc_id for r in classes.collect()}
    sets = {i: {tuple(w[j : j + 5]) for j in range(max(len(w) - 4, 1))} for i in ids.values() for w in [texts[i].split()]}
    want = {(a, b) for a in sets for b in sets if a < b and 9 * len(sets[a] & sets[b]) >= 4 * (len(sets[a]) + len(sets[b]))}
    for part_rows in (1, 32):
        got = {tuple(sorted((ids[r.a], ids[r.b]))) for r in nearcopies.alike_by_prefix(docs, classes.drop("doc_id"), 5, part_rows).distinct().collect()}
        assert len(want) > 150 and want <= got
