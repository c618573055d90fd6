import zlib
from collections import Counter

import numpy as np
import pytest

from folioframe.llm import mixing, sharding, topk
from tests.llm.brute import words

MASK = 2**64 - 1


def brute_targets(sizes, weights=(5, 2, 1), most=3):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, free, target = sum(sizes.values()), set(order), {}
    while free:
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if share[s] > most * sizes[s]]
        if not over:
            return target | share
        for s in over:
            target[s] = most * sizes[s]
            left -= target[s]
            free.remove(s)
    return target


def solved(sizes, target, most=3):
    """The multiplier of one source by bisection on all its documents, and their rates."""
    z = np.array(sizes) / np.mean(sizes)
    rates = lambda m: np.minimum(most, np.exp(np.minimum(700, m * z)))
    lo, hi = -4000.0, 4000.0
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if (rates(mid) * sizes).sum() < target else (lo, mid)
    return rates(lo)


def test_mix_meets_targets(messy_docs):
    df = messy_docs.union(messy_docs.filter("doc_id % 4 = 0")).withColumnRenamed("rate", "copies")
    got = mixing.mix(df).collect()
    texts = {r.doc_id: r.text or "" for r in df.collect()}
    sizes = Counter()
    for r in got:
        assert r.size == len(words(texts[r.doc_id])) and r.taken <= 3 * r.size and r.taken == r.copies * r.size
        sizes[r.source] += r.size
    want = brute_targets(sizes)
    for s in sizes:
        rows = [r for r in got if r.source == s]
        assert all(r.source_size == sizes[s] and abs(r.target - want[s]) < 1e-6 * max(1, want[s]) for r in rows)
        assert abs(sum(r.taken for r in rows) - want[s]) <= max(r.size for r in rows)
        if want[s] < 3 * sizes[s]:
            rates = solved([r.size for r in rows], want[s])
            assert np.allclose([r.rate for r in rows], rates, atol=2e-6)
    again = mixing.mix(df.repartition(5)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_newton_reaches_the_dual_optimum(spark):
    rng = np.random.default_rng(2)
    ratios = {"tiny": 1e-4, "few": 0.01, "half": 0.5, "same": 1.0, "more": 2.2, "nearly": 2.999, "all": 3.0}
    sizes = {s: rng.pareto(1.2, 400).astype(int) * 7 + 1 for s in ratios} | {"zero": np.zeros(5, int)}
    hist = [(s, int(k), int(n)) for s, v in sizes.items() for k, n in zip(*np.unique(v, return_counts=True))]
    goals = [(s, int(v.sum()), float(v.sum() * ratios.get(s, 0))) for s, v in sizes.items()]
    h, g = spark.createDataFrame(hist, "source string, size long, n long"), spark.createDataFrame(goals, "source string, source_size long, target double")
    for r in mixing.balanced(h, g).collect():
        v = sizes[r.source]
        if not v.any():
            assert r.multiplier == 0
            continue
        rates = np.minimum(3, np.exp(np.minimum(700, r.multiplier * v / r.scale)))
        assert abs((rates * v).sum() - r.target) <= 1e-9 * r.target, r


def test_taken_rows_keep_columns_of_any_name(spark):
    rows = [(i % 7 or None, "w " * (i % 11), "ab"[i % 2], i, "x", "y", "z") for i in range(60)] + [(None, None, None, 60, "", "", "")] * 2
    df = spark.createDataFrame(rows, "doc_id int, text string, source string, _s int, _b string, copies string, size string")
    got = mixing.take(df)
    assert got.columns == df.columns
    n = Counter(tuple(r) for r in got.collect())
    taken = Counter()
    for r in mixing.mix(df).collect():
        taken[(r.doc_id, r.source, r.size)] += r.copies
    assert max(n.values()) <= 6 and set(n) <= {tuple(r) for r in df.collect()}
    have = Counter()
    for r, k in n.items():
        have[(r[0], r[2], len((r[1] or "").split()))] += k
    assert +have == +taken


def test_sources_are_ranked_by_code_point(spark):
    names = ["b", "a", "Z", "é", "", "ab", "😀", "\uffee", None]
    df = spark.createDataFrame([(x,) for x in names], "source string")
    got = {r.source: r["rank"] for r in mixing.ranked(df, "source").collect()}
    assert got == {x: i for i, x in enumerate(sorted(names, key=lambda x: (x is None, x or "")))}


def test_mix_and_shard_empty(no_docs):
    assert mixing.mix(no_docs).count() == 0 and mixing.take(no_docs).count() == 0
    assert sharding.shard_documents(no_docs).count() == 0


def brute_jump(key, n):
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) & MASK
        j = int((b + 1) * (float(1 << 31) / ((key >> 33) + 1)))
    return b


def test_jump(spark):
    rng = np.random.default_rng(4)
    keys = [0, 1, MASK, 2**63, *(int(x) for x in rng.integers(0, 2**63, 50))]
    df = spark.createDataFrame([(str(k),) for k in keys], "k string")
    key = sharding.F.col("k").cast("decimal(20,0)")
    for n in (1, 2, 16, 17, 40):
        got = {r.k: r.s for r in df.select("k", sharding.jump(key, n).alias("s")).collect()}
        assert got == {str(k): brute_jump(k, n) for k in keys}


def test_shards(messy_docs):
    df = messy_docs.union(messy_docs.filter("doc_id % 5 = 0")).union(messy_docs.filter("doc_id in (1, 4)").selectExpr("cast(null as long)", "text", "lang", "source", "n_chars", "rate"))
    got = sharding.shard_documents(df).collect()
    assert len(got) == df.count()
    text = Counter((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in df.collect())
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == text
    assert all(r.grown_shard in (r.shard, 16) and 0 <= r.shard < 16 and r.law == "key" for r in got)
    for s in range(16):
        own = [r.slot for r in got if r.shard == s]
        assert sorted(own) == list(range(len(own)))


def brute_top(rows, k=5):
    ok = [(i, np.floor(256 * np.array(e, float)).astype(int)) for i, e in rows if i is not None and e is not None and all(x is not None and np.isfinite(x) for x in e)]
    out = []
    for i in sorted({i for i, _ in ok if i % 50 == 0}):
        q = next(e for j, e in ok if j == i)
        c = sorted((-int(sum(a * b for a, b in zip(q, e))), j) for j, e in ok if j != i)[:k]
        out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(c)]
    return sorted(out)


def test_top_k(spark, monkeypatch):
    for name, size in (("BLOCK", 8), ("BOUNDS", 4), ("CELL_BLOCKS", 3), ("QUERIES", 2)):
        monkeypatch.setattr(topk, name, size)
    rng = np.random.default_rng(8)
    rows = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(-100, 150, 2)]
    rows += [(3, None), (50 * 7, [float("nan")] * 6), (5, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (7, [float("inf")] * 6), (None, [1.0] * 6), (9, []), (400, []), (11, [0.5, 0.5]), (1001, rows[0][1]), (1003, rows[0][1]), (1005, rows[0][1]), (1005, rows[0][1])]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "vec_id long, embedding array<double>, g string, score string").repartition(3)
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_inner(df).collect())
    assert got == brute_top(rows)


def test_top_k_edges(spark):
    schema = "vec_id long, embedding array<double>"
    assert topk.top_inner(spark.createDataFrame([], schema)).count() == 0
    assert topk.top_inner(spark.createDataFrame([(50, [1.0])], schema)).count() == 0
    # Repeated ids: candidates each for itself, but not of their own query, which is answered once.
    rows = [(50, [1.0]), (50, [2.0]), (1, [1.0]), (1, [1.0]), (2, [-1.0])]
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_inner(spark.createDataFrame(rows, schema)).collect())
    assert got == [(50, 1, 1, 512 * 256), (50, 2, 1, 512 * 256), (50, 3, 2, -512 * 256)]
    large = [(0, [4e6, 1.0]), (1, [2e6, 1.0])]
    assert [r.score for r in topk.top_inner(spark.createDataFrame(large, schema)).collect()] == [1024000000 * 512000000 + 65536]
    with pytest.raises(Exception, match="too large for 64-bit scores"):
        topk.top_inner(spark.createDataFrame([(0, [3e9, 1.0]), (1, [2e9, 1.0])], schema)).collect()


def test_only_blocks_that_may_score_are_sent(spark, monkeypatch):
    """Vectors whose size falls with the id: the first blocks hold all answers, and the others stay where they are."""
    monkeypatch.setattr(topk, "BLOCK", 10)
    sent = []
    real = topk._searched

    def counted(questions, blocks, pairs, k):
        sent.append(pairs.count())
        return real(questions, blocks, pairs, k)

    monkeypatch.setattr(topk, "_searched", counted)
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in np.abs(rng.normal(size=4)) * (100 if i < 40 else 1)]) for i in range(600)]
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_inner(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())
    assert got == brute_top(rows) and sum(sent) <= 10
