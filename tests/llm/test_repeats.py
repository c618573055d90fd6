import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioframe.llm import passages, recur, suffixes
from tests.llm.brute import words


def brute_passages(rows, window):
    docs = [(i, words(t or "")) for i, t in rows]
    seen = Counter(tuple(w[a : a + window]) for _, w in docs for a in range(len(w) - window + 1))
    out = []
    for i, w in docs:
        gone = set()
        for a in range(len(w) - window + 1):
            if seen[tuple(w[a : a + window])] > 1:
                gone.update(range(a, a + window))
        kept = " ".join(x for n, x in enumerate(w) if n not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def brute_bytes(rows, window):
    rank = lambda i: -(2**63) if i is None else i
    docs = sorted({(rank(i), (t or "").encode()) for i, t in rows})
    first = {}
    for i, t in docs:
        for a in range(len(t) - window + 1):
            s = t[a : a + window]
            first[s] = min(first.get(s, (i, a)), (i, a))
    out = []
    for i, t in [(i, (t or "").encode()) for i, t in rows]:
        gone = np.zeros(len(t), bool)
        for a in range(len(t) - window + 1):
            if first[t[a : a + window]] < (rank(i), a):
                gone[a : a + window] = True
        spans = int(np.sum(np.diff(np.concatenate([[0], gone.view(np.int8)])) == 1))
        kept = bytes(np.frombuffer(t, np.uint8)[~gone])
        out.append((i, len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def check_both(df):
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    got = passages.remove_repeated_passages(df)
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got.collect()), key=str) == brute_passages(rows, 35)
    got = suffixes.remove_repeated_bytes(df)
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got.collect()), key=str) == brute_bytes(rows, 100)


@pytest.fixture
def few_groups(monkeypatch):
    monkeypatch.setattr(recur, "sizes", lambda n: (5, 7))


@pytest.mark.parametrize("most", [200, 300_000])
def test_messy_documents(messy_docs, few_groups, monkeypatch, most):
    monkeypatch.setattr(passages.occurrences, "__defaults__", (most,))
    check_both(messy_docs)


def test_repeated_rows_and_null_ids(spark, messy_docs, few_groups):
    some = messy_docs.filter("doc_id % 2 = 0").select("doc_id", "text")
    nulls = messy_docs.filter("doc_id % 7 = 0").selectExpr("cast(null as long) as doc_id", "text").dropDuplicates(["text"])
    rows = [(r.doc_id, r.text) for r in some.union(some).collect()]
    df = some.union(some)
    got = suffixes.remove_repeated_bytes(df).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got), key=str) == brute_bytes(rows, 100)
    got = passages.remove_repeated_passages(df).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got), key=str) == brute_passages(rows, 35)
    assert suffixes.remove_repeated_bytes(nulls.union(some)).count() == nulls.count() + some.count()


def test_common_anchors_go_window_by_window(spark, few_groups, monkeypatch):
    rng = random.Random(5)
    say = lambda n: " ".join("".join(rng.choice("abcde") for _ in range(4)) for _ in range(n))
    line = say(30)
    rows = [(i, say(20) + " " + line + " " + say(rng.choice([2, 4, 20]))) for i in range(40)] + [(100 + i, "z " * 9 + line + " tail " * 9) for i in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    def often(docs, units, size, buckets):
        h = set()
        for batch in [docs.filter(F.col("doc_id") < 50).toArrow()]:
            for _, _, _, _, _, _, _, gram, (_, _, _, p) in units.read(batch.column("text")):
                u, n = np.unique(gram[p], return_counts=True)
                h |= set(u[n > 5].tolist())
        return np.sort(np.array(list(h), np.uint64))

    check_both(df)
    # Crowded anchors are found while their hashes are counted, frequent ones on a sample.
    with monkeypatch.context() as m:
        m.setattr(recur, "CROWD", 3)
        check_both(df)
    monkeypatch.setattr(recur, "frequent_anchors", often)
    check_both(df)


@pytest.mark.parametrize("crowd", [4, 4096])
def test_a_passage_in_every_document(spark, few_groups, monkeypatch, crowd):
    """One passage everywhere, long texts, many equal short rows; beyond so many homes the sample finds the passage's anchors by itself."""
    monkeypatch.setattr(recur, "CROWD", crowd)
    rng = random.Random(9)
    say = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    line = say(60)
    rows = [(i, f"{say(3)} {line} {say(3)}") for i in range(120)] + [(200, say(1500) + " " + line), (None, None), (None, None), (None, ""), (None, ""), (7, "x"), (7, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert (len(recur.frequent_anchors(df, recur.Units("byte", 100, 32), 10, 5)) > 0) == (crowd == 4)
    check_both(df)


def test_very_long_text(spark, few_groups):
    """A text of 2 MB that holds a passage of another one twice."""
    rng = np.random.default_rng(1)
    word = np.array(["".join(x) for x in rng.choice(list("abcdefgh"), (5000, 6))])
    say = lambda n: " ".join(word[rng.integers(0, 5000, n)])
    line = say(80)
    df = spark.createDataFrame([(1, say(20) + " " + line), (2, say(150_000) + " " + line + " " + say(150_000) + " " + line)], "doc_id long, text string")
    got = {r.doc_id: r for r in passages.remove_repeated_passages(df).collect()}
    assert (got[1].n_words, got[1].n_removed, got[2].n_words, got[2].n_removed) == (100, 80, 300_160, 160)
    got = {r.doc_id: r for r in suffixes.remove_repeated_bytes(df).collect()}
    assert got[1].n_removed == 0 and 2 * len(line) <= got[2].n_removed <= 2 * len(line) + 40 and got[2].n_spans == 2


def test_empty_table(no_docs):
    assert passages.remove_repeated_passages(no_docs).count() == 0
    assert suffixes.remove_repeated_bytes(no_docs).count() == 0


@pytest.mark.parametrize("runs", [1, 2, 5, 8])
def test_loser_tree_merges_like_sorted(runs):
    rng = random.Random(runs)
    lists = [sorted(bytes(rng.choice(b"a\x00") for _ in range(rng.randrange(1, 8))) for _ in range(rng.randrange(0, 30))) for _ in range(runs)]
    packed = [suffixes.opened(suffixes.front_coded(x, np.zeros(len(x), suffixes.PLACE))) for x in lists]
    out = []
    for i, lcp, s in suffixes.merged([(p[0], p[1], p[3]) for p in packed]):
        assert s == lists[i].pop(0)
        if out:
            assert lcp == suffixes.shared_prefix(out[-1], s)
        out.append(s)
    assert out == sorted(out) and not any(lists)


def test_occurrences_are_those_of_a_plain_search():
    rng = np.random.default_rng(6)
    line = np.concatenate([rng.integers(0, 3, 400), [-1], rng.integers(0, 70_000, 400), [-1], rng.integers(0, 3, 50)])
    phrases = [line[a : a + n].copy() for a, n in ((3, 5), (100, 8), (101, 6), (450, 30), (805, 4)) if (line[a : a + n] >= 0).all()]
    want = sorted({(i, i + len(p) - 1) for p in phrases for i in range(len(line) - len(p) + 1) if (line[i : i + len(p)] == p).all()})
    for most in (1, 12, 1000):
        assert sorted({tuple(x) for part in passages.occurrences(line, phrases, most) for x in part.tolist()}) == want


def test_joined_spans():
    window = 5
    rows = [(1, 1, 0, 8), (1, 1, 5 + passages.CHAINED, 12), (1, 1, 9 + passages.CHAINED, 14), (1, 1, 30, 40), (1, 1, 38 + passages.CHAINED, 50), (2, 1, 15, 20)]
    got = passages.joined(np.array(rows, recur.VERDICT), window)
    assert got.tolist() == [(1, 1, 0, 14), (1, 1, 30, 40), (1, 1, 38, 50), (2, 1, 15, 20)]


def test_chains_need_equal_neighbours_everywhere():
    # Texts 0 1 2 in row 1 and row 2; text 3 follows 2 in row 2 only; text 1 alone in row 3 breaks its chain.
    at = [(1, 0, 0), (1, 3, 1), (1, 6, 2), (2, 0, 0), (2, 3, 1), (2, 6, 2), (2, 9, 3)]
    place = np.zeros(len(at), recur.PASSAGE)
    place["row"], place["at"], place["windows"] = [r for r, _, _ in at], [a for _, a, _ in at], 3
    number, single = np.array([t for _, _, t in at]), np.zeros(len(at), bool)
    assert passages.chained(number, place, single, 4).tolist() == [False, True, True, False]
    alone = np.zeros(1, recur.PASSAGE)
    alone["row"], alone["windows"] = 3, 3
    assert passages.chained(np.append(number, 1), np.concatenate([place, alone]), np.zeros(8, bool), 4).tolist() == [False] * 4


def test_words_are_numbered_by_their_bytes():
    data = np.frombuffer(b"ab cd ab abc cd", np.uint8)
    starts, ends = np.array([0, 3, 6, 9, 13]), np.array([2, 5, 8, 12, 15])
    for hashes in ([7, 9, 7, 8, 9], [1, 1, 1, 1, 1], [7, 7, 7, 8, 7]):  # as they are, and with collisions
        got = passages.numbered(data, starts, ends, np.array(hashes, np.uint64)).tolist()
        assert got[0] == got[2] and got[1] == got[4] and len(set(got)) == 3
