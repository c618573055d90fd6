import random

import numpy as np
import pytest
import xxhash

from folioframe.llm import simhash
from tests.llm.brute import ascii_lower, words


def brute_fingerprint(text):
    w = words(ascii_lower(text or ""))
    if not w:
        return 0
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps):
    ids = sorted(fps, key=lambda x: (x is not None, x))
    root = {i: i for i in ids}
    todo = list(ids)
    for i in ids:
        if root[i] != i:
            continue
        stack = [i]
        while stack:
            a = stack.pop()
            for b in todo:
                if b != i and root[b] == b and (fps[a] ^ fps[b]).bit_count() <= 2:
                    root[b] = i
                    stack.append(b)
    return root


def test_golay_words_two_bits_apart_share_a_codeword():
    rng = np.random.default_rng(1)
    for word in rng.integers(0, 2**23, 200):
        own = set(simhash.golay_keys(np.array([word]))[1].tolist())
        errors = [0] + [1 << a for a in range(23)] + [(1 << a) | (1 << b) for a in range(23) for b in range(a)]
        row, index = simhash.golay_keys(word ^ np.array(errors))
        shared = {r for r, i in zip(row.tolist(), index.tolist()) if i in own}
        assert shared == set(range(len(errors)))


def test_fuzzy_keys_find_two_errors_anywhere():
    rng = np.random.default_rng(2)
    fp = rng.integers(0, 2**63, 20, dtype=np.uint64)
    for f in fp:
        own = set(simhash.fuzzy_keys(np.array([f]))[1].tolist())
        others = np.array([f ^ np.uint64((1 << a) | (1 << b)) for a in range(64) for b in range(a)], np.uint64)
        row, key = simhash.fuzzy_keys(others)
        assert {r for r, k in zip(row.tolist(), key.tolist()) if k in own} == set(range(len(others)))


@pytest.mark.parametrize("most", [2, 128])
def test_links_of_connects_like_all_pairs(most):
    rng = random.Random(3)
    base = rng.getrandbits(64)
    fps = sorted({base ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(4))) for _ in range(300)} | {rng.getrandbits(64) for _ in range(50)})
    arr = np.array(fps, np.uint64)
    row, key = simhash.fuzzy_keys(arr)
    links = simhash.links_of(arr[row], key, most)
    assert all((int(a) ^ int(b)).bit_count() <= 2 for a, b in links)
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links.tolist():
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    want = brute_components({f: f for f in fps})
    assert {f: find(f) for f in fps} == want


def test_groups_match_brute_force(spark, messy_docs):
    rows = [(r["doc_id"], r["text"]) for r in messy_docs.collect()]
    got = simhash.simhash_groups(messy_docs).collect()
    assert sorted((str(r.doc_id), r.fingerprint) for r in got) == sorted((str(i), f"{brute_fingerprint(t):016x}") for i, t in rows)
    fp = {}
    for i, t in rows:
        fp.setdefault(i, brute_fingerprint(t))
    if len({i for i, _ in rows}) == len(rows):
        want = brute_components(fp)
        assert {r.doc_id: r.component_id for r in got} == want


def test_empty_table(spark, no_docs):
    assert simhash.simhash_groups(no_docs).count() == 0
    assert simhash.keep_one(no_docs).count() == 0
