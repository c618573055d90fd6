"""Hard negatives against all scores in plain Python; bounds against the scores they bound."""

import math
import random

import numpy as np
import pytest

from folioframe.llm import negatives


def brute(rows, every, k=5, m=5, least=80, out_of=100):
    ok = [(i, lab, [math.floor(256 * x) for x in v]) for i, lab, v in rows if i is not None and lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for r, (i, lab, v) in enumerate(ok):
        if i % every:
            continue
        s = sorted((-sum(a * b for a, b in zip(v, w)), j, l) for q, (j, l, w) in enumerate(ok) if q != r)
        for ns, p, _ in [x for x in s if x[2] == lab][:k]:
            ps = -ns
            neg = [x for x in s if x[2] != lab and least * ps <= -out_of * x[0] <= out_of * ps][:m]
            out += [(i, p, n + 1, j, ps, -x) for n, (x, j, _) in enumerate(neg)]
    return sorted(out)


def vectors(kind, n=400, dim=9):
    rng = random.Random(kind)
    centres = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(5)]
    out = []
    for i in range(n):
        c = rng.choice(centres) if kind != "random" else [0] * dim
        v = [float(np.float32(x + rng.gauss(0, {"random": 1, "clusters": 0.1, "ties": 0}[kind]))) for x in c]
        if kind != "ties":
            v = [x * 3 ** rng.randrange(-2, 3) for x in v]
        out.append((i, rng.choice([0, 0, 0, 1, 2]), v))
    odd = [(None, 1, [1.0] * dim), (800, None, [1.0] * dim), (801, 1, None), (802, 1, [None] * dim), (803, 1, [math.inf] * dim), (804, 0, [math.nan] * dim), (805, 0, []), (810, 0, [2.0, -1.0]), (820, 77, [1.0] * dim), (0, 1, [0.0] * dim)]
    return out + odd + out[:30]


@pytest.mark.parametrize("kind", ["random", "clusters", "ties"])
def test_all_scores(spark, kind, monkeypatch):
    for name, value in {"ROWS": 16, "GROUP_BITS": 3, "CELL_BITS": 2, "BOUNDS": 4, "HELD": 50}.items():
        monkeypatch.setattr(negatives, name, value)
    rows = vectors(kind)
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id int, label int, embedding array<double>, row int, b int").repartition(3)
    got = sorted(map(tuple, negatives.hard_negatives(df, every=10).collect()))
    assert got == brute(rows, 10)
    assert negatives.hard_negatives(df.limit(0)).count() == 0


def test_parameters_and_large_values(spark):
    rows = [(i, i % 2, [float((i * 7919) % 1000) * 2**11, 1.0 + i]) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, label long, embedding array<double>")
    got = negatives.hard_negatives(df, positives=2, negatives=3, every=20, least=1, out_of=3).collect()
    assert sorted(map(tuple, got)) == brute(rows, 20, 2, 3, 1, 3)
    with pytest.raises(Exception, match="too large"):
        negatives.hard_negatives(spark.createDataFrame([(0, 1, [1e300])], df.schema)).count()


def test_bounds_hold(spark):
    rng = np.random.default_rng(5)
    refs = rng.normal(size=(6, 8))
    refs /= np.linalg.norm(refs, axis=1)[:, None]
    a = (rng.normal(size=(40, 8)) * 10.0 ** rng.integers(0, 8, (40, 1))).astype(np.int64)
    b = np.concatenate([a[:20], a[:20] * -1, a[:20] * 3, (rng.normal(size=(60, 8)) * 100).astype(np.int64), np.zeros((2, 8), np.int64)])
    (na, ga), (nb, gb) = negatives.angles_of(a, refs), negatives.angles_of(b, refs)
    low, high = negatives.score_bounds(na, ga, (nb, nb), (gb, gb))
    s = a @ b.T
    assert (low <= s).all() and (s <= high).all()
    assert (high - low < 0.9 * 2 * na[:, None] * nb + 3).mean() > 0.5  # they say something
