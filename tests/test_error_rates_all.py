"""Error rates of all pairs, as they are written, against plain Python."""

import pytest

from folioframe.plans import q_quality as Q

ROWS = [(1, 0, "größe naïve", "gräße naive"), (1, 1, " ".join(f"w{i}" for i in range(120)), " ".join(f"w{i}" for i in range(5, 125))), (2, 0, "", ""), (2, 1, "", "a"), (3, 0, "é à", "à é"), (3, 1, "a  b\nc", None), (4, 0, "日本 語", "日木 語")]


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


def rate(r, p):
    return edits(r, p) / len(r) if r else float(bool(p))


@pytest.fixture(scope="module")
def pairs(spark):
    return spark.createDataFrame(ROWS, "conv_id int, turn int, ref string, pred string")


def plain(f):
    return {(c, t): pytest.approx(f(" ".join((r or "").split()), " ".join((p or "").split()))) for c, t, r, p in ROWS}


def got(df):
    return {(r[0], r[1]): r[2] for r in df.collect()}


def test_each(pairs):
    assert got(Q.n12(pairs)) == plain(rate)
    assert got(Q.n13(pairs)) == plain(lambda r, p: rate(r.split(), p.split()))
    assert got(Q.n9(pairs)) == plain(lambda r, p: 0.0 if not r or not p else 1 - edits(r, p) / max(len(r), len(p)))


def test_mean(pairs):
    have = [(" ".join(r.split()), " ".join((p or "").split())) for _, _, r, p in ROWS if r.strip()]
    row = Q.a14(pairs).first()
    assert row.mean_cer == pytest.approx(sum(rate(r, p) for r, p in have) / len(have))
    assert row.mean_wer == pytest.approx(sum(rate(r.split(), p.split()) for r, p in have) / len(have))
