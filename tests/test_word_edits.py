"""Word edits against the table of edits, and on very long texts."""

import random
import time

from pyspark.sql import functions as F

from folioframe.functions import similarity as S
from tests import brute_extract as B


def test_random_texts(spark):
    rng = random.Random(8)
    say = lambda n, v: " ".join(rng.choice("abcdefgh"[:v]) for _ in range(n))
    pairs = [(i, say(rng.randrange(0, 90), v), say(rng.randrange(0, 90), v)) for i, v in enumerate([1, 2, 3, 8] * 30)]
    pairs += [(500, None, None), (501, "", "a b"), (502, "a b", None), (503, "a", "a"), (504, " a  b ", "a b c")]
    got = {r.i: r.w for r in spark.createDataFrame(pairs, "i int, ref string, pred string").select("i", S.wer(F.col("ref"), F.col("pred")).alias("w")).collect()}
    for i, a, b in pairs:
        x, y = (a or "").split(), (b or "").split()
        want = (0.0 if not y else 1.0) if not x else B.edits(x, y) / len(x)
        assert abs(got[i] - want) < 1e-12, (a, b)


def test_many_distinct_words(spark):
    """50,000 distinct words, every hundredth replaced, some left out and added; more than any 16-bit code holds."""
    words = [f"w{i}" for i in range(50_000)]
    other = [f"x{i}" if i % 100 == 7 else w for i, w in enumerate(words) if i % 5000 != 3] + ["more", "words"]
    df = spark.createDataFrame([(" ".join(words), " ".join(other))], "ref string, pred string").select(S.wer(F.col("ref"), F.col("pred")).alias("w"))
    assert df.first().w == (500 + 10 + 2) / 50_000
    start = time.perf_counter()
    spark.createDataFrame([(" ".join(words[:5000]), " ".join(reversed(words[:5000])))], "ref string, pred string").select(S.wer(F.col("ref"), F.col("pred")).alias("w")).first()
    assert time.perf_counter() - start < 20
