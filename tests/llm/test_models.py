import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from folioframe.llm import language, quality


def held(i, folds, which):
    return zlib.crc32(str(i).encode()) % folds == which


def test_quality_held_out(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.01')}/{t}.parquet") for t in ("documents", "labels"))
    got = quality.classify(docs, labels).join(labels, "doc_id").toPandas()
    assert all(r.held_out == held(r.doc_id, 5, 0) for r in got.itertuples())
    test = got[got.held_out]
    pos, neg = test[test.quality == 1].score.to_numpy(), test[test.quality == 0].score.to_numpy()
    auc = ((pos[:, None] > neg[None, :]) + 0.5 * (pos[:, None] == neg[None, :])).mean()
    assert auc > 0.9
    assert ((test.predicted == 1) == (test.score >= 0.3)).all()


def test_quality_corner_cases(spark, messy_docs, no_docs):
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = quality.classify(messy_docs, none).collect()
    assert len(got) == messy_docs.count() and all(r.score == 0.5 and r.predicted == 1 for r in got)
    one = spark.createDataFrame([(i, 1) for i in range(1, 60)] + [(4, 0), (None, 1), (7, None)], "doc_id long, quality int")
    assert all(0 <= r.score <= 1 for r in quality.classify(messy_docs, one).collect())
    assert quality.classify(no_docs, one).count() == 0
    assert "rate" in quality.keep_good(messy_docs.withColumn("quality_score", F.lit("x")).withColumn("score", F.lit(1)), one).columns


def test_isotonic_is_monotone():
    rng = np.random.default_rng(0)
    s = rng.random(500)
    x, y = quality.isotonic(s, (rng.random(500) < s).astype(float))
    assert (np.diff(x) > 0).all() and (np.diff(y) > 0).all()


def test_statistics_do_not_depend_on_neighbours():
    texts = ["One two, two.\nTHREE!! four", "", None, "é é é", "a" * 50, "x\n\ny\nx"]
    whole = quality.statistics(pa.array(texts))
    for i, t in enumerate(texts):
        assert np.allclose(whole[i], quality.statistics(pa.array([t], pa.string()))[0])


def test_language_held_out(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.01')}/documents.parquet")
    got = language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert all(r.held_out == held(r.doc_id, 4, 2) for r in got)
    test = [r for r in got if r.held_out]
    assert np.mean([r.lang == r.lang_pred for r in test]) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_language_corner_cases(spark, no_docs):
    rows = [(1, None, "en"), (2, "", "en"), (3, "123 !!", "fr"), (4, "plain words here", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in language.identify(df).collect()}
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (1, 2, 3))
    assert language.identify(no_docs).count() == 0
    only = spark.createDataFrame([(i, "some words of text", "en") for i in range(9)], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in language.identify(only).collect()} == {"en"}


@pytest.mark.parametrize("n", [5, 200])
def test_svm_separates(n):
    rng = np.random.default_rng(n)
    x = rng.normal(size=(n, 10)).astype(np.float32)
    y = np.where(x[:, 0] + 0.1 > 0, 1.0, -1.0)
    w = language.fit_svm(x, y)
    assert (np.sign(x @ w[:-1] + w[-1]) == y).mean() > 0.95
