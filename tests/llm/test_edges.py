"""Extra columns of any name, null and repeated ids, repeated rows, odd languages and empty tables, for operators and stages; models against plain sums."""

import re

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from folioframe.llm import language, quality, queries
from tests.llm.test_nearcopies import brute_groups

#: Names that operators use inside, and others that could clash.
EXTRA = ["y", "_l", "_s", "_b", "_gone", "_bad", "c0", "score", "quality_score", "size", "copies", "d", "k", "row", "doc", "class", "label", "n", "shard", "slot", "fp", "x", "a"]


@pytest.fixture(scope="module")
def odd_docs(spark, messy_docs):
    rows = [(r.doc_id if r.doc_id % 5 else None, r.text, r.lang, r.source) for r in messy_docs.collect()]
    rows += rows[::4] + [(1, "another text of an id that is there", "en", "a"), (None, "x", "en\tus", None), (None, "x", "en\tus", None)]
    return spark.createDataFrame([(*r, len(r[1] or ""), *range(len(EXTRA))) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} int" for c in EXTRA)).repartition(3)


@pytest.fixture(scope="module")
def tables(spark, odd_docs, tmp_path_factory):
    """Two folders of tables: odd documents, and none."""
    at = tmp_path_factory.mktemp("tables")
    labels = spark.createDataFrame([(i, i % 3 % 2, 0, 1, 2) for i in range(90)] + [(None, 1, None, 3, 4), (7, None, 1, 5, 6)], "doc_id long, quality int, toxic int, y int, x int")
    long = next(r.text for r in odd_docs.collect() if r.text and len(r.text.split()) > 30)
    items = spark.createDataFrame([("7", " ".join(long.split()[3:20]), 1), (None, None, 2)], "item_id string, text string, token int")
    for name, some in (("odd", lambda df: df), ("none", lambda df: df.limit(0))):
        for t, df in (("documents", odd_docs), ("labels", labels), ("benchmark", items)):
            some(df).write.parquet(f"{at}/{name}/{t}.parquet")
    return at


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - {"op10_topk", "op12_negatives", "op13_variants"}))
def test_operators_return_a_row_for_each_row(spark, tables, name):
    docs = spark.read.parquet(f"{tables}/odd/documents.parquet")
    got = queries.queries()[name](spark, f"{tables}/odd").collect()
    key = lambda i: (i is not None, i or 0)
    assert sorted((r.doc_id for r in got), key=key) == sorted((r.doc_id for r in docs.select("doc_id").collect()), key=key)
    assert queries.queries()[name](spark, f"{tables}/none").count() == 0


def test_stages_keep_odd_rows_and_columns(spark, tables):
    docs = spark.read.parquet(f"{tables}/odd/documents.parquet")
    names, before = docs.columns, docs
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        got = stage(spark, before, f"{tables}/odd")
        empty = stage(spark, docs.limit(0), f"{tables}/none")
        assert empty.count() == 0
        if name == "sharding":
            assert got.count() == before.count()
            continue
        assert got.columns == names and empty.columns == names
        got.write.parquet(f"{tables}/stage{i}")
        after = spark.read.parquet(f"{tables}/stage{i}")
        rows = {tuple(r) for r in before.collect()}
        assert after.count() > 0 and {tuple(r) for r in after.collect()} <= rows
        if name == "near_duplicates":
            texts = sorted({r.text or "" for r in before.collect()})
            root = brute_groups(dict(enumerate(texts)))
            assert after.count() == len(set(root.values()))
        before = after
    assert corpus_pipeline.run(spark, f"{tables}/none").count() == 0


def test_quality_scores_are_those_of_plain_sums(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    m = quality.train(docs, labels)
    got = {r.doc_id: r.score for r in quality.scores(docs.select("doc_id", "text"), m, "score").collect()}
    for r in docs.filter("length(text) < 3000").limit(25).collect():
        t = r.text
        raw, w = t.encode(), re.findall(rb"[^\x20\x09-\x0D]+", t.encode())
        n = max(1, len(w))
        lines = [x for x in (re.findall(rb"[^\x20\x09-\x0D]+", p) for p in raw.split(b"\n")) if x]
        stats = [sum(c[b] for b in raw) / max(1, len(raw)) for c in quality.CLASSES.values()]
        stats += [np.log1p(len(raw)), np.log1p(len(w)), sum(map(len, w)) / n, sum(len(x) > 15 for x in w) / n, len(set(w)) / n, sum(a == b for a, b in zip(w, w[1:])) / n]
        stats += [len({tuple(w[i : i + 3]) for i in range(len(w) - 2)}) / max(1, len(w) - 2), sum(x[-1:] in (b".", b",") for x in w) / n]
        stats += [np.log1p(len(w) / max(1, len(lines))), len({tuple(x) for x in lines}) / max(1, len(lines)), sum(sum(65 <= b <= 90 for b in x) >= max(2, len(x) // 2) for x in w) / n]
        z = np.clip((np.array(stats) - m.mean) / m.std, -8, 8)
        f = [np.sqrt(2 / len(m.b)) * np.cos(sum(a * b for a, b in zip(z, m.w[:, j])) + m.b[j]) for j in range(len(m.b))]
        s = sum(a * b for a, b in zip([*f, 1.0], m.beta))
        assert got[r.doc_id] == pytest.approx(float(np.clip(np.interp(s, m.knots, m.values), 0, 1)), abs=1e-6)


def test_predictions_are_those_of_plain_votes(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    m = language.train(docs)
    rows = docs.filter("length(text) between 30 and 400").limit(25).collect()
    got, _ = m.predict(language.ngram_features(pa.array([r.text for r in rows])))
    for r, said in zip(rows, got):
        raw = bytes(0x20 if b < 0x80 and not chr(b).isalpha() else b + 32 if 65 <= b <= 90 else b for b in r.text.encode())
        counts = np.zeros(language.DIM)
        for n in (1, 2, 3):
            for i in range(len(raw) - n + 1):
                code = n
                for b in raw[i : i + n]:
                    code = (code * 256 + b) % 2**64
                counts[int(language.mix(np.array([code], np.uint64))[0] % np.uint64(language.DIM))] += 1
        x = np.append(np.sqrt(counts) / np.linalg.norm(np.sqrt(counts)), 1.0)
        family = max(m.families, key=lambda f: x @ m.weights[None, f]) if len(m.families) > 1 else m.families[0]
        own = [v for v in m.langs if m.family[v] == family]
        wins = {v: 0 for v in own}
        for i, a in enumerate(own):
            for b in own[i + 1 :]:
                wins[a if x @ m.weights[a, b] > 0 else b] += 1
        assert wins[said] == max(wins.values())
