import pytest

import corpus_pipeline
from folioframe.llm import mixing, quality
from tests.llm.test_decontaminate import brute
from tests.llm.test_nearcopies import brute_groups


@pytest.fixture(scope="module")
def stages(spark, sf_dir, tmp_path_factory):
    at = tmp_path_factory.mktemp("stages")
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), {}
    out["documents"] = docs
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf_dir).write.parquet(str(at / name))
        docs = out[name] = spark.read.parquet(str(at / name))
    return out


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_columns(stages):
    for name in list(stages)[:-1]:
        assert stages[name].columns == stages["documents"].columns
    assert "shard" in stages["sharding"].columns


def test_quality_stage(spark, sf_dir, stages):
    got = quality.classify(stages["documents"], spark.read.parquet(f"{sf_dir}/labels.parquet")).filter("predicted = 1")
    assert ids(stages["quality"]) == ids(got)


def test_near_duplicates_stage(stages):
    root = brute_groups({r.doc_id: r.text for r in stages["quality"].collect()})
    assert ids(stages["near_duplicates"]) == sorted(set(root.values()))


def test_decontamination_stage(spark, sf_dir, stages):
    items = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    want = [r[0] for r in brute([(r.doc_id, r.text) for r in stages["near_duplicates"].collect()], items) if not r[-1]]
    assert ids(stages["decontamination"]) == sorted(want)


def test_mixing_stage(stages):
    taken = {r.doc_id: r.copies for r in mixing.mix(stages["decontamination"]).collect()}
    assert ids(stages["mixing"]) == sorted(i for i, n in taken.items() for _ in range(n))


def test_sharding_stage(stages):
    got = stages["sharding"].collect()
    assert ids(stages["sharding"]) == ids(stages["mixing"])
    for shard in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == shard) == list(range(sum(r.shard == shard for r in got)))


def test_run_is_the_stages(spark, sf_dir, stages):
    assert ids(corpus_pipeline.run(spark, sf_dir)) == ids(stages["sharding"])

