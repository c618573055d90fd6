"""Label scores cover long blocks, non-ASCII letters and dashes."""

from folioframe.plans import q_documents as Q


def test_every_block_is_scored(spark, monkeypatch):
    texts = ["x" * 45 + " owner name", "ownér name", "owner-name", "owner name", "q"]
    blocks = spark.createDataFrame(list(enumerate(texts)), "block_id int, text string")
    monkeypatch.setattr(Q, "blocks_of", lambda docs: docs)
    got = {(r.block_id, r.label): r.score for r in Q.j9(blocks).collect()}
    assert got[0, "owner name"] == 0.94 and got[3, "owner name"] == 1.0
    # One letter of ten differs, one word of three is shared.
    assert abs(got[1, "owner name"] - (0.65 * 0.9 + 0.35 / 3)) < 1e-9
    assert (2, "owner name") in got and not any(b == 4 for b, _ in got)
