"""The extractors on every page of the documents, and on pages of table forms, against plain Python."""

from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from folioframe import presets as P
from folioframe.operators import extract
from folioframe.plans import q_documents as Q
from tests import brute_extract as B

COLUMNS = ("field_name", "value", "normalized_value", "confidence", "method", "evidence_block_id", "position")


def forms(spark):
    """Table forms: header rows over values, labels beside values, close rows, owners and areas under their headers, all digits scripts."""
    rows = []

    def put(page, x, y, text, width=180.0, height=24.0, conf=90.0):
        rows.append((page, page * 1000 + len(rows), int(y + x), text, conf, (float(x), float(y), width, height)))

    heads = [xs[0] for xs in P.TABLE_LABELS.values()]
    values = ["१२/३", "-", "भोगवटादार वर्ग १", "रमेश पाटील", "४५", "मळा", "2.50"]
    for page in range(1000, 1030):
        for i, (h, v) in enumerate(zip(heads, values)):
            if page % 7 != i:
                put(page, 260 * (i % 4), 100 + 60 * (i // 4) * 3, h if page % 3 else h + " :", conf=80.0 + i)
                put(page, 260 * (i % 4) + page % 5 * 9, 150 + 60 * (i // 4) * 3 + page % 4 * 7, v, conf=60.0 + page % 9)
        put(page, 0, 600, "Owner Name")
        for k in range(3):
            put(page, 10 + k, 650 + 50 * k, f"Asha Kale {k}", conf=50.0 + k)
        put(page, 600, 600, "क्षेत्रफळ" if page % 2 else "Area")
        for k in range(4):
            put(page, 610, 650 + 45 * k, ("1.5", "०.७५", "abc", "2,25")[k])
        put(page, 0, 900, ("Area: 2.5 ha", "Extent - 3 sqft", "क्षेत्र : १.२ हे", "taluka/tehsil: Haveli", "Taluka / Haveli", "Khata No. : 12x")[page % 6])
        put(page, 0, 950, "खाते क्रमांक")
        put(page, 200, 951, ("७७", "77", "फेरफार क्रमांक")[page % 3])
        put(page, 0, 1000, "Mutation")
        put(page, 200, 1003, ("नोंदणी माहिती", "क्रमांक", "MR 12")[page % 3])
    return spark.createDataFrame(rows, "page_id long, block_id long, block_number int, text string, confidence double, bbox struct<x: double, y: double, width: double, height: double>")


@pytest.fixture(scope="module")
def blocks(spark, sf_dir):
    own = Q.blocks_of(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("page_id", "block_id", F.col("block_number").cast("int").alias("block_number"), "text", "confidence", "bbox")
    return own.unionByName(forms(spark)).cache()


@pytest.fixture(scope="module")
def pages(blocks):
    out = defaultdict(list)
    for r in blocks.collect():
        out[r.page_id].append({"block_id": r.block_id, "block_number": r.block_number, "text": r.text, "confidence": r.confidence, **r.bbox.asDict()})
    return out


def rows_of(df):
    return sorted((r.page_id, *(round(r[c], 6) if c == "confidence" else r[c] for c in COLUMNS)) for r in df.select("page_id", *COLUMNS).collect())


def plain(pages, extractor):
    names = {"evidence_block_id": "block"}
    return sorted((p, *(round(x["confidence"], 6) if c == "confidence" else x[names.get(c, c)] for c in COLUMNS)) for p, bs in pages.items() for x in extractor(bs))


@pytest.mark.parametrize("name", ["inline", "adjacent", "owner_rows", "area_rows", "table_fields"])
def test_each_extractor(blocks, pages, name):
    got = rows_of(getattr(extract, f"extract_{name}")(extract.in_reading_order(blocks)))
    want = plain(pages, lambda bs: getattr(B, name)(B.ordered(bs)))
    assert len(want) > 20 and got == want


def test_all_together(blocks, pages):
    got = extract.reading_order(extract.extract_fields(blocks)).collect()
    assert sorted((r.page_id, r.field_name, r.value, r.method, r.evidence_block_id) for r in got) == sorted((p, x["field_name"], x["value"], x["method"], x["block"]) for p, bs in pages.items() for x in B.everything(bs))
    order = [(r.page_id, r.position, r.field_name, r.normalized_value) for r in got]
    assert order == sorted(order)


def test_evidence(blocks, pages):
    text = {b["block_id"]: b["text"] for bs in pages.values() for b in bs}
    got = extract.link_evidence(extract.extract_inline(extract.in_reading_order(blocks)), blocks).collect()
    assert len(got) == len(plain(pages, lambda bs: B.inline(B.ordered(bs)))) and all(r.ocr_text == text[r.evidence_block_id] and r.evidence_order == 0 for r in got)


def test_batch_with_lineage(spark, sf_dir, pages):
    got = {r.page_id: r for r in Q.x9(spark.read.parquet(f"{sf_dir}/documents.parquet")).collect()}
    for p, r in got.items():
        want = B.everything(pages[p])
        assert (r.n_fields or 0) == len(want) and r.run_id == 2 * p and r.extraction_status == "COMPLETED"
        assert (r.extraction_confidence is None) == (not want) and (not want or abs(r.extraction_confidence - sum(x["confidence"] for x in want) / len(want)) < 1e-6)
