"""Headings that are found where tables are parsed: the results of the lookups over all cells, without a shuffle of cells."""

import random

import pytest
from pyspark.sql import functions as F

from folioframe import presets as P
from folioframe.operators import tables
from folioframe.plans import catalog

WORDS = ["", "", "12/3", "7", "आर", "७", "x &amp; y", "<b>7</b>", "a<br>b", "-", "&amp;#2326;", "&lt;br&gt;", "“”", "Holder 5", "खाते क्रमाक", "खाते", "NAME no", "no", *[a for xs in P.GRID_ALIASES.values() for a in xs]]


def html_of(rng):
    cell = lambda: f"<{rng.choice(['td', 'td', 'th', 'TD class=x'])}{rng.choice(['', '', '', ' colspan=2', ' rowspan=2'])}>{rng.choice(WORDS)}</td>"
    rows = lambda: "".join("<tr>" + "".join(cell() for _ in range(rng.randrange(6))) + "</tr>" for _ in range(rng.randrange(12)))
    return rng.choice(["<p>a</p><TABLE id=1>{}</TABLE>b", "<table>{}", "</table><table>{}", "<table>{}</table>{}<table>{}</table>x<table>{}</table>", "<table><tr><td>{}<table>{}</table></td></tr>{}</table>", "<table>{}</table><table>{}", "{}"]).replace("{}", "\0").replace("\0", rows())


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(31)
    # A document's tables are cut in the parser as html_tables cuts them.
    return spark.createDataFrame([(k, html_of(rng)) for k in range(250)] + [(250, None), (251, "")], "doc_id long, html string").repartition(3)


def rows(df, names):
    return sorted(tuple(str(r[n]) for n in names) for r in df.collect())


def test_tables_are_cut_as_by_the_walk(docs):
    want = [(r.doc_id, r.table_no, r.table_html) for r in tables.html_tables(docs).collect()]
    got = [(r.doc_id, i, t) for r in docs.collect() if r.html for i, t in enumerate(tables._cut_tables(r.html))]
    assert sorted(got) == sorted(want) and len(got) > 250


@pytest.mark.parametrize("aliases", [P.GRID_ALIASES, {"account_number": ("खाते क्रमांक",)}, {"name": ("NAME no", "७ 5")}])
@pytest.mark.parametrize("least", [0.78, 0.6])
def test_grid_hits_are_those_of_all_cells(docs, aliases, least):
    want = tables.grid_lookup(tables.html_table_cells(docs), aliases, least=least)
    got = tables.html_grid_lookup(docs, aliases, least=least)
    assert set(got.columns) == set(want.columns)
    assert rows(got, sorted(got.columns)) == rows(want, sorted(got.columns)) and want.count() > 10


@pytest.mark.parametrize("aliases", [P.GRID_ALIASES, {"account_number": ("खाते क्रमांक",)}])
def test_header_rows_are_those_of_all_cells(docs, aliases):
    want = tables.header_row_lookup(tables.html_table_cells(docs), aliases)
    got = tables.html_header_row_lookup(docs, aliases)
    assert set(got.columns) == set(want.columns)
    assert rows(got, sorted(got.columns)) == rows(want, sorted(got.columns)) and want.count() > 30


@pytest.mark.parametrize("name", ["x11_w12_grid_all_fields", "x12_header_row_all_fields", "x11_w12_grid_lookup", "x12_header_row_lookup"])
def test_no_cell_is_shuffled(spark, sf_dir, name):
    said = catalog.queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in said and "SortMergeJoin" not in said and "BroadcastHashJoin" in said
