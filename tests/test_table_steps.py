"""Work on tables that is done once, and without a shuffle of cells."""

import random

from pyspark.sql import functions as F

from folioframe.functions import text as T
from folioframe.operators import tables
from folioframe.plans import catalog


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def html_of(rng):
    words = ["", "12/3", "खाते क्रमांक", "शेताचे स्थानिक नाव", "जिरायत", "आर", "x &amp; y", "<b>7</b>"]
    cell = lambda: f"<td{rng.choice(['', '', ' colspan=2', ' rowspan=2'])}>{rng.choice(words)}</td>"
    rows = lambda: "".join("<tr>" + "".join(cell() for _ in range(rng.randrange(6))) + "</tr>" for _ in range(rng.randrange(5)))
    return rng.choice(["<p>a</p><TABLE id=1>{}</TABLE>b", "<table>{}", "</table><table>{}", "<table>{}</table>{}<table>{}</table>", "<table><tr><td>{}<table>{}</table></td></tr></table>", "{}"]).replace("{}", rows())


def test_neighbours_told_by_the_parser_are_those_of_the_window(spark):
    rng = random.Random(11)
    own = spark.createDataFrame([(k, html_of(rng)) for k in range(300)], "doc_id long, html string")
    rows = lambda df: sorted(map(tuple, df.collect()))
    told = tables.harvest_candidates(tables.html_table_cells(own, beside=tables.HARVEST_LABELS))
    assert "Exchange" not in plan(told)
    want = rows(tables.harvest_candidates(tables.html_table_cells(own)))
    assert rows(told) == want and {f for _, f, _ in want} == {"survey_gat_number", "sub_division", "land_tenure", "account_number", "local_field_name"}


def test_harvest_shuffles_no_cells(spark, sf_dir):
    assert "Window" not in plan(catalog.queries()["x14_harvest"](spark, sf_dir))


def test_a_single_table_is_cut_out_as_the_walk_does(spark):
    rng = random.Random(2)
    texts = [html_of(rng) for _ in range(200)] + ["<table>a", "a</table>b<table>c", "<table>a</table", "<table a='1'>x</TABLE >y", "</table><table>", "<table></table>"]
    own = spark.createDataFrame(list(enumerate(texts)), "doc_id long, html string")
    # With an empty table behind it, no document is a single table.
    more = own.withColumn("html", F.concat("html", F.lit("<table>"), F.lit("</table>")))
    last = tables.html_tables(more).groupBy("doc_id").agg(F.max("table_no").alias("last"))
    want = tables.html_tables(more).join(last, "doc_id").filter("table_no < last").select("doc_id", "table_no", "table_html")
    closed = own.filter(F.size(F.regexp_extract_all("html", F.lit("(?i)<table\\b"), F.lit(0))) <= F.size(F.regexp_extract_all("html", F.lit("(?i)</table\\b[^>]*>"), F.lit(0)))).filter(~F.col("html").rlike("^a?</table>")).select("doc_id")
    assert sorted(map(tuple, tables.html_tables(own).join(closed, "doc_id").collect())) == sorted(map(tuple, want.join(closed, "doc_id").collect()))


def test_positional_fields_parse_the_tables_once(spark, sf_dir):
    assert "MapInArrow" not in plan(catalog.queries()["x13_positional_fields"](spark, sf_dir))


def test_many_patterns_are_evaluated_one_by_one(spark, sf_dir):
    assert "lambdafunction" in plan(catalog.queries()["n5_n8_normalisers"](spark, sf_dir))
    own = spark.createDataFrame([(1, " A-1 "), (2, None)], "k int, v string")
    assert [tuple(r) for r in T.apart(own, a=F.trim("v"), b=F.length("v")).orderBy("k").collect()] == [(1, " A-1 ", "A-1", 5), (2, None, None, None)]


def test_lines_are_assembled_without_a_shuffle_of_words(spark, sf_dir):
    said = plan(catalog.queries()["a8_assemble_lines"](spark, sf_dir))
    assert said.count("Exchange") == 1 and said.index("Generate") < said.index("Exchange")


def test_a_pass_is_lower_cased_once(spark, sf_dir):
    said = catalog.queries()["w9_best_pass"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert said.count("lower(") == 1 and "lambda" not in said
