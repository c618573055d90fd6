"""Steps whose rows or Python calls once grew faster than their input."""

from pyspark.sql import functions as F

from folioframe.operators import match, tables, validate


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_claims_of_one_name_are_not_multiplied(spark):
    """1,000 claims of a name that 50 reference rows have: 50 rows are joined, not 50,000."""
    ref = spark.createDataFrame([(f"D{i}", "d", f"T{i}", f"t{i}", "Anand", None) for i in range(50)], "district_code string, district_name string, taluka_code string, taluka_name string, village_name string, local_name string")
    claims = spark.range(1000).select(F.col("id").alias("claim_id"), F.lit("anand ").alias("village"), F.when(F.col("id") % 2 == 0, "T7").alias("taluka"))
    got = match.match_reference(claims, ref, parent="taluka")
    assert [(r.match_status, r["count"]) for r in got.groupBy("match_status").count().orderBy("match_status").collect()] == [("AMBIGUOUS", 500), ("MATCHED", 500)]
    seen = "\n".join(x for x in got._jdf.queryExecution().optimizedPlan().toString().splitlines())
    assert seen.count("Aggregate") >= 2  # the names of claims are made distinct before the join


def test_clusters_need_no_pandas_group(spark):
    rows = [(1, f"f{i}", "village", v, None, c, None) for i, (v, c) in enumerate([("Anandpur Khurd", 1), ("Anandpur Khurde", 2), ("Borivali", 3)])]
    rows += [(2, "k1", "khata_number", "12345678901234567890", None, 1, 4.0), (2, "k2", "khata_number", "12345678901234567891", None, 2, 6.0), (2, "k3", "khata_number", "12345678901234567891", None, 3, None)]
    df = spark.createDataFrame(rows, "document_id int, field_id string, field_name string, value string, normalized_value string, created_at int, confidence double")
    out = validate.duplicate_consistency_fuzzy(df)
    assert "FlatMapGroupsInPandas" not in plan(out)
    assert sorted((r.field_id, r.status, r.confidence) for r in out.collect()) == [("f0", "REVIEW", None), ("f2", "REVIEW", None), ("k1", "REVIEW", 4.0), ("k2", "REVIEW", 6.0)]


def test_headings_are_scored_once(spark):
    """Aliases are literals (no Python call for each of them), and the results are those of every cell against every alias."""
    texts = ["खाते क्रमांक", "खाता क्रमाक", "एकूण खाते क्रमांक आहे", "17", "&amp;#2326;", "खा", "", None, "भूमापन क्रमाक", "x" * 40]
    cells = spark.createDataFrame([(1, 0, i // 5, i % 5, t, False) for i, t in enumerate(texts)], "doc_id int, table_no int, row int, col int, text string, header boolean")
    aliases = {"account_number": ("खाते क्रमांक", "खाता क्रमांक"), "survey_gat_number": ("भूमापन क्रमांक",)}
    every = cells.select("text").withColumn("_n", tables.eval_text("text", "html")).filter("_n <> ''").withColumn("_a", F.explode(tables._aliases(aliases)))
    want = {(r.text, r.f, round(r.s, 9)) for r in every.select("text", F.col("_a.field").alias("f"), tables.label_score(F.col("_n"), F.col("_a.alias"), contained=0.93, ratio_only=True).alias("s")).collect() if r.s >= 0.6}
    named = tables._named_cells(cells, tables._known(aliases), 0.6, "levenshtein", 0.93)
    assert {(r.text, r.field, round(r.header_score, 9)) for r in named.collect() if r.header_score >= 0.6} == want and len(want) >= 6
    assert plan(named).count("unescaped") <= 4


def test_equal_pairs_are_compared_once(monkeypatch):
    """A batch of a few values thousands of times over costs a comparison for each two different values."""
    import difflib

    import pandas as pd

    from folioframe.functions.similarity import ratcliff

    made = []

    class Counted(difflib.SequenceMatcher):
        def ratio(self):
            made.append(1)
            return super().ratio()

    monkeypatch.setattr(difflib, "SequenceMatcher", Counted)
    a, b = ["Owner 1", "Owner 2", None, "", "Onwer 17"] * 1000, ["Owner 17"] * 5000
    got = list(ratcliff.func(pd.Series(a), pd.Series(b)))
    assert len(made) <= 5
    assert got == [difflib.SequenceMatcher(None, x or "", y).ratio() for x, y in zip(a, b, strict=True)]
