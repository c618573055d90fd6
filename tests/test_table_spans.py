"""Placing of spanning cells against plain Python, on random tables."""

import random

import pytest
from pyspark.sql import functions as F

from folioframe.operators import tables


def brute(rows, most):
    out, below = {}, {}
    last = max((i + 1 for i, r in enumerate(rows) if r), default=0)
    for r in range(last):
        now = {c: v for c, v in below.items() if v[0] > 0}
        below = {c: (n - 1, t) for c, (n, t) in now.items()}
        out |= {(r, c): t for c, (_, t) in now.items()}
        col = 0
        for text, down, across in rows[r]:
            while col in now:
                col += 1
            for x in range(col, min(col + max(1, across), most)):
                if x not in now:
                    now[x] = True
                    out[r, x] = text
                    below[x] = (min(max(1, down), len(rows) - r) - 1, text)
            col += max(1, across)
    return out


@pytest.mark.parametrize("most", [1000, 6])
def test_random_tables(spark, most, monkeypatch):
    monkeypatch.setattr(tables, "MOST_COLUMNS", most)
    rng = random.Random(9)
    docs, want = [], {}
    for i in range(60):
        rows = [[(f"t{r}.{c}", rng.choice([1, 1, 1, 0, 2, 3, 99]), rng.choice([1, 1, 1, 2, 3, 5000 if most < 1000 else 2])) for c in range(rng.randrange(0, 5))] for r in range(rng.randrange(0, 6))]
        body = "".join("<tr>" + "".join(f"<td ROWSPAN={d} class='x' colspan = \"{a}\">{t}</td>" for t, d, a in r) + "</tr>" for r in rows)
        docs.append((i, f"<table>{body}</table>"))
        want |= {(i, *at): t for at, t in brute(rows, most).items()}
    df = spark.createDataFrame([*docs, (60, None), (61, ""), (62, "<table></table>"), (63, "<table><tr></tr></table>")], "doc_id int, html string")
    got = tables.html_table_cells(df).collect()
    assert len(got) == len(want) and {(r.doc_id, r.row, r.col): r.text for r in got} == want


def test_harvest_of_repeated_labels(spark):
    """A cell right of two local-name labels comes out twice, one in two roles once for each."""
    cells = spark.createDataFrame([(1, 0, 1, 0, "शेताचे स्थानिक नाव"), (1, 0, 1, 1, "शेताचे स्थानिक नाव"), (1, 0, 1, 2, "mango"), (1, 0, 1, 3, "आर"), (1, 0, 2, 0, "खाते क्रमांक"), (1, 0, 2, 1, "17"), (1, 0, 2, 3, "18")], "doc_id int, table_no int, row int, col int, text string").withColumn("header", F.lit(False))
    got = sorted((r.field, r.candidate) for r in tables.harvest_candidates(cells).collect())
    assert got == sorted([("sub_division", "शेताचे स्थानिक नाव"), ("land_tenure", "mango"), ("local_field_name", "शेताचे स्थानिक नाव"), ("local_field_name", "mango"), ("local_field_name", "mango"), ("account_number", "17")])
