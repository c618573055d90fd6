import re
import time

import numpy as np
import pytest

from folioframe.llm import licences

LINES = {"cc-by-nc": "Licensed under CC BY-NC 4.0.", "gpl": "This work is licensed under the GNU General Public License, version 3.", "mit": "Released under the MIT License.", "apache": "Licensed under the Apache License, Version 2.0.", "proprietary": "All rights reserved."}


def test_planted_lines_are_named_and_nothing_else(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.01')}/documents.parquet")
    want = {r.doc_id: ",".join(sorted({f for f, t in LINES.items() if t in r.text.split("\n")})) for r in docs.collect()}
    got = {r.doc_id: r for r in licences.licence_report(docs).collect()}
    assert len(got) == len(want) and sum(map(bool, want.values())) > 10
    assert {i: g.families for i, g in got.items()} == want
    assert sum(g.n_unknown for g in got.values()) <= 2
    word = re.compile(r"[0-9A-Za-z\u0080-\U0010ffff]")
    n = {r.doc_id: len(re.findall("1+", "".join("1" if word.search(x) else "0" for x in r.text.split("\n")))) for r in docs.collect()}
    assert {i: g.n_paragraphs for i, g in got.items()} == n


MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:"""
GPL = """ * This program is free software: you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation, either version 3 of the License, or
 * (at your option) any later version."""
APACHE = """# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at"""
ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies."""


@pytest.fixture(scope="module")
def model(spark, sf_dir):
    start = time.perf_counter()
    out = licences.train(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    assert time.perf_counter() - start < 60
    return out


def test_wrapped_notices(spark, model, sf_dir):
    filler = spark.read.parquet(f"{sf_dir}/documents.parquet").filter("length(text) between 500 and 900 and text not like '%icense%' and text not like '%eserved%'").first().text.replace("\n", " ")
    rows = [(1, MIT), (2, GPL), (3, "int main() {}\n\n" + APACHE + "\n\nreturn 0;"), (4, filler + "\n" + MIT + "\n" + filler), (5, ISC), (6, filler), (7, MIT + "\n\n" + GPL), (8, MIT)]
    got = {r.doc_id: sorted({f.family for f in r.found}) for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string"), model=model).collect()}
    assert got == {1: ["mit"], 2: ["gpl"], 3: ["apache"], 4: ["mit"], 5: ["unknown"], 6: [], 7: ["gpl", "mit"], 8: ["mit"]}


def test_scores_are_those_of_a_plain_sum(spark, model):
    """Window by window: n-grams hashed one by one, weights added in a loop, soft-max."""
    text = "Some words before. " + MIT + " And some words behind it"
    grams, first = licences._coded([text])
    of, a, b = licences.windows_of(np.array([0]), first[1:])
    got = model.probabilities(grams, a, b)
    assert len(a) > 5 and a[0] == 0 and b.max() == first[-1] and (b - a <= licences.WINDOW).all()
    for row, x, y in zip(got, a.tolist(), b.tolist()):
        score, n = np.zeros(len(model.classes)), 0
        for k in range(1, licences.GRAMS + 1):
            for i in range(x, y - k + 1):
                score += model.w[grams[i, k - 1]]
                n += 1
        z = np.exp((score / np.sqrt(n) + model.bias) / model.temperature)
        assert np.allclose(row, z / z.sum(), atol=1e-5)


def test_paraphrases_unknown_licences_and_corner_cases(spark, messy_docs, no_docs):
    rows = [(1, "body text here\nThis project is licensed under the terms of the MIT license. Enjoy"), (2, None), (3, ""), (4, "\n\n"), (5, "You may redistribute this work under the License, Version 9, of the Frobnicate Foundation."), (6, "see the LICENSE\nLICENSED UNDER THE APACHE LICENSE, VERSION 2.0.\nx")]
    df = messy_docs.select("doc_id", "text").filter("doc_id > 6").union(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r.doc_id: r for r in licences.scan(df).collect()}
    assert [(f.paragraph, f.family) for f in got[1].found] == [(0, "mit")]
    assert [(f.paragraph, f.family) for f in got[6].found] == [(0, "apache")]
    assert all(f.family == "unknown" for f in got[5].found)
    assert all(got[i].n_paragraphs == 0 and not got[i].found for i in (2, 3, 4))
    assert licences.scan(no_docs).count() == 0
