"""Licence scans: a trained paragraph classifier, its calibrated unknown class, and a comparison with templates."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from folioframe.llm.arrowtext import LOWER, chunks, gram_hashes, mix, word_hashes, words
from folioframe.llm.common import row_key

# The notices that these licences ask for, and the statements by which they are commonly referred to.
TEMPLATES = {
    "apache": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "mit": [
        "Released under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "SPDX-License-Identifier: MIT",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "You should have received a copy of the GNU General Public License along with this program.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "lgpl": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU Lesser General Public License along with this library.",
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
    ],
    "bsd": [
        "Released under the BSD License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at", "Licensed under the Mozilla Public License, version 2.0.", "SPDX-License-Identifier: MPL-2.0"],
    "cc-by": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "This article is available under CC BY-SA 4.0."],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "Licensed under CC BY-NC-ND 4.0."],
    "cc0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", "Released into the public domain under CC0 1.0 Universal."],
    "proprietary": ["All rights reserved.", "No part of this publication may be reproduced, distributed, or transmitted in any form without the prior written permission of the publisher.", "Confidential and proprietary. Unauthorized copying of this file is strictly prohibited."],
}
NONE, UNKNOWN = "none", "unknown"
#: Words of windows, short ones for short statements, and between windows; statements are learned as windows show them.
WINDOW, SHORT = 24, 8
STEPS = {WINDOW: 8, SHORT: 3}
#: Hashed n-grams (1 to 3 words), corpus windows learned from at most (about, by hash), variants of each statement, passes over the rows.
DIM, GRAMS, NEGATIVES, VARIANTS, EPOCHS = 1 << 17, 3, 4000, 30, 12
#: Share of a template's word pairs that confirm a family, and that an unknown licence must share with some template to be reported.
CONFIRM, HINT = 0.8, 0.15
#: Models with a part of the families held out; they show how an unknown licence scores.
FOLDS = 3

SEPARATOR = np.ones(256, bool)
SEPARATOR[0x80:] = False
for _a, _b in ((0x30, 0x3A), (0x61, 0x7B)):
    SEPARATOR[_a:_b] = False


def tokens(text: str) -> list[str]:
    return re.findall(r"[0-9a-z\u0080-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))


def grams_of(buf: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """(words, GRAMS): the bucket of the n-gram that starts at each word, -1 where the text ends before."""
    h = word_hashes(buf, s, e, SEPARATOR)
    out = np.full((len(s), GRAMS), -1, np.int64)
    for n in range(1, GRAMS + 1):
        g = mix(gram_hashes(h, n) + np.uint64(n))
        out[: len(g), n - 1] = (g % np.uint64(DIM)).astype(np.int64)
    return out


class Model:
    """Sparse multinomial logistic regression; ``least`` is the licence probability that counts, ``known`` the family's share of it."""

    def __init__(self, classes: list[str], w: np.ndarray, bias: np.ndarray, temperature: float = 1.0, least: float = 0.5, known: float = 0.5):
        self.classes, self.w, self.bias, self.temperature, self.least, self.known = classes, w, bias, temperature, least, known

    def probabilities(self, grams: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Class probabilities of the windows of words a to b (exclusive). An n-gram counts if it lies inside the window."""
        total = np.zeros((len(a), len(self.classes)))
        count = np.zeros(len(a))
        for n in range(1, GRAMS + 1):
            col = grams[:, n - 1]
            past = np.maximum(a, b - n + 1)
            score = np.where(col[:, None] >= 0, self.w[col], 0)
            sums = np.concatenate([np.zeros((1, len(self.classes))), np.cumsum(score, 0, dtype=np.float64)])
            total += sums[past] - sums[a]
            count += past - a
        z = (total / np.sqrt(np.maximum(count, 1))[:, None] + self.bias) / self.temperature
        p = np.exp(z - z.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)


def likeness(template: list[str], own: list[str]) -> float:
    """Share of a template's word pairs (of its words, if it has one) that the passage holds."""
    pair = lambda w: Counter(zip(w, w[1:], strict=False)) if len(template) > 1 else Counter(w)
    t = pair(template)
    return sum((t & pair(own)).values()) / max(1, sum(t.values()))


def _coded(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(grams of all texts' words, first word of each text and the total)."""
    data = [t.encode() for t in texts]
    buf = LOWER[np.frombuffer(b"\n".join(data), np.uint8)]
    off = np.cumsum([0, *(len(d) + 1 for d in data)])
    off[-1] = len(buf)
    s, e, first = words(buf, off, SEPARATOR)
    return grams_of(buf, s, e), first


def fit(texts: list[str], labels: np.ndarray, classes: list[str], seed: int = 5, epochs: int = EPOCHS) -> Model:
    """Multinomial logistic regression on the sparse n-grams of windows, by AdaGrad; classes weigh alike."""
    rng = np.random.default_rng(seed)
    grams, first = _coded(texts)
    cols, rows = [], []
    for n in range(1, GRAMS + 1):
        for i, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
            own = grams[a : max(a, b - n + 1), n - 1]
            cols.append(own)
            rows.append(np.full(len(own), i))
    cols, rows = np.concatenate(cols), np.concatenate(rows)
    order = np.argsort(rows, kind="stable")
    cols, edge = cols[order], np.searchsorted(rows[order], np.arange(len(texts) + 1))
    k = len(classes)
    w, bias = np.zeros((DIM, k)), np.zeros(k)
    speed, speed_b = np.full((DIM, k), 1e-6), np.full(k, 1e-6)
    weight = 1 / np.sqrt(np.bincount(labels, minlength=k).clip(1))
    weight = weight / weight[labels].mean()
    order = np.arange(len(texts))
    for _ in range(epochs):
        rng.shuffle(order)
        for part in np.array_split(order, max(1, len(order) // 256)):
            size = edge[part + 1] - edge[part]
            own = cols[np.repeat(edge[part] - np.cumsum(size) + size, size) + np.arange(int(size.sum()))]
            mine = np.repeat(np.arange(len(part)), size)
            scale = 1 / np.sqrt(np.maximum(size, 1))
            heads = np.flatnonzero(np.diff(mine, prepend=-1))
            z = np.zeros((len(part), k))
            z[mine[heads]] = np.add.reduceat(w[own], heads, axis=0) if len(own) else 0
            z = z * scale[:, None] + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(part)), labels[part]] -= 1
            p *= (weight[labels[part]] / len(part))[:, None]
            u, back = np.unique(own, return_inverse=True)
            by = np.argsort(back, kind="stable")
            grad = np.add.reduceat((p * scale[:, None])[mine][by], np.flatnonzero(np.diff(back[by], prepend=-1)), axis=0) if len(own) else np.zeros((0, k))
            speed[u] += grad**2
            w[u] -= 0.3 * grad / np.sqrt(speed[u])
            g = p.sum(0)
            speed_b += g**2
            bias -= 0.05 * g / np.sqrt(speed_b)
    return Model(classes, w, bias)


def _scores(model: Model, texts: list[str]) -> np.ndarray:
    grams, first = _coded(texts)
    return model.probabilities(grams, first[:-1], first[1:])


def _variants(statement: str, corpus: list[list[str]], rng: np.random.Generator, n: int) -> list[str]:
    """A statement as windows show it: whole, in pieces if it is longer, with words lost, in the place of words of a corpus window."""
    w, out = statement.split(), []
    for i in range(n):
        size = SHORT if i % 3 == 1 and len(w) <= SHORT else WINDOW
        have = [x for x in w if i == 0 or rng.random() > 0.04]
        if len(have) >= size:
            a = int(rng.integers(-size // 2, len(have) - size // 2)) if len(have) > size else 0
            have = have[max(a, 0) : a + size]
        around = corpus[int(rng.integers(len(corpus)))] if i and corpus else []
        left = int(rng.integers(0, size - len(have) + 1))
        out.append(" ".join([*around[:left], *have, *around[left + len(have) : size]]))
    return out


def corpus_windows(docs: DataFrame, negatives: int) -> DataFrame:
    """(p): about ``negatives`` windows of words, two from each document of a hash sample, at places anywhere in it that its hash decides."""
    n = docs.count()
    some = docs.filter(F.pmod(row_key(), F.lit(max(1, 2 * n // negatives))) == 0).select("text", row_key().alias("k"))

    def cut(batches):
        for batch in batches:
            out = []
            for t, k in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = tokens(t or "")
                for i in range(2 if own else 0):
                    a = (k * (2 * i + 1) >> 8) % max(1, len(own) - WINDOW + 1)
                    out.append(" ".join(own[a : a + WINDOW]))
            yield pa.record_batch([pa.array(out, pa.string())], names=["p"])

    return some.mapInArrow(cut, "p string")


def train(docs: DataFrame, templates: dict[str, list[str]] = TEMPLATES, negatives: int = NEGATIVES) -> Model:
    """Learns from variants of the statements and from corpus windows that are like none of them.

    ``least`` is above nearly all corpus windows of a calibration fifth. For the unknown class, models are trained with a third of the families
    held out: ``known`` is the share of a licence's probability that the likeliest family must have, chosen so that most windows of held-out
    families, licences that the model doesn't know, are below, and at most a tenth of calibration windows of known ones. Temperature is fitted
    on the calibration fifth. The models are groups of their own, a task each, learned from the same bounded sample.
    """
    bare = [(f, tokens(t)) for f, ts in templates.items() for t in ts]
    families = list(templates)

    def learn(t: pa.Table) -> pa.Table:
        fold = t.column("fold")[0].as_py()
        rng = np.random.default_rng(9)
        corpus = sorted(p for p in t.column("p").to_pylist() if p)
        corpus = [p for p in corpus if max(likeness(b, p.split()) for _, b in bare) < 0.2]  # no parts of a statement either
        around = [p.split() for p in corpus]
        held = {f for i, f in enumerate(families) if i % FOLDS == fold}
        classes = [NONE, *(f for f in families if f not in held)]
        texts = [*corpus, *(" ".join(w[len(w) // 2 :][:SHORT]) for w in around)]
        labels = [0] * len(texts)
        unknown = []
        for f in families:
            for statement in templates[f]:
                v = _variants(statement, around, rng, VARIANTS)
                if f in held:
                    unknown += v
                else:
                    texts += v
                    labels += [classes.index(f)] * len(v)
        licence = [w for s in templates.values() for x in s for w in tokens(x)]
        for _ in range(300):  # single licence words among others say nothing
            own = list(around[int(rng.integers(len(around)))]) if around else []
            for w in rng.choice(licence, 2).tolist():
                own.insert(int(rng.integers(len(own) + 1)), w)
            texts.append(" ".join(own))
            labels.append(0)
        labels = np.array(labels)
        cal = rng.random(len(texts)) < 0.2
        pick = lambda m: [x for x, y in zip(texts, m, strict=True) if y]
        model = fit(pick(~cal), labels[~cal], classes)
        given = labels[cal]
        best = (np.inf, 1.0)
        for temperature in (0.25, 0.5, 1.0, 2.0, 4.0):
            model.temperature = temperature
            p = _scores(model, pick(cal))
            best = min(best, (float(-np.log(np.maximum(p[np.arange(len(given)), given], 1e-12)).mean()), temperature))
        model.temperature = best[1]
        p = _scores(model, pick(cal))
        clean = 1 - p[given == 0, 0]
        share = lambda q: (q[:, 1:].max(1) / np.maximum(q[:, 1:].sum(1), 1e-12)).tolist()
        return pa.table(
            {"fold": pa.array([fold], pa.int32()), "w": pa.array([model.w.astype(np.float32).tobytes()], pa.binary()), "bias": [model.bias.tolist()], "temperature": [model.temperature], "clean": pa.array([clean.tolist()], pa.list_(pa.float64())), "known": pa.array([share(p[given > 0])], pa.list_(pa.float64())), "unknown": pa.array([share(_scores(model, unknown)) if unknown else []], pa.list_(pa.float64()))}
        )

    spark = docs.sparkSession
    some = corpus_windows(docs, negatives).unionByName(spark.createDataFrame([("",)], "p string"))
    each = some.withColumn("fold", F.explode(F.array(*map(F.lit, range(-1, FOLDS))))).repartition(4 * (FOLDS + 1), "fold")  # a task each
    got = {r.fold: r for r in each.groupBy("fold").applyInArrow(learn, "fold int, w binary, bias array<double>, temperature double, clean array<double>, known array<double>, unknown array<double>").collect()}
    r = got[-1]
    least = max([0.5, *r.clean]) if r.clean else 0.5
    other = np.array([x for f in range(FOLDS) for x in got[f].unknown])
    known = float(np.clip(min(np.quantile(other, 0.75), np.quantile(r.known, 0.1)), 0.3, 0.95)) if len(other) and r.known else 0.5
    return Model([NONE, *families], np.frombuffer(r.w, np.float32).reshape(DIM, -1), np.array(r.bias), r.temperature, float(min(least, 0.99)), known)


FOUND = "doc_id long, n_paragraphs long, found array<struct<paragraph: int, family: string, probability: double, template: string, likeness: double, text: string>>"
_FOUND = pa.list_(pa.struct([("paragraph", pa.int32()), ("family", pa.string()), ("probability", pa.float64()), ("template", pa.string()), ("likeness", pa.float64()), ("text", pa.string())]))


def paragraphs(buf: np.ndarray, off: np.ndarray, s: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Number of the paragraph of each word, counted through the chunk: a line without a word ends a paragraph, as does the document."""
    nl = np.concatenate([[0], np.cumsum(buf == 0x0A)])
    new = np.ones(len(s), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (nl[s[1:]] > nl[s[:-1]] + 1)
    return np.cumsum(new) - 1


def windows_of(head: np.ndarray, past: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(paragraph, first word, word after the last) of the windows of paragraphs of both sizes, in order; the last ones are at the end."""
    n, out = past - head, []
    for size, step in STEPS.items():
        k = np.where(n <= size, 1, -(-(n - size) // step) + 1)
        of = np.repeat(np.arange(len(head)), k)
        at = np.arange(int(k.sum())) - np.repeat(np.cumsum(k) - k, k)
        a = np.maximum(head[of], np.minimum(head[of] + at * step, past[of] - size))
        out.append((of, a, np.minimum(a + size, past[of])))
    of, a, b = (np.concatenate(x) for x in zip(*out, strict=True))
    o = np.lexsort((b, a))
    return of[o], a[o], b[o]


def named(said: np.ndarray, own: list[str], bare: list[tuple[str, str, list[str]]], classes: list[str], known: float) -> tuple[str, str | None, float]:
    """(family, template, likeness) of a passage with the family probabilities ``said``.

    If the likeliest family has ``known`` of the licence's probability it is compared with its own templates first, and stands if one is held to
    CONFIRM. Otherwise the other families follow in the order of their probability, and if none is held the licence is unknown.
    """
    order = np.argsort(-said, kind="stable")
    sure = said[order[0]] >= known * said.sum()
    seen = (UNKNOWN, None, 0.0)
    best = 0.0
    for c in order.tolist():
        like, t = max((likeness(w, own), t) for f, t, w in bare if f == classes[c + 1])
        best = max(best, like)
        if like >= CONFIRM and (sure or like > seen[2]):
            seen = (classes[c + 1], t, like)
            if sure:
                break
    return seen if seen[1] else (UNKNOWN, None, best)


def scan(docs: DataFrame, templates: dict[str, list[str]] = TEMPLATES, model: Model | None = None) -> DataFrame:
    """(doc_id, n_paragraphs, found), one row per row of ``docs``: the passages of paragraphs that read like a licence.

    A paragraph is a run of lines with words (0-9, a-z after lower-casing A-Z, non-ASCII; comment marks are no words); it is counted from 0.
    The classifier reads it in overlapping windows of WINDOW and of SHORT words. Windows that meet and are likelier a licence than ``least`` make a passage. Its
    windows name families; each stands if a template of it is held by these windows and as many words around them as a template has, see
    ``named``. If no family stands, the passage is ``unknown``, and reported if it shares HINT of some template. Ties go to the family listed first. Null and empty texts have no paragraph. Repeated rows get equal answers, other
    columns are ignored. A model may be given, so that it is trained once for many tables.
    """
    model = model or train(docs, templates)
    bare = [(f, t, tokens(t)) for f, ts in templates.items() for t in ts]
    reach = max(len(w) for _, _, w in bare)

    def run(batches):
        for batch in batches:
            count, found = np.zeros(batch.num_rows, np.int64), [[] for _ in range(batch.num_rows)]
            for lo, hi, raw, off in chunks(batch.column(1)):
                buf = LOWER[raw]
                s, e, first = words(buf, off, SEPARATOR)
                if not len(s):
                    continue
                doc = np.repeat(np.arange(hi - lo), np.diff(first))
                para = paragraphs(buf, off, s, doc)
                head = np.flatnonzero(np.diff(para, prepend=-1))
                past = np.append(head[1:], len(s))
                count[lo:hi] = np.bincount(doc[head], minlength=hi - lo)
                start = np.searchsorted(doc[head], np.arange(hi - lo))
                of, a, b = windows_of(head, past)
                p = model.probabilities(grams_of(buf, s, e), a, b)
                like = np.flatnonzero(1 - p[:, 0] >= model.least)
                if not len(like):
                    continue
                new = np.ones(len(like), bool)
                new[1:] = (of[like[1:]] != of[like[:-1]]) | (a[like[1:]] > np.maximum.accumulate(b[like])[:-1])
                data = buf.tobytes()
                for passage in np.split(like, np.flatnonzero(new)[1:]):
                    i = int(of[passage[0]])
                    d = int(doc[head[i]])
                    best = p[passage, 1:].argmax(1)
                    rows = {}
                    for c in sorted(set(best.tolist())):
                        part = passage[best == c]
                        x, y = max(int(head[i]), int(a[part[0]]) - reach), min(int(past[i]), int(b[part].max()) + reach)
                        own = [data[u:v].decode(errors="replace") for u, v in zip(s[x:y].tolist(), e[x:y].tolist(), strict=True)]
                        family, t, alike = named(p[part, 1:].max(0), own, bare, model.classes, model.known)
                        text = raw[int(s[a[part[0]]]) : int(e[b[part].max() - 1])].tobytes().decode(errors="replace")
                        row = {"paragraph": i - int(start[d]), "family": family, "probability": float(1 - p[part, 0].min()), "template": t, "likeness": float(alike), "text": text}
                        if family not in rows or alike > rows[family]["likeness"]:
                            rows[family] = row
                    if len(rows) > 1 or UNKNOWN in rows and rows[UNKNOWN]["likeness"] < HINT:
                        rows.pop(UNKNOWN, None)
                    found[lo + d] += rows.values()
            yield pa.record_batch([batch.column(0), pa.array(count), pa.array(found, _FOUND)], names=["doc_id", "n_paragraphs", "found"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, FOUND)


def licence_report(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """(doc_id, n_paragraphs, n_licence, n_unknown, families): per document, the confirmed families sorted and joined by commas."""
    s = scan(docs, model=model)
    sure = F.filter("found", lambda x: x["family"] != UNKNOWN)
    return s.select("doc_id", "n_paragraphs", F.size(sure).cast("long").alias("n_licence"), (F.size("found") - F.size(sure)).cast("long").alias("n_unknown"), F.array_join(F.array_sort(F.array_distinct(F.transform(sure, lambda x: x["family"]))), ",").alias("families"))
