"""Quality scores: random Fourier features of document statistics, ridge regression and isotonic calibration."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructField, StructType

from folioframe.llm.arrowtext import chunks, gram_hashes, word_hashes, words
from folioframe.llm.common import checkpointed

#: Most labelled rows that are learned from (a hash sample beyond that), Fourier features, ridge, kernel width.
TRAIN_ROWS, FEATURES, RIDGE, WIDTH = 50_000, 256, 1e-2, 4.0
THRESHOLD = 0.3
FOLDS = 5


def _class(*codes: int | range) -> np.ndarray:
    t = np.zeros(256, np.int64)
    for c in codes:
        t[list(c) if isinstance(c, range) else [c]] = 1
    return t


#: Byte classes whose shares are statistics.
CLASSES = {
    "upper": _class(range(0x41, 0x5B)),
    "lower": _class(range(0x61, 0x7B)),
    "digit": _class(range(0x30, 0x3A)),
    "blank": _class(0x20, range(0x09, 0x0E)),
    "newline": _class(0x0A),
    "stop": _class(0x2E, 0x2C),
    "loud": _class(0x21, 0x3F),
    "symbol": _class(0x23, 0x24, 0x25, 0x26, 0x2A, 0x2B, 0x3D, 0x40, 0x5E, 0x7E),
    "bracket": _class(0x28, 0x29, 0x3C, 0x3E, 0x5B, 0x5D, 0x7B, 0x7C, 0x7D),
    "mark": _class(0x22, 0x27, 0x2D, 0x2F, 0x3A, 0x3B, 0x5C, 0x5F, 0x60),
    "control": _class(range(0, 9), range(0x0E, 0x20), 0x7F),
    "high": _class(range(0x80, 0x100)),
}
STATISTICS = [*CLASSES, "log_bytes", "log_words", "word_length", "long_words", "distinct_words", "repeat_next", "distinct_triples", "ends_stop", "line_words", "distinct_lines", "upper_words"]


def statistics(column: pa.Array) -> np.ndarray:
    """A row of STATISTICS for each text; a text without words has zeros but for its byte shares."""
    out = np.zeros((len(column), len(STATISTICS)))
    for lo, hi, buf, off in chunks(column):
        n, size = hi - lo, np.diff(off)
        x = np.zeros((n, len(STATISTICS)))
        share = 1 / np.maximum(size, 1)
        for j, t in enumerate(CLASSES.values()):
            c = np.concatenate([[0], np.cumsum(t[buf])])
            x[:, j] = (c[off[1:]] - c[off[:-1]]) * share
        s, e, first = words(buf, off)
        k = np.diff(first)
        per = 1 / np.maximum(k, 1)
        doc = np.repeat(np.arange(n), k)
        add = lambda v: np.bincount(doc, weights=v, minlength=n)  # noqa: B023, E731
        h = word_hashes(buf, s, e)

        def distinct(owner: np.ndarray, value: np.ndarray) -> np.ndarray:
            o = np.lexsort((value, owner))
            a, b = owner[o], value[o]
            new = np.ones(len(o), bool)
            new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
            return np.bincount(a[new], minlength=n)  # noqa: B023

        j = len(CLASSES)
        x[:, j] = np.log1p(size)
        x[:, j + 1] = np.log1p(k)
        x[:, j + 2] = add(e - s) * per
        x[:, j + 3] = add((e - s) > 15) * per
        x[:, j + 4] = distinct(doc, h) * per
        same = np.zeros(len(h), bool)
        same[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
        x[:, j + 5] = add(same) * per
        g = gram_hashes(h, 3)
        in_doc = doc[: len(g)] == doc[len(doc) - len(g) :] if len(g) else np.zeros(0, bool)
        x[:, j + 6] = distinct(doc[: len(g)][in_doc], g[in_doc]) / np.maximum(k - 2, 1)
        if len(e):
            x[:, j + 7] = add(np.isin(buf[e - 1], (0x2E, 0x2C))) * per
            up = np.concatenate([[0], np.cumsum(CLASSES["upper"][buf])])
            x[:, j + 10] = add(up[e] - up[s] >= np.maximum(2, (e - s) // 2)) * per
            # A line starts at the first word of a document and at the first word after a newline.
            nl = np.concatenate([[0], np.cumsum(buf == 0x0A)])
            head = np.ones(len(s), bool)
            head[1:] = (doc[1:] != doc[:-1]) | (nl[s[1:]] != nl[s[:-1]])
            at = np.flatnonzero(head)
            lines = np.bincount(doc[at], minlength=n)
            x[:, j + 8] = np.log1p(k / np.maximum(lines, 1))
            x[:, j + 9] = distinct(doc[at], np.add.reduceat(h, at)) / np.maximum(lines, 1)
        out[lo:hi] = x
    return out


class Model:
    """Standardised statistics -> sqrt(2/D) cos(w x + b) -> ridge score -> isotonic probability."""

    def __init__(self, mean, std, w, b, beta, knots, values):
        self.mean, self.std, self.w, self.b, self.beta, self.knots, self.values = mean, std, w, b, beta, knots, values

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.std, -8, 8)
        f = np.cos(z @ self.w + self.b) * np.sqrt(2 / len(self.b))
        return np.hstack([f, np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.beta

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(x), self.knots, self.values), 0.0, 1.0)


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators: (mean score, mean label) of the pools; between them the calibration is linear."""
    o = np.argsort(score, kind="stable")
    pools: list[list[float]] = []
    for s, v in zip(score[o].tolist(), y[o].tolist(), strict=True):
        pools.append([s, v, 1.0])
        while len(pools) > 1 and pools[-2][1] / pools[-2][2] >= pools[-1][1] / pools[-1][2]:
            s2, v2, n2 = pools.pop()
            pools[-1] = [pools[-1][0] + s2, pools[-1][1] + v2, pools[-1][2] + n2]
    p = np.array(pools)
    return p[:, 0] / p[:, 2], p[:, 1] / p[:, 2]


def _sums(rows: DataFrame, part) -> list[np.ndarray]:
    """Adds up part(statistics, label), a list of arrays, over partitions of the bounded training rows (16 at most)."""

    def run(batches):
        total = None
        for batch in batches:
            x = np.stack(batch.column(0).to_numpy(zero_copy_only=False)) if batch.num_rows else np.zeros((0, len(STATISTICS)))
            if not len(x):
                continue
            new = part(x, batch.column(1).to_numpy(zero_copy_only=False))
            total = new if total is None else [a + b for a, b in zip(total, new, strict=True)]
        if total is not None:
            yield pa.record_batch([pa.array([[t.ravel().tolist() for t in total]], pa.list_(pa.list_(pa.float64())))], names=["s"])

    got = [[np.array(a) for a in r.s] for r in rows.select("x", "y").coalesce(16).mapInArrow(run, "s array<array<double>>").collect()]
    return [sum(a) for a in zip(*got, strict=True)]


def fold(doc_id: str = "doc_id", folds: int = FOLDS):
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, features: int = FEATURES, seed: int = 11) -> Model:
    """Learns from labelled documents outside fold 0. A tenth of the learned rows calibrates, the others fit the ridge.

    Of more than ``rows`` labels a hash sample is learned from; it is small enough to be broadcast to the documents.
    """
    lab = labels.filter("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("double").alias("y")).filter(fold() != 0)
    share = max(1, -(-lab.count() // rows))
    lab = lab.filter(F.pmod(F.xxhash64("doc_id"), F.lit(share)) == 0).select(F.col("doc_id").alias("_l"), "y")

    def stats(batches):
        for batch in batches:
            x = statistics(batch.column(0))
            yield pa.record_batch([pa.array(list(x), pa.list_(pa.float64())), batch.column(1), batch.column(2)], names=["x", "y", "cal"])

    own = docs.select("doc_id", "text").join(F.broadcast(lab), F.col("doc_id") == F.col("_l")).select("text", "y", (F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(10)) == 0).alias("cal"))
    t = checkpointed(own.mapInArrow(stats, "x array<double>, y double, cal boolean"))
    fit, cal = t.filter("NOT cal"), t.filter("cal")
    first = _sums(fit, lambda x, y: [np.array([len(x)]), x.sum(0), (x**2).sum(0), np.array([y.sum()])])
    rng = np.random.default_rng(seed)
    d = len(STATISTICS)
    w, b = rng.normal(size=(d, features)) / WIDTH, rng.uniform(0, 2 * np.pi, features)
    if not first:  # nothing to learn from
        return Model(np.zeros(d), np.ones(d), w, b, np.zeros(features + 1), np.array([0.0]), np.array([0.5]))
    n, mean = first[0][0], first[1] / first[0][0]
    std = np.sqrt(np.maximum(first[2] / n - mean**2, 1e-12))
    m = Model(mean, np.where(std > 1e-6, std, 1.0), w, b, np.zeros(features + 1), np.array([0.0]), np.array([first[3][0] / n]))

    def normal(x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        f = m.features(x)
        return [f.T @ f, f.T @ y]

    gram, moment = _sums(fit, normal)
    m.beta = np.linalg.solve(gram.reshape(features + 1, -1) + RIDGE * n / features * np.eye(features + 1), moment)
    pairs = [(r.x, r.y) for r in cal.collect()] or [(r.x, r.y) for r in fit.collect()]  # a tenth of the bounded sample
    m.knots, m.values = isotonic(m.raw(np.array([x for x, _ in pairs])), np.array([y for _, y in pairs]))
    return m


def scores(docs: DataFrame, model: Model, name: str = "quality_score") -> DataFrame:
    """The columns of ``docs``, whatever their names, and behind them the score."""
    at = docs.columns.index("text")
    own = [f"c{i}" for i in range(len(docs.columns))]

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.score(statistics(batch.column(at))))], names=[*own, "score"])

    schema = StructType([StructField(c, f.dataType) for c, f in zip(own, docs.schema.fields, strict=True)]).add("score", "double")
    return docs.toDF(*own).mapInArrow(run, schema).toDF(*docs.columns, name)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row.

    The statistics are of the whole text; null and empty texts have zeros and are scored like any other, and equal texts alike, so repeated
    rows get equal answers. Null doc_ids are in the fold of the empty string. Several labels of a document count by their mean, and each of
    the rows that share its id is learned from. With no labels every score is 0.5; with one class it is that class's. Other columns are ignored.
    """
    s = scores(docs.select("doc_id", "text"), train(docs, labels), "score")
    return s.select("doc_id", (fold() == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows that score at least THRESHOLD, each judged for itself, with all their columns, whatever these are called."""
    good = scores(docs, train(docs, labels)).toDF(*[f"c{i}" for i in range(len(docs.columns))], "score").filter(F.col("score") >= THRESHOLD)
    return good.drop("score").toDF(*docs.columns)
