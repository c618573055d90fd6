"""Hard negatives by angular triangle filtering.

Every vector stores its norm and its angles to a few reference directions. For two vectors, angles to one direction differ by at most the angle
between the two and sum to at least it, so stored angles bound their cosine from both sides; times the norms, widened for rounding, they bound the
integer score. An anchor's windows of scores (all from its k-th positive on; from a share of a positive's score up to it) are compared with these
bounds, of blocks of rows first and of rows then, and only what overlaps a window is scored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from folioframe.llm.common import checkpointed
from folioframe.llm.topk import LARGEST, _matrix, _product, _wide

#: Reference directions, and the sample of rows that they are chosen from.
REFERENCES, SAMPLE = 12, 512
#: Rows of a block (a power of two), and the bits of a number that count anchors in a group and blocks in a cell: up to 2048 anchors meet up to 32 blocks at once.
ROWS, GROUP_BITS, CELL_BITS = 256, 11, 5
#: Blocks whose bounds are looked at together; found scores that are held before they are cut to the best.
BOUNDS, HELD = 512, 200_000
#: Stored angles are rounded to single precision and computed in double; this covers both, and the score's bounds get a unit besides.
SLACK = 1e-5
LEAST, MOST = -(2**62), 2**62


def references(vectors: DataFrame, some: int = REFERENCES, sample: int = SAMPLE) -> np.ndarray:
    """Directions (rows of unit length): of the ``sample`` vectors of smallest hash, those that are farthest from the ones before. They decide how much is left out, not what comes out."""
    rows = vectors.select("v").orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).collect()
    m = np.zeros((len(rows), max([1, *(len(r.v) for r in rows)])))
    for i, r in enumerate(rows):
        m[i, : len(r.v)] = r.v
    norms = np.linalg.norm(m, axis=1)
    m = m[norms > 0] / norms[norms > 0, None]
    if not len(m):
        return np.eye(1)
    out = [0]
    near = m @ m[0]
    while len(out) < some and near.min() < 1 - 1e-9:
        out.append(int(near.argmin()))
        near = np.maximum(near, m @ m[out[-1]])
    return m[out]


def angles_of(m: np.ndarray, refs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Norms, and angles to the references. A vector of length zero has right angles; all its scores are zero."""
    d = max(m.shape[1], refs.shape[1])
    m = _wide(m, d).astype(np.float64)
    norm = np.sqrt((m * m).sum(1))
    return norm, np.arccos(np.clip(m @ _wide(refs, d).T / np.maximum(norm, 1e-300)[:, None], -1, 1)).astype(np.float32)


def score_bounds(norm_a: np.ndarray, angle_a: np.ndarray, norms: tuple[np.ndarray, np.ndarray], angles: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(least, greatest) score of each anchor with what has norms and angles between the given ends: integers as doubles, safe against rounding."""
    apart, together = np.zeros((len(norm_a), len(norms[0]))), np.full((len(norm_a), len(norms[0])), np.pi)
    for r in range(angle_a.shape[1]):
        a, lo, hi = angle_a[:, r, None].astype(np.float64), angles[0][None, :, r], angles[1][None, :, r]
        np.maximum(apart, np.maximum(a - hi, lo - a), out=apart)
        np.minimum(together, np.minimum(a + hi, 2 * np.pi - a - lo), out=together)
    near, far = np.cos(np.clip(apart - SLACK, 0, np.pi)), np.cos(np.clip(together + SLACK, 0, np.pi))
    size = norm_a[:, None] * norms[0], norm_a[:, None] * norms[1]
    slack = 1 + size[1] * 1e-9
    return np.where(far < 0, size[1], size[0]) * far - slack, np.where(near < 0, size[0], size[1]) * near + slack


def _blob(x: np.ndarray) -> pa.Array:
    return pa.array([np.ascontiguousarray(x).tobytes()], pa.binary())


def _places(refs: np.ndarray):
    """Adds where a row goes in the order of blocks: its nearest reference and the angle to it."""

    def run(batches):
        for b in batches:
            _, angle = angles_of(_matrix(b.column("v")), refs)
            at = angle.argmin(1)
            yield b.append_column("ref", pa.array(at.astype(np.int32))).append_column("angle", pa.array(angle[np.arange(len(at)), at]))

    return run


BLOCK = "label long, dim long, width long, n long, ids binary, data binary, norms binary, angles binary"


def _packed(rows: int, refs: np.ndarray):
    """Cuts sorted partitions into blocks of one label."""

    def pack(t: pa.Table) -> pa.RecordBatch:
        v = t.column("v").combine_chunks()
        m = _matrix(v.chunk(0) if isinstance(v, pa.ChunkedArray) else v)
        norm, angle = angles_of(m, refs)
        small = m.astype(np.int16) if np.abs(m).max(initial=0) < 2**15 else m
        ids = t.column("vec_id").to_numpy().astype(np.int64)
        cols = [pa.array([t.column("label")[0].as_py()]), *(pa.array([x]) for x in (m.shape[1], small.itemsize, len(ids))), _blob(ids), _blob(small), _blob(norm), _blob(angle)]
        return pa.record_batch(cols, names=[c.split()[0] for c in BLOCK.split(", ")])

    def run(batches):
        held = None
        for b in batches:
            t = pa.Table.from_batches([b])
            held = pa.concat_tables([held, t]) if held is not None else t
            while held.num_rows:
                label = held.column("label").to_numpy()
                end = int(np.searchsorted(label, label[0], "right"))
                if end < rows and end == held.num_rows:
                    break  # more of this block may follow
                yield pack(held.slice(0, min(end, rows)))
                held = held.slice(min(end, rows))
        if held is not None and held.num_rows:
            yield pack(held)

    return run


class Block:
    """An opened block. ``row`` numbers its rows apart from all others'."""

    def __init__(self, r: dict):
        n, self.label = r["n"], r["label"]
        self.ids = np.frombuffer(r["ids"], np.int64)
        self.row = r["b"] * ROWS + np.arange(n)
        self.data = np.frombuffer(r["data"], np.int16 if r["width"] == 2 else np.int64).reshape(n, r["dim"])
        self.norm = np.frombuffer(r["norms"], np.float64)
        self.angle = np.frombuffer(r["angles"], np.float32).reshape(n, -1)


class Anchors:
    """Anchors of a group, with the windows of scores that are looked for: (anchors, windows) arrays ``low`` and ``high``."""

    def __init__(self, t: pa.Table):
        column = lambda c: (lambda x: x.chunk(0) if isinstance(x, pa.ChunkedArray) else x)(t.column(c).combine_chunks())
        self.row, self.label, self.norm = (t.column(c).to_numpy() for c in ("row", "label", "norm"))
        self.angle = column("angle").flatten().to_numpy().reshape(len(self.row), -1)
        self.v = _matrix(column("v")) if "v" in t.column_names else None
        low, high = t.column("low").to_pylist(), t.column("high").to_pylist()
        wide = max(map(len, low))
        pad = lambda x, fill: np.array([[*y, *[fill] * (wide - len(y))] for y in x], np.int64).reshape(len(x), wide)
        self.low, self.high = pad(low, MOST), pad(high, LEAST)

    def overlap(self, least: np.ndarray, greatest: np.ndarray) -> np.ndarray:
        out = np.zeros(least.shape, bool)
        for w in range(self.low.shape[1]):
            out |= (greatest >= self.low[:, w, None]) & (least <= self.high[:, w, None])
        return out


def _extremes(batches):
    """Ends of the norms and angles of BOUNDS blocks at a time, with the blocks' numbers and labels."""
    held = []

    def pack() -> pa.RecordBatch:
        b, label, ends = zip(*held, strict=True)
        return pa.record_batch([_blob(np.array(b)), _blob(np.array(label)), _blob(np.stack(ends))], names=["bs", "labels", "ends"])

    for batch in batches:
        for r in batch.to_pylist():
            norm, angle = np.frombuffer(r["norms"], np.float64), np.frombuffer(r["angles"], np.float32).reshape(r["n"], -1).astype(np.float64)
            held.append((r["b"], r["label"], np.concatenate([[norm.min(), norm.max()], angle.min(0), angle.max(0)])))
            if len(held) == BOUNDS:
                yield pack()
                held = []
    if held:
        yield pack()


def _home(k: int, every: int):
    """The anchors of each block, with one window: from the k-th best score within their own block, which their k-th positive reaches."""

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                x = Block(r)
                at = np.nonzero(x.ids % every == 0)[0]
                if not len(at):
                    continue
                v = x.data.astype(np.int64)
                s = _product(v[at], v)
                s[np.arange(len(at)), at] = LEAST
                low = np.sort(s, 1)[:, -k] if s.shape[1] > k else np.full(len(at), LEAST)
                lists = lambda m, kind: pa.array(list(m), pa.list_(kind))
                cols = [pa.array(x.row[at]), pa.array(x.ids[at]), pa.array(np.full(len(at), x.label)), lists(v[at], pa.int64()), pa.array(x.norm[at]), lists(x.angle[at], pa.float32()), lists(low[:, None], pa.int64()), lists(np.full((len(at), 1), MOST), pa.int64())]
                yield pa.record_batch(cols, names=[c.split()[0] for c in ANCHOR.split(", ")])

    return run


ANCHOR = "row long, anchor_id long, label long, v array<long>, norm double, angle array<float>, low array<long>, high array<long>"


def _reached(anchors: DataFrame, ends: DataFrame, same: bool) -> DataFrame:
    """(g, b): the blocks whose bounds overlap a window of an anchor of group g, of its label or of other labels.

    Groups send norms, angles and windows, without vectors, to every lane of block bounds: the stated anchors against all rows, in blocks of both.
    """
    lanes = min(ends.count(), 2 * int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    asked = anchors.groupBy("g").agg(F.collect_list(F.struct("row", "label", "norm", "angle", "low", "high")).alias("anchors"))
    asked = asked.withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(max(0, lanes - 1)))))
    given = ends.withColumn("lane", F.pmod(F.xxhash64("bs"), F.lit(max(1, lanes))).cast("int"))

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                a = Anchors(pa.Table.from_struct_array(batch.column("anchors")[i].values))
                b, label = (np.frombuffer(batch.column(c)[i].as_py(), np.int64) for c in ("bs", "labels"))
                e = np.frombuffer(batch.column("ends")[i].as_py(), np.float64).reshape(len(b), -1)
                k = (e.shape[1] - 2) // 2
                go = a.overlap(*score_bounds(a.norm, a.angle, (e[:, 0], e[:, 1]), (e[:, 2 : 2 + k], e[:, 2 + k :])))
                go &= (a.label[:, None] == label) == same
                hit = b[go.any(0)]
                yield pa.record_batch([pa.array(np.full(len(hit), batch.column("g")[i].as_py())), pa.array(hit)], names=["g", "b"])

    return asked.join(given, "lane").select("g", "anchors", "bs", "labels", "ends").mapInArrow(run, "g long, b long")


FOUND = "row long, w int, found long, found_row long, score long"


def _cut(parts: list[tuple], k: int) -> list[tuple]:
    """The k best of every (anchor, window): higher scores first, ties by smaller id."""
    row, w, found, at, score = (np.concatenate(c) for c in zip(*parts, strict=True))
    o = np.lexsort((at, found, -score, w, row))
    row, w, found, at, score = (c[o] for c in (row, w, found, at, score))
    new = np.r_[True, (row[1:] != row[:-1]) | (w[1:] != w[:-1])] if len(row) else np.zeros(0, bool)
    first = np.maximum.accumulate(np.where(new, np.arange(len(row)), 0))
    keep = np.arange(len(row)) - first < k
    return [tuple(c[keep] for c in (row, w, found, at, score))]


def search_cell(a: Anchors, blocks: list[Block], same: bool, k: int) -> list[tuple]:
    """The k best rows of each window among the blocks. Rows whose bounds overlap no window of any anchor aren't scored."""
    parts, held = [], 0
    for x in blocks:
        who = np.nonzero((a.label == x.label) == same)[0]
        if not len(who):
            continue
        go = np.zeros((len(a.row), len(x.ids)), bool)
        go[who] = a.overlap(*score_bounds(a.norm, a.angle, (x.norm, x.norm), (x.angle, x.angle)))[who]
        who, rows = np.nonzero(go.any(1))[0], np.nonzero(go.any(0))[0]
        if not len(who):
            continue
        s = _product(a.v[who], x.data[rows].astype(np.int64))
        ok = go[np.ix_(who, rows)] & (a.row[who, None] != x.row[rows])
        for w in range(a.low.shape[1]):
            i, j = np.nonzero(ok & (s >= a.low[who, w, None]) & (s <= a.high[who, w, None]))
            parts.append((a.row[who[i]], np.full(len(i), w, np.int32), x.ids[rows[j]], x.row[rows[j]], s[i, j]))
            held += len(i)
        if held > HELD:
            parts = _cut(parts, k)
            held = len(parts[0][0])
    return _cut(parts, k) if parts else []


def _searched(anchors: DataFrame, blocks: DataFrame, pairs: DataFrame, same: bool, k: int) -> DataFrame:
    """(row, w, found, found_row, score, rank): the k best rows of each window of each anchor, among the blocks that ``pairs`` gives its group."""
    cells = checkpointed(pairs.withColumn("cell", F.shiftright("b", CELL_BITS)))
    asked = anchors.drop("anchor_id").join(cells.select(F.col("g").alias("ag"), F.col("cell").alias("ac")).distinct(), F.col("g") == F.col("ag")).drop("g")
    given = blocks.join(cells.select(F.col("b").alias("pb"), "g", "cell"), F.col("b") == F.col("pb")).drop("pb")

    def search(a: pa.Table, b: pa.Table) -> pa.Table:
        found = search_cell(Anchors(a), [Block(r) for r in b.drop_columns(["g", "cell"]).to_pylist()], same, k) if a.num_rows and b.num_rows else []
        return pa.table(dict(zip((c.split()[0] for c in FOUND.split(", ")), found[0] if found else [np.zeros(0, t) for t in (np.int64, np.int32, np.int64, np.int64, np.int64)], strict=True)))

    best = asked.groupBy("ag", "ac").cogroup(given.groupBy("g", "cell")).applyInArrow(search, FOUND)
    order = W.partitionBy("row", "w").orderBy(F.col("score").desc(), "found", "found_row")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def hard_negatives(vectors: DataFrame, positives: int = 5, negatives: int = 5, every: int = 100, least: int = 80, out_of: int = 100, scale: int = 256) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of (vec_id, embedding, label).

    Anchors are the rows whose vec_id is divisible by ``every``. An anchor's positives are the ``positives`` best other rows of its label; for each, negatives
    are the ``negatives`` best rows of other labels of which the score is least/out_of of the positive's score at least and that score at most. Scores are
    integer inner products of floor(scale * x); higher ones come first, ties go to the smaller vec_id.

    Rows with a null vec_id, label or vector, or with a null or non-finite component take no part; a shorter vector counts as filled with zeros, an empty one
    scores zero. Rows that repeat an id are rows like others: candidates each for itself, and each an anchor with rows of its own. Values too large for 64-bit scores
    are an error. Other columns are ignored, and an empty table gives no rows.
    """
    ok = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    values = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("long"))
    v = vectors.filter(ok).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), values.alias("v"))
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    v = v.withColumn("v", F.when(square < float(LARGEST), F.col("v")).otherwise(F.raise_error(F.concat(F.lit("too large for 64-bit scores: vec_id "), F.col("vec_id")))))
    refs = references(v)
    # Blocks hold rows of one label that are near to each other in angle, so that their bounds are close.
    place = ["label", "ref", "angle", "vec_id"]
    placed = v.mapInArrow(_places(refs), "vec_id long, label long, v array<long>, ref int, angle float")
    blocks = placed.repartitionByRange(*place).sortWithinPartitions(*place).select("vec_id", "label", "v").mapInArrow(_packed(ROWS, refs), BLOCK)
    blocks = checkpointed(blocks.withColumn("b", F.monotonically_increasing_id()))
    ends = checkpointed(blocks.select("b", "label", "n", "norms", "angles").mapInArrow(_extremes, "bs binary, labels binary, ends binary"))
    anchors = checkpointed(blocks.mapInArrow(_home(positives, every), ANCHOR).withColumn("g", F.shiftright(F.monotonically_increasing_id(), GROUP_BITS)))

    best = checkpointed(_searched(anchors, blocks, _reached(anchors, ends, True), True, positives).select("row", F.col("rank").alias("place"), F.col("found").alias("positive_id"), F.col("score").alias("positive_score")))
    low = F.ceil(F.col("positive_score").cast("decimal(20,0)") * least / out_of).cast("long")
    windows = best.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("place", low.alias("low"), F.col("positive_score").alias("high")))).alias("windows"))
    asked = checkpointed(anchors.drop("low", "high").join(windows, "row").select("*", F.col("windows.low").alias("low"), F.col("windows.high").alias("high")).drop("windows"))
    found = _searched(asked, blocks, _reached(asked, ends, False), False, negatives).withColumn("place", F.col("w") + 1)
    named = best.join(anchors.select("row", "anchor_id"), "row")
    return found.join(named, ["row", "place"]).select("anchor_id", "positive_id", "rank", F.col("found").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


ORACLE = """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.r, a.vec_id AS anchor_id, c.r AS cr, c.vec_id, a.label = c.label AS same, coalesce(list_sum(list_transform(range(1, least(len(a.v), len(c.v)) + 1), lambda i: a.v[i] * c.v[i])), 0)::BIGINT AS score
  FROM v a JOIN v c ON a.vec_id % 100 = 0 AND a.r <> c.r),
p AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id, cr) AS place FROM s WHERE same QUALIFY place <= 5),
n AS (SELECT p.anchor_id, p.vec_id AS positive_id, row_number() OVER (PARTITION BY p.r, p.place ORDER BY s.score DESC, s.vec_id, s.cr)::INT AS rank, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
  FROM p JOIN s ON p.r = s.r AND NOT s.same AND 100 * s.score::HUGEINT BETWEEN 80 * p.score::HUGEINT AND 100 * p.score::HUGEINT)
SELECT * FROM n WHERE rank <= 5
"""
