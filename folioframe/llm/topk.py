"""Exact top-k inner-product search with block-at-a-time pruning.

Vectors are cut into blocks of a range of ids. A block's bounds, the largest and smallest value of each dimension, are some hundredth of it;
a query's products with them, summed, bound every score in the block. Bounds go to all queries, blocks only where they may score: first to
the queries for which their bound is the best, whose k best scores there are a threshold, and then to those whose threshold their bound reaches.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from folioframe.llm.common import checkpointed

#: Vectors of one block, block bounds of one bounds block, queries of one query block, blocks searched by one task for a query block.
BLOCK, BOUNDS, QUERIES, CELL_BLOCKS = 256, 1024, 512, 16
#: Blocks that give a query its threshold.
SEEDS = 2
#: Squares of a vector's components sum to less, so that scores stay inside 64 bits.
LARGEST = 2**62
LEAST = -(2**63)


def quantised(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, v array<long>): floor(scale * x); vectors null, empty of a valid id, or with a null or non-finite component are left out.

    A vector whose scores might not fit into 64 bits (the squares of its components sum to 2**62 or more) is an error: by the inequality
    of Cauchy and Schwarz all products of the others do.
    """
    ok = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    square = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + F.floor(x.cast("double") * scale).cast("double") * F.floor(x.cast("double") * scale))
    values = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale))
    fits = F.when(square < float(LARGEST), values).otherwise(F.raise_error(F.concat(F.lit("too large for 64-bit scores: vec_id "), F.col("vec_id"))))
    return vectors.filter(ok).select(F.col("vec_id").cast("long").alias("vec_id"), fits.alias("v"))


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column as one matrix; shorter vectors are filled with zeros, which add nothing to a product."""
    size = np.asarray(column.value_lengths())
    out = np.zeros((len(column), int(size.max(initial=0))), np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    out[np.repeat(np.arange(len(size)), size), np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out


def _packed(rows: int):
    """Cuts sorted partitions into blocks: id, dimensions, ids, values and their extremes as bytes."""

    def run(batches):
        part = None
        for batch in batches:
            part = pa.concat_tables([part, pa.Table.from_batches([batch])]) if part is not None else pa.Table.from_batches([batch])
            while part.num_rows >= rows:
                yield pack(part.slice(0, rows))
                part = part.slice(rows)
        if part is not None and part.num_rows:
            yield pack(part)

    def pack(t: pa.Table) -> pa.RecordBatch:
        t = t.combine_chunks()
        m = _matrix(t.column(1).combine_chunks() if t.column(1).num_chunks != 1 else t.column(1).chunk(0))
        ids = t.column(0).to_numpy().astype(np.int64)
        small = m.astype(np.int16) if np.abs(m).max(initial=0) < 2**15 else m
        blob = lambda x: pa.array([x.tobytes()], pa.binary())
        return pa.record_batch([pa.array([m.shape[1]]), pa.array([small.itemsize]), blob(ids), blob(small), blob(np.stack([m.max(0), m.min(0)]))], names=["dim", "width", "ids", "data", "ends"])

    return run


PACKED = "dim long, width long, ids binary, data binary, ends binary"


def _open(t: pa.Table) -> list[tuple[np.ndarray, np.ndarray]]:
    out = []
    for m, w, i, d in zip(*(t.column(c).to_pylist() for c in ("dim", "width", "ids", "data")), strict=True):
        ids = np.frombuffer(i, np.int64)
        out.append((ids, np.frombuffer(d, np.int16 if w == 2 else np.int64).reshape(len(ids), m).astype(np.int64)))
    return out


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = min(a.shape[1], b.shape[1])
    a, b = a[:, :d], b[:, :d]
    if d and float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * d < 2**53:  # exact in doubles
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def bounds_of(q: np.ndarray, ends: list[np.ndarray]) -> np.ndarray:
    """(queries, blocks): what no score in a block exceeds, the summed products with its term maxima (minima where the query is negative)."""
    dim = max([q.shape[1], *(e.shape[1] for e in ends)])
    q, top, low = _wide(q, dim), np.stack([_wide(e, dim)[0] for e in ends]), np.stack([_wide(e, dim)[1] for e in ends])
    return _product(np.maximum(q, 0), top) + _product(np.minimum(q, 0), low)


def search_cell(queries: list, floor: np.ndarray, blocks: list, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best k candidates of each query among the blocks: (query, candidate, score); what scores below ``floor`` may be missing.

    Queries go through the blocks in the order of the bound, all at the same depth together, and a query is done when its next
    bound is below its floor or its k-th score; equal bounds go on, for ties.
    """
    qid, q = np.concatenate([x for x, _ in queries]), _stack([m for _, m in queries])
    dim = max(q.shape[1], max(m.shape[1] for _, m in blocks))
    q = _wide(q, dim)
    blocks = [(i, _wide(m, dim)) for i, m in blocks]
    bound = bounds_of(q, [np.stack([m.max(0), m.min(0)]) for _, m in blocks])
    order = np.argsort(-bound, axis=1, kind="stable")
    best = np.full((len(qid), k), np.iinfo(np.int64).min)
    who = np.full((len(qid), k), np.iinfo(np.int64).max)
    alive = np.arange(len(qid))
    for depth in range(len(blocks)):
        nxt = order[alive, depth]
        go = bound[alive, nxt] >= np.maximum(best[alive, -1], floor[alive])
        alive, nxt = alive[go], nxt[go]
        if not len(alive):
            break
        for b in np.unique(nxt):
            rows = alive[nxt == b]
            ids, m = blocks[b]
            s = _product(q[rows], m)
            s = np.where(ids[None, :] == qid[rows][:, None], np.iinfo(np.int64).min, s)
            cs, ci = np.concatenate([best[rows], s], 1), np.concatenate([who[rows], np.broadcast_to(ids, s.shape)], 1)
            o = np.lexsort((ci, ~cs), axis=1)[:, :k]
            best[rows], who[rows] = np.take_along_axis(cs, o, 1), np.take_along_axis(ci, o, 1)
    r, c = np.nonzero(best > np.iinfo(np.int64).min)
    return qid[r], who[r, c], best[r, c]


def _wide(m: np.ndarray, dim: int) -> np.ndarray:
    return m if m.shape[1] == dim else np.pad(m, ((0, 0), (0, dim - m.shape[1])))


def _stack(ms: list[np.ndarray]) -> np.ndarray:
    return np.concatenate([_wide(m, max(x.shape[1] for x in ms)) for m in ms])


FOUND = "query_id long, vec_id long, score long"
LEAST = -(2**63)


def _found(q: np.ndarray, who: np.ndarray, score: np.ndarray) -> pa.Table:
    return pa.table({"query_id": q, "vec_id": who, "score": score})


def top_inner(vectors: DataFrame, k: int = 5, every: int = 50) -> DataFrame:
    """(query_id, rank, vec_id, score): for each vector whose id is divisible by ``every``, the k best of all others.

    Scores are integer inner products of floor(256 * x); ties go to the smaller vec_id. Vectors that are null or hold
    a null or non-finite component take no part, nor do null ids; a shorter vector counts as filled with zeros; values too large for 64-bit
    scores are an error. Rows that repeat an id are candidates each for itself, except for the query of that id; a repeated query is answered
    once, for its row of the largest vector. Other columns are ignored.

    The SEEDS best blocks of each query by bound give its k-th score at least; every block that reaches it for some query of a query
    block is sent there once, cells of CELL_BLOCKS at a time, and their best are merged.
    """
    v = quantised(vectors.select("vec_id", "embedding"))
    number = lambda df, c: df.withColumn(c, F.monotonically_increasing_id())
    asked = v.filter(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.max("v").alias("v"))
    # Checkpointed, so that the numbers of blocks are those of the written blocks.
    blocks = checkpointed(number(v.repartitionByRange("vec_id").sortWithinPartitions("vec_id").mapInArrow(_packed(BLOCK), PACKED), "b"))
    ask = checkpointed(number(asked.repartitionByRange("vec_id").sortWithinPartitions("vec_id").mapInArrow(_packed(QUERIES), PACKED), "g"))

    ends = checkpointed(blocks.select("b", "dim", "ends").mapInArrow(_bounds_blocks, "bs binary, dim long, ends binary").withColumn("j", F.monotonically_increasing_id()))
    questions = ask.select("g", "dim", "width", "ids", "data")
    best = lambda df, n: df.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))).filter(F.col("rank") <= n)

    def seeds(one: dict, bound: np.ndarray, floor: np.ndarray) -> pa.RecordBatch:
        few = min(SEEDS, bound.shape[1])
        at = np.argsort(-bound, axis=1, kind="stable")[:, :few]
        return pa.record_batch([pa.array(np.full(at.size, one["g"])), pa.array(np.repeat(np.frombuffer(one["ids"], np.int64), few)), pa.array(np.frombuffer(one["bs"], np.int64)[at.ravel()]), pa.array(np.take_along_axis(bound, at, 1).ravel())], names=["g", "query_id", "vec_id", "score"])

    def reaching(one: dict, bound: np.ndarray, floor: np.ndarray) -> pa.RecordBatch:
        b = np.frombuffer(one["bs"], np.int64)[(bound >= floor[:, None]).any(0)]
        return pa.record_batch([pa.array(np.full(len(b), one["g"])), pa.array(b)], names=["g", "b"])

    seeded = checkpointed(best(_with_bounds(questions, ends, seeds, "g long, query_id long, vec_id long, score long"), SEEDS).select("g", F.col("vec_id").alias("b")).distinct())
    first = checkpointed(_searched(questions, blocks, seeded, k))
    floors = best(first, k).filter(F.col("rank") == k).join(asked.select(F.col("vec_id").alias("query_id")), "query_id").select("query_id", "score")
    by_block = ask.select("g", "ids").mapInArrow(_members, "g long, query_id long").join(floors, "query_id").groupBy("g").agg(F.collect_list(F.struct("query_id", "score")).alias("floors"))
    questions = checkpointed(questions.join(by_block, "g", "left"))
    rest = _with_bounds(questions, ends, reaching, "g long, b long").distinct().join(seeded, ["g", "b"], "left_anti")
    found = first.unionByName(_searched(questions, blocks, rest, k))
    return best(found, k).select("query_id", "rank", "vec_id", "score")


def _members(batches):
    for batch in batches:
        for g, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            q = np.frombuffer(ids, np.int64)
            yield pa.record_batch([pa.array(np.full(len(q), g)), pa.array(q)], names=["g", "query_id"])


def _bounds_blocks(batches):
    """The numbers and extremes of BOUNDS blocks at a time, filled with zeros to the same dimensions."""
    held = []

    def pack() -> pa.RecordBatch:
        dim = max(e.shape[1] for _, e in held)
        return pa.record_batch([pa.array([np.array([b for b, _ in held]).tobytes()], pa.binary()), pa.array([dim]), pa.array([np.stack([_wide(e, dim) for _, e in held]).tobytes()], pa.binary())], names=["bs", "dim", "ends"])

    for batch in batches:
        for b, dim, ends in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            held.append((b, np.frombuffer(ends, np.int64).reshape(2, dim)))
            if len(held) == BOUNDS:
                yield pack()
                held = []
    if held:
        yield pack()


def _floors(one: dict) -> np.ndarray:
    at = {x["query_id"]: x["score"] for x in one.get("floors") or ()}
    return np.array([at.get(i, LEAST) for i in np.frombuffer(one["ids"], np.int64).tolist()], np.int64)


def _with_bounds(questions: DataFrame, ends: DataFrame, visit, schema: str) -> DataFrame:
    """visit(row, bounds, floors) of every query block with every bounds block: the stated queries against all rows, in blocks of both.

    A query block takes one of ``lanes`` copies of each bounds block, so a join key has a few query blocks and one bounds block.
    """
    n = ends.agg(F.collect_list("j")).first()[0]  # one number for BOUNDS * BLOCK vectors
    lanes = max(1, questions.count() // 8)
    q = questions.withColumns({"j": F.explode(F.array(*map(F.lit, n)).cast("array<long>")), "lane": F.pmod(F.xxhash64("g"), F.lit(lanes))})
    e = ends.select("j", "bs", F.col("dim").alias("edim"), "ends", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(lanes - 1).cast("long"))).alias("lane"))

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                t = pa.Table.from_batches([batch.slice(i, 1)])
                one = t.to_pylist()[0]
                bounds = np.frombuffer(one["ends"], np.int64).reshape(-1, 2, one["edim"])
                yield visit(one, bounds_of(_open(t)[0][1], list(bounds)), _floors(one))

    return q.join(e, ["j", "lane"]).mapInArrow(run, schema)


def _searched(questions: DataFrame, blocks: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score): the k best of each query among the blocks that ``pairs`` (g, b) gives its query block, in cells of a bounded size."""
    cell = F.floor(F.row_number().over(W.partitionBy("g").orderBy("b")) / CELL_BLOCKS).cast("long")
    cells = checkpointed(pairs.withColumn("cell", cell))
    asked = questions.join(cells.select("g", F.col("cell").alias("qc")).distinct(), "g")
    given = blocks.select("b", "dim", "width", "ids", "data").join(cells, "b").withColumnsRenamed({"g": "bg", "cell": "bc"})

    def search(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return pa.table({c: np.zeros(0, np.int64) for c in ("query_id", "vec_id", "score")})
        q, who, score = search_cell(_open(a), _floors(a.to_pylist()[0]), _open(b), k)
        return pa.table({"query_id": q, "vec_id": who, "score": score})

    return asked.groupBy("g", "qc").cogroup(given.groupBy("bg", "bc")).applyInArrow(search, "query_id long, vec_id long, score long")


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
