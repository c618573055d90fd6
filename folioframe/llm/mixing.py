"""Mixing sources to target weights by entropy balancing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from folioframe.llm.common import checkpointed, word_count

WEIGHTS = (5, 2, 1)
MOST = 3
#: Rates are rounded to millionths, so that sums of them are exact.
UNIT = 1_000_000
#: Newton steps at most, and the part of a target that a step's gradient may miss when it is the last but one.
STEPS, TOLERANCE = 200, 1e-9
#: Blocks of a source: classes of documents whose sizes differ by 3 % at most, by three hex digits of the order key.
SIZE_CLASSES, BLOCK_DIGITS = 32, 3


def ranked(per: DataFrame, column: str) -> DataFrame:
    """Adds ``rank``, from 0 in the order of a column of distinct values, null last: ranges are sorted apart and counted first."""
    order = F.col(column).asc_nulls_last()
    part = checkpointed(per.repartitionByRange(order).withColumn("_p", F.spark_partition_id()))
    sizes = sorted((r["_p"], r["n"]) for r in part.groupBy("_p").agg(F.count(F.lit(1)).alias("n")).collect())  # a row per task
    before, pairs = 0, []
    for p, n in sizes:
        pairs += [F.lit(p), F.lit(before)]
        before += n
    if not pairs:
        return part.withColumn("rank", F.lit(0).cast("long")).drop("_p")
    within = F.row_number().over(W.partitionBy("_p").orderBy(order)) - 1
    return part.withColumn("rank", (F.create_map(*pairs)[F.col("_p")] + within).cast("long")).drop("_p")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, target) from (source, size, n): weights by code point order (null last), targets at most ``most`` times the source.

    Shares are of what capped sources leave, and sources above their cap are capped, until none is above; a round is a sum over the sources.
    """
    per = ranked(sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), "source")
    weight = F.element_at(F.array(*map(F.lit, weights)), F.pmod(F.col("rank"), F.lit(len(weights))).cast("int") + 1).cast("long")
    per = checkpointed(per.select("source", F.col("source_size").cast("long"), weight.alias("weight"), F.lit(False).alias("capped")))
    everything = per.agg(F.sum("source_size")).first()[0] or 0
    while True:
        free = per.agg(F.sum(F.when(F.col("capped"), F.col("source_size")).otherwise(0)).alias("held"), F.sum(F.when(F.col("capped"), 0).otherwise(F.col("weight"))).alias("weight")).first()
        rest, shares = everything - most * (free["held"] or 0), free["weight"] or 0
        above = ~F.col("capped") & (F.col("weight") * F.lit(rest) > F.lit(most * shares) * F.col("source_size"))
        if not shares or per.filter(above).isEmpty():
            break
        per = checkpointed(per.withColumn("capped", F.col("capped") | above))
    share = F.col("weight").cast("double") * F.lit(float(rest)) / F.lit(float(max(shares, 1)))
    return per.select("source", "source_size", F.when(F.col("capped"), (most * F.col("source_size")).cast("double")).otherwise(share).alias("target"))


def balanced(sizes: DataFrame, targets: DataFrame, most: int = MOST) -> DataFrame:
    """The multipliers of entropy balancing: (source, source_size, target, scale, multiplier).

    Over document rates r between 0 and ``most`` the divergence sum(r log r - r) is least, given that for each source rates times sizes
    sum to its target. The dual is convex with one multiplier a source, and its rates are exponentially tilted: exp(multiplier * size /
    scale), ``most`` at the most, scale being the source's mean size. A Newton step sums gradient and Hessian over all documents (equal sizes of
    a source together, with their number) and keeps to the bracket that gradients of earlier steps left. Steps end once every source is met.
    Sources that can't miss (no words, or a target at the cap) have a multiplier of 0 or infinity from the start.
    """
    full = F.col("target") >= most * F.col("source_size")
    mean = sizes.groupBy("source").agg((F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("scale"))
    state = targets.join(mean, targets["source"].eqNullSafe(mean["source"])).select(targets["source"], "source_size", "target", "scale")
    start = F.when(F.col("source_size") == 0, 0.0).when(full, float("inf")).otherwise(F.log(F.col("target") / F.col("source_size")))
    state = checkpointed(state.withColumns({"multiplier": start, "low": F.lit(float("-inf")), "high": F.lit(float("inf")), "met": (F.col("source_size") == 0) | full}))
    for _ in range(STEPS):
        if state.filter("NOT met").isEmpty():
            break
        open_ = state.filter("NOT met")
        at = sizes.join(open_.select(F.col("source").alias("_s"), "scale", "multiplier"), F.col("source").eqNullSafe(F.col("_s")))
        z, m = F.col("size") / F.col("scale"), F.col("multiplier")
        inner = m * z < F.log(F.lit(float(most)))
        words = F.col("n") * F.col("size")
        sums = at.groupBy("_s").agg(
            F.sum(words * F.when(inner, F.exp(m * z)).otherwise(float(most))).alias("have"),
            F.sum(F.when(inner, words * z * F.exp(m * z)).otherwise(0.0)).alias("hessian"),
        )
        j = open_.join(sums, open_["source"].eqNullSafe(sums["_s"])).drop("_s")
        miss = F.col("have") - F.col("target")
        low, high = F.when(miss < 0, m).otherwise(F.col("low")), F.when(miss > 0, m).otherwise(F.col("high"))
        newton = m - miss / F.col("hessian")
        # Outside the bracket: its middle, or double steps while it is open.
        middle = F.when(low == float("-inf"), F.least(2 * high, high - 1)).when(high == float("inf"), F.greatest(2 * low, low + 1)).otherwise((low + high) / 2)
        step = F.when((F.col("hessian") > 0) & (newton > low) & (newton < high), newton).otherwise(middle)
        done = F.abs(miss) <= TOLERANCE * F.col("target")
        # The step after the tolerance is met is taken: convergence is quadratic there, so it leaves only rounding errors.
        j = j.select("source", "source_size", "target", "scale", F.when(miss == 0, m).otherwise(step).alias("multiplier"), low.alias("low"), high.alias("high"), done.alias("met"))
        state = checkpointed(state.filter("met").unionByName(j))
    return state.drop("low", "high", "met")


def rate_units(size: Column, scale: Column, multiplier: Column, most: int) -> Column:
    """A document's rate in millionths; that of one without words is 1."""
    rate = F.least(F.lit(float(most)), F.exp(multiplier * (size / scale)))
    return F.when(size == 0, UNIT).otherwise(F.round(rate * UNIT).cast("long"))


def _sized(docs: DataFrame) -> DataFrame:
    """All of a row as ``d``, its source, size and order key, which id and text decide."""
    order = F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(F.coalesce("text", F.lit("")))))
    return docs.select(F.struct("*").alias("d"), F.col("doc_id").alias("id"), F.col("source").alias("source"), word_count("text").alias("size"), order.alias("o"))


def _placed(sized: DataFrame, bare: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """``sized`` with source_size, target, rate (in millionths) and copies. ``bare`` has (source, size, o) of the same rows, cheaply.

    A source's documents are walked in the order of size class and order key; where the sum of the rates' fractions passes a half, one and
    a half and so on, a document is taken once more. So of any size as many copies are taken as their rates say, to within one.
    """
    sizes = checkpointed(bare.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")))
    goals = checkpointed(balanced(sizes, source_targets(sizes, weights, most), most).withColumnRenamed("source", "_s"))
    kind = F.when(F.col("size") == 0, -1).otherwise(F.floor(F.log(F.col("size").cast("double")) * SIZE_CLASSES).cast("int"))

    def rated(df: DataFrame) -> DataFrame:
        df = df.withColumns({"kind": kind, "b": F.substring("o", 1, BLOCK_DIGITS)}).join(goals, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
        df = df.withColumn("rate", rate_units(F.col("size"), F.col("scale"), F.col("multiplier"), most))
        return df.withColumn("part", F.col("rate") % UNIT)

    block = rated(bare).groupBy("source", "kind", "b").agg(F.sum("part").alias("sum"))
    # Sums before a size class of the source, a few hundred, and before a block of the class, 4,096 at most: no task holds all of a source.
    earlier = lambda keys, by, c: F.coalesce(F.sum(c).over(W.partitionBy(*keys).orderBy(by).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    kinds = block.groupBy("source", "kind").agg(F.sum("sum").alias("sum"))
    kinds = kinds.select(F.col("source").alias("_s"), F.col("kind").alias("_k"), earlier(["source"], "kind", "sum").alias("kind_before"))
    block = block.withColumn("block_before", earlier(["source", "kind"], "b", "sum"))
    block = block.join(kinds, F.col("source").eqNullSafe(F.col("_s")) & (F.col("kind") == F.col("_k")))
    block = block.select("_s", "_k", F.col("b").alias("_b"), (F.col("kind_before") + F.col("block_before")).alias("before"))
    walk = W.partitionBy("source", "kind", "b").orderBy("o", F.col("id").asc_nulls_first()).rowsBetween(W.unboundedPreceding, -1)
    j = rated(sized).withColumn("own", F.coalesce(F.sum("part").over(walk), F.lit(0)))
    j = j.join(block, F.col("source").eqNullSafe(F.col("_s")) & (F.col("kind") == F.col("_k")) & (F.col("b") == F.col("_b")))
    so_far = F.col("before") + F.col("own") + UNIT // 2
    extra = F.floor((so_far + F.col("part")) / UNIT) - F.floor(so_far / UNIT)
    return j.withColumn("copies", (F.floor(F.col("rate") / UNIT) + extra).cast("int"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """Copies of each document that bring every source to its target: (doc_id, source, size, source_size, target, rate, taken, copies), one row per row.

    size counts words (null text: 0), taken is copies times size. Sources share all words by weight, in code point order, up to ``most`` times
    their own; ``balanced`` tilts the rates of their documents and ``_placed`` rounds them into copies, so that a source misses its target by
    about the size of one document. Texts without words are taken once. Null sources are one source, null doc_ids count as empty;
    repeated rows are taken each for itself, and which one takes a copy makes no difference. Other columns are ignored.
    """
    bare = checkpointed(_sized(docs.select("doc_id", "source", "text")).drop("d"))
    placed = _placed(bare, bare.drop("id"), weights, most)
    return placed.select(F.col("id").alias("doc_id"), "source", "size", "source_size", "target", (F.col("rate") / UNIT).alias("rate"), (F.col("copies") * F.col("size")).alias("taken"), "copies")


def take(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """The mixed documents: each row of ``docs`` as often as its copies say, with all its columns, whatever these are called."""
    bare = checkpointed(_sized(docs.select("doc_id", "source", "text")).select("source", "size", "o"))
    placed = _placed(_sized(docs), bare, weights, most).filter("copies > 0")
    return placed.select("d", F.explode(F.array_repeat(F.lit(1), F.col("copies")))).select("d.*")


#: Bisects each multiplier instead of Newton's method; a source's documents are walked at once.
ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    md5(coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))) AS o FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, avg(size) AS scale, row_number() OVER (ORDER BY source NULLS LAST) AS rn FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][((rn - 1) % 3 + 1)::INT]::BIGINT AS weight FROM s),
c AS (SELECT *, sum(source_size) OVER () AS a, sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER b, 0) AS ls, sum(weight) OVER () - coalesce(sum(weight) OVER b, 0) AS lw FROM w
      WINDOW b AS (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
k AS (SELECT *, 3 * source_size * lw <= ls * weight AS capped FROM c),
g AS (SELECT source, source_size, scale, rn, CASE WHEN capped THEN (3 * source_size)::DOUBLE ELSE weight::DOUBLE * (a - 3 * sum(CASE WHEN capped THEN source_size ELSE 0 END) OVER ())::DOUBLE
      / (sum(CASE WHEN capped THEN 0 ELSE weight END) OVER ())::DOUBLE END AS target FROM k),
h AS (SELECT rn, d.size, (d.size * count(*))::DOUBLE AS words, d.size / any_value(scale) AS z FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source GROUP BY rn, d.size),
it(step, rn, lo, hi) AS (SELECT 0, rn, -4000.0::DOUBLE, 4000.0::DOUBLE FROM g
  UNION ALL
  SELECT any_value(it.step) + 1, it.rn, CASE WHEN sum(words * least(3.0, exp(least(700.0, (lo + hi) / 2 * z)))) < any_value(target) THEN any_value((lo + hi) / 2) ELSE any_value(lo) END,
         CASE WHEN sum(words * least(3.0, exp(least(700.0, (lo + hi) / 2 * z)))) < any_value(target) THEN any_value(hi) ELSE any_value((lo + hi) / 2) END
  FROM it JOIN g ON g.rn = it.rn JOIN h ON h.rn = it.rn WHERE it.step < 90 GROUP BY it.rn),
f AS (SELECT g.*, (lo + hi) / 2 AS m FROM g JOIN it ON g.rn = it.rn WHERE it.step = 90),
r AS (SELECT d.doc_id, d.source, d.size, d.o, source_size, target, CASE WHEN d.size = 0 THEN -1 ELSE floor(ln(d.size::DOUBLE) * 32)::INT END AS kind,
      CASE WHEN d.size = 0 THEN 1000000 WHEN target >= 3 * source_size THEN 3000000 ELSE round(least(3.0, exp(least(700.0, m * (d.size / scale)))) * 1000000)::BIGINT END AS rate FROM d JOIN f ON d.source IS NOT DISTINCT FROM f.source),
p AS (SELECT *, coalesce(sum(rate % 1000000) OVER (PARTITION BY source ORDER BY kind, o, doc_id NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT + 500000 AS so_far FROM r)
SELECT doc_id, size, source_size, target, (size * (rate // 1000000 + (so_far + rate % 1000000) // 1000000 - so_far // 1000000))::BIGINT AS taken FROM p
"""
