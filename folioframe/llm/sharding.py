"""Jump consistent hashing of stable keys to shards, in column expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

SHARDS = 16
#: Multiplier of the 64-bit linear congruential step of jump consistent hashing.
STEP = 2862933555777941757
#: Blocks of a shard in which slots are numbered: three hex digits of the order key.
BLOCK_DIGITS = 3


def jump(key: Column, shards: int) -> Column:
    """Shard of an unsigned 64-bit key, given as decimal(20,0). With one shard more, rows only move into the new shard.

    The generator's product is below 2**126, so decimal(38,0) holds it; the modulus brings it back to 64 bits. A jump
    lands at least one shard further, so as many steps as shards are enough, and steps after the last leave all as it is.
    """
    big = lambda x: F.lit(str(x)).cast("decimal(20,0)")
    dec = lambda c: c.cast("decimal(20,0)")
    start = F.struct(dec(key).alias("k"), F.lit(-1).cast("long").alias("b"), F.lit(0).cast("long").alias("j"))

    def step(s: Column, _: Column) -> Column:
        k = dec((s["k"] * F.lit(STEP).cast("decimal(19,0)") + 1) % big(2**64))
        high = F.floor(k / F.lit(2**33).cast("decimal(11,0)")).cast("double")
        go = s["j"] < shards
        return F.when(go, F.struct(k.alias("k"), s["j"].alias("b"), F.floor((s["j"] + 1).cast("double") * (F.lit(2147483648.0) / (high + 1.0))).cast("long").alias("j"))).otherwise(s)

    return F.aggregate(F.sequence(F.lit(1), F.lit(shards)), start, step, lambda s: s["b"].cast("int"))


def stable_key(doc_id: Column) -> Column:
    """64 bits of md5 of the id as text, as decimal(20,0); null counts as empty."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit(""))), 1, 16), 16, 10).cast("decimal(20,0)")


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard), one row per row.

    size is the UTF-8 bytes of the text plus 1 (null: 1), text_crc32 that of the text (null: of no bytes). The id and the
    number of shards decide (law ``key``); null ids share a shard. Slots number a shard's rows without gaps, ordered by
    md5 of id and text checksum: blocks of that order are counted first, so no task sees a whole shard, and rows of one id but different texts
    are in different blocks. Equal rows get slots of their own. Other columns are ignored.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    d = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    d = d.withColumn("_o", F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("text_crc32").cast("string"))))
    key = stable_key(F.col("doc_id"))
    d = d.withColumns({"shard": jump(key, shards), "grown_shard": jump(key, shards + 1), "_b": F.substring("_o", 1, BLOCK_DIGITS)})
    before = W.partitionBy("shard").orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    block = d.groupBy("shard", "_b").count().withColumn("_before", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    within = F.row_number().over(W.partitionBy("shard", "_b").orderBy("_o", F.col("doc_id").asc_nulls_first(), "size", "text_crc32"))
    return d.withColumn("_in", within - 1).join(block, ["shard", "_b"]).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("_before") + F.col("_in")).cast("long").alias("slot"), "grown_shard")


def _jump_sql(n: int) -> str:
    state = "{'k': k, 'b': -1::BIGINT, 'j': 0::BIGINT}"
    nk = f"((s.k * {STEP}::UHUGEINT + 1) % 18446744073709551616::UHUGEINT)"
    return f"""(list_reduce(range(1, {n + 1}), lambda s, i: CASE WHEN s.j < {n} THEN {{'k': {nk}, 'b': s.j,
        'j': floor((s.j + 1)::DOUBLE * (2147483648.0::DOUBLE / (({nk} // 8589934592::UHUGEINT)::DOUBLE + 1.0)))::BIGINT}} ELSE s END, {state})).b::INT"""


ORACLE = f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
k AS (SELECT *, ('0x' || md5(coalesce(doc_id::VARCHAR, ''))[1:16])::UBIGINT::UHUGEINT AS k FROM d),
tab AS (SELECT list(c ORDER BY i) AS tab FROM (SELECT i, list_reduce(range(0, 9), lambda a, x: CASE WHEN x = 0 THEN i::BIGINT WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END, i::BIGINT) AS c FROM range(0, 256) r(i))),
c AS (SELECT rid, xor(list_reduce(list_transform(regexp_extract_all(hex(encode(t)), '..'), lambda h: ('0x' || h)::BIGINT), lambda a, x: xor(a // 256, tab[1 + xor(a % 256, x)]), 4294967295::BIGINT), 4294967295) AS crc FROM k, tab),
r AS (SELECT doc_id, strlen(t)::BIGINT + 1 AS size, crc AS text_crc32, md5(coalesce(doc_id::VARCHAR, '') || ':' || crc) AS o, {_jump_sql(SHARDS)} AS shard, {_jump_sql(SHARDS + 1)} AS grown_shard FROM k JOIN c USING (rid))
SELECT doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY o, doc_id NULLS FIRST, size, text_crc32) - 1 AS slot, grown_shard FROM r
"""
