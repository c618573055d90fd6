"""Benchmark decontamination by a prefix-filtered set join."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from folioframe.llm.arrowtext import LOWER, chunks, gram_hashes, mix, word_hashes, words
from folioframe.llm.common import NULL_ID, checkpointed, doc_key, row_key

WINDOW, SHINGLE = 10, 3
#: Bits of the filter that keeps shingles of no item at home: 16 for each item shingle, 2**27 (16 MB) at most.
FILTER_BITS, FILTER_MOST = 16, 27
#: Most bytes of item windows that are broadcast; they are added up first.
BROADCAST_BYTES = 32 << 20

#: Everything but 0-9, a-z and bytes from 0x80 on separates words, once A-Z are lower-cased.
SEPARATOR = np.ones(256, bool)
SEPARATOR[0x80:] = False
SEPARATOR[0x30:0x3A] = False
SEPARATOR[0x61:0x7B] = False


def _shingles(h: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(position, hash) of the n-word shingles that stay inside a document."""
    g = gram_hashes(h, n)
    inside = np.zeros(len(g), bool)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        inside[a : max(a, b - n + 1)] = True
    at = np.flatnonzero(inside)
    return at, mix(g[at] + np.uint64(n))


def item_windows(items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """(item_id, phrase, n, at, token): the windows of each item, with each of their shingles and where it is.

    A window is ``window`` consecutive words, or all words of a shorter item that has any; its shingles have ``shingle``
    words, or as many as it has.
    """

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_pylist()
            out = []
            for lo, hi, raw, off in chunks(batch.column(1)):
                buf = LOWER[raw]
                s, e, first = words(buf, off, SEPARATOR)
                h = word_hashes(buf, s, e, SEPARATOR)
                data = buf.tobytes()
                for i in range(hi - lo):
                    a, b = int(first[i]), int(first[i + 1])
                    w = [data[x:y].decode() for x, y in zip(s[a:b].tolist(), e[a:b].tolist(), strict=True)]
                    n = min(window, len(w))
                    k = min(shingle, n)
                    if not n:
                        continue
                    g = mix(gram_hashes(h[a:b], k) + np.uint64(k)).view(np.int64).tolist()
                    for j in range(len(w) - n + 1):
                        phrase = " ".join(w[j : j + n])
                        out += [(ids[lo + i], phrase, n, t - j, g[t]) for t in range(j, j + n - k + 1)]
            cols = list(zip(*out, strict=True)) if out else [[]] * 5
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int64()), strict=True)], names=["item_id", "phrase", "n", "at", "token"])

    return items.select(F.col("item_id").cast("string"), "text").mapInArrow(run, "item_id string, phrase string, n int, at int, token long")


def token_filter(windows: DataFrame) -> tuple[np.ndarray, int, list[int]]:
    """(bits, how many as a power of two, shingle lengths): a bit map of the items' shingles, of bounded size whatever the benchmark."""
    k = F.least("n", F.lit(SHINGLE))
    seen = windows.select("token").distinct().agg(F.count(F.lit(1))).first()[0]
    power = min(FILTER_MOST, max(10, int(seen * FILTER_BITS).bit_length()))

    def mark(batches):
        bits = np.zeros(1 << (power - 3), np.uint8)
        for batch in batches:
            t = batch.column(0).to_numpy().view(np.uint64)
            for shift in (0, 32):
                x = (t >> np.uint64(shift)) & np.uint64((1 << power) - 1)
                np.bitwise_or.at(bits, (x >> np.uint64(3)).astype(np.int64), (1 << (x & np.uint64(7)).astype(np.uint8)).astype(np.uint8))
        yield pa.record_batch([pa.array([bits.tobytes()], pa.binary())], names=["bits"])

    bits = np.zeros(1 << (power - 3), np.uint8)
    for r in windows.select("token").coalesce(8).mapInArrow(mark, "bits binary").collect():
        bits |= np.frombuffer(r.bits, np.uint8)
    return bits, power, sorted(r.k for r in windows.select(k.alias("k")).distinct().collect())


def _passes(t: np.ndarray, bits: np.ndarray, power: int) -> np.ndarray:
    ok = np.ones(len(t), bool)
    for shift in (0, 32):
        x = (t >> np.uint64(shift)) & np.uint64((1 << power) - 1)
        ok &= (bits[(x >> np.uint64(3)).astype(np.int64)] >> (x & np.uint64(7)).astype(np.uint8)) & 1 == 1
    return ok


def rarity(docs: DataFrame, bits: np.ndarray, power: int, lengths: list[int]) -> DataFrame:
    """(token, df): how often shingles that pass the filter occur in all documents."""

    def run(batches):
        for batch in batches:
            got = []
            for _, _, raw, off in chunks(batch.column(0)):
                buf = LOWER[raw]
                s, e, first = words(buf, off, SEPARATOR)
                h = word_hashes(buf, s, e, SEPARATOR)
                for k in lengths:
                    _, t = _shingles(h, first, k)
                    got.append(t[_passes(t, bits, power)])
            u, n = np.unique(np.concatenate(got) if got else np.zeros(0, np.uint64), return_counts=True)
            yield pa.record_batch([pa.array(u.view(np.int64)), pa.array(n)], names=["token", "n"])

    return docs.select("text").mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("df"))


def prefix_tokens(windows: DataFrame, df: DataFrame) -> DataFrame:
    """(phrase, n, at, token): of each distinct window the rarest shingle in the documents.

    The whole window must occur, so its prefix in the order of rarity is one shingle. Windows with a shingle that
    occurs nowhere can't occur.
    """
    w = windows.select("phrase", "n", "at", "token").distinct().join(df, "token", "left")
    order = W.partitionBy("phrase").orderBy(F.coalesce("df", F.lit(0)), "token", "at")
    return w.withColumn("_r", F.row_number().over(order)).filter("_r = 1 AND df IS NOT NULL").select("phrase", "n", "at", "token")


def candidates(docs: DataFrame, bits: np.ndarray, power: int, lengths: list[int], window: int) -> DataFrame:
    """(doc, row, n_words, tokens array of (token, pos, before, around)): documents' shingles that pass the filter, with the words around."""
    reach = window - 1
    schema = "doc long, row long, n_words long, tokens array<struct<token: long, pos: long, before: int, around: string>>"
    kind = pa.list_(pa.struct([("token", pa.int64()), ("pos", pa.int64()), ("before", pa.int32()), ("around", pa.string())]))

    def run(batches):
        for batch in batches:
            out: list[list] = [[] for _ in range(batch.num_rows)]
            count = np.zeros(batch.num_rows, np.int64)
            for lo, hi, raw, off in chunks(batch.column(2)):
                buf = LOWER[raw]
                s, e, first = words(buf, off, SEPARATOR)
                count[lo:hi] = np.diff(first)
                h = word_hashes(buf, s, e, SEPARATOR)
                for k in lengths:
                    at, t = _shingles(h, first, k)
                    ok = _passes(t, bits, power)
                    at, t = at[ok], t[ok].view(np.int64)
                    d = np.searchsorted(first, at, "right") - 1
                    a, b = np.maximum(at - reach, first[d]), np.minimum(at + k + reach, first[d + 1])
                    for p, tok, i, x, y in zip(at.tolist(), t.tolist(), d.tolist(), a.tolist(), b.tolist(), strict=True):
                        around = b" ".join([buf[u:v].tobytes() for u, v in zip(s[x:y].tolist(), e[x:y].tolist(), strict=True)])
                        out[lo + i].append({"token": tok, "pos": p - int(first[i]), "before": p - x, "around": around.decode()})
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(count), pa.array(out, kind)], names=["doc", "row", "n_words", "tokens"])

    return docs.select(doc_key().alias("doc"), row_key().alias("row"), "text").mapInArrow(run, schema)


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, row, n_words, n_hit, n_items, items, items_sha256, contaminated), one row per row of ``docs``; row is row_key().

    Words are runs of 0-9, a-z and non-ASCII after lower-casing A-Z; null has none. A window is ``window`` consecutive words
    of an item (all of a shorter one; an item without words has none), and a document word inside any occurrence of a window is hit.
    items lists the ids (as strings, sorted) of items with windows that occur; null item ids count as ''. A null doc_id is a
    document like any other; repeated rows get equal answers. Other columns are ignored.

    Item shingles are ordered by their rarity in the documents, and documents are joined on the rarest of each window.
    The place of the shingle in the window and the document's length bound where the window can lie; there its words are
    compared. Document shingles that no item has are left out early by a filter of bounded size; it only saves work.
    Windows point to their set of items; the sets themselves are joined once for each document and set.
    """
    windows = checkpointed(item_windows(items, window))
    bits, power, lengths = token_filter(windows)
    prefix = prefix_tokens(windows, rarity(docs, bits, power, lengths))
    owner = windows.groupBy("phrase").agg(F.array_sort(F.collect_set(F.coalesce("item_id", F.lit("")))).alias("ids"))
    owner = checkpointed(owner.withColumn("owners", F.sha2(F.to_json("ids"), 256)))
    sets = owner.groupBy("owners").agg(F.first("ids").alias("ids"))
    wanted = checkpointed(prefix.join(owner.select("phrase", "owners"), "phrase").select("token", "at", "n", "phrase", "owners"))
    scanned = checkpointed(candidates(docs, bits, power, lengths, window))
    tok = scanned.select("doc", "row", F.explode("tokens").alias("t")).select("doc", "row", "t.*")
    # Few windows are sent to all executors; beyond that the join is shuffled, and hot shingles are split by Spark.
    small = wanted.agg(F.coalesce(F.sum(F.octet_length("phrase") + 128), F.lit(0))).first()[0] <= BROADCAST_BYTES
    left = F.col("before") - F.col("at")
    have = F.split("around", " ")
    hit = tok.join(F.broadcast(wanted) if small else wanted, "token").filter((left >= 0) & (left + F.col("n") <= F.size(have)) & (F.array_join(F.slice(have, left + 1, F.col("n")), " ") == F.col("phrase")))
    span = F.struct((F.col("pos") - F.col("at")).alias("from"), (F.col("pos") - F.col("at") + F.col("n")).alias("to"))
    per = checkpointed(hit.groupBy("doc", "row").agg(F.collect_set(span).alias("spans"), F.collect_set("owners").alias("owners")))
    # Union of the spans: in order of their start, each adds what lies beyond the furthest end so far.
    start = F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n"))
    union = F.aggregate(F.array_sort("spans"), start, lambda a, s: F.struct(F.greatest(a["end"], s["to"]).alias("end"), (a["n"] + F.greatest(F.lit(0), s["to"] - F.greatest(a["end"], s["from"]))).alias("n")), lambda a: a["n"])
    owned = per.select("doc", "row", F.explode("owners").alias("owners")).join(sets, "owners").groupBy("doc", "row").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))).alias("items"))
    per = per.select("doc", "row", union.alias("n_hit")).join(owned, ["doc", "row"])
    j = scanned.select("doc", "row", "n_words").join(per, ["doc", "row"], "left")
    items_of = F.coalesce("items", F.array().cast("array<string>"))
    return j.select(F.when(F.col("doc") != NULL_ID, F.col("doc")).alias("doc_id"), "row", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.size(items_of).cast("long").alias("n_items"), items_of.alias("items"), F.sha2(F.array_join(items_of, ","), 256).alias("items_sha256"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"))


def clean_only(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows that hold no window of any item, each judged for itself (equal rows alike), with all their columns, whatever these are called."""
    bad = contamination(docs, items, window).filter("contaminated").select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("doc"), "row").distinct()
    packed = docs.select(F.struct("*").alias("d"), doc_key().alias("doc"), row_key().alias("row"))
    return packed.join(bad, ["doc", "row"], "left_anti").select("d.*")
