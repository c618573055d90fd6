"""SimHash near-duplicates, joined by fuzzy keys from the binary Golay code.

A 64-bit fingerprint is cut into three segments of 22, 21 and 21 bits. Fingerprints that differ by at most two bits
have an error-free segment (pigeonhole), and the segment after it, in a cycle, has two errors at most. The second
segment, read as a 23-bit word, is decoded to the indices of all Golay codewords within distance 4; two words at
distance 2 or less always share one of those. A key is (which segment is exact, its bits, a codeword index), at most
18 keys a fingerprint. Equal keys are brought together, and each candidate is verified on the full fingerprints.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from folioframe.llm.arrowtext import LOWER, chunks, words
from folioframe.llm.common import checkpointed, components, doc_key, kept_rows, row_key, spread_join

SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Generator polynomial of the (23, 12, 7) Golay code: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GENERATOR = 0b101011100011


def _syndrome(word: np.ndarray) -> np.ndarray:
    """Remainder of 23-bit words after division by the generator."""
    r = np.asarray(word, np.int64).copy()
    for bit in range(22, 10, -1):
        r = np.where((r >> bit) & 1, r ^ (GENERATOR << (bit - 11)), r)
    return r


def golay_codewords() -> np.ndarray:
    """(4096, 23): the bits of the codewords, in the order of their index, the upper twelve bits."""
    upper = np.arange(4096) << 11
    return ((upper | _syndrome(upper))[:, None] >> np.arange(23)) & 1


@lru_cache(1)
def near_offsets() -> np.ndarray:
    """For each syndrome, the error patterns of weight <= 4 with that syndrome, padded with -1: word ^ pattern is a codeword."""
    from itertools import combinations

    pats = [sum(1 << b for b in c) for w in range(5) for c in combinations(range(23), w)]
    syn = _syndrome(np.array(pats))
    per: list[list[int]] = [[] for _ in range(2048)]
    for s, p in zip(syn.tolist(), pats, strict=True):
        per[s].append(p)
    width = max(map(len, per))
    return np.array([x + [-1] * (width - len(x)) for x in per], np.int64)


def golay_keys(word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, codeword index) of all codewords within distance 4 of each 23-bit word; the index is the 12 message bits."""
    pats = near_offsets()[_syndrome(word)]
    row, col = np.nonzero(pats >= 0)
    return row, (word[row] ^ pats[row, col]) >> 11


def fuzzy_keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key): two fingerprints at most two bits apart share a key."""
    rows, keys = [], []
    for i, (shift, size) in enumerate(SEGMENTS):
        s2, n2 = SEGMENTS[(i + 1) % 3]
        exact = (fp >> np.uint64(shift)).astype(np.int64) & ((1 << size) - 1)
        fuzzy = (fp >> np.uint64(s2)).astype(np.int64) & ((1 << n2) - 1)
        row, index = golay_keys(fuzzy)
        rows.append(row)
        keys.append((np.int64(i) << 34) | (exact[row] << 12) | index)
    return np.concatenate(rows), np.concatenate(keys)


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, row, fp long): lower-cased A-Z, words between ASCII white space, shingles with repeats, XXH64 with seed 42."""

    def run(batches):
        for batch in batches:
            out = np.zeros(batch.num_rows, np.uint64)
            for lo, hi, raw, off in chunks(batch.column(2)):
                buf = LOWER[raw]
                s, e, first = words(buf, off)
                if not len(s):
                    continue
                # Words joined by one space: copy each word to its place in a clean buffer.
                size = e - s
                put = np.zeros(len(s), np.int64)
                np.cumsum((size + 1)[:-1], out=put[1:])
                clean = np.full(int(put[-1] + size[-1]), 32, np.uint8)
                inner = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
                clean[np.repeat(put, size) + inner] = buf[np.repeat(s, size) + inner]
                data, end = clean.tobytes(), put + size
                n = np.diff(first)
                # The shingles of a document: n - shingle + 1, or one of all its words.
                k = np.where(n >= shingle, n - shingle + 1, np.minimum(n, 1))
                total = int(k.sum())
                doc = np.repeat(np.arange(hi - lo), k)
                at = first[:-1][doc] + np.arange(total) - np.repeat(np.cumsum(k) - k, k)
                till = np.minimum(at + shingle, first[1:][doc]) - 1
                digest = xxhash.xxh64_intdigest
                h = np.fromiter((digest(data[a:b], 42) for a, b in zip(put[at].tolist(), end[till].tolist(), strict=True)), np.uint64, total)
                heads = np.flatnonzero(np.diff(doc, prepend=-1))
                fp = np.zeros(len(heads), np.uint64)
                half = k[doc[heads]]
                for bit in range(64):
                    ones = np.add.reduceat(((h >> np.uint64(bit)) & np.uint64(1)).astype(np.uint8), heads, dtype=np.int64)
                    fp |= (2 * ones > half).astype(np.uint64) << np.uint64(bit)
                out[lo + doc[heads]] = fp
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(out.view(np.int64))], names=["doc_id", "row", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("row"), "text").mapInArrow(run, "doc_id long, row long, fp long")


def links_of(fp: np.ndarray, key: np.ndarray, most: int = 128) -> np.ndarray:
    """Verified links (a, b) among fingerprints that share a key, enough to connect whatever is two bits apart.

    Keys of up to ``most`` fingerprints: each with each later one. Larger ones aren't paired: a fingerprint and its 64
    one-bit neighbours are spelled out, and what meets in one of these is at most two bits apart; each is linked to
    the smallest there. So a key costs time in proportion to its fingerprints.
    """
    order = np.lexsort((fp, key))
    fp, key = fp[order], key[order]
    starts = np.flatnonzero(np.diff(key, prepend=key[0] - 1)) if len(key) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(starts, len(key)))
    out = []
    big = sizes > most
    small = np.repeat(~big, sizes)
    f, k = fp[small], key[small]
    for d in range(1, int(sizes[~big].max(initial=1))):
        same = k[d:] == k[:-d]
        if not same.any():
            break
        a, b = f[:-d][same], f[d:][same]
        near = (np.bitwise_count(a ^ b) <= 2) & (a != b)
        out.append(np.stack([a[near], b[near]], 1))
    flips = np.concatenate([[0], np.uint64(1) << np.arange(64, dtype=np.uint64)]).astype(np.uint64)
    for s, n in zip(starts[big].tolist(), sizes[big].tolist(), strict=True):
        u = np.unique(fp[s : s + n])
        mid = (u[:, None] ^ flips[None, :]).ravel()
        who = np.repeat(u, 65)
        o = np.lexsort((who, mid))
        mid, who = mid[o], who[o]
        head = np.maximum.accumulate(np.where(np.diff(mid, prepend=~mid[:1]) != 0, np.arange(len(mid)), 0))
        far = who != who[head]
        out.append(np.unique(np.stack([who[head][far], who[far]], 1), axis=0))
    return np.unique(np.concatenate(out), axis=0) if out else np.zeros((0, 2), np.uint64)


def near_links(distinct_fp: DataFrame, total: int, rows_a_shard: int = 4096) -> DataFrame:
    """(a, b): links at two bits or less among distinct fingerprints; a shard holds about ``rows_a_shard`` * 16 keys."""
    shards = max(64, -(-total // rows_a_shard))

    def spell(batches):
        for batch in batches:
            fp = np.ascontiguousarray(batch.column(0).to_numpy(zero_copy_only=False)).view(np.uint64)
            row, key = fuzzy_keys(fp)
            spread = (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)
            yield pa.record_batch([pa.array((spread % np.uint64(shards)).astype(np.int32)), pa.array(key), pa.array(fp[row].view(np.int64))], names=["shard", "key", "fp"])

    def link(t: pa.Table) -> pa.Table:
        pairs = links_of(t.column("fp").to_numpy().view(np.uint64), t.column("key").to_numpy()).view(np.int64)
        return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})

    keys = distinct_fp.select("fp").mapInArrow(spell, "shard int, key long, fp long")
    return keys.groupBy("shard").applyInArrow(link, "a long, b long")


def _labelled(docs: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, row, fp, label): label is the smallest fingerprint that is linked, directly or through others."""
    fps = checkpointed(fingerprints(docs, shingle))
    distinct = checkpointed(fps.groupBy("fp").agg(F.count(F.lit(1)).alias("n")))
    label = components(near_links(distinct, distinct.count()))
    at = checkpointed(distinct.join(label, distinct["fp"] == label["node"], "left").select("fp", "n", F.coalesce("label", "fp").alias("label")))
    return checkpointed(spread_join(fps, at, "fp", "n", fps.count()))


def simhash_groups(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """Near-duplicate groups: (doc_id, fingerprint, component_id, component), one row per row of ``docs``.

    Fingerprints that differ in two bits or less are linked; component_id is the smallest doc_id reachable that isn't null, and null if there
    is none; component is the smallest fingerprint reachable, which tells components apart in any case. A text without words (null, empty,
    blank) has fingerprint zero and is linked like any other. Copies and repeated rows share a fingerprint and are counted once, by a
    partial aggregation. Other columns are ignored.
    """
    at = _labelled(docs, shingle)
    root = at.groupBy("label").agg(F.min("doc_id").alias("component_id"), F.count(F.lit(1)).alias("n"))
    shown = lambda c: F.lower(F.lpad(F.hex(c), 16, "0"))
    return spread_join(at, root, "label", "n", at.count()).select("doc_id", shown("fp").alias("fingerprint"), "component_id", shown("label").alias("component"))


def keep_one(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """The documents, less all but one row of each near-duplicate group: one of the smallest doc_id (null comes last).

    Rows are judged each for itself, so rows that share an id may part; of equal rows one stays. All columns are kept, whatever their names.
    """
    at = _labelled(docs, shingle).select(doc_key().alias("doc"), "row", "doc_id", "label")
    best = at.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc", "row")).alias("best"))
    return kept_rows(docs, at.select("doc", "row"), best.select("best.doc", "best.row"))
