"""Near copies at a similarity: the pipeline's form of operator 2, with a longer fingerprint and exact verification.

Operator 2 links 64-bit fingerprints at two bits; near copies of similarity 0.8 are 15 % of the bits apart. Here a set of word
shingles has a SimHash of 299 bits, thirteen segments of 23. A segment is decoded softly: the two Golay codewords that agree best with
the signed bit sums are its indices, so unsure bits count little. Two segments in a cycle make a key, four keys a pair of segments: by
the pigeonhole principle some of the thirteen pairs have few errors. Measured at similarities from 0.8 on: a segment shares an index with
probability 0.6, a copy a key with 0.99. What shares a key is compared on 192 bits, then on the shingle sets themselves.
Documents with equal sets are one class.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window as W, functions as F

from folioframe.llm.arrowtext import LOWER, chunks, gram_hashes, mix, word_hashes, words
from folioframe.llm.common import checkpointed, components, doc_key, kept_rows, row_key, spread_join
from folioframe.llm.decontaminate import _passes, token_filter
from folioframe.llm.simhash import golay_codewords

SHINGLE = 5
SEGMENT, SEGMENTS, DECODED = 23, 13, 2
#: The least similarity, as a fraction: 4 / 5.
SIMILAR = (4, 5)
#: 64-bit words of the fingerprint: all that segments need, and those that candidates are compared on.
WORDS, COMPARED = 5, 3
#: Most compared bits in which alike sets differ: 15.2 % are expected at the least similarity, and three deviations more are let pass.
FAR = 44
#: Fingerprints of a key that are all compared in one task; a key of more is linked to its smallest and compared by shingles.
CROWD = 2048
#: Links of a fingerprint that are verified at first for each key: its nearest earlier ones. What these don't connect is compared by shingles.
NEAREST = 1


def _sets(column, shingle: int):
    """(first row, rows, sorted distinct shingle hashes, bounds) of each chunk; a shorter text is one shingle of all its words."""
    for lo, hi, raw, off in chunks(column):
        buf = LOWER[raw]
        s, e, first = words(buf, off)
        h = word_hashes(buf, s, e)
        n = np.diff(first)
        k = np.where(n >= shingle, n - shingle + 1, np.minimum(n, 1))
        doc = np.repeat(np.arange(hi - lo), k)
        at = first[:-1][doc] + np.arange(len(doc)) - np.repeat(np.cumsum(k) - k, k)
        grams = np.zeros(len(doc), np.uint64)
        for size in range(1, shingle + 1):
            own = np.minimum(n, shingle)[doc] == size
            if own.any():
                grams[own] = mix(gram_hashes(h, size)[at[own]] + np.uint64(size))
        order = np.argsort(grams)
        order = order[np.argsort(doc[order].astype(np.uint16) if hi - lo < 1 << 16 else doc[order], kind="stable")]
        doc, grams = doc[order], grams[order]
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (grams[1:] != grams[:-1])
        doc, grams = doc[new], grams[new]
        yield lo, hi - lo, grams, np.searchsorted(doc, np.arange(hi - lo + 1))


def _classes(grams: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """One hash a set; that of the empty set is 0."""
    data, at = grams.tobytes(), (bounds * 8).tolist()
    return np.fromiter((xxhash.xxh64_intdigest(data[a:b], 42) if b > a else 0 for a, b in zip(at[:-1], at[1:], strict=True)), np.uint64, len(at) - 1)


@lru_cache(1)
def _counters() -> np.ndarray:
    """For each byte value its bits, the highest first, as eight counters of a byte."""
    return (np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1)).reshape(-1, 8).copy().view(np.uint64).ravel()


def bit_sums(grams: np.ndarray, heads: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each non-empty set and each bit: how many shingles have it set, less those that don't.

    Eight bits are counted at a time, in counters of a byte, over runs of 255 shingles at most.
    """
    runs = -(-sizes // 255)
    owner = np.cumsum(runs) - runs
    at = np.repeat(heads, runs) + 255 * (np.arange(int(runs.sum())) - np.repeat(owner, runs))
    out = np.zeros((len(heads), 64 * WORDS), np.int64)
    for w in range(WORDS):
        h = mix(grams + np.uint64(0x9E3779B97F4A7C15 * (w + 1) & 0xFFFFFFFFFFFFFFFF)).view(np.uint8).reshape(-1, 8)
        for k in range(8):
            some = np.add.reduceat(_counters()[h[:, k]], at).view(np.uint8).reshape(-1, 8).astype(np.int64)
            out[:, 64 * w + 8 * k : 64 * w + 8 * k + 8] = np.add.reduceat(some, owner, axis=0)
    return 2 * out - sizes[:, None]


@lru_cache(1)
def _signs() -> np.ndarray:
    """The signs of half of the codewords (the all-ones word is a codeword, so the others are their complements)."""
    return (2.0 * golay_codewords()[:2048] - 1).astype(np.float32).T.copy()


def soft_indices(sums: np.ndarray) -> np.ndarray:
    """(rows, DECODED): the codewords that agree best with a segment's bit sums; complements are numbered from 2048 on."""
    c = sums.astype(np.float32) @ _signs()
    size, at = np.abs(c), np.arange(len(c))
    out = np.zeros((len(c), DECODED), np.int64)
    for i in range(DECODED):
        best = size.argmax(1)
        out[:, i] = best + 2048 * (c[at, best] < 0)
        size[at, best] = -1
    return out


def keys_of(sums: np.ndarray) -> np.ndarray:
    """(rows, keys): the keys of bit sums, a pair of neighbouring segments' indices each."""
    own = [soft_indices(sums[:, s * SEGMENT : (s + 1) * SEGMENT]) for s in range(SEGMENTS)]
    return np.concatenate([(s << 24) | (own[s][:, [i]] << 12) | own[(s + 1) % SEGMENTS][:, [j]] for s in range(SEGMENTS) for i in range(DECODED) for j in range(DECODED)], 1)


KEYS = SEGMENTS * DECODED**2


def sketches(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, row, class, size, fp, keys): of each row its shingle set's hash and size, fingerprint and keys (none without words)."""

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            cls, size = np.zeros(n, np.uint64), np.zeros(n, np.int32)
            fp, keys = np.zeros((n, 8 * COMPARED), np.uint8), np.zeros((n, KEYS), np.int32)
            for lo, m, grams, bounds in _sets(batch.column(2), shingle):
                cls[lo : lo + m], size[lo : lo + m] = _classes(grams, bounds), np.diff(bounds)
                some = np.flatnonzero(np.diff(bounds))
                if len(some):
                    sums = bit_sums(grams, bounds[:-1][some], np.diff(bounds)[some])
                    fp[lo + some] = np.packbits(sums[:, : 64 * COMPARED] > 0, axis=1)
                    keys[lo + some] = keys_of(sums)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * KEYS), pa.array(keys.ravel()))
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(cls.view(np.int64)), pa.array(size), pa.array([x.tobytes() for x in fp], pa.binary()), lists], names=["doc_id", "row", "class", "size", "fp", "keys"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("row"), "text").mapInArrow(run, "doc_id long, row long, class long, size int, fp binary, keys array<int>")


def sets_of(docs: DataFrame, wanted: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(class, grams): the sets of the wanted classes (class, row: a row that has it), and of few others that a bit map of the rows lets pass."""
    bits, power, _ = token_filter(wanted.select(F.col("row").alias("token"), F.lit(1).alias("n")))

    def run(batches):
        for batch in batches:
            some = batch.column(1).filter(pa.array(_passes(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64), bits, power)))
            cls, out = [], []
            for _, _, grams, bounds in _sets(some, shingle):
                c = _classes(grams, bounds)
                cls += c.view(np.int64).tolist()
                out += [grams[a:b].view(np.int64) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            yield pa.record_batch([pa.array(cls, pa.int64()), pa.array(out, pa.list_(pa.int64()))], names=["class", "grams"])

    return docs.select(row_key().alias("row"), "text").mapInArrow(run, "class long, grams array<long>").groupBy("class").agg(F.first("grams").alias("grams"))


def _could(a, b):
    """Sizes that allow the least similarity."""
    return SIMILAR[1] * np.minimum(a, b).astype(np.int64) >= SIMILAR[0] * np.maximum(a, b).astype(np.int64)


def near_in_key(fp: np.ndarray, size: np.ndarray, nearest: int = NEAREST) -> tuple[np.ndarray, np.ndarray, bool]:
    """(a, b, complete): pairs a < b of rows that may be alike, for each row the nearest earlier ones; whether these are all; a block of rows at a time."""
    n, out, complete = len(fp), [], True
    for lo in range(0, n, 256):
        hi = min(lo + 256, n)
        gap = sum(np.bitwise_count(fp[lo:hi, None, w] ^ fp[None, :, w]).astype(np.int32) for w in range(fp.shape[1]))
        gap[~_could(size[lo:hi, None], size[None, :])] = 999
        me = np.arange(lo, hi)
        gap[np.arange(n)[None, :] >= me[:, None]] = 999
        few = min(nearest, n - 1)
        at = np.argpartition(gap, few - 1, axis=1)[:, :few] if few else np.zeros((hi - lo, 0), np.int64)
        a, b = at.ravel(), np.repeat(me, few)
        ok = gap[b - lo, a] <= FAR
        out.append(np.stack([a[ok], b[ok]], 1))
        complete &= bool(((gap <= FAR).sum(1) <= nearest).all())
    pairs = np.unique(np.concatenate(out), axis=0) if out else np.zeros((0, 2), np.int64)
    return pairs[:, 0], pairs[:, 1], complete


def meetings(reps: DataFrame, total: int, nearest: int = NEAREST, crowd: int = CROWD, rows_a_shard: int = 4096) -> DataFrame:
    """(a, b, key): pairs a < b of classes that share a key and may be alike, and (class, class, key) of the keys that have more such pairs.

    A key of up to about ``crowd`` classes is compared in one task. Larger ones link each class to the smallest by an aggregation; they are
    found on a sample by the class's hash, which only decides where a key is compared.
    """
    shards = max(64, -(-total // rows_a_shard))
    share = max(1, crowd // 32)
    spelled = reps.filter("size > 0").select("class", "size", "fp", F.explode("keys").alias("key"))
    some = reps.filter((F.col("size") > 0) & (F.pmod(F.xxhash64("class"), F.lit(share)) == 0)).select(F.explode("keys").alias("_k"))
    crowded = checkpointed(some.groupBy("_k").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") * share > crowd).select("_k"))

    def meet(t: pa.Table) -> pa.Table:
        key, cls, size = (t.column(c).to_numpy() for c in ("key", "class", "size"))
        fp = np.frombuffer(b"".join(t.column("fp").to_pylist()), np.uint64).reshape(-1, COMPARED)
        order = np.lexsort((cls, key))
        key, cls, size, fp = key[order], cls[order], size[order], fp[order]
        starts = np.flatnonzero(np.diff(key, prepend=key[0] - 1)) if len(key) else np.zeros(0, np.int64)
        sizes = np.diff(np.append(starts, len(key)))
        out = []
        small = np.repeat(sizes <= 16, sizes)
        k, c, n, f = key[small], cls[small], size[small], fp[small]
        for d in range(1, int(sizes[sizes <= 16].max(initial=1))):
            at = np.flatnonzero((k[d:] == k[:-d]) & _could(n[d:], n[:-d]))
            at = at[np.bitwise_count(f[at] ^ f[at + d]).sum(1) <= FAR]
            out.append((c[at], c[at + d], np.zeros(len(at), np.int64)))
        for s, m in zip(starts[sizes > 16].tolist(), sizes[sizes > 16].tolist(), strict=True):
            a, b, complete = near_in_key(fp[s : s + m], size[s : s + m], nearest)
            own = cls[s : s + m]
            out.append((own[a], own[b], np.zeros(len(a), np.int64)))
            if not complete:
                out.append((own, own, np.full(m, key[s])))
        pairs = np.unique(np.stack([np.concatenate(x) for x in zip(*out, strict=True)], 1), axis=0) if out else np.zeros((0, 3), np.int64)
        return pa.table({"a": pairs[:, 0], "b": pairs[:, 1], "key": pairs[:, 2]})

    quiet, star = spelled, None
    if not crowded.isEmpty():
        quiet = spelled.join(crowded, F.col("key") == F.col("_k"), "left_anti")
        among = spelled.select("key", "class").join(crowded, F.col("key") == F.col("_k"), "left_semi")
        least = among.groupBy("key").agg(F.min("class").alias("a"))
        star = least.join(among, "key").filter("class <> a").select("a", F.col("class").alias("b"), F.lit(0).cast("long").alias("key"))
        star = star.unionByName(among.select(F.col("class").alias("a"), F.col("class").alias("b"), F.col("key").cast("long").alias("key")))
    met = quiet.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int")).select("shard", "key", "class", "size", "fp")
    met = met.groupBy("shard").applyInArrow(meet, "a long, b long, key long")
    return met if star is None else met.unionByName(star)


def verified(docs: DataFrame, pairs: DataFrame, rows: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """The pairs (a, b) of classes whose sets are alike; ``rows`` has a row of each class."""
    pairs = checkpointed(pairs.select("a", "b").distinct())
    total = pairs.count()
    wanted = checkpointed(rows.join(pairs.select(F.explode(F.array("a", "b")).alias("class")).distinct(), "class", "left_semi"))
    sets = checkpointed(sets_of(docs, wanted, shingle))
    # The smallest class of a large key is in very many pairs.
    often = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
    left = spread_join(pairs, often.join(sets, often["a"] == sets["class"]).select("a", "n", F.col("grams").alias("ga")), "a", "n", total, 200)
    both = left.join(sets.select(F.col("class").alias("b"), F.col("grams").alias("gb")), "b")
    inter = F.size(F.array_intersect("ga", "gb"))
    return checkpointed(both.filter(inter * (SIMILAR[0] + SIMILAR[1]) >= SIMILAR[0] * (F.size("ga") + F.size("gb"))).select("a", "b"))


def alike_by_prefix(docs: DataFrame, classes: DataFrame, shingle: int, part_rows: int = 32) -> DataFrame:
    """(a, b): all pairs of classes (class, row, label, size) of unlike labels that can be alike.

    All sets are in one order, rarest shingles first. Of two alike sets, the first shingle that both hold has a rank in each;
    what ranks before it is not shared, so 9 * (size - rank + 1) is at least 4 * (sum of both sizes) on either side. That leaves the
    first ninth (and one) of the smaller set and the first fifth (and one) of the larger, and ties both ranks to both sizes.
    A set whose own shingles fill its first ninth meets nobody from the smaller side. Smaller sides are dealt, by shingle, size band
    and label, to parts of about ``part_rows``; larger sides go to the parts of the band and of the one below that have another label.
    """
    near, far = SIMILAR
    classes = checkpointed(classes)
    tok = checkpointed(classes.join(sets_of(docs, classes, shingle), "class").select("class", "label", "size", F.explode("grams").alias("gram")))
    often = tok.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").withColumn("times", F.col("n"))
    order = W.partitionBy("class").orderBy(F.coalesce("times", F.lit(1)), "gram")
    first = spread_join(tok, often, "gram", "n", tok.count()).withColumn("rest", F.col("size") - F.row_number().over(order) + 1)
    # The least and the most size of a partner that what is left of the set allows.
    own = first.filter((F.col("times") > 1) & (far * F.col("rest") >= near * F.col("size"))).select("gram", "class", "label", "size", "rest")
    band = F.floor(F.log(F.col("size").cast("double")) / F.log(F.lit(far / near)) + 1e-9).cast("int")
    own = checkpointed(own.withColumns({"band": band, "small": (near + far) * F.col("rest") >= 2 * near * F.col("size")}))
    # Shingles whose classes are one component already are done.
    marks = own.groupBy("gram").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count_if("small").alias("least"), F.count(F.lit(1)).alias("n")).filter("lo <> hi AND least > 0")
    own = checkpointed(spread_join(own, marks.select("gram", "n", F.lit(True).alias("open")), "gram", "n", own.count()).filter("open").drop("open"))
    small = own.filter("small")
    held = small.groupBy("gram", "band", "label").agg(F.ceil(F.count(F.lit(1)) / part_rows).cast("int").alias("parts"))
    to = own.select("gram", F.col("class").alias("b"), F.col("label").alias("lb"), F.col("size").alias("sb"), F.col("rest").alias("rb"), F.explode(F.array("band", F.col("band") - 1)).alias("band"))
    to = to.join(held, ["gram", "band"]).filter("label <> lb").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    x = small.join(held, ["gram", "band", "label"]).withColumn("part", F.pmod(F.xxhash64("class"), F.col("parts")).cast("int")).select("gram", "band", "label", "part", F.col("class").alias("a"), F.col("size").alias("sa"), F.col("rest").alias("ra"))
    first = (F.col("sa") < F.col("sb")) | ((F.col("sa") == F.col("sb")) & (F.col("a") < F.col("b")))
    fits = (far * F.col("sa") >= near * F.col("sb")) & ((near + far) * F.least("ra", "rb") >= near * (F.col("sa") + F.col("sb")))
    met = x.join(to, ["gram", "band", "label", "part"]).filter(first & fits)
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def near_copy_labels(docs: DataFrame, shingle: int = SHINGLE, nearest: int = NEAREST, crowd: int = CROWD) -> tuple[DataFrame, DataFrame]:
    """(rows with doc_id, row and class; classes with n, the number of their rows, and label, the smallest class that is linked)."""
    own = checkpointed(sketches(docs, shingle))
    reps = checkpointed(own.groupBy("class").agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("row"), F.first("size").alias("size"), F.first("fp").alias("fp"), F.first("keys").alias("keys")))
    met = checkpointed(meetings(reps, reps.count(), nearest, crowd))
    rows = reps.select("class", "row")
    links = verified(docs, met.filter("a <> b"), rows, shingle)
    large = met.filter("a = b").select("key", F.col("a").alias("class"))
    label = components(links)
    if not large.isEmpty():
        at = large.join(label, large["class"] == label["node"], "left").select("key", "class", F.coalesce("label", "class").alias("label"))
        at = checkpointed(at.join(reps.select("class", "row", "size"), "class"))
        # Keys whose classes are one component already are done.
        apart = lambda df, c: df.join(df.groupBy(c).agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi").select(c), c, "left_semi")
        more = alike_by_prefix(docs, apart(at, "key").select("class", "row", "label", "size").distinct(), shingle)
        label = components(links.unionByName(verified(docs, more, rows, shingle)))
    at = reps.join(label, reps["class"] == label["node"], "left").select("class", "n", F.coalesce("label", "class").alias("label"))
    return own.select("doc_id", "row", "class"), checkpointed(at)


def near_copy_groups(docs: DataFrame, shingle: int = SHINGLE, nearest: int = NEAREST, crowd: int = CROWD) -> DataFrame:
    """(doc_id, row, class, label, component_id), one row per row of ``docs``: documents whose shingle sets are alike are linked.

    component_id is the smallest doc_id reachable that isn't null (null if there is none), label tells components apart in any case.
    Texts without words are alike. Of a key with more near pairs than are verified at once, what is not connected yet is compared
    again by its rarest shingles, so nothing is left out. Other columns are ignored.
    """
    own, at = near_copy_labels(docs, shingle, nearest, crowd)
    labelled = checkpointed(spread_join(own, at, "class", "n", own.count()))
    root = labelled.groupBy("label").agg(F.min("doc_id").alias("component_id"), F.count(F.lit(1)).alias("n"))
    return spread_join(labelled, root, "label", "n", labelled.count())


def keep_one(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """The documents, less all but one row of each group of near copies: one of the smallest doc_id (null comes last).

    Rows are judged each for itself, so rows that share an id may part; of equal rows one stays. All columns are kept, whatever their names.
    """
    own, at = near_copy_labels(docs, shingle)
    labelled = spread_join(own, at, "class", "n", own.count()).select(doc_key().alias("doc"), "row", "doc_id", "label")
    best = labelled.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc", "row")).alias("best"))
    return kept_rows(docs, own.select(doc_key().alias("doc"), "row"), best.select("best.doc", "best.row"))
