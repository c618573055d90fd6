"""Finding windows of consecutive units (words or bytes) that occur more than once, without shipping every window.

Each window chooses an anchor, the k-gram of smallest hash inside it, so equal windows have equal anchors and about one
position in half a window is an anchor. Three exchanges narrow the work down, none of them by a limit:

1. The hash of every anchor goes to a bucket of its hash with the home of its document; hashes seen twice or more come back.
2. At home (documents are dealt by id and text) the runs of windows with such an anchor become passages. Each is sent once
   from a home to the bucket of its anchor.
3. There all passages with an anchor meet, and the caller decides which windows recur; spans of the first copy go back home.

No anchor may crowd a bucket, at any size. Anchors that occur more than CROWD times, counted exactly in the first exchange,
send their windows one by one, by the window's own hash; equal windows come from a home once, so a bucket gets one from each home
at most. Beyond CROWD homes that may be too many: then anchors that make up a share of 1/MOST of a sample (MOST grows with the buckets,
to a million, and the sample with MOST) are left out of the exchanges, and their windows are counted by an aggregation of equal
windows, which Spark combines before it shuffles. Both only decide where windows are compared.
Numbers of homes and buckets follow the bytes of text, so a group stays at a few megabytes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from folioframe.llm.arrowtext import BYTE, anchors, chunks, gram_hashes, mix, word_hashes, words
from folioframe.llm.common import doc_key, row_key, spread_join

ROUTED = "slot int, kind int, data binary"
#: An anchor's hash, a home that holds it, and how often.
HASH_HOME = np.dtype([("h", "<u8"), ("home", "<i4"), ("n", "<i4")])
#: A passage: routing key, home, document, row, first window, windows, copies seen at home, bytes, a mark for the caller.
PASSAGE = np.dtype([("key", "<u8"), ("home", "<i4"), ("doc", "<i8"), ("row", "<i8"), ("at", "<i8"), ("windows", "<i4"), ("copies", "<i4"), ("size", "<i4"), ("mark", "u1")])
#: Units of a row that are covered by recurring windows.
VERDICT = np.dtype([("row", "<i8"), ("doc", "<i8"), ("from", "<i8"), ("to", "<i8")])
#: Occurrences of an anchor beyond which its windows are sent one by one, and homes beyond which even equal windows are combined before.
CROWD = 4096
#: Least and most anchors that are looked for in the sample, and sampled bytes for each.
MOST, SAMPLE = (10_000, 1_000_000), 5000


def _spread(h: np.ndarray, n: int) -> np.ndarray:
    return ((h >> np.uint64(20)) % np.uint64(n)).astype(np.int32)


def routed(slots: np.ndarray, kind: int, records: np.ndarray, blobs: list[bytes] | None = None) -> Iterator[tuple[int, int, bytes]]:
    """One (slot, kind, bytes) for each slot; with blobs, those of the records follow their header."""
    if not len(slots):
        return
    order = np.argsort(slots, kind="stable")
    edge = np.flatnonzero(np.diff(slots[order], prepend=-1))
    for a, b in zip(edge.tolist(), [*edge[1:].tolist(), len(order)], strict=True):
        part = order[a:b]
        data = records[part].tobytes()
        if blobs is not None:
            data = len(part).to_bytes(4, "little") + data + b"".join([blobs[i] for i in part.tolist()])
        yield int(slots[part[0]]), kind, data


def batch_of(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    slot, kind, data = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.record_batch([pa.array(slot, pa.int32()), pa.array(kind, pa.int32()), pa.array(data, pa.binary())], names=["slot", "kind", "data"])


def table_of(rows: list[tuple[int, int, bytes]]) -> pa.Table:
    return pa.Table.from_batches([batch_of(rows)])


def unpack(data: bytes) -> tuple[np.ndarray, list[bytes]]:
    n = int.from_bytes(data[:4], "little")
    head = np.frombuffer(data, PASSAGE, n, 4)
    at = 4 + n * PASSAGE.itemsize
    out = []
    for size in head["size"].tolist():
        out.append(data[at : at + size])
        at += size
    return head, out


class Units:
    """How text becomes units: ``window`` units recur or not, anchors are runs of ``k``."""

    def __init__(self, kind: str, window: int, k: int):
        self.kind, self.window, self.k = kind, window, k

    def read(self, column: pa.Array) -> Iterator[tuple]:
        """(first row, bytes, byte offsets, unit starts or None, unit ends, unit offsets, gram hashes, anchors) of chunks."""
        for lo, _, buf, off in chunks(column):
            if self.kind == "byte":
                starts = ends = None
                units, uoff = BYTE[buf], off
            else:
                starts, ends, uoff = words(buf, off)
                units = word_hashes(buf, starts, ends)
            gram = gram_hashes(units, self.k)
            yield lo, buf, off, starts, ends, uoff, units, gram, anchors(gram, uoff, self.window, self.k)


def text_bytes(docs: DataFrame) -> int:
    return docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]


def homes(docs: DataFrame, n: int, short: int) -> DataFrame:
    """(slot, doc, row, text): documents dealt to homes by id and text, so equal rows meet, but for texts of less than ``short`` bytes.

    These can't hold a window, get no verdict, and are dealt evenly, however many of them are equal.
    """
    row = row_key()
    tiny = F.coalesce(F.octet_length("text"), F.lit(0)) < short
    slot = F.pmod(F.when(tiny, F.xxhash64(F.monotonically_increasing_id())).otherwise(row), F.lit(n)).cast("int")
    return docs.select(slot.alias("slot"), doc_key().alias("doc"), row.alias("row"), "text")


def frequent_anchors(docs: DataFrame, units: Units, size: int, buckets: int) -> np.ndarray:
    """Hashes of at least 1/most of all anchors of a hash sample of documents; ``most`` follows the number of buckets. None up to CROWD buckets."""
    if buckets <= CROWD:
        return np.zeros(0, np.uint64)
    most = min(max(MOST[0], buckets), MOST[1])
    share = max(1, size // (most * SAMPLE))
    some = docs.filter(F.pmod(row_key(), F.lit(share)) == 0).select("text")

    def count(batches):
        for batch in batches:
            h = [g[p] for _, _, _, _, _, _, _, g, (_, _, _, p) in units.read(batch.column(0))]
            u, n = np.unique(np.concatenate(h) if h else np.zeros(0, np.uint64), return_counts=True)
            yield pa.record_batch([pa.array(u.view(np.int64)), pa.array(n)], names=["h", "n"])

    per = some.mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    total = per.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    rows = per.filter((F.col("n") >= 64) & (F.col("n") * most >= total)).select("h").collect()  # most rows at the most
    return np.sort(np.array([r.h for r in rows], np.int64).view(np.uint64))


def among(values: np.ndarray, sorted_set: np.ndarray) -> np.ndarray:
    if not len(sorted_set):
        return np.zeros(len(values), bool)
    return sorted_set[np.minimum(np.searchsorted(sorted_set, values), len(sorted_set) - 1)] == values


def repeated_anchors(home: DataFrame, units: Units, buckets: int, often: np.ndarray, crowd: int | None = None) -> DataFrame:
    """(slot home, kind, data): for each home the hashes of anchors that occur at least twice in the corpus, those of more than ``crowd``
    occurrences as kind 1; the anchors of ``often`` aren't looked at."""
    crowd = CROWD if crowd is None else crowd

    def scan(batches):
        held, n = [], 0

        def flush():
            r = np.concatenate(held)
            return batch_of(list(routed(_spread(r["h"], buckets), 0, r)))

        for batch in batches:
            at = batch.column(0).to_numpy(zero_copy_only=False)
            for lo, _, _, _, _, _, _, gram, (d, _, _, p) in units.read(batch.column(1)):
                r = np.zeros(len(p), HASH_HOME)
                r["h"], r["home"], r["n"] = gram[p], at[lo + d], 1
                held.append(thin(r[~among(r["h"], often)]))
                n += len(held[-1])
            if n > 2_000_000:
                yield flush()
                held, n = [], 0
        if held:
            yield flush()

    def thin(r: np.ndarray) -> np.ndarray:
        """One entry for each (hash, home)."""
        r = r[np.lexsort((r["home"], r["h"]))]
        head = np.flatnonzero((np.diff(r["h"], prepend=~r["h"][:1]) != 0) | (np.diff(r["home"], prepend=-1) != 0))
        out = r[head]
        out["n"] = np.add.reduceat(r["n"], head) if len(head) else 0
        return out

    def match(t: pa.Table) -> pa.Table:
        r = np.frombuffer(b"".join(t.column("data").to_pylist()), HASH_HOME)
        r = r[np.lexsort((r["home"], r["h"]))]
        head = np.flatnonzero(np.diff(r["h"], prepend=~r["h"][:1]) != 0)
        n = np.add.reduceat(r["n"].astype(np.int64), head) if len(head) else np.zeros(0, np.int64)
        n = np.repeat(n, np.diff(np.append(head, len(r))))
        new = np.ones(len(r), bool)
        new[1:] = (r["h"][1:] != r["h"][:-1]) | (r["home"][1:] != r["home"][:-1])
        out = []
        for kind, use in ((0, new & (n > 1) & (n <= crowd)), (1, new & (n > crowd))):
            out += routed(r["home"][use].copy(), kind, r["h"][use].copy())
        return table_of(out)

    return home.select("slot", "text").mapInArrow(scan, ROUTED).groupBy("slot").applyInArrow(match, ROUTED)


def _texts(data: bytes, starts, ends, first: np.ndarray, past: np.ndarray) -> list[bytes]:
    """The units from first to past, words joined by one space."""
    if starts is None:
        return [data[a:b] for a, b in zip(first.tolist(), past.tolist(), strict=True)]
    ws = [data[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
    return [b" ".join(ws[a:b]) for a, b in zip(first.tolist(), past.tolist(), strict=True)]


def passages(home: DataFrame, repeated: DataFrame, units: Units, deal: Callable) -> DataFrame:
    """(slot, kind, data): the passages of each home, as ``deal(home, texts, places, lead, single)`` spells them.

    places are PASSAGE records (their copies, size and home are left to ``deal``), lead is where in a passage its anchor is, single tells
    windows of crowded anchors, which go one by one under their own hash.
    """
    window = units.window

    def cut(docs: pa.Table, seen: pa.Table) -> pa.Table:
        if not docs.num_rows or not seen.num_rows:
            return table_of([])
        of = lambda kind: np.unique(np.frombuffer(b"".join(x for k, x in zip(seen.column("kind").to_pylist(), seen.column("data").to_pylist(), strict=True) if k == kind), np.uint64))
        cold, crowded = of(0), of(1)
        wanted = np.sort(np.concatenate([cold, crowded]))
        doc, row = docs.column("doc").to_numpy(), docs.column("row").to_numpy()
        texts, places, leads, singles = [], [], [], []
        for lo, buf, _, starts, ends, uoff, uh, gram, (d, first, last, p) in units.read(docs.column("text")):
            h = gram[p]
            use = among(h, wanted)
            d, first, last, h = d[use], first[use], last[use], h[use]
            lead, single = p[use] - first, among(h, crowded)
            if single.any():
                n = (last - first + 1)[single]
                w = np.repeat(first[single] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
                wide = gram_hashes(uh, window)
                d = np.concatenate([d[~single], np.repeat(d[single], n)])
                first, last = np.concatenate([first[~single], w]), np.concatenate([last[~single], w])
                h, lead = np.concatenate([h[~single], mix(wide[w])]), np.concatenate([lead[~single], np.zeros(len(w), np.int64)])
                single = np.arange(len(d)) >= len(d) - len(w)
            if not len(d):
                continue
            texts += _texts(buf.tobytes(), starts, ends, first, last + window)
            place = np.zeros(len(d), PASSAGE)
            place["key"], place["doc"], place["row"], place["at"], place["windows"] = h, doc[lo + d], row[lo + d], first - uoff[d], last - first + 1
            places.append(place)
            leads.append(lead)
            singles.append(single)
        if not texts:
            return table_of([])
        return table_of(deal(docs.column("slot")[0].as_py(), texts, np.concatenate(places), np.concatenate(leads), np.concatenate(singles)))

    return home.groupBy("slot").cogroup(repeated.groupBy("slot")).applyInArrow(cut, ROUTED)


WINDOWS = "slot int, text binary, doc long, row long, at long, copies long"


def frequent_windows(home: DataFrame, units: Units, often: np.ndarray, once: bool) -> DataFrame:
    """(slot, text, doc, row, at, copies): the windows around frequent anchors; with ``once``, one of each home and text, at the smallest document and place."""
    window = units.window

    def run(batches):
        for batch in batches:
            slot, doc, row = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            for lo, buf, _, starts, ends, uoff, _, gram, (d, first, last, p) in units.read(batch.column(3)):
                use = among(gram[p], often)
                d, first, n = d[use], first[use], (last - first + 1)[use]
                w = np.repeat(first - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
                d = np.repeat(d, n)
                texts = _texts(buf.tobytes(), starts, ends, w, w + window)
                yield pa.record_batch([pa.array(slot[lo + d]), pa.array(texts, pa.binary()), pa.array(doc[lo + d]), pa.array(row[lo + d]), pa.array(w - uoff[d]), pa.array(np.ones(len(d), np.int64))], names=["slot", "text", "doc", "row", "at", "copies"])

    if not once:
        return home.mapInArrow(run, WINDOWS)
    one = home.mapInArrow(run, WINDOWS).groupBy("slot", "text").agg(F.min(F.struct("doc", "at", "row")).alias("first"), F.sum("copies").alias("copies"))
    return one.select("slot", "text", "first.doc", "first.row", "first.at", "copies")


def frequent_verdicts(own: DataFrame, units: Units, first_stays: bool) -> DataFrame:
    """Spans of the windows of ``frequent_windows`` that recur, for their homes; with ``first_stays``, without that of the smallest document and place."""
    per = own.groupBy("text").agg(F.sum("copies").alias("copies_in_all"), F.count(F.lit(1)).alias("n"), F.min(F.struct("doc", "at")).alias("least"))
    j = spread_join(own, per.filter("copies_in_all > 1"), "text", "n", own.count()).filter("copies_in_all IS NOT NULL")
    if first_stays:
        j = j.filter(F.struct("doc", "at") != F.col("least"))

    def pack(batches):
        for batch in batches:
            slot, doc, row, at = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            v = np.zeros(len(slot), VERDICT)
            v["row"], v["doc"], v["from"], v["to"] = row, doc, at, at + units.window - 1
            yield batch_of(list(routed(slot, 1, v)))

    return j.select("slot", "doc", "row", "at").mapInArrow(pack, ROUTED)


def verdicts_home(home_of: np.ndarray, verdicts: np.ndarray) -> list[tuple[int, int, bytes]]:
    return list(routed(home_of, 1, verdicts)) if len(verdicts) else []


def passed_on(t: pa.Table) -> tuple[list[bytes], list[tuple[int, int, bytes]]]:
    """Data of kind 0, and rows of kind 1 on their way home."""
    kinds, datas = t.column("kind").to_pylist(), t.column("data").to_pylist()
    return [x for k, x in zip(kinds, datas, strict=True) if k == 0], [(int.from_bytes(x[:4], "little"), 1, x[4:]) for k, x in zip(kinds, datas, strict=True) if k == 1]


def sizes(total_bytes: int) -> tuple[int, int]:
    """Homes and buckets: about four megabytes of text each, at least 96."""
    return (max(96, total_bytes >> 22),) * 2
