"""Suffix-array deduplication: a distributed merge sort of front-coded suffix runs.

The suffixes that are sorted start at anchors that recur (see ``recur``), go on to the end of the anchor's passage, and then
hold what lies before the anchor, backwards. In sorted order equal passages are neighbours, and all passages that can share a
window stand together, since they share the anchor. Homes sort their suffixes into runs and front-code them (the length of the
prefix shared with the suffix before, then the rest). The runs, cut at splitters, are exchanged, and each range is merged
by a loser tree whose players carry how much of their prefix they are known to share with the last winner: a match compares
these lengths first and never looks at known bytes again.

The shared lengths that come out of the merge settle all windows. A window that starts a bytes before its anchor recurs in another
passage if both share at least window - a bytes from the anchor on and a bytes before it; so for each a the passages fall into
classes, cut where the shared length of sorted neighbours is less, and the smallest document and place of a class keeps its window.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from folioframe.llm import recur
from folioframe.llm.arrowtext import chunks
from folioframe.llm.common import NULL_ID, checkpointed, row_key

WINDOW, ANCHOR = 100, 32
#: Place of a suffix: document, row, first byte of the passage, home, windows, bytes before the anchor.
PLACE = np.dtype([("doc", "<i8"), ("row", "<i8"), ("at", "<i4"), ("home", "<i4"), ("windows", "<u2"), ("lead", "<u2")])
#: Bytes of a splitter; no more than an anchor has, so that an anchor's suffixes are never parted.
SPLIT_BYTES = 24


def shared_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    x = int.from_bytes(a[:n]) ^ int.from_bytes(b[:n])
    return (8 * n - x.bit_length()) // 8


def front_coded(values: list[bytes], place: np.ndarray) -> bytes:
    """A sorted run: count, shared prefix lengths, lengths, places and the rest of each suffix."""
    lcp = [0, *(shared_prefix(a, b) for a, b in zip(values, values[1:], strict=False))][: len(values)]
    rest = b"".join([v[n:] for v, n in zip(values, lcp, strict=True)])
    return len(values).to_bytes(4, "little") + np.array(lcp, "<u2").tobytes() + np.array([len(v) for v in values], "<u2").tobytes() + place.tobytes() + rest


def opened(data: bytes) -> tuple[list[int], list[int], np.ndarray, bytes]:
    n = int.from_bytes(data[:4], "little")
    lcp, size = np.frombuffer(data, "<u2", n, 4), np.frombuffer(data, "<u2", n, 4 + 2 * n)
    return lcp.tolist(), size.tolist(), np.frombuffer(data, PLACE, n, 4 + 4 * n), data[4 + 4 * n + n * PLACE.itemsize :]


def merged(runs: list[tuple[list[int], list[int], bytes]]) -> Iterator[tuple[int, int, bytes]]:
    """Merges front-coded runs: (run, prefix shared with the suffix before, suffix) in sorted order, by a loser tree."""
    k = 1
    while k < len(runs):
        k *= 2
    value: list[bytes] = [b""] * k
    known = [-1] * k  # prefix shared with the last winner; -1: ended
    index, at = [0] * k, [0] * k

    def advance(i: int) -> None:
        lcp, size, rest = runs[i]
        j = index[i]
        if j == len(lcp):
            known[i] = -1
            return
        n, a = lcp[j], at[i]
        b = a + size[j] - n
        value[i] = value[i][:n] + rest[a:b]
        known[i], index[i], at[i] = n, j + 1, b

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser). All players share known bytes with the same last winner: who shares more is smaller."""
        x, y = known[a], known[b]
        if x != y:
            return (a, b) if x > y else (b, a)
        if x < 0:
            return a, b
        p, q = value[a][x:], value[b][x:]
        if p <= q:
            known[b] = x + shared_prefix(p, q)
            return a, b
        known[a] = x + shared_prefix(p, q)
        return b, a

    for i in range(len(runs)):
        advance(i)
    loser = [0] * k
    winners = [0] * k + list(range(k))
    for node in range(k - 1, 0, -1):
        winners[node], loser[node] = play(winners[2 * node], winners[2 * node + 1])
    top = winners[1] if k > 1 else 0
    while known[top] >= 0:
        yield top, known[top], value[top]
        advance(top)
        node = (top + k) // 2
        while node:
            top, loser[node] = play(top, loser[node])
            node //= 2


def _runs(splitters: list[bytes], slots: int, window: int):
    """Sorts a home's suffixes into one run for each range; equal passages, neighbours then, are sent once, for their smallest document and
    place, and the others are settled. Windows of crowded anchors are dealt by their hash."""

    def deal(home: int, texts: list[bytes], head: np.ndarray, lead: np.ndarray, single: np.ndarray) -> list[tuple[int, int, bytes]]:
        values = [t[a:] + t[:a][::-1] for t, a in zip(texts, lead.tolist(), strict=True)]
        keys, ones = head["key"].tolist(), single.tolist()
        at = list(zip(head["doc"].tolist(), head["at"].tolist(), head["row"].tolist(), strict=True))
        order = sorted(range(len(values)), key=lambda i: (ones[i], values[i], lead[i], at[i]))
        new = np.array([True, *(values[i] != values[j] or lead[i] != lead[j] or ones[i] != ones[j] for i, j in zip(order, order[1:], strict=False))])
        order = np.array(order)
        first = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
        more = ~new & ((head["doc"][order] != head["doc"][first]) | (head["at"][order] != head["at"][first]))  # equal rows are one document
        place = np.zeros(len(head), PLACE)
        for k in ("doc", "row", "at", "windows"):
            place[k] = head[k]
        place["home"], place["lead"] = home, lead
        own: dict[tuple[int, int], list[int]] = {}
        for i in order[new].tolist():
            spot = (2, (keys[i] >> 20) % slots) if ones[i] else (0, bisect_right(splitters, values[i][:SPLIT_BYTES]))
            own.setdefault(spot, []).append(i)
        # Equal rows of a document have verdicts of their own only through their row, which they share.
        out = [(slot, kind, front_coded([values[i] for i in rows], place[rows])) for (kind, slot), rows in own.items()]
        later = order[more]
        if len(later):
            v = np.zeros(len(later), recur.VERDICT)
            v["row"], v["doc"], v["from"], v["to"] = head["row"][later], head["doc"][later], head["at"][later], head["at"][later] + head["windows"][later] + window - 2
            out.append((home % slots, 1, home.to_bytes(4, "little") + v.tobytes()))
        return out

    return deal


def _later(p: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, whether it comes after its group's first): by document and place. Equal rows have equal places, and neither comes first."""
    o = np.lexsort((p["at"], p["doc"], group))
    g, doc, at = group[o], p["doc"][o], p["at"][o]
    head = np.flatnonzero(np.diff(g, prepend=-1))
    lead = np.repeat(head, np.diff(np.append(head, len(g))))
    return o, (doc != doc[lead]) | (at != at[lead])


def before_anchor(values: list[bytes], lead: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rank, shared): the order of what lies before the anchors, backwards, and the prefix that neighbours in it share."""
    back = [v[len(v) - a :] for v, a in zip(values, lead.tolist(), strict=True)]
    order = sorted(range(len(back)), key=back.__getitem__)
    rank = np.zeros(len(back), np.int64)
    rank[order] = np.arange(len(back))
    return rank, np.array([0, *(shared_prefix(back[i], back[j]) for i, j in zip(order, order[1:], strict=False))], np.int64)[: len(back)]


def later_windows(values: list[bytes], shared: np.ndarray, p: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Spans (as verdicts) and homes of the windows that start earlier in another of these passages.

    The passages are sorted, ``shared`` is the prefix of each that the one before shares. Windows are compared by shared lengths alone.
    """
    lead, n = p["lead"].astype(np.int64), p["windows"].astype(np.int64)
    rank, back = before_anchor(values, lead)
    found = []
    for a in range(int((lead - n + 1).min()), int(lead.max()) + 1):
        here = np.flatnonzero((a <= lead) & (a > lead - n))
        if len(here) < 2:
            continue
        right, left = np.cumsum(shared < window - a)[here], np.cumsum(back < a)[rank[here]]
        place, doc = p["at"][here] + lead[here] - a, p["doc"][here]
        o = np.lexsort((place, doc, left, right))
        new = np.ones(len(o), bool)
        new[1:] = (right[o][1:] != right[o][:-1]) | (left[o][1:] != left[o][:-1])
        first = o[np.maximum.accumulate(np.where(new, np.arange(len(o)), 0))]
        later = (doc[o] != doc[first]) | (place[o] != place[first])
        found.append(np.stack([here[o[later]], place[o[later]]], 1))
    at = np.concatenate(found) if found else np.zeros((0, 2), np.int64)
    at = at[np.lexsort((at[:, 1], at[:, 0]))]
    new = np.ones(len(at), bool)
    new[1:] = (at[1:, 0] != at[:-1, 0]) | (at[1:, 1] != at[:-1, 1] + 1)
    a = np.flatnonzero(new)
    b = np.append(a[1:], len(at)) - 1 if len(a) else a
    q = p[at[a, 0]]
    v = np.zeros(len(a), recur.VERDICT)
    v["row"], v["doc"], v["from"], v["to"] = q["row"], q["doc"], at[a, 1], at[b, 1] + window - 1
    return v, q["home"]


def _merge(window: int, anchor: int):
    """In a range: merges the runs, settles equal passages, and then the windows that different passages around one anchor share."""

    def combine(data: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        runs = [opened(x) for x in data]
        base = np.cumsum([0, *(len(r[0]) for r in runs)])[:-1].tolist()
        values, lcps, rank = [], [], []
        for i, n, v in merged([(r[0], r[1], r[3]) for r in runs]):
            values.append(v)
            lcps.append(n)
            rank.append(base[i])
            base[i] += 1
        return values, np.array(lcps), np.concatenate([r[2] for r in runs])[np.array(rank)]

    def settle(values: list[bytes], lcps: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(number of the passage of each suffix, verdicts, their homes)."""
        size = np.array([len(v) for v in values])
        same = np.zeros(len(p), bool)
        same[1:] = (lcps[1:] == size[1:]) & (size[1:] == size[:-1]) & (p["lead"][1:] == p["lead"][:-1])
        which = np.cumsum(~same)
        o, later = _later(p, which)
        q = p[o[later]]
        v = np.zeros(len(q), recur.VERDICT)
        v["row"], v["doc"], v["from"], v["to"] = q["row"], q["doc"], q["at"], q["at"] + q["windows"] + window - 2
        return which, v, q["home"]

    def run(t: pa.Table) -> pa.Table:
        cold, out = recur.passed_on(t)
        single = [x for k, x in zip(t.column("kind").to_pylist(), t.column("data").to_pylist(), strict=True) if k == 2]
        said, home = [], []
        for data, whole in ((cold, True), (single, False)):
            if not data:
                continue
            values, lcps, p = combine(data)
            which, v, h = settle(values, lcps, p)
            said.append(v)
            home.append(h)
            if whole:
                # The smallest of equal passages stands for them; what neighbours that stay share is the least shared between them.
                o, _ = _later(p, which)
                firsts = np.sort(o[np.diff(which[o], prepend=-1) != 0])
                shared = np.minimum.reduceat(lcps, np.concatenate([[0], firsts[:-1] + 1])) if len(firsts) else lcps[:0]
                group = np.cumsum(shared < anchor)
                _, inverse, times = np.unique(group, return_inverse=True, return_counts=True)
                meet = np.flatnonzero(times[inverse] > 1)
                if len(meet):
                    own = firsts[meet]
                    # Groups that are left out share less than an anchor with their neighbours.
                    v, h = later_windows([values[i] for i in own.tolist()], np.where(np.diff(group[meet], prepend=-1) != 0, 0, shared[meet]), p[own], window)
                    said.append(v)
                    home.append(h)
        if said:
            out += recur.verdicts_home(np.concatenate(home).astype(np.int32), np.concatenate(said))
        return recur.table_of(out)

    return run


CUT = "doc_id long, n_bytes long, n_removed long, n_spans long, starts array<long>, ends array<long>, kept_sha256 string"
CUT_ARROW = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("starts", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), ("kept_sha256", pa.string())])


def _cut(docs: pa.Table, said: pa.Table) -> pa.Table:
    v = np.unique(np.frombuffer(b"".join(said.column("data").to_pylist()), recur.VERDICT)) if said.num_rows else np.zeros(0, recur.VERDICT)
    rows = []
    doc, row = docs.column("doc").to_numpy(), docs.column("row").to_numpy()
    left, right = np.searchsorted(v["row"], row, "left"), np.searchsorted(v["row"], row, "right")
    for lo, hi, buf, off in chunks(docs.column("text")):
        data = buf.tobytes()
        for i in range(lo, hi):
            text = data[off[i - lo] : off[i - lo + 1]]
            mine = v[left[i] : right[i]]
            mine = mine[mine["doc"] == doc[i]]
            spans: list[list[int]] = []
            for a, b in sorted(zip(mine["from"].tolist(), (mine["to"] + 1).tolist(), strict=True)):
                if spans and a <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], b)
                else:
                    spans.append([a, b])
            edges = [0, *(x for s in spans for x in s), len(text)]
            kept = b"".join(text[edges[j] : edges[j + 1]] for j in range(0, len(edges), 2))
            rows.append((None if doc[i] == NULL_ID else int(doc[i]), len(text), len(text) - len(kept), len(spans), [s[0] for s in spans], [s[1] for s in spans], hashlib.sha256(kept).hexdigest()))
    cols = list(zip(*rows, strict=True)) if rows else [[] for _ in CUT_ARROW]
    return pa.table([pa.array(c, f.type) for c, f in zip(cols, CUT_ARROW, strict=True)], schema=CUT_ARROW)


def splitters_of(docs: DataFrame, units: recur.Units, size: int, ranges: int, sample_bytes: int = 1 << 23) -> list[bytes]:
    """Prefixes that cut the order of anchors into ranges, from a bounded hash sample; they only balance the merge."""
    share = max(1, size // sample_bytes)
    some = docs.filter(F.pmod(row_key(), F.lit(share)) == 0).select("text")

    def pick(batches):
        for batch in batches:
            for _, buf, _, _, _, _, _, _, (_, _, _, p) in units.read(batch.column(0)):
                data = buf.tobytes()
                yield pa.record_batch([pa.array([data[i : i + SPLIT_BYTES] for i in p[::4].tolist()], pa.binary())], names=["p"])

    picked = sorted(bytes(r.p) for r in some.mapInArrow(pick, "p binary").collect())
    return sorted({picked[len(picked) * i // ranges] for i in range(1, ranges)}) if picked else []


def remove_repeated_bytes(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """Removes each byte covered by a ``window``-byte string that also starts earlier: in a smaller doc_id, or before in the same document.

    Returns doc_id, n_bytes, n_removed, n_spans, starts and ends (of the maximal removed runs, end exclusive) and the SHA-256
    of the remaining bytes, one row per row of ``docs``. Text is UTF-8; null and empty texts have no bytes and lose none, nor
    does a text shorter than the window. Null ids come before all others. Equal rows (id and text) are one document and are
    cut alike. Strings are judged on the input. Other columns are ignored.

    Only windows around anchors that recur can have an equal, and these are in the passages that the merge sort brings together.
    Equal passages are settled as they come out of it; different passages around one anchor by the lengths that neighbours share.
    """
    units = recur.Units("byte", window, anchor)
    size = recur.text_bytes(docs)
    homes, buckets = recur.sizes(size)
    often = recur.frequent_anchors(docs, units, size, buckets)
    split = splitters_of(docs, units, size, homes)
    home = recur.homes(docs, homes, window)
    repeated = recur.repeated_anchors(home, units, buckets, often)
    said = recur.passages(home, repeated, units, _runs(split, buckets, window)).groupBy("slot").applyInArrow(_merge(window, anchor), recur.ROUTED)
    if len(often):
        common = checkpointed(recur.frequent_windows(home, units, often, once=False))
        said = said.unionByName(recur.frequent_verdicts(common, units, first_stays=True))
    return home.groupBy("slot").cogroup(said.groupBy("slot")).applyInArrow(_cut, CUT)
