"""Substring deduplication by repeated-phrase automata."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from folioframe.llm import recur
from folioframe.llm.arrowtext import chunks, word_hashes, words
from folioframe.llm.common import NULL_ID, checkpointed

WINDOW, ANCHOR = 35, 12
#: Words of phrases in one automaton; a home with more compiles several, one after the other.
AUTOMATON_WORDS = 300_000


#: Added to where a span starts: its passage follows the one before wherever the home holds either.
CHAINED = 1 << 62


def chained(number: np.ndarray, place: np.ndarray, single: np.ndarray, n: int) -> np.ndarray:
    """For each of n passage texts: does each of its occurrences directly follow one text's, and each of these lead on to it?"""
    order = np.lexsort((place["at"], place["doc"], place["row"]))
    p, t, one = place[order], number[order], single[order]
    on = (p["row"][1:] == p["row"][:-1]) & (p["doc"][1:] == p["doc"][:-1]) & (p["at"][1:] == p["at"][:-1] + p["windows"][:-1]) & ~one[1:] & ~one[:-1]
    after, before = np.full(len(t), -1), np.full(len(t), -1)
    after[:-1][on], before[1:][on] = t[1:][on], t[:-1][on]

    def same(other: np.ndarray) -> np.ndarray:
        low, high = np.full(n, n), np.full(n, -1)
        np.minimum.at(low, t, other)
        np.maximum.at(high, t, other)
        return np.where(low == high, low, -1)

    back, on_to = same(before), same(after)
    return (back >= 0) & (on_to[np.maximum(back, 0)] == np.arange(n))


def _deal(window: int, buckets: int):
    """Sends each passage of a home once, to the bucket of its key; one that the home holds several times is confirmed right away."""

    def deal(home: int, texts: list[bytes], place: np.ndarray, lead: np.ndarray, single: np.ndarray) -> list[tuple[int, int, bytes]]:
        first: dict[bytes, int] = {}
        number = np.fromiter((first.setdefault(t, len(first)) for t in texts), np.int64, len(texts))
        _, own, copies = np.unique(number, return_index=True, return_counts=True)
        head = place[own]
        head["copies"], head["home"], head["size"] = copies, home, [len(t) for t in first]
        head["mark"] = chained(number, place, single, len(first))
        out = list(recur.routed(recur._spread(head["key"], buckets), 0, head, list(first)))
        twice = head[head["copies"] > 1]
        if len(twice):
            out.append((home % buckets, 1, home.to_bytes(4, "little") + _spans(twice, np.zeros(len(twice), np.int64), twice["windows"] - 1, window).tobytes()))
        return out

    return deal


def _spans(head: np.ndarray, low: np.ndarray, high: np.ndarray, window: int) -> np.ndarray:
    """The words of windows low to high of passages."""
    v = np.zeros(len(head), recur.VERDICT)
    v["row"], v["doc"], v["from"], v["to"] = head["row"], head["doc"], head["at"] + low + CHAINED * ((head["mark"] > 0) & (low == 0)), head["at"] + high + window - 1
    return v


def joined(v: np.ndarray, window: int) -> np.ndarray:
    """Spans whose passages are chained are one phrase; so a home's automata hold little more than its recurring words."""
    mark, v = v["from"] >= CHAINED, v.copy()
    v["from"][mark] -= CHAINED
    order = np.lexsort((~mark, v["from"], v["doc"], v["row"]))
    v, mark = v[order], mark[order]
    if not len(v):
        return v
    new = np.ones(len(v), bool)
    new[1:] = ~mark[1:] | (v["row"][1:] != v["row"][:-1]) | (v["doc"][1:] != v["doc"][:-1]) | (v["from"][1:] != v["to"][:-1] - window + 2)
    head = np.flatnonzero(new)
    out = v[head]
    out["to"] = v["to"][np.append(head[1:], len(v)) - 1]
    return np.unique(out)


def confirmed_runs(parts: list[tuple[np.ndarray, list[bytes]]], window: int) -> dict[bytes, list[tuple[int, int]]]:
    """For each passage the runs (first, last) of its windows that recur, word by word: all of a passage that is seen twice, else those that
    another passage of the same key holds as well."""
    texts: dict[bytes, int] = {}
    keys: dict[int, set] = {}
    for head, blobs in parts:
        for k, c, t in zip(head["key"].tolist(), head["copies"].tolist(), blobs, strict=True):
            texts[t] = texts.get(t, 0) + c
            keys.setdefault(k, set()).add(t)
    runs: dict[bytes, list[tuple[int, int]]] = {}
    for own in keys.values():
        seen: dict[tuple, int] = {}
        wins: dict[bytes, list[tuple]] = {}
        if len(own) > 1:  # equal windows have their anchor at equal places, so one passage doesn't hold a window twice
            for t in own:
                w = t.split(b" ")
                wins[t] = [tuple(w[i : i + window]) for i in range(len(w) - window + 1)]
                for x in wins[t]:
                    seen[x] = seen.get(x, 0) + 1
        for t in own:
            n = t.count(b" ") + 2 - window
            if texts[t] > 1:
                runs[t] = [(0, n - 1)]
            elif t in wins:
                again = np.array([False, *(seen[x] > 1 for x in wins[t]), False])
                edge = np.flatnonzero(again[1:] != again[:-1])
                runs[t] = list(zip(edge[::2].tolist(), (edge[1::2] - 1).tolist(), strict=True))
    return runs


def _confirm(window: int):
    def run(t: pa.Table) -> pa.Table:
        own, out = recur.passed_on(t)
        parts = [recur.unpack(x) for x in own]
        runs = confirmed_runs(parts, window)
        for head, blobs in parts:
            at, low, high = [], [], []
            for i, text in enumerate(blobs):
                for a, b in runs.get(text, ()):
                    at.append(i)
                    low.append(a)
                    high.append(b)
            if at:
                out += recur.verdicts_home(head["home"][at], _spans(head[at], np.array(low), np.array(high), window))
        return recur.table_of(out)

    return run


def occurrences(words_: np.ndarray, phrases: list[np.ndarray], most: int = AUTOMATON_WORDS) -> Iterator[np.ndarray]:
    """Streams a text of word numbers (-1 between documents) through the automata of phrases: rows (first word, last word) of every occurrence.

    A word of a phrase is written as one code point, so that a phrase is a short string and its automaton has a node a word.
    """
    at = 0
    while at < len(phrases):
        till, size = at, 0
        while till < len(phrases) and (till == at or size + len(phrases[till]) <= most):
            size += len(phrases[till])
            till += 1
        letters = np.unique(np.concatenate(phrases[at:till]))
        code = np.arange(1, len(letters) + 1, dtype=np.uint32)
        code += (code >= 0xD800) * np.uint32(0x800)  # no surrogates
        sheet = np.zeros(max(int(words_.max(initial=0)), int(letters[-1])) + 2, "<u4")  # other words, and the place between documents, are 0
        sheet[letters] = code
        sign = lambda w: sheet[w].tobytes().decode("utf-32-le")  # noqa: B023, E731
        machine = ahocorasick.Automaton()
        for p in phrases[at:till]:
            machine.add_word(sign(p), len(p))
        machine.make_automaton()
        hits = np.array(list(machine.iter(sign(words_))), np.int64).reshape(-1, 2)
        yield np.stack([hits[:, 0] - hits[:, 1] + 1, hits[:, 0]], 1)
        at = till


def numbered(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """A number for each word, equal for equal words only: by their hashes, if all words of a hash have the same bytes, else one by one."""
    _, first, number = np.unique(hashes, return_index=True, return_inverse=True)
    like = first[number]
    size = ends - starts
    same = bool((size == size[like]).all())
    for a in range(0, len(starts), 100_000):
        n = size[a : a + 100_000]
        inner = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        same = same and bool((data[np.repeat(starts[a : a + 100_000], n) + inner] == data[np.repeat(starts[like[a : a + 100_000]], n) + inner]).all())
    if same:
        return number.astype(np.int64)
    text, own = data.tobytes(), {}
    return np.fromiter((own.setdefault(text[a:b], len(own)) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)), np.int64, len(starts))


CLEANED = "doc_id long, n_words long, n_removed long, kept string, kept_sha256 string"
_CLEANED = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string()), ("kept_sha256", pa.string())])


def _cleaned(window: int, with_text: bool):
    """A home's documents without its confirmed phrases: these are read where the spans say, compiled, and all documents are streamed through."""

    def run(docs: pa.Table, said: pa.Table) -> pa.Table:
        v = np.unique(np.frombuffer(b"".join(said.column("data").to_pylist()), recur.VERDICT)) if said.num_rows else np.zeros(0, recur.VERDICT)
        v = joined(v, window)
        doc, row = docs.column("doc").to_numpy(), docs.column("row").to_numpy()
        texts, count, hashes = [], [], []
        for lo, hi, buf, off in chunks(docs.column("text")):
            starts, ends, first = words(buf, off)
            texts.append((lo, hi, buf, starts, ends, first))
            count.append(np.diff(first))
            if len(v):
                hashes.append(word_hashes(buf, starts, ends))
        # Documents lie one after the other, with one place between them.
        base = np.cumsum(np.concatenate([[0], *(c + 1 for c in count)]))
        gone = np.zeros(int(base[-1]), bool)
        if len(v):
            at = np.cumsum([0, *(len(t[2]) for t in texts)])
            ids = numbered(np.concatenate([t[2] for t in texts]), np.concatenate([t[3] + x for t, x in zip(texts, at, strict=False)]), np.concatenate([t[4] + x for t, x in zip(texts, at, strict=False)]), np.concatenate(hashes))
            line = np.full(len(gone), -1, np.int64)
            n = np.concatenate(count)
            line[np.repeat(base[:-1], n) + np.arange(len(ids)) - np.repeat(np.cumsum(n) - n, n)] = ids
            order = np.lexsort((doc, row))
            place = np.zeros(len(v), np.int64)
            where = {}
            for i in order.tolist():
                where.setdefault((int(row[i]), int(doc[i])), i)
            place = base[[where[(r, d)] for r, d in zip(v["row"].tolist(), v["doc"].tolist(), strict=True)]]
            phrases = {line[a : b + 1].tobytes() for a, b in zip((place + v["from"]).tolist(), (place + v["to"]).tolist(), strict=True)}
            spans = np.concatenate([np.zeros((0, 2), np.int64), *occurrences(line, [np.frombuffer(p, np.int64) for p in sorted(phrases)])])
            edge = np.zeros(len(gone) + 1, np.int64)
            np.add.at(edge, spans[:, 0], 1)
            np.add.at(edge, spans[:, 1] + 1, -1)
            gone = np.cumsum(edge[:-1]) > 0
        rows: dict[str, list] = {c: [] for c in _CLEANED.names}
        for lo, hi, buf, starts, ends, first in texts:
            data = buf.tobytes()
            for i in range(lo, hi):
                a, b = int(first[i - lo]), int(first[i - lo + 1])
                keep = ~gone[base[i] : base[i] + b - a]
                text = b" ".join([data[x:y] for x, y in zip(starts[a:b][keep].tolist(), ends[a:b][keep].tolist(), strict=True)])
                for c, x in zip(_CLEANED.names, (None if doc[i] == NULL_ID else int(doc[i]), b - a, b - a - int(keep.sum()), text.decode() if with_text else None, hashlib.sha256(text).hexdigest()), strict=True):
                    rows[c].append(x)
        return pa.table(rows, schema=_CLEANED)

    return run


def remove_repeated_passages(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, with_text: bool = True) -> DataFrame:
    """Removes each word inside a window of ``window`` words that also starts anywhere else, all occurrences alike.

    Returns doc_id, n_words, n_removed, kept (the remaining words joined by one space; null without ``with_text``) and its
    SHA-256, one row per row of ``docs``. Words lie between ASCII white space and are unchanged; null and blank texts have
    none; a text shorter than the window loses nothing. Repeated rows are occurrences of their own. Other columns are ignored.

    Passages around anchors that recur are brought together by anchor (see ``recur``), where the phrases that recur are confirmed word by word.
    Spans of confirmed phrases go to the homes that hold them. A home compiles its phrases into Aho-Corasick automata and streams all its
    documents, whole, through them: whatever an automaton finds is removed. A phrase is in the automata of every home that holds it.
    """
    units = recur.Units("word", window, anchor)
    size = recur.text_bytes(docs)
    homes, buckets = recur.sizes(size)
    often = recur.frequent_anchors(docs, units, size, buckets)
    home = recur.homes(docs, homes, 2 * window - 1)
    repeated = recur.repeated_anchors(home, units, buckets, often)
    said = recur.passages(home, repeated, units, _deal(window, buckets)).groupBy("slot").applyInArrow(_confirm(window), recur.ROUTED)
    if len(often):
        common = checkpointed(recur.frequent_windows(home, units, often, once=True))
        said = said.unionByName(recur.frequent_verdicts(common, units, first_stays=False))
    return home.groupBy("slot").cogroup(said.groupBy("slot")).applyInArrow(_cleaned(window, with_text), CLEANED)
