"""Vectorised text primitives on Arrow string columns, for use inside Spark tasks.

A column is cut into chunks of whole documents of about half a megabyte (a longer document is a chunk of its own),
so that the working arrays stay small whatever the batch size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_rng = np.random.default_rng(20240229)
#: Random 64-bit number of each byte value.
BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
_R = 0x9E3779B97F4A7C15 | 1
_RINV = pow(_R, -1, 2**64)

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_pow_cache: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    have = _pow_cache.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, 1 << 16), base, np.uint64)
        steps[0] = 1
        have = _pow_cache[base] = np.cumprod(steps, dtype=np.uint64)
    return have[:n]


def chunks(column: pa.Array, limit: int = 1 << 19) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of runs of whole documents; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if not n:
        return
    _, off, data = column.buffers()
    off = np.frombuffer(off, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield i, j, data[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def words(buf: np.ndarray, off: np.ndarray, is_sep: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end) of each word in bytes, and for each document the index of its first word, plus the total."""
    n = len(buf)
    w = np.zeros(n + 2, bool)
    w[1:-1] = ~is_sep[buf]
    heads = off[:-1][off[:-1] < n]
    begin, end = w[1:-1] & ~w[:-2], w[1:-1] & ~w[2:]
    begin[heads] = w[1:-1][heads]
    tails = heads[heads > 0] - 1
    end[tails] = w[1:-1][tails]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, off)


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, is_sep: np.ndarray = SPACE) -> np.ndarray:
    if not len(starts):
        return np.zeros(0, np.uint64)
    head = np.zeros(len(buf), np.int64)
    head[starts] = starts
    rel = np.arange(len(buf)) - np.maximum.accumulate(head)
    top = int((ends - starts).max())
    np.minimum(rel, top, out=rel)
    part = np.where(is_sep, U(0), BYTE)[buf] * powers(0xD6E8FEB86659FD93, top + 1)[rel]
    return mix(np.add.reduceat(part, starts) + (ends - starts).astype(np.uint64))


def gram_hashes(units: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n units; len(units) - n + 1 of them. Runs may cross documents: the caller leaves these out."""
    if len(units) < n:
        return np.zeros(0, np.uint64)
    c = np.zeros(len(units) + 1, np.uint64)
    np.cumsum(units * powers(_R, len(units)), out=c[1:])
    return mix((c[n:] - c[:-n]) * powers(_RINV, len(units) - n + 1))


def anchors(gram: np.ndarray, off: np.ndarray, window: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of consecutive windows that choose the same k-gram: (document, first window, last window, anchor).

    A window's anchor is its k-gram of the smallest hash, the leftmost on ties: it depends on the window's content
    alone, so equal windows anywhere have equal anchors at equal places. ``off`` counts units; windows stay inside documents.
    """
    none = np.zeros(0, np.int64)
    m, n = window - k + 1, len(gram)
    size = np.diff(off)
    long = np.flatnonzero(size >= window)
    if n < m or not len(long):
        return none, none, none, none
    bits = U(34)
    packed = (gram >> bits << bits) | np.arange(n, dtype=np.uint64)
    rows = -(-n // m)
    a = np.full(rows * m, np.iinfo(np.uint64).max, np.uint64)
    a[:n] = packed
    a = a.reshape(rows, m)
    fore = np.minimum.accumulate(a, axis=1).ravel()
    back = np.minimum.accumulate(a[:, ::-1], axis=1)[:, ::-1].ravel()
    count = n - m + 1
    low = (np.minimum(back[:count], fore[m - 1 : m - 1 + count]) & ((U(1) << bits) - U(1))).astype(np.int64)
    step = np.zeros(int(off[-1]) + 2, np.int32)
    np.add.at(step, off[:-1][long], 1)
    np.add.at(step, off[1:][long] - window + 1, -1)
    s = np.flatnonzero(np.cumsum(step)[:count] > 0)
    at = low[s]
    new = np.ones(len(s), bool)
    new[1:] = (at[1:] != at[:-1]) | (s[1:] != s[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(s)) - 1
    return np.searchsorted(off, s[first], "right") - 1, s[first], s[last], at[first]
