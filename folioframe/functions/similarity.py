"""Similarities and error rates. The default similarity is edit-distance based; Ratcliff-Obershelp runs as an Arrow UDF."""

from __future__ import annotations

from pyspark.sql import Column, functions as F
from pyspark.sql.types import DoubleType, LongType

from folioframe.functions.text import eval_text


@F.pandas_udf(DoubleType())
def ratcliff(a, b):
    """Ratcliff-Obershelp ratio, batch-wise; meant for short strings."""
    import pandas as pd
    from difflib import SequenceMatcher

    # The second string is indexed, so pairs of the same one are compared with the same matcher; equal pairs of a batch are compared once.
    known: dict[str, SequenceMatcher] = {}
    said: dict[tuple[str, str], float] = {}
    out = []
    for x, y in zip(a, b, strict=True):
        pair = x or "", y or ""
        if pair not in said:
            if pair[1] not in known:
                known[pair[1]] = SequenceMatcher(None, "", pair[1])
            known[pair[1]].set_seq1(pair[0])
            said[pair] = known[pair[1]].ratio()
        out.append(said[pair])
    return pd.Series(out, dtype="float64")


def ratcliff_ratios(a: list[str], b: list[str]):
    """The ratios of ``ratcliff`` of a[i] and b[j] as a function of arrays i and j, nan where either is empty; inside a task. Many pairs are compared at once."""
    import numpy as np
    from difflib import SequenceMatcher

    # Longer texts are left to difflib, which looks away from frequent characters from 200 on.
    short = 100

    def points(texts):
        return np.array([x if len(x) <= short else "" for x in texts] or [""]).view(np.uint32).reshape(max(1, len(texts)), -1).T

    x, y = points(a), points(b)
    letters = np.zeros(0x110000, dtype=np.uint32)
    letters[x], letters[y] = 1, 1
    letters = np.cumsum(letters, dtype=np.uint32)
    letters = letters.astype(np.uint8) if letters[-1] < 256 else letters
    x, y = (np.ascontiguousarray(letters[of]) for of in (x, y))
    long, wide = (np.array([len(t) for t in texts], dtype=np.int64) for texts in (a, b))

    def ratios(i, j):
        out = np.full(len(i), np.nan)
        n, m = long[i], wide[j]
        held = np.nonzero((n > 0) & (m > 0))[0]
        fit = (n[held] <= short) & (m[held] <= short)
        for k in held[~fit].tolist():
            out[k] = SequenceMatcher(None, a[i[k]], b[j[k]]).ratio()
        held = held[fit]
        for top in range(0, len(held), 1 << 15):
            at = held[top : top + (1 << 15)]
            out[at] = 2.0 * _matches_at_once(x, y, i[at], j[at], n[at], m[at]) / (n[at] + m[at])
        return out

    return ratios


def _matches_at_once(x, y, i, j, n, m):
    """How many characters the matching blocks of the columns i of x and j of y hold, n and m rows of them: the longest block, the first in x and then in y, and so on on both sides of it."""
    import numpy as np

    matches, zero = np.zeros(len(i), dtype=np.int64), np.zeros(len(i), dtype=np.int64)
    # Pieces that are left: the number of the pair, where the piece starts in x and y, and its lengths.
    todo = [(np.arange(len(i)), zero, zero, n, m)]
    while todo:
        k, p, q, n, m = todo.pop()
        rows, cols = int(n.max()), int(m.max())
        # Rows and columns behind a piece's end are equal to nothing.
        left = [np.where(r < n, x[np.minimum(p + r, len(x) - 1), i[k]].astype(np.int32), -1) for r in range(rows)]
        right = [np.where(c < m, y[np.minimum(q + c, len(y) - 1), j[k]].astype(np.int32), -2) for c in range(cols)]
        best, end, stop = (np.zeros(len(k), dtype=np.uint8) for _ in range(3))
        above = [np.zeros(len(k), dtype=np.uint8)] * (cols + 1)
        for r in range(rows):
            row = [above[0]]
            for c in range(cols):
                run = above[c] + np.uint8(1)
                run *= left[r] == right[c]
                row.append(run)
                more = run > best
                if more.any():
                    np.copyto(best, run, where=more)
                    end[more], stop[more] = r + 1, c + 1
            above = row
        matches[k] += best
        size, end, stop = best.astype(np.int64), end.astype(np.int64), stop.astype(np.int64)
        before = (size > 0) & (end > size) & (stop > size)
        behind = (size > 0) & (end < n) & (stop < m)
        pieces = [of[before] for of in (k, p, q, end - size, stop - size)], [of[behind] for of in (k, p + end, q + stop, n - end, m - stop)]
        for of in pieces:
            # Pieces of like sizes go together.
            wide = np.maximum(of[3], of[4]) if len(of[0]) else of[0]
            for low, high in ((0, 3), (3, 8), (8, 1 << 30)):
                now = (wide > low) & (wide <= high)
                if now.any():
                    todo.append(tuple(v[now] for v in of))
    return matches


def similarity(a: Column, b: Column, method: str = "levenshtein") -> Column:
    """1 for equal, 0 if either is empty, else a ratio in [0, 1]."""
    a, b = F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))
    ratio = ratcliff(a, b) if method == "ratcliff" else 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b))
    return F.when((a == "") | (b == ""), 0.0).when(a == b, 1.0).otherwise(ratio)


def edit_similarities(a: list[str], b: list[str], i, j):
    """The edit-distance ratios of a[i[k]] and b[j[k]] as an array, nan where either is empty; inside a task."""
    return edit_ratios(a, b)(i, j)


#: Longest text, without what all texts begin and end with, whose edits are counted together with other pairs'.
_SHORT = 250


def edit_ratios(a: list[str], b: list[str]):
    """``edit_similarities`` of two lists as a function of i and j. The table of edits is filled for many pairs at once, a byte a pair, between what all texts begin and end with."""
    import os

    import numpy as np

    full = [x for x in (*a, *b) if x]
    start = len(os.path.commonprefix([min(full), max(full)])) if full else 0
    turned = [x[start:][::-1] for x in full]
    end = len(os.path.commonprefix([min(turned), max(turned)])) if full else 0

    def points(texts):
        inner = np.array([x[start : len(x) - end] if 0 < len(x) - start - end <= _SHORT else "" for x in texts] or [""])
        return inner.view(np.uint32).reshape(len(inner), -1).T

    x, y = points(a), points(b)
    letters = np.zeros(0x110000, dtype=np.uint32)
    letters[x], letters[y] = 1, 1
    letters = np.cumsum(letters, dtype=np.uint32)
    letters = letters.astype(np.uint8) if letters[-1] < 256 else letters
    x, y = (np.ascontiguousarray(letters[of]) for of in (x, y))
    long, wide = (np.array([len(t) for t in texts], dtype=np.int64) for texts in (a, b))

    def ratios(i, j):
        out = np.full(len(i), np.nan)
        n, m = long[i], wide[j]
        held = np.nonzero((n > 0) & (m > 0))[0]
        short = held[np.maximum(n[held], m[held]) - start - end <= _SHORT]
        if len(short) < len(held):
            for k in np.setdiff1d(held, short):
                p, q = a[i[k]], b[j[k]]
                out[k] = 1 - sequence_edits(p, q) / max(len(p), len(q))
        if len(x) * len(y) > 400:
            # Pairs of like lengths share a table.
            short = short[np.argsort(n[short] + m[short], kind="stable")]
        for top in range(0, len(short), 1 << 15):
            at = short[top : top + (1 << 15)]
            out[at] = 1 - _edits_at_once(x, y, i[at], j[at], n[at] - start - end, m[at] - start - end) / np.maximum(n[at], m[at])
        return out

    return ratios


def _edits_at_once(x, y, i, j, n, m):
    """Edits of the columns i of x and j of y, n and m rows of them at most _SHORT each."""
    import numpy as np

    rows, cols, lengths = int(n.max()), int(m.max()), range(int(m.min()), int(m.max()) + 1)
    alike = int(n.min()) == rows and len(lengths) == 1
    p, q, n, m = x[:rows, i], y[:cols, j], n.astype(np.uint8), m.astype(np.uint8)
    above = [np.full(len(i), k, dtype=np.uint8) for k in range(cols + 1)]
    edits = np.where(n == 0, m, 0)
    for k in range(1, rows + 1):
        row = [np.full(len(i), k, dtype=np.uint8)]
        for c in range(1, cols + 1):
            best = np.minimum(above[c], row[-1])
            best += 1
            other = (p[k - 1] != q[c - 1]).view(np.uint8)
            other += above[c - 1]
            row.append(np.minimum(best, other, out=best))
        above = row
        if alike:
            continue
        done = n == k
        if done.any():
            for c in lengths:
                now = done & (m == c)
                edits[now] = row[c][now]
    return above[cols] if alike else edits


def contained_similarity(ref: Column, pred: Column, method: str = "levenshtein") -> Column:
    """1 when the normalised reference occurs in the prediction, else their similarity."""
    r, p = eval_text(ref), eval_text(pred)
    return F.when(r == "", 0.0).when(p.contains(r), 1.0).otherwise(similarity(r, p, method))


def label_score(text: Column, label: Column, method: str = "levenshtein", contained: float = 0.94, ratio_only: bool = False) -> Column:
    """1 equal, ``contained`` if one holds the other, else 0.65 similarity + 0.35 token Jaccard (or the similarity alone)."""
    ratio = similarity(text, label, method)
    t1, t2 = F.array_distinct(F.split(text, " ")), F.array_distinct(F.split(label, " "))
    mixed = 0.65 * ratio + 0.35 * F.size(F.array_intersect(t1, t2)) / F.greatest(F.lit(1), F.size(F.array_union(t1, t2)))
    return F.when(text == "", 0.0).when(text == label, 1.0).when(text.contains(label) | label.contains(text), contained).otherwise(ratio if ratio_only else mixed)


def cer(ref: Column, pred: Column) -> Column:
    """Character edits over reference length; an empty reference is 0 if the prediction is empty too, else 1."""
    r, p = eval_text(ref, "cer"), eval_text(pred, "cer")
    return F.when(r == "", F.when(p == "", 0.0).otherwise(1.0)).otherwise(F.levenshtein(r, p) / F.length(r))


def sequence_edits(x, y) -> int:
    """Edits between two sequences: bit-parallel, all of a row of the table at once."""
    x, y = list(x), list(y)
    while x and y and x[-1] == y[-1]:
        x.pop(), y.pop()
    n = next((i for i, (p, q) in enumerate(zip(x, y, strict=False)) if p != q), min(len(x), len(y)))
    x, y = x[n:], y[n:]
    if not x or not y:
        return len(x) + len(y)
    at: dict[int, int] = {}
    for i, w in enumerate(x):
        at[w] = at.get(w, 0) | 1 << i
    # Bits of ``up`` and ``down``: where the column of the table of edits rises or falls by one from a word of x to the next.
    full, top = (1 << len(x)) - 1, 1 << (len(x) - 1)
    up, down, n = full, 0, len(x)
    for w in y:
        eq = at.get(w, 0)
        same = (((eq & up) + up) ^ up) | eq | down
        rise, fall = down | (full & ~(same | up)), up & same
        n += 1 if rise & top else -1 if fall & top else 0
        rise, fall = (rise << 1 | 1) & full, fall << 1 & full
        seen = eq | down
        up, down = fall | (full & ~(seen | rise)), rise & seen
    return n


@F.pandas_udf(LongType())
def word_edits(a, b):
    """Edits between two arrays of numbers, batch-wise: bit-parallel, all of a row of the table at once, so long texts take words times words / 64."""
    import pandas as pd

    return pd.Series([sequence_edits([] if x is None else x, [] if y is None else y) for x, y in zip(a, b, strict=True)], dtype="int64")


def wer(ref: Column, pred: Column) -> Column:
    """Word edits over reference words, whatever the number of words or distinct words. Words are compared by their 64-bit hashes."""
    r, p = eval_text(ref, "cer"), eval_text(pred, "cer")
    numbers = lambda x: F.transform(F.when(x == "", F.array().cast("array<string>")).otherwise(F.split(x, " ")), lambda w: F.xxhash64(w))
    return F.when(r == "", F.when(p == "", 0.0).otherwise(1.0)).otherwise(word_edits(numbers(r), numbers(p)) / F.size(F.split(r, " ")))


def identity_match(ref: Column, cand: Column, text: Column) -> Column:
    """Digits equal, or the reference's digits a whole run of the text's digits, or compact containment."""
    r, c = eval_text(ref, "digits"), eval_text(cand, "digits")
    rc, cc = eval_text(ref, "compact"), eval_text(cand, "compact")
    run = F.exists(F.split(F.regexp_replace(F.coalesce(text, F.lit("")), "[^0-9]+", " "), " "), lambda x: x == r)
    return ((r != "") & ((r == c) | run)) | ((r == "") & (rc != "") & cc.contains(rc))
