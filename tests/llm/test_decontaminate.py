import hashlib
import re

import pytest

from folioframe.llm import decontaminate
from tests.llm.brute import ascii_lower


def toks(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(text or ""))


def brute(docs, items):
    wins = {}
    for i, t in items:
        w = toks(t)
        n = min(10, len(w))
        for a in range(len(w) - n + 1 if n else 0):
            wins.setdefault(tuple(w[a : a + n]), set()).add(i or "")
    out = []
    for d, t in docs:
        w = toks(t)
        hit, ids = set(), set()
        for win, own in wins.items():
            for a in range(len(w) - len(win) + 1):
                if tuple(w[a : a + len(win)]) == win:
                    hit.update(range(a, a + len(win)))
                    ids |= own
        out.append((d, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


@pytest.mark.parametrize("broadcast", [0, 1 << 25])
def test_against_brute_force(spark, messy_docs, monkeypatch, broadcast):
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", broadcast)
    docs = [(r.doc_id, r.text) for r in messy_docs.collect()]
    long = [t for _, t in docs if t and len(t.split()) > 30]
    w = long[0].split()
    items = [("10", " ".join(w[3:30])), ("9", " ".join(w[20:29]).upper() + "!!"), ("2", " ".join(long[1].split()[4:18]) + " nowhere else"), ("x", None), ("y", "..."), ("z", w[5]), (None, " ".join(long[2].split()[-12:])), ("10", " ".join(w[3:30])), ("pair", " ".join(w[7:9])), ("rep", "ab ab ab ab ab ab ab ab ab ab ab ab"), ("cjk", "日本語")]
    idf = spark.createDataFrame(items, "item_id string, text string")
    got = decontaminate.contamination(messy_docs, idf).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got), key=str) == brute(docs, items)
    kept = {r.doc_id for r in decontaminate.clean_only(messy_docs, idf).collect()}
    assert kept == {r.doc_id for r in got if not r.contaminated}


def test_empty_tables(spark, messy_docs, no_docs):
    none = spark.createDataFrame([], "item_id long, text string")
    got = decontaminate.contamination(messy_docs, none).collect()
    assert len(got) == messy_docs.count() and not any(r.contaminated for r in got)
    assert got[0].items_sha256 == hashlib.sha256(b"").hexdigest()
    assert decontaminate.contamination(no_docs, none).count() == 0


def test_rows_are_judged_each_for_itself(spark):
    """Null and repeated ids, equal rows, a long text, columns of any name, a phrase that many items share."""
    phrase = "one two three four five six seven eight nine ten"
    long = "lorem ipsum " * 90_000 + phrase
    rows = [(1, phrase), (1, "clean text of the same id"), (None, phrase), (None, "clean"), (2, long), (3, None), (3, None)]
    df = spark.createDataFrame([(*r, "a", "b", "c") for r in rows], "doc_id long, text string, _bad string, row string, d string")
    items = spark.createDataFrame([(f"i{n}", phrase + f" and {n}") for n in range(300)], "item_id string, text string")
    got = decontaminate.contamination(df, items).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items) for r in got), key=str) == sorted(((i, len(toks(t)), 10 * (phrase in (t or "")), 300 * (phrase in (t or ""))) for i, t in rows), key=str)
    kept = decontaminate.clean_only(df, items)
    assert kept.columns == df.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted(((i, t) for i, t in rows if phrase not in (t or "")), key=str)
