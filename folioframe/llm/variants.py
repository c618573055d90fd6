"""Spelling variants: exact neighbours at one edit, through pairs of trie nodes.

The vocabulary is sorted, and the nodes of the trie over it are numbered: a node is known by its depth and the rank of the first word below it.
The reversed words give a second trie. Word x with position i left out is the pair (node of what stands before i, node of what stands after i):
two words that share such a pair differ by a replaced code point; a word that has the same pair with nothing left out lacks an inserted one. Node
numbers are exact, so what the join finds needs no check, and at most one word for each code point of the alphabet shares a pair.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from folioframe.llm.common import checkpointed

RUNS = "[A-Za-z\\u00C0-\\u00FF]+"
#: Words of fewer code points or occurrences aren't in the vocabulary; one run in SLIP loses a code point; a form occurs LEAD times as often at least.
SHORTEST, OFTEN, SLIP, LEAD = 5, 3, 97, 2
#: Bits of a node's number that hold its depth: words of up to 16 million code points, 5 * 10**11 words.
DEPTH = 24
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def vocabulary(docs: DataFrame, slip: int | None = SLIP, shortest: int = SHORTEST, often: int = OFTEN) -> DataFrame:
    """(word, n): runs of letters in all texts, A-Z lower-cased, of at least ``shortest`` code points, that occur ``often`` times.

    Where ``slip`` divides h, the CRC-32 of ``<doc_id>:<run>``, the run's code point h % length is left out first. A null id counts as
    empty there; null and empty texts have no runs. Counts are combined before they are exchanged.
    """
    run = F.explode(F.regexp_extract_all("text", F.lit(RUNS), F.lit(0)))
    w = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("d"), run.alias("r")).filter(F.length("r") >= shortest)
    w = w.select("d", F.translate("r", UPPER, LOWER).alias("r"))
    if slip:
        h, at = F.crc32(F.concat("d", F.lit(":"), "r")), (F.col("h") % F.length("r")).cast("int")
        w = w.withColumn("h", h).select(F.when(F.col("h") % slip == 0, F.concat(F.substring("r", F.lit(1), at), F.substring("r", at + 2, F.length("r")))).otherwise(F.col("r")).alias("r"))
    return w.filter(F.length("r") >= shortest).groupBy(F.col("r").alias("word")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= often)


def _shared(a: str, b: str) -> int:
    """Code points that two words have in common at the front."""
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if a[:mid] == b[:mid] else (lo, mid - 1)
    return lo


def _along(at: list[int], before: str, word: str, rank: int) -> list[int]:
    """The ranks at which the nodes of ``word`` begin, where ``at`` has those of the word before it: what isn't shared begins here."""
    same = _shared(before, word)
    return at[:same] + [rank] * (len(word) - same)


def _ends(frames):
    """Of a sorted partition: its first and last word, how many it has, and the ranks in it at which the nodes of the last one begin."""
    first, last, n, at, part = None, "", 0, [], None
    for f in frames:
        for part, word in zip(f["part"], f["w"], strict=True):  # noqa: B007
            at, first, last, n = _along(at, last, word, n), word if n == 0 else first, word, n + 1
    if n:
        yield pd.DataFrame({"part": [part], "first": [first], "last": [last], "n": [n], "at": [at]})


def _numbered(start: dict[int, int], carried: dict[int, list[int]]):
    """Numbers the nodes of sorted partitions, that begin at rank ``start`` and share the nodes ``carried`` with the word before them."""

    def run(frames):
        before, at, rank = None, [], 0
        for f in frames:
            ranks, nodes = [], []
            for part, word in zip(f["part"], f["w"], strict=True):
                if before is None:
                    rank, at = start[part], carried[part]
                    before = word[: len(at)]
                at = _along(at, before, word, rank)
                nodes.append(np.concatenate([[0], (np.array(at, np.int64) << DEPTH) + np.arange(1, len(word) + 1)]))  # 0: the root
                ranks.append(rank)
                before, rank = word, rank + 1
            yield f.drop(columns=["part", "w"]).assign(rank=np.array(ranks, np.int64), nodes=nodes)

    return run


def trie_nodes(words: DataFrame, spelled: Column) -> DataFrame:
    """``words`` with rank, the place in the order of ``spelled``, and nodes, the numbers of the trie nodes of depth 0 to length along it.

    Words, which must be distinct, are range-partitioned by their first 64 code points and sorted. A node that reaches into the next partition keeps its number:
    every partition tells its first and last word, and the driver hands on the nodes that neighbours share. It sees one row a partition.
    """
    w = words.withColumns({"w": spelled, "_l": F.substring(spelled, 1, 64)}).repartitionByRange("_l").sortWithinPartitions("_l", "w").drop("_l")
    w = checkpointed(w.withColumn("part", F.spark_partition_id()))
    start, carried, rank, last, nodes = {}, {}, 0, "", []
    for e in w.select("part", "w").mapInPandas(_ends, "part int, first string, last string, n long, at array<long>").orderBy("part").collect():
        start[e.part], carried[e.part] = rank, nodes[: _shared(last, e.first)]
        known = carried[e.part]
        nodes = [known[d] if d < len(known) and r == 0 else rank + r for d, r in enumerate(e["at"])]
        rank, last = rank + e.n, e.last
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in words.schema)
    return w.mapInPandas(_numbered(start, carried), f"{fields}, rank long, nodes array<long>")


def _near(nodes: DataFrame) -> DataFrame:
    """(rank, n_near, best): how many words each word is near to, and n and -rank of the one of largest n; words near none are left out.

    A pair of nodes has the words that agree when a code point is left out there (gaps) and at most one word that is the pair itself. Inserting next to an
    equal code point gives the same word, so only the first of a row of equal code points counts, and each near word is counted once. The two
    best of a pair answer for all its words; no pairs of words are made.
    """
    length = F.size("starts") - 1
    letters = F.split("word", "")
    rises = F.zip_with(letters, F.concat(F.array(F.lit("")), F.slice(letters, F.lit(1), F.greatest(length - 1, F.lit(0)))), lambda a, b: a != b)
    gaps = F.arrays_zip(F.slice("starts", F.lit(1), length).alias("p"), F.reverse(F.slice("ends", F.lit(1), length)).alias("s"), rises.alias("rises"))
    whole = F.arrays_zip(F.col("starts").alias("p"), F.reverse("ends").alias("s"), F.array_repeat(F.lit(True), length + 1).alias("rises"))
    kept = nodes.select("rank", "n", gaps.alias("g"), whole.alias("w"))
    rows = kept.select("rank", "n", F.lit(True).alias("gap"), F.inline("g").alias("p", "s", "rises")).unionByName(kept.select("rank", "n", F.lit(False).alias("gap"), F.inline("w").alias("p", "s", "rises")))
    # Of gaps first the best, then the word itself.
    pair = W.partitionBy("p", "s").orderBy(F.col("gap").desc(), F.col("n").desc(), "rank").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    me = F.struct("gap", "n", (-F.col("rank")).alias("r"))
    value = lambda c: F.when(c["gap"], F.struct(c["n"], c["r"]))
    at = rows.select(
        "rank", "gap", "rises", F.count_if("gap").over(pair).alias("gaps"), F.count_if(F.col("gap") & F.col("rises")).over(pair).alias("rising"), F.first(me).over(pair).alias("a"), F.nth_value(me, 2).over(pair).alias("b"),
        F.max(F.when(F.col("gap") & F.col("rises"), F.struct("n", (-F.col("rank")).alias("r")))).over(pair).alias("riser"), F.max(F.when(~F.col("gap"), F.struct("n", (-F.col("rank")).alias("r")))).over(pair).alias("itself"),
    )
    other = F.when(F.col("a.r") == -F.col("rank"), value(F.col("b"))).otherwise(value(F.col("a")))
    as_gap = F.when(F.col("rises"), F.greatest(other, "itself")).otherwise(other)
    found = at.select("rank", F.when(F.col("gap"), F.col("gaps") - 1 + (F.col("rises") & F.col("itself").isNotNull()).cast("int")).otherwise(F.col("rising")).alias("near"), F.when(F.col("gap"), as_gap).otherwise(F.col("riser")).alias("best"))
    return found.filter("near > 0").groupBy("rank").agg(F.sum("near").alias("n_near"), F.max("best").alias("best"))


def _roots(forms: DataFrame) -> DataFrame:
    """(rank, root) of (rank, form): forms followed to the last. Counts at least double on the way, so a few rounds of doubling reach it."""
    at = checkpointed(forms.select("rank", F.col("form").alias("root")))
    while True:
        nxt = at.select(F.col("rank").alias("_r"), F.col("root").alias("_to"))
        step = checkpointed(at.join(nxt, F.col("root") == F.col("_r"), "left").select("rank", F.coalesce("_to", "root").alias("root"), F.col("_to").isNotNull().alias("more")))
        at = step.drop("more")
        if step.filter("more").isEmpty():
            return at


def spelling_variants(words: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of distinct (word, n): how each word is mostly spelled.

    Two words are near if they differ by exactly one inserted, deleted or replaced code point. A word's form is its near word of largest n (ties: the
    smallest in code-point order) if that is at least LEAD times the word's own n, else null, as is form_n; root is the last of the forms that follow, the
    word itself without a form. n_near counts near words. Words of any length take memory in proportion to it; null words take no part, an empty
    word is near to those of one code point, and an empty table gives no rows. Other columns are ignored.
    """
    w = trie_nodes(words.filter("word IS NOT NULL").select("word", F.col("n").cast("long").alias("n")), F.reverse("word")).withColumnRenamed("nodes", "ends").drop("rank")
    nodes = checkpointed(trie_nodes(w, F.col("word")).withColumnRenamed("nodes", "starts"))
    names = nodes.select("rank", "word", "n")
    best = names.join(_near(nodes), "rank", "left")
    form = F.when(F.col("best.n") >= LEAD * F.col("n"), F.col("best"))
    best = checkpointed(best.select("rank", "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), (-form["r"]).alias("form"), form["n"].alias("form_n")))
    roots = _roots(best.filter("form IS NOT NULL").select("rank", "form"))
    named = lambda c: names.select(F.col("rank").alias(f"_{c}"), F.col("word").alias(f"{c}_word"))
    j = best.join(roots, "rank", "left").join(named("form"), F.col("form") == F.col("_form"), "left").join(named("root"), F.col("root") == F.col("_root"), "left")
    return j.select("word", F.col("form_word").alias("form"), F.coalesce("root_word", "word").alias("root"), "n", "n_near", "form_n")


#: One code point left out at each place spells what neighbours share; edges by replaced, left out and added code points.
ORACLE = f"""
WITH RECURSIVE tab AS (SELECT list(c ORDER BY i) AS tab FROM (SELECT i, list_reduce(range(0, 9), lambda a, x: CASE WHEN x = 0 THEN i::BIGINT WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END, i::BIGINT) AS c FROM range(0, 256) r(i))),
r AS (SELECT coalesce(doc_id::VARCHAR, '') AS d, unnest(regexp_extract_all(text, '[A-Za-z\u00C0-\u00FF]+')) AS r FROM documents),
l AS (SELECT d, translate(r, '{UPPER}', '{LOWER}') AS r, count(*) AS k FROM r WHERE length(r) >= {SHORTEST} GROUP BY ALL),
h AS (SELECT r, k, xor(list_reduce(list_transform(regexp_extract_all(hex(encode(d || ':' || r)), '..'), lambda x: ('0x' || x)::BIGINT), lambda a, x: xor(a // 256, tab[1 + xor(a % 256, x)]), 4294967295::BIGINT), 4294967295) AS h FROM l, tab),
w AS (SELECT CASE WHEN h % {SLIP} = 0 THEN r[:h % length(r)] || r[h % length(r) + 2:] ELSE r END AS w, k FROM h),
v AS (SELECT w AS word, sum(k)::BIGINT AS n FROM w WHERE length(w) >= {SHORTEST} GROUP BY 1 HAVING sum(k) >= {OFTEN}),
g AS (SELECT word, n, i, word[:i] || word[i + 2:] AS left_out, word[:i] || '*' || word[i + 2:] AS pattern FROM (SELECT *, unnest(range(0, length(word))) AS i FROM v)),
e AS (SELECT a.word, b.word AS other, b.n FROM g a JOIN g b ON a.pattern = b.pattern AND a.word <> b.word
  UNION SELECT g.word, v.word, v.n FROM g JOIN v ON g.left_out = v.word UNION SELECT v.word, g.word, g.n FROM g JOIN v ON g.left_out = v.word),
b AS (SELECT word, count(*) AS n_near, first(other ORDER BY n DESC, other) AS other, max(n) AS other_n FROM e GROUP BY 1),
f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= {LEAD} * v.n THEN other END AS form, CASE WHEN other_n >= {LEAD} * v.n THEN other_n END AS form_n FROM v LEFT JOIN b USING (word)),
c AS (SELECT word, word AS root, form AS nxt FROM f UNION ALL SELECT c.word, f.word, f.form FROM c JOIN f ON c.nxt = f.word)
SELECT word, form, root, n, n_near, form_n FROM f JOIN (SELECT word, root FROM c WHERE nxt IS NULL) USING (word)
"""
