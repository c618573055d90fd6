"""Quality evaluation: ground truth in long form, recall, similarity, coverage and error rates, per field and overall."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from folioframe.functions.similarity import cer, similarity, wer
from folioframe.functions.text import basename, eval_text, is_evaluable, pinned
from folioframe.operators.store import stored


def melt_truth(wide: DataFrame, fields: tuple[str, ...], key: str = "image") -> DataFrame:
    """(key, field, value, status): one row for each of the wide table's fields."""
    cells = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value"), F.col(f"{f}_status").cast("string").alias("status")) for f in fields])
    return wide.select(key, F.explode(cells).alias("_c")).select(key, "_c.*")


def field_visibility(truth: DataFrame, texts: DataFrame, key: str = "image", fuzzy: float = 0.80) -> DataFrame:
    """(key, field, value, exact, similarity, fuzzy) of evaluable values: are they in the page's text?"""
    own = pinned(truth.filter(is_evaluable("status", "value")), _v=eval_text("value"))
    j = own.join(pinned(texts.select(key, "text"), _t=eval_text("text")), key)
    exact = F.col("_t").contains(F.col("_v")) & (F.col("_v") != "")
    near = F.when(F.col("_v") == "", 0.0).when(exact, 1.0).otherwise(similarity(F.col("_v"), F.col("_t")))
    return j.select(key, "field", "value", exact.alias("exact"), near.alias("similarity")).withColumn("fuzzy", F.col("similarity") >= fuzzy)


def word_positions(texts: DataFrame, text: str = "text") -> DataFrame:
    """(at, pos, word, t): the words of every normalised text with their places; ``at`` is a key of 128 bits of the row, t its other columns, with the first word only."""
    keep = [F.col(f"`{c}`") for c in texts.columns if c != text]
    t = pinned(texts, _d=eval_text(F.col(f"`{text}`")))
    key = F.struct(F.xxhash64(*keep).alias("a") if keep else F.lit(0).cast("long").alias("a"), F.xxhash64("_d", F.lit(1)).alias("b"))
    # A text is hashed once, before it becomes words.
    t = t.select(F.inline(F.array(F.struct(key.alias("at"), F.struct(*keep).alias("_t"), F.split("_d", " ").alias("_w"))))).select("at", "_t", F.posexplode("_w").alias("pos", "word"))
    return t.select("at", "pos", "word", F.when(F.col("pos") == 0, F.col("_t")).alias("t"))


def _matching_words(pieces: DataFrame, words: DataFrame) -> DataFrame:
    """(kind, piece, word, n): the words that a value's piece can stand in: ``all`` of a word, its ``end``, its ``start``, or ``any`` part of it.

    Words spell their parts of the lengths that pieces have, and parts and pieces are joined as they are; words are those of the texts, each once.
    """
    of = lambda kind: pieces.filter(F.col("kind") == kind).select("piece").distinct()
    spelled = {
        "all": lambda w, n: F.array(w), "end": lambda w, n: F.transform(n, lambda x: F.right(w, x)), "start": lambda w, n: F.transform(n, lambda x: F.left(w, x)),
        "any": lambda w, n: F.array_distinct(F.flatten(F.transform(n, lambda x: F.transform(F.sequence(F.lit(1), F.length(w) - x + 1), lambda s: F.substring(w, s, x))))),
    }
    out = None
    for kind, parts in spelled.items():
        lengths = of(kind).agg(F.collect_set(F.length("piece")).alias("lengths"))  # one row, of at most as many numbers as a word is long
        own = words.join(F.broadcast(lengths)) if kind != "all" else words.withColumn("lengths", F.array(F.length("word")))
        own = pinned(own, _n=F.filter("lengths", lambda x: x <= F.length("word"))).select("word", "n", F.explode(parts(F.col("word"), F.col("_n"))).alias("piece"))
        found = own.join(of(kind), "piece").select(F.lit(kind).alias("kind"), "piece", "word", "n")
        out = found if out is None else out.unionByName(found)
    return out


def values_in_texts(values: DataFrame, texts: DataFrame, value: str = "value", text: str = "text") -> DataFrame:
    """(value columns, text columns but the texts) of every value that occurs in a text, both normalised: all values against all texts.

    An index of words with their places answers a value by its rarest piece: the value's inner words are words of the text, its first and
    last are the end and the start of one, and a single word is part of one. Where the rarest piece stands tells where the others have to; they
    are looked up there, by text and place. Texts are not exchanged, only words, and what is exchanged grows with them, whatever the values'
    lengths. Normalised values that are empty occur nowhere; a text that holds a value several times comes out once, repeated rows as often as they are there.
    """
    v = pinned(values.select(F.struct("*").alias("v")), n=eval_text(F.col(f"v.`{value}`"))).filter("n <> ''")
    v = pinned(v, q=F.md5("n"))
    q = pinned(v.select("q", "n").distinct(), w=F.split("n", " ")).withColumn("k", F.size("w"))
    kind = F.when(F.col("k") == 1, "any").when(F.col("i") == 0, "end").when(F.col("i") == F.col("k") - 1, "start").otherwise("all")
    pieces = q.select("q", "k", F.posexplode("w").alias("i", "piece")).withColumn("kind", kind)
    rows = stored(word_positions(texts, text))
    index = rows.select("at", "pos", "word")
    match = stored(_matching_words(pieces, index.groupBy("word").agg(F.count(F.lit(1)).alias("n"))))
    often = match.groupBy("kind", "piece").agg(F.sum("n").alias("n"))
    # A value with a piece that no text holds occurs nowhere.
    anchor = pieces.join(often, ["kind", "piece"]).groupBy("q", "k").agg(F.count(F.lit(1)).alias("have"), F.min_by(F.struct("kind", "piece", "i"), F.struct("n", "i")).alias("r")).filter("have = k").select("q", "k", "r.*")
    # Stored, so that the words are not exchanged where few of them, or few texts, are asked for.
    asked = stored(anchor.join(match.select("kind", "piece", "word"), ["kind", "piece"]).select("q", "k", "i", "word"))
    begun = stored(index.join(asked, "word").select("q", "k", "at", (F.col("pos") - F.col("i")).alias("begin"), "i").filter("begin >= 0"))
    single = begun.filter("k = 1").select("q", "at")
    # What else the value needs, at its place.
    rest = begun.filter("k > 1").withColumnRenamed("i", "known").join(pieces.select("q", "i", "piece", "kind"), "q").filter("i <> known").withColumn("pos", F.col("begin") + F.col("i"))
    ok = F.when(F.col("kind") == "all", F.col("word") == F.col("piece")).when(F.col("kind") == "end", F.endswith("word", "piece")).otherwise(F.startswith("word", "piece"))
    near = index.join(begun.filter("k > 1").select("at").distinct(), "at", "left_semi")
    whole = rest.join(near, ["at", "pos"]).filter(ok).groupBy("q", "k", "at", "begin").agg(F.count(F.lit(1)).alias("have")).filter("have = k - 1").select("q", "at")
    found = single.unionByName(whole).distinct()
    return v.join(found, "q").join(rows.filter("pos = 0").select("at", "t"), "at").select("v.*", "t.*")


def _per_field(df: DataFrame, *aggregates) -> DataFrame:
    """Aggregates for each field, and for all under the name OVERALL."""
    return df.rollup("field").agg(*aggregates, F.grouping("field").alias("_g")).withColumn("field", F.when(F.col("_g") == 1, "OVERALL").otherwise(F.col("field"))).drop("_g")


def field_benchmark(pairs: DataFrame) -> DataFrame:
    """Recall of values in texts: pairs (field, exact, fuzzy, similarity)."""
    return _per_field(pairs, F.count(F.lit(1)).alias("evaluable"), F.avg(F.col("exact").cast("int")).alias("exact_recall"), F.avg(F.col("fuzzy").cast("int")).alias("fuzzy_recall"), F.avg("similarity").alias("mean_similarity"))


def retrieval_benchmark(pairs: DataFrame) -> DataFrame:
    """Found-in-text recall: pairs (field, found)."""
    return _per_field(pairs, F.count(F.lit(1)).alias("evaluable"), F.count_if("found").alias("found"), F.avg(F.col("found").cast("int")).alias("recall"))


def timing_summary(timings: DataFrame) -> DataFrame:
    return timings.agg(F.count(F.lit(1)).alias("pages"), F.sum("seconds").alias("total_seconds"), F.avg("seconds").alias("mean_seconds"), F.max("seconds").alias("slowest"), F.min("seconds").alias("fastest"))


def scored(preds: DataFrame, truth: DataFrame, numeric: tuple[str, ...] = (), key: str = "image", method: str = "levenshtein") -> DataFrame:
    """(key, field, value, prediction, extracted, exact, similarity): evaluable truth of documents that have predictions, joined by file basename."""
    t = truth.filter(is_evaluable("status", "value", lenient=True)).withColumn("_b", basename(key))
    p = preds.select(basename(key).alias("_b"), "field", F.col("value").alias("prediction"))
    docs = preds.select(basename(key).alias("_b")).distinct()
    j = t.join(docs, "_b", "left_semi").join(p, ["_b", "field"], "left")
    n = lambda c: F.when(F.col("field").isin(*numeric), eval_text(c, "number")).otherwise(eval_text(c, "html"))
    j = j.withColumns({"_t": n("value"), "_p": n("prediction")})
    return j.select(F.col("_b").alias(key), "field", "value", "prediction", (F.trim(F.coalesce("prediction", F.lit(""))) != "").alias("extracted"), ((F.col("_t") != "") & (F.col("_t") == F.col("_p"))).alias("exact"), similarity(F.col("_t"), F.col("_p"), method).alias("similarity"))


def extraction_accuracy(rows: DataFrame) -> DataFrame:
    """Coverage, exact recall and mean similarity of scored rows."""
    return _per_field(rows, F.count(F.lit(1)).alias("evaluable"), F.count_if("extracted").alias("extracted"), F.count_if("exact").alias("exact"), F.avg(F.col("extracted").cast("int")).alias("coverage"), F.avg(F.col("exact").cast("int")).alias("exact_recall"), F.avg("similarity").alias("mean_similarity"))


def failures(rows: DataFrame) -> DataFrame:
    return rows.filter("NOT exact")


def error_rates(pairs: DataFrame) -> DataFrame:
    """Mean CER and WER of pairs (ref, pred); empty references are counted apart and left out of the means."""
    blank = eval_text("ref", "cer") == ""
    own = pairs.select(blank.alias("blank"), cer(F.col("ref"), F.col("pred")).alias("cer"), wer(F.col("ref"), F.col("pred")).alias("wer"))
    mean = lambda c: F.avg(F.when(~F.col("blank"), F.col(c)))
    return own.agg(F.count(F.lit(1)).alias("samples"), F.count_if("blank").alias("empty_references"), mean("cer").alias("mean_cer"), mean("wer").alias("mean_wer"))


def annotation_progress(truth: DataFrame, key: str = "image") -> DataFrame:
    """Per sample: fields, reviewed fields, complete; and all samples under OVERALL."""
    done = F.count_if(F.trim(F.coalesce("status", F.lit(""))) != "")
    out = truth.rollup(key).agg(F.count(F.lit(1)).alias("fields"), done.alias("reviewed"), F.grouping(key).alias("_g"))
    return out.select(F.when(F.col("_g") == 1, "OVERALL").otherwise(F.col(key).cast("string")).alias(key), "fields", "reviewed", (F.col("fields") == F.col("reviewed")).alias("complete"))


def join_truth(preds: DataFrame, truth: DataFrame, key: str = "image") -> tuple[DataFrame, DataFrame]:
    """(joined, unmatched): predictions with the truth of their basename, and distinct documents without any."""
    p = preds.withColumn("_b", basename(key))
    t = truth.withColumn("_b", basename(key)).drop(key)
    return p.join(t, "_b"), p.join(t, "_b", "left_anti").select(F.col("_b").alias(key)).distinct()


def missing_pages(truth: DataFrame, cached: DataFrame, key: str = "image") -> DataFrame:
    """Distinct truth pages that a cached benchmark lacks."""
    return truth.select(basename(key).alias(key)).distinct().join(cached.select(basename(key).alias(key)), key, "left_anti")


def report(overall: DataFrame, per_field: DataFrame, rows: DataFrame, key: str = "image") -> DataFrame:
    """One nested row a document: its fields; with the overall and per-field summaries as small literal columns of the report's first part."""
    docs = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("field", "exact", "similarity"))).alias("fields"))
    summary = per_field.groupBy().agg(F.array_sort(F.collect_list(F.struct(*per_field.columns))).alias("field_summary"))
    head = overall.withColumn("_1", F.lit(1)).join(summary.withColumn("_1", F.lit(1)), "_1").drop("_1").select(F.lit("summary").alias("part"), F.to_json(F.struct("*")).alias("content"))
    return head.unionByName(docs.select(F.lit("document").alias("part"), F.to_json(F.struct("*")).alias("content")))
