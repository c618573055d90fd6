"""Label/value extraction from OCR blocks: inline, adjacent, below a header, and header rows of a table.

Blocks are rows (page_id, block_id, block_number, text, confidence, bbox). Every extractor returns the columns of FIELDS.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from folioframe import presets as P
from folioframe.functions.geometry import has_box, method_confidence, right_of_same_row, table_confidence
from folioframe.functions.similarity import label_score
from folioframe.functions.text import any_of, clean_candidate, fold_digits, let, looks_like_label, may_be_label, may_be_number, may_begin_with_label, may_share_label, normalize_label, normalize_value, pinned, positive, rename_field, valid_positive, valid_survey, valid_table_value, valid_text
from folioframe.operators.runs import dedup_strongest, latest_run, run_confidence, union_fields
from folioframe.operators.store import stored

FIELDS = ("page_id", "field_name", "value", "normalized_value", "confidence", "method", "evidence_block_id", "evidence_bbox", "position")


def in_reading_order(blocks: DataFrame) -> DataFrame:
    """Adds position: rank on the page by y, x and block number; boxless blocks count as at 0, 0."""
    y, x = F.coalesce("bbox.y", F.lit(0.0)), F.coalesce("bbox.x", F.lit(0.0))
    return blocks.withColumn("position", F.row_number().over(W.partitionBy("page_id").orderBy(y, x, "block_number", "block_id")))


def with_next(blocks: DataFrame) -> DataFrame:
    """Adds next_block, the successor on the page in reading order."""
    w = W.partitionBy("page_id").orderBy("position")
    return blocks.withColumn("next_block", F.lead(F.struct("block_id", "text", "confidence", "bbox", "position")).over(w))


def classify(docs: DataFrame, signals: dict = P.CLASS_SIGNALS, least: int = 7, text: str = "text") -> DataFrame:
    """Adds document_type, class_confidence and matched_signals: the first class of strictly highest summed weights."""
    norm = lambda c: F.trim(F.regexp_replace(F.lower(fold_digits(c)), "\\s+", " "))
    docs = pinned(docs, _n=norm(text))
    n = F.col("_n")
    cases = []
    for i, (name, phrases) in enumerate(signals.items()):
        hits = F.array_compact(F.array(*[F.when(n.contains(norm(F.lit(p))), F.struct(F.lit(p).alias("phrase"), F.lit(w).alias("weight"))) for p, w in phrases]))
        score = F.aggregate(hits, F.lit(0), lambda a, h: a + h["weight"])
        cases.append(F.struct(score.alias("score"), F.lit(-i).alias("rank"), F.lit(name).alias("name"), F.transform(hits, lambda h: h["phrase"]).alias("hits")))
    # Structs compare by score, then by the earlier class.
    best = F.array_max(F.array(*cases))
    out = pinned(docs, _best=best)
    s = F.col("_best.score")
    kind = F.when(s < least, "UNKNOWN").otherwise(F.col("_best.name"))
    conf = F.when(s < least, F.least(F.lit(100.0), s * 8.0)).otherwise(F.least(F.lit(98.0), 55.0 + s * 4.0))
    return out.withColumns({"document_type": kind, "class_confidence": conf, "matched_signals": F.when(s > 0, F.col("_best.hits")).otherwise(F.array().cast("array<string>"))}).drop("_best", "_n")


def detect_language(text: Column, first: str = "[\\u0900-\\u097F]", second: str = "[A-Za-z]", names: tuple[str, str, str] = ("mar", "eng", "mar+eng")) -> Column:
    a, b = F.regexp_count(F.coalesce(text, F.lit("")), F.lit(first)), F.regexp_count(F.coalesce(text, F.lit("")), F.lit(second))
    t = a + b
    pa, pb = a / F.greatest(t, F.lit(1)), b / F.greatest(t, F.lit(1))
    return F.when(t == 0, "unknown").when((pa >= 0.35) & (pb >= 0.08), names[2]).when(pa >= 0.55, names[0]).when(pb >= 0.55, names[1]).otherwise(names[2])


def _field(df: DataFrame, name, value: Column, normalized: Column, confidence: Column, method: Column, block: Column | None = None) -> DataFrame:
    b = (lambda k: block[k]) if block is not None else F.col
    return df.select("page_id", (F.lit(name) if isinstance(name, str) else name).alias("field_name"), value.alias("value"), normalized.alias("normalized_value"), confidence.cast("double").alias("confidence"), method.alias("method"), b("block_id").alias("evidence_block_id"), b("bbox").alias("evidence_bbox"), b("position").alias("position"))


def _normal(name: Column, value: Column) -> Column:
    return F.when(name.isin("survey_number", "khata_number", "area"), normalize_value(value, "number")).otherwise(normalize_value(value))


def _by_field(given: dict | None, name: Column, value: Column, otherwise: Column) -> Column:
    """What the callback of a field's name makes of its value, for the fields that have one."""
    for field, make in (given or {}).items():
        otherwise = F.when(name == field, make(value)).otherwise(otherwise)
    return otherwise


def inline_value(name: Column, label: Column, v: Column, units: dict = P.AREA_UNITS) -> Column:
    """What a field takes from the text behind its label, null if that isn't of its form: numbers joined by slashes, a number, an amount with a unit
    of its label or without, or any text."""
    d = fold_digits(v)
    parts = F.transform(F.split(d, "/"), lambda x: F.trim(x))
    unit = F.trim(F.regexp_replace(d, "^[0-9]+([.,][0-9]+)?", ""))
    tight = lambda c: F.regexp_replace(F.lower(c), "\\s+", "")
    allowed = F.create_map(*[x for k, us in units.items() for x in (F.lit(k), F.array(*[tight(F.lit(u)) for u in us]))])[label]
    amount = F.trim(F.substring(v, F.lit(1), F.length(v) - F.length(unit)))
    return (
        F.when(name == "survey_number", F.when(F.forall(parts, lambda x: x.rlike("^[0-9]+$")), v))
        .when(name == "khata_number", F.when(d.rlike("^[0-9]+$"), v))
        .when(name == "area", F.when(fold_digits(amount).rlike("^[0-9]+([.,][0-9]+)?$") & ((unit == "") | F.array_contains(allowed, tight(unit))), amount))
        .otherwise(v)
    )


def extract_inline(blocks: DataFrame, labels: dict = P.INLINE_LABELS, units: dict = P.AREA_UNITS, normalize: dict | None = None, validate: dict | None = None) -> DataFrame:
    """"label: value" in one block.

    What stands before a separator (the second one first, as a label may hold one) is looked up among the labels; what follows is read by the
    form of its field, and dropped if it isn't a valid value. ``normalize`` and ``validate`` map a field to a function of its value's column that
    stands in for the preset's; a value without a normalised form, or not valid or null for its validator, is dropped.
    """
    tight = lambda c: F.regexp_replace(F.lower(c), "\\s+", "")
    known = {"".join(x.split()).lower(): f for f, xs in labels.items() for x in xs}
    own = pinned(blocks.filter(may_begin_with_label("text", known)), _c=clean_candidate("text"))
    own = pinned(own, _one=F.regexp_extract("_c", "^[^:|/-]*", 0), _two=F.regexp_extract("_c", "^[^:|/-]*[:|/-][^:|/-]*(?=[:|/-])", 0))
    said = F.create_map(*[F.lit(x) for kv in known.items() for x in kv])
    split = lambda c: F.when(F.length(c) < F.length("_c"), F.struct(tight(F.col(c)).alias("label"), F.trim(F.substring(F.col("_c"), F.length(c) + 2, F.length("_c"))).alias("rest")))
    hit = pinned(own, _s=F.array_compact(F.array(F.when(F.col("_two") != "", split("_two")), split("_one"))))
    hit = hit.withColumn("_h", F.filter("_s", lambda x: said[x["label"]].isNotNull() & (x["rest"] != ""))).filter(F.size("_h") > 0)
    hit = pinned(hit, _n=said[F.col("_h")[0]["label"]], _l=F.col("_h")[0]["label"], _r=F.col("_h")[0]["rest"])
    hit = pinned(hit, _v=clean_candidate(inline_value(F.col("_n"), F.col("_l"), F.col("_r"), units))).filter("_v <> ''")
    n, v = F.col("_n"), F.col("_v")
    valid = F.when(n == "survey_number", valid_survey(v)).when(n == "khata_number", F.lit(True)).when(n == "area", valid_positive(v)).when(F.length(v) > 120, F.lit(False)).otherwise(valid_text(v, n))
    hit = pinned(hit.filter(_by_field(validate, n, v, valid)), _norm=_by_field(normalize, n, v, _normal(n, v))).filter("_norm <> ''")
    method = F.lit("regex_label")
    return _field(hit, n, v, F.col("_norm"), method_confidence(F.col("confidence"), method), method)


def label_list(labels: dict) -> Column:
    """The dictionary as a literal array of (label_field, label_rank, label)."""
    return F.array(*[F.struct(F.lit(f).alias("label_field"), F.lit(i).alias("label_rank"), normalize_label(F.lit(x), "–—-").alias("label")) for i, (f, xs) in enumerate(labels.items()) for x in xs])


def extract_adjacent(blocks: DataFrame, labels: dict = P.ADJACENT_LABELS, normalize: dict | None = None, validate: dict | None = None) -> DataFrame:
    """A block that is a label, and its successor on the same row to the right.

    Mutation and registration values that look like headers are kept at confidence 25, method spatial_label_value_suspect.
    ``normalize`` and ``validate`` are callbacks by field, as in ``extract_inline``.
    """
    name = F.coalesce(*[F.when(F.col("_l").isin(*xs), F.lit(f)) for f, xs in labels.items()])
    followed = blocks if "next_block" in blocks.columns else with_next(blocks)
    own = pinned(followed.filter(may_be_label("text", [x for xs in labels.values() for x in xs])), _l=normalize_label("text"))
    own = pinned(own, _name=name).filter(F.col("_name").isNotNull() & F.col("next_block").isNotNull())
    own = pinned(own.filter(right_of_same_row(F.col("bbox"), F.col("next_block.bbox"))), _v=clean_candidate(F.col("next_block.text"))).filter("_v <> ''")
    n, v = F.col("_name"), F.col("_v")
    valid = F.when(n == "survey_number", valid_survey(v)).when(n == "khata_number", fold_digits(v).rlike("^[0-9]+$")).when(n == "area", valid_positive(v)).otherwise(valid_text(v, n))
    suspect = n.isin("mutation", "registration") & looks_like_label(v)
    own = pinned(own, _ok=F.coalesce(_by_field(validate, n, v, valid), F.lit(False)), _s=suspect, _norm=_by_field(normalize, n, v, _normal(n, v))).filter("(_ok OR _s) AND _norm <> ''")
    method = F.when(~F.col("_ok") & F.col("_s"), "spatial_label_value_suspect").otherwise("spatial_label_value")
    suspicious = ~F.col("_ok") & F.col("_s")
    conf = F.when(suspicious, 25.0).otherwise(method_confidence(F.col("next_block.confidence"), method))
    return _field(own, n, v, F.col("_norm"), conf, method, F.col("next_block"))


def _headers(blocks: DataFrame, headers: tuple[str, ...]) -> DataFrame:
    return blocks.filter(may_be_label("text", headers) & normalize_label("text").isin(*headers))


def values_below(headers: DataFrame, blocks: DataFrame, dy: float, width: float, left: float = 20.0, right: float = 40.0) -> DataFrame:
    """(header columns as h, block columns): blocks at most ``dy`` under a header whose x is in its column, on the same page.

    A page is cut into bands of height ``dy``; a header meets the blocks of its own band and of the next two (one for rounding), so that the pairs
    that are looked at grow with a page's blocks.
    """
    h = headers.filter(has_box(F.col("bbox"))).select("page_id", F.struct("block_id", "bbox").alias("h"))
    bottom = F.col("h.bbox.y") + F.col("h.bbox.height")
    band = lambda y: F.floor(y / dy).cast("double")
    h = h.withColumn("_band", F.explode(F.array_distinct(F.transform(F.array(*[F.lit(float(k)) for k in range(3)]), lambda k: band(bottom) + k))))
    gap = F.col("bbox.y") - bottom
    inside = F.col("bbox.x").between(F.col("h.bbox.x") - left, F.col("h.bbox.x") + F.greatest(F.col("h.bbox.width"), F.lit(width)) + right)
    own = blocks.filter(has_box(F.col("bbox"))).withColumn("_band", band(F.col("bbox.y")))
    return own.join(h, ["page_id", "_band"]).filter((gap > 0) & (gap <= dy) & inside & (F.col("h.block_id") != F.col("block_id"))).drop("_band")


def top_below(found: DataFrame, k: int) -> DataFrame:
    w = W.partitionBy("page_id", "h.block_id").orderBy("bbox.y", "bbox.x", "block_number", "block_id")
    return found.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k).drop("_r")


def extract_owner_rows(blocks: DataFrame, headers: tuple[str, ...] = P.OWNER_HEADERS, dy: float = 260, width: float = 240, k: int = 2) -> DataFrame:
    """Values are read only where they stand below a header."""
    found = pinned(values_below(_headers(blocks, headers), blocks, dy, width), _v=clean_candidate("text"))
    v = F.col("_v")
    own = pinned(found, _ok=valid_text(v, "owner") & ~looks_like_label(v)).filter("_ok")
    method = F.lit("owner_table_row")
    return _field(top_below(own, k), "owner", v, normalize_value(v), method_confidence(F.col("confidence"), method), method)


def extract_area_rows(blocks: DataFrame, headers: tuple[str, ...] = P.AREA_HEADERS, dy: float = 280, width: float = 180, k: int = 10) -> DataFrame:
    plain = lambda c: c.rlike("^[0-9]+([.,][0-9]+)?\\z")  # noqa: E731  # such a number is clean and normal as it is
    numbers = pinned(blocks.filter(may_be_number("text")), _v=F.when(plain(F.col("text")), F.col("text")).otherwise(clean_candidate("text")))
    v, n = F.col("_v"), F.col("_n")
    numbers = pinned(numbers, _n=F.when(plain(v), v).otherwise(normalize_value(v, "number"))).filter(positive(n))
    own = values_below(_headers(blocks, headers), numbers, dy, width)
    method = F.lit("area_table_row")
    return _field(top_below(own, k), "area", v, n, method_confidence(F.col("confidence"), method), method)


def cluster_rows(blocks: DataFrame) -> DataFrame:
    """Adds row_idx (0 from the top) and row_size: a new row starts where the centre is further from the one before than max(18, 0.9 x the smaller height)."""
    own = blocks.filter(has_box(F.col("bbox"))).withColumn("_cy", F.col("bbox.y") + F.col("bbox.height") / 2)
    w = W.partitionBy("page_id").orderBy("_cy", "bbox.x", "block_number", "block_id")
    far = F.col("_cy") - F.lag("_cy").over(w) > F.greatest(F.lit(18.0), 0.9 * F.least("bbox.height", F.lag("bbox.height").over(w)))
    own = own.withColumn("_new", F.coalesce(far, F.lit(False)).cast("int")).withColumn("row_idx", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)).cast("int"))
    return own.withColumn("row_size", F.count(F.lit(1)).over(W.partitionBy("page_id", "row_idx"))).drop("_cy", "_new")


def cluster_rows_greedy(blocks: DataFrame, least: int = 1) -> DataFrame:
    """Adds row_idx (in the order in which rows begin) and row_size: from the top, a block joins the nearest row centre within max(18, 0.9 x the smaller height); centres are running means.

    A fold over a page's sorted blocks, in the JVM. Its state has the rows that are open: one that a block is too far below takes none of the later ones. Of two equally near rows the
    earlier takes the block. One task holds a page's blocks. Blocks without a box are left out, and so are pages with fewer than ``least`` others.
    """
    own = blocks.filter(has_box(F.col("bbox")))
    b = F.struct((F.col("bbox.y") + F.col("bbox.height") / 2).cast("double").alias("cy"), F.col("bbox.x").alias("x"), F.col("block_id").alias("id"), F.col("bbox.height").cast("double").alias("h"), F.struct(*own.columns).alias("b"))
    pages = own.groupBy(F.col("page_id").alias("_page")).agg(F.array_sort(F.collect_list(b)).alias("_b")).filter(F.size("_b") >= least)
    start = F.struct(F.array().cast("array<struct<c:double,h:double,n:int,i:int>>").alias("open"), F.lit(0).alias("rows"), F.array().cast("array<int>").alias("of"))

    def step(s: Column, x: Column) -> Column:
        reach = lambda h: F.greatest(F.lit(18.0), 0.9 * h)
        still = F.filter(s["open"], lambda r: x["cy"] - r["c"] <= reach(r["h"]))

        def put(still: Column) -> Column:
            near = F.filter(F.transform(still, lambda r: F.struct(F.abs(x["cy"] - r["c"]).alias("d"), r["i"].alias("i"), F.least(x["h"], r["h"]).alias("h"))), lambda r: r["d"] <= reach(r["h"]))

            def joined(at: Column) -> Column:
                grown = F.transform(still, lambda r: F.when(r["i"] == at, F.struct((r["c"] + (x["cy"] - r["c"]) / (r["n"] + 1)).alias("c"), F.greatest(r["h"], x["h"]).alias("h"), (r["n"] + 1).alias("n"), r["i"].alias("i"))).otherwise(r))
                fresh = F.concat(still, F.array(F.struct(x["cy"].alias("c"), x["h"].alias("h"), F.lit(1).alias("n"), s["rows"].alias("i"))))
                return F.struct(F.when(at.isNull(), fresh).otherwise(grown).alias("open"), (s["rows"] + at.isNull().cast("int")).alias("rows"), F.concat(s["of"], F.array(F.coalesce(at, s["rows"]))).alias("of"))

            return let(F.array_min(near)["i"], joined)

        return let(still, put)

    pages = pinned(pages, _of=F.aggregate("_b", start, step)["of"])
    # Rows stay with their page, so they are counted where they are.
    out = pages.select("_page", F.inline(F.arrays_zip(F.transform("_b", lambda x: x["b"]).alias("b"), F.col("_of").alias("row_idx")))).toDF("_page", "b", "row_idx")
    return out.select("b.*", "row_idx", F.count(F.lit(1)).over(W.partitionBy("_page", "row_idx")).cast("int").alias("row_size"))


def _known_labels(labels: dict) -> list:
    """The rows of ``label_list``, worked out once, so that the list and its words are literals for each block."""
    return SparkSession.active().range(1).select(F.inline(label_list(labels))).collect()


def _named_labels(text: Column, known: list, least: float) -> tuple[Column, Column]:
    """(may there be any, the labels) that ``text`` may reach ``least`` with, above 0.65: those that share a word with it, hold it or are in it.

    A score is 0.65 of the likeness and 0.35 of the shared words, so above 0.65 one word at least is shared, unless one holds the other. A text that is
    too long to be alike enough has to hold a label. Whether there may be any is told without a list.
    """
    every = F.array(*[F.struct(F.lit(r.label_field).alias("label_field"), F.lit(r.label).alias("label"), F.lit(r.label_rank).alias("label_rank"), F.array(*map(F.lit, r.label.split(" "))).alias("words")) for r in known])
    words = F.array(*map(F.lit, dict.fromkeys(w for r in known for w in r.label.split(" "))))
    shared = F.array_intersect(F.split(text, " "), words)
    hit = lambda got: F.filter(every, lambda x: F.arrays_overlap(x["words"], got) | text.contains(x["label"]) | x["label"].contains(text))
    # A likeness of r, of whichever method, needs lengths a <= b * (2 / r - 1).
    longest = max(len(r.label) for r in known) * (2 * 0.65 / (least - 0.35) - 1)
    every_label = list(dict.fromkeys(r.label for r in known))
    held = F.arrays_overlap(F.split(text, " "), words) | any_of([F.lit(x).contains(text) for x in every_label])
    may = ((F.length(text) <= int(longest) + 1) & held) | any_of([text.contains(F.lit(x)) for x in every_label])
    return may, F.transform(let(shared, hit), lambda x: F.struct(x["label_field"].alias("label_field"), x["label"].alias("label"), x["label_rank"].alias("label_rank")))


def score_headers(blocks: DataFrame, labels: dict = P.TABLE_LABELS, method: str = "levenshtein", least: float = 0.0) -> DataFrame:
    """Every block against every label: (block columns, label_field, label, label_rank, header_score). The label list is a small literal.

    Pairs that can't reach ``least`` are left out before they are compared: above 0.65 they have to share a word or hold each other, which an index
    of the labels' words tells; below, an edit-distance ratio is at most the shorter length over the longer.
    """
    known = _known_labels(labels) if least > 0.65 else []
    own = blocks.filter(may_share_label("text", [r.label for r in known])) if known else blocks
    own = pinned(own, _n=normalize_label("text", "–—-")).filter("_n <> ''")
    if known:
        may, named = _named_labels(F.col("_n"), known, least)
        own = own.filter(may).withColumn("_l", F.explode(named))
    else:
        own = own.withColumn("_l", F.explode(label_list(labels)))
    own = own.select(*blocks.columns, "_n", "_l.*")
    if 0 < least <= 0.65 and method == "levenshtein":
        a, b = F.length("_n"), F.length("label")
        own = own.filter((0.65 * F.least(a, b) / F.greatest(a, b) + 0.35 >= least) | F.col("_n").contains(F.col("label")) | F.col("label").contains(F.col("_n")))
    return pinned(own, header_score=label_score(F.col("_n"), F.col("label"), method)).drop("_n")


def best_headers(scored: DataFrame, thresholds: dict = P.TABLE_THRESHOLDS, otherwise: float = 0.70) -> DataFrame:
    """The strongest label of each block, if above its field's threshold; of these the strongest block of each page and field."""
    best = W.partitionBy("page_id", "block_id").orderBy(F.col("header_score").desc(), "label_rank", "label")
    least = F.coalesce(F.create_map(*[F.lit(x) for kv in thresholds.items() for x in kv])[F.col("label_field")], F.lit(otherwise))
    own = scored.withColumn("_r", F.row_number().over(best)).filter((F.col("_r") == 1) & (F.col("header_score") >= least))
    one = W.partitionBy("page_id", "label_field").orderBy(F.col("header_score").desc(), "block_number", "block_id")
    return own.withColumn("_r", F.row_number().over(one)).filter("_r = 1").drop("_r")


def resolve_header_values(headers: DataFrame, rows: DataFrame, labels: dict = P.TABLE_LABELS) -> DataFrame:
    """Best value of each header: (page_id, label_field, header_score, relation_score, v) with v the value block.

    Values are valid blocks of the next four rows in the header's column, or to its right if its row has two blocks at most
    and the block isn't a header itself.
    """
    h = headers.select("page_id", "label_field", "header_score", F.struct("block_id", "bbox", "row_idx", "row_size", "confidence").alias("h"))
    v = rows.select("page_id", F.struct("block_id", "text", "bbox", "row_idx", "confidence", "position").alias("v"))
    j = h.join(v, "page_id").filter((F.col("h.block_id") != F.col("v.block_id")) & (F.col("v.row_idx") - F.col("h.row_idx")).between(0, 4))
    hb, vb = F.col("h.bbox"), F.col("v.bbox")
    step = F.col("v.row_idx") - F.col("h.row_idx")
    dx = F.abs((vb["x"] + vb["width"] / 2) - (hb["x"] + hb["width"] / 2))
    limit = F.greatest(F.lit(90.0), 2.2 * hb["width"], 0.18 * F.greatest(hb["width"], vb["width"]))
    under = (step >= 1) & (dx <= limit) & (vb["y"] - (hb["y"] + hb["height"]) <= 520)
    below = 0.55 * (1 - step / 5) + 0.45 * (1 - dx / limit)
    gap = vb["x"] - (hb["x"] + hb["width"])
    level = F.abs((vb["y"] + vb["height"] / 2) - (hb["y"] + hb["height"] / 2)) <= F.greatest(F.lit(24.0), F.least(hb["height"], vb["height"]))
    beside = (step == 0) & (F.col("h.row_size") <= 2) & (gap >= -10) & level
    # Texts are read only where they stand right.
    j = pinned(j.filter(under | beside), _fine=valid_table_value(F.col("label_field"), F.col("v.text"))).filter("_fine")
    j = pinned(j, _vn=F.when(~under, normalize_label("v.text", "–—-")))
    may, named = _named_labels(F.col("_vn"), _known_labels(labels), 0.82)
    j = pinned(j, _known=F.when(~under & may, F.exists(named, lambda x: label_score(F.col("_vn"), x["label"]) >= 0.82)).otherwise(F.lit(False)))
    score = F.when(under, below).when(beside & ~F.col("_known"), 0.65 + 0.35 * F.greatest(F.lit(0.0), 1 - gap / 1000))
    j = pinned(j, relation_score=score).filter("relation_score IS NOT NULL")
    w = W.partitionBy("page_id", "label_field").orderBy(F.col("relation_score").desc(), F.col("v.confidence").desc_nulls_last(), F.col("v.position"))
    return j.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def extract_table_fields(blocks: DataFrame, labels: dict = P.TABLE_LABELS) -> DataFrame:
    """Header rows and the values under them, of pages with at least two usable blocks."""
    usable = stored(cluster_rows_greedy(blocks.filter(F.trim(F.coalesce("text", F.lit(""))) != ""), least=2))
    got = resolve_header_values(best_headers(score_headers(usable, labels, least=0.70)), usable, labels)
    v = clean_candidate(F.col("v.text"), " .,:;|/")
    f = F.col("label_field")
    norm = F.when(f.isin("survey_number", "account_number", "cultivable_area"), F.regexp_replace(normalize_value(v, "number"), "^[.-]+|[.-]+$", "")).when(f == "subdivision", normalize_value(v, "number")).otherwise(F.lower(clean_candidate(fold_digits(v))))
    conf = table_confidence(F.coalesce("v.confidence", "h.confidence"), F.col("header_score"), F.col("relation_score"))
    got = pinned(got, _v=v, _n=norm).filter("_n <> ''")
    out = _field(got, rename_field("label_field"), F.col("_v"), F.col("_n"), conf, F.lit("table_header_value"), F.col("v"))
    return dedup_strongest(out.withColumn("field_id", F.col("evidence_block_id")), "page_id").drop("field_id")


def extract_fields(blocks: DataFrame, normalize: dict | None = None, validate: dict | None = None) -> DataFrame:
    """All extractors, the strongest evidence of each value, in reading order. The ordered blocks are stored once for all of them,
    those that may be labels with the block that follows.

    ``normalize`` and ``validate`` go to the label extractors.
    """
    followed = stored(with_next(in_reading_order(blocks)).withColumn("next_block", F.when(may_be_label("text", [x for xs in P.ADJACENT_LABELS.values() for x in xs]), F.col("next_block"))))
    b = followed.drop("next_block")
    labelled = (extract_inline(b, normalize=normalize, validate=validate), extract_adjacent(followed, normalize=normalize, validate=validate))
    parts = [d.select(*FIELDS) for d in (extract_table_fields(b), *labelled, extract_owner_rows(b), extract_area_rows(b))]
    every = union_fields(*parts).withColumn("field_id", F.col("evidence_block_id"))
    return dedup_strongest(every, "page_id").drop("field_id")


def reading_order(fields: DataFrame) -> DataFrame:
    return fields.orderBy("page_id", "position", "field_name", "normalized_value")


def extract_documents(pages: DataFrame, runs: DataFrame, blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(fields, runs): extraction on each page's newest completed OCR run; per run the mean confidence and a status."""
    newest = latest_run(runs, key="page_id")
    own = blocks.join(newest.select("run_id"), "run_id", "left_semi")
    fields = extract_fields(own.drop("run_id")).join(newest.select("page_id", "run_id"), "page_id").join(pages.select("page_id", "document_id"), "page_id")
    per = newest.join(run_confidence(fields).withColumnRenamed("confidence", "extraction_confidence"), "run_id", "left")
    return fields, per.select("run_id", "page_id", "extraction_confidence", F.lit("COMPLETED").alias("extraction_status"))


def link_evidence(fields: DataFrame, blocks: DataFrame) -> DataFrame:
    """(field columns, ocr_text, evidence_order): each field with the block it was read from."""
    b = blocks.select(F.col("block_id").alias("evidence_block_id"), F.col("text").alias("ocr_text"))
    return fields.join(b, "evidence_block_id").withColumn("evidence_order", F.lit(0))
