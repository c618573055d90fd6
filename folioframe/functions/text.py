"""Normalisers, predicates and text helpers as column expressions.

Digits are transliterated before any numeric pattern, character classes are explicit (letters, marks and digits of any
script), and lower-casing replaces full case folding; null counts as the empty string unless said otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StringType

from folioframe import presets as P

LETTER = "[A-Za-z\\u0900-\\u097F]"
SPACES = "[\\s\\u00A0]+"


def text(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def let(value: Column, f) -> Column:
    """f(value) with value computed once, however often f uses it."""
    return F.transform(F.array(value), f)[0]


def pinned(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns that are computed once for each row.

    They come out of a generator of one row, so that expressions on top of them, and filters that are pushed down, refer to
    their values instead of repeating how they are made.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def apart(df: DataFrame, **columns: Column) -> DataFrame:
    """``pinned`` for many patterns at once: they are evaluated in a lambda, one by one.

    A stage's expressions become one method, and one of more than 8,000 bytes of byte code is never compiled by the JVM. A Python function can't stand in a lambda.
    """
    return df.select("*", F.inline(F.transform(F.array(F.lit(0)), lambda _: F.struct(*[c.alias(n) for n, c in columns.items()]))))


def fold_digits(c: Column | str) -> Column:
    return F.translate(text(c), P.DEVANAGARI_DIGITS, "0123456789")


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, SPACES, " "))


def strip(c: Column, chars: str) -> Column:
    """Removes any of ``chars`` from both ends."""
    inner = "".join("\\" + x if x in "\\]^-[" else x for x in chars)
    return F.regexp_replace(c, f"^[{inner}]+|[{inner}]+$", "")


def clean_candidate(c: Column | str, chars: str = " .,:;|/-") -> Column:
    return strip(squeeze(text(c)), chars)


def normalize_label(c: Column | str, dashes: str = "-") -> Column:
    x = F.lower(F.trim(fold_digits(c)))
    x = F.regexp_replace(x, "[/|.:,;()\\[\\]{}#\\\\]", " ")
    return squeeze(F.regexp_replace(x, f"[{dashes}]", " "))


def any_of(conditions: list[Column]) -> Column:
    """Whether any holds, nested no deeper than it has to be."""
    half = len(conditions) // 2
    return any_of(conditions[:half]) | any_of(conditions[half:]) if half else conditions[0]


def _spelled(label: str, between: str) -> str:
    """A pattern of a label's characters, with ``between`` among them; a digit may be of either script."""
    return between.join(f"[{x}{P.DEVANAGARI_DIGITS[int(x)]}]" if x in "0123456789" else f"\\Q{x}\\E" for x in label)


def may_be_label(c: Column | str, labels) -> Column:
    """False only where ``normalize_label`` gives none of ``labels``: one look at the text's start instead of the normaliser's patterns over all of it."""
    gap = "[\\s\\u00A0/|.:,;()\\[\\]{}#\\\\–—-]"
    words = "|".join(f"{gap}+".join(_spelled(w, "") for w in x.split()) for x in labels)
    return F.lower(text(c)).rlike(f"^{gap}*(?:{words}){gap}*\\z")


def may_begin_with_label(c: Column | str, tight_labels) -> Column:
    """False only where no label, white space aside, stands before a separator at the start of ``clean_candidate``."""
    space = "[\\s\\u00A0]*"
    return F.lower(text(c)).rlike(f"^[\\s\\u00A0.,:;|/-]*(?:{'|'.join(_spelled(x, space) for x in tight_labels)}){space}[:|/-]")


def may_share_label(c: Column | str, labels) -> Column:
    """False only where ``normalize_label`` shares no word with any of ``labels``, which are normalised, and neither holds the other."""
    words = dict.fromkeys(w for x in labels for w in x.split())
    if any(x.isdigit() for w in words for x in w):
        return F.lit(True)
    raw, first = F.lower(text(c)), [ord(w[0]) for w in words if ord(w[0]) > 127]
    inner = "".join(f"\\x{{{ord(x):x}}}" for x in sorted({x for w in words for x in w}))
    looks = [raw.rlike(f"^[{inner}\\s\\u00A0/|.:,;()\\[\\]{{}}#\\\\–—-]*\\z")]
    if first:
        looks.append(raw.rlike(f"[\\x{{{min(first):x}}}-\\x{{{max(first):x}}}]"))
    return any_of(looks + [raw.contains(F.lit(w)) for w in words if ord(w[0]) <= 127])


def may_be_number(c: Column | str) -> Column:
    """False only where ``clean_candidate`` isn't digits and a point."""
    return text(c).rlike(f"^[0-9{P.DEVANAGARI_DIGITS}\\s\\u00A0.,:;|/-]+\\z")


def normalize_value(c: Column | str, kind: str = "text") -> Column:
    x = fold_digits(c)
    if kind == "number":
        return F.regexp_replace(x, SPACES, "")
    return F.lower(strip(squeeze(x), ".,;:()[]{}"))


@F.pandas_udf(StringType())
def nfkc(a):
    """Unicode compatibility composition, batch-wise; Spark has no built-in for it."""
    import unicodedata

    return a.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def entity_text(c: Column | str, compose: bool = False) -> Column:
    """Folded text of an entity; with ``compose`` compatibility characters (full-width, ligatures) are composed first."""
    x = F.lower(nfkc(text(c)) if compose else text(c))
    x = F.regexp_replace(x, "\\u0964", ".")
    x = F.regexp_replace(x, "[\\u200B-\\u200F\\u202A-\\u202E]", "")
    x = squeeze(F.regexp_replace(x, "[^\\p{L}\\p{M}\\p{N}_\\s./-]", " "))
    return F.regexp_replace(F.regexp_replace(x, "(?<![\\p{L}\\p{M}\\p{N}_])gat(?![\\p{L}\\p{M}\\p{N}_])", "survey"), "(?<![\\p{L}\\p{M}\\p{N}_])गट(?![\\p{L}\\p{M}\\p{N}_])", "survey")


def entity_number(c: Column | str, legacy: bool = False) -> Column:
    """Digits, dots and slashes; with ``legacy`` slashes go too, so that 124/3 equals 1243."""
    return F.regexp_replace(F.regexp_replace(fold_digits(c), "[^0-9.]" if legacy else "[^0-9./]", ""), "\\.+$", "")


def eval_text(c: Column | str, variant: str = "benchmark", cleaned: bool = False) -> Column:
    """Normalisers of the evaluations: benchmark, cer (white space only), html, compact (letters and digits), digits, number.

    html and number clean a cell first, unless it is ``cleaned``.
    """
    if variant == "cer":
        return squeeze(F.regexp_replace(text(c), "\\u200B", " "))
    x = fold_digits(clean_html_cell(c) if variant in ("html", "number") and not cleaned else c)
    if variant == "digits":
        return F.regexp_replace(x, "[^0-9]", "")
    if variant == "number":
        return F.regexp_extract(F.replace(x, F.lit(" "), F.lit("")), "[0-9]+(/[0-9]+)*", 0)
    x = F.lower(F.trim(x))
    if variant == "compact":
        return F.regexp_replace(x, "[^\\p{L}\\p{M}\\p{N}_]+", "")
    if variant == "html":
        return squeeze(F.regexp_replace(F.regexp_replace(x, "[“”\"‘’]", ""), "[^\\p{L}\\p{M}\\p{N}_/.-]+", " "))
    x = F.regexp_replace(x, "[–—−]", "-")
    return squeeze(F.regexp_replace(x, "[^\\p{L}\\p{M}\\p{N}_\\s/-]", " "))


def reference_name(c: Column | str) -> Column:
    return squeeze(F.regexp_replace(F.lower(fold_digits(c)), "[.,;:()\\[\\]{}]", ""))


def consistency_text(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(F.lower(fold_digits(c)), "[\\s,;:]+", " "))


def first_number(c: Column | str) -> Column:
    return F.replace(F.regexp_extract(fold_digits(c), "[0-9]+([.,][0-9]+)?", 0), F.lit(","), F.lit(".")).try_cast("double")


def date_from_text(c: Column | str) -> Column:
    """d/m/Y if such a form occurs anywhere, else Y/m/d; an impossible date is null."""
    x = fold_digits(c)
    dmy, ymd = "([0-9]{1,2})[/-]([0-9]{1,2})[/-]([0-9]{4})", "([0-9]{4})[/-]([0-9]{1,2})[/-]([0-9]{1,2})"
    part = lambda p, *order: F.concat_ws("-", *[F.lpad(F.regexp_extract(x, p, i), 4 if i == order[0] else 2, "0") for i in order])
    return F.when(x.rlike(dmy), F.try_to_date(part(dmy, 3, 2, 1), "yyyy-MM-dd")).when(x.rlike(ymd), F.try_to_date(part(ymd, 1, 2, 3), "yyyy-MM-dd"))


def char_references(c: Column) -> Column:
    """Numeric (&#8377; &#x20B9;) and named (&eacute;) references as characters, once; text without any stays in the JVM."""
    return F.when(c.rlike("&#?[A-Za-z0-9]+;"), unescaped(F.when(c.rlike("&#?[A-Za-z0-9]+;"), c))).otherwise(c)


@F.pandas_udf(StringType())
def unescaped(a):
    """HTML character references, batch-wise."""
    import html

    return a.map(lambda x: None if x is None else html.unescape(x))


def clean_html_cell(c: Column | str) -> Column:
    return squeeze(char_references(F.regexp_replace(text(c), "(?i)<br\\s*/?>", " ")))


def blank_to_null(c: Column | str) -> Column:
    return F.nullif(F.trim(F.col(c) if isinstance(c, str) else c), F.lit(""))


def rename_field(c: Column | str, mapping: dict[str, str] = P.TABLE_FIELD_NAMES) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])[c], c)


def has_letter(c: Column | str, letters: str = LETTER) -> Column:
    return text(c).rlike(letters)


def valid_survey(c: Column | str) -> Column:
    return fold_digits(clean_candidate(c)).rlike("^[0-9]+(\\s*/\\s*[0-9]+)*$")


def valid_positive(c: Column | str) -> Column:
    return positive(normalize_value(c, "number"))


def positive(n: Column) -> Column:
    """Is the normalised number of such a form, and above 0?"""
    return n.rlike("^[0-9]+([.,][0-9]+)?$") & (F.coalesce(F.replace(n, F.lit(","), F.lit(".")).try_cast("double"), F.lit(0.0)) > 0)


def _is_label(n: Column, generic, words, numberless, phrases) -> Column:
    out = n.isin(*generic) | ((n != "") & (F.size(F.array_except(F.split(n, " "), F.array(*map(F.lit, words)))) == 0))
    for w in numberless:
        out = out | (n.contains(w) & ~n.rlike("[0-9]"))
    for p in phrases:
        out = out | n.contains(p)
    return out


def looks_like_label(c: Column | str, generic=P.GENERIC_HEADERS, words=P.LABEL_WORDS, numberless=P.NUMBERLESS_WORDS, phrases=P.LABEL_PHRASES) -> Column:
    return let(normalize_label(c), lambda n: _is_label(n, generic, words, numberless, phrases))


def valid_text(c: Column | str, field: Column | str, generic=P.GENERIC_HEADERS, labels=P.LABELS_IN_VALUE, named=P.NAMED_FIELDS) -> Column:
    field = F.lit(field) if isinstance(field, str) else field
    return let(F.array(clean_candidate(c), normalize_label(clean_candidate(c))), lambda p: (
        F.length(p[0]).between(1, 120) & (p[1] != "") & ~_is_label(p[1], generic, P.LABEL_WORDS, P.NUMBERLESS_WORDS, P.LABEL_PHRASES)
        & ~p[0].rlike(f"(?i)({'|'.join(labels)})\\s*[:|/-]") & (~field.isin(*named) | has_letter(p[0]))
    ))


def valid_table_value(field: Column | str, c: Column | str, generic=P.TABLE_GENERIC, header_words=P.TABLE_HEADER_WORDS) -> Column:
    field = F.lit(field) if isinstance(field, str) else field
    x = clean_candidate(c, " .,:;|/")
    d, n = fold_digits(x), normalize_label(x, "–—-")
    header = F.exists(F.array(*map(F.lit, header_words)), lambda w: n.contains(w)) & (F.size(F.split(n, " ")) <= 8)
    form = (
        F.when(field == "survey_number", d.rlike("^[0-9]+(\\s*/\\s*[0-9]+)*$"))
        .when(field == "subdivision", d.rlike("^([0-9]+(\\s*/\\s*[0-9]+)*|-)$"))
        .when(field == "account_number", d.rlike("^[0-9]+$"))
        .when(field == "cultivable_area", d.rlike("^[0-9]+([.,][0-9]+)?$"))
        .when(field == "land_tenure", has_letter(x))
        .when(field.isin("holder_name", "local_field_name"), has_letter(x) & ~header)
        .otherwise(True)
    )
    return F.length(x).between(1, 180) & ~n.isin(*generic) & form


def is_evaluable(status: Column | str, value: Column | str, lenient: bool = False) -> Column:
    s, v = F.lower(F.trim(text(status))), F.trim(text(value))
    return (v != "") & (~s.isin("not_visible", "unreadable", "empty", "") if lenient else (s == "present"))


def status_bucket(c: Column | str, buckets: dict[str, tuple[str, ...]] = P.STATUS_BUCKETS) -> Column:
    s = F.upper(F.col(c) if isinstance(c, str) else c)
    out = F.lit(None).cast("string")
    for name, values in buckets.items():
        out = F.when(s.isin(*values), F.lit(name)).otherwise(out)
    return out


def basename(c: Column | str) -> Column:
    return F.regexp_extract(text(c), "[^/\\\\]+$", 0)
