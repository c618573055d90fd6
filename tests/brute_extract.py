"""Extraction of one page in plain Python, block by block: what the set-based operators are held against."""

import re

from folioframe import presets as P

WS = "[ \t\n\x0b\f\r\xa0]+"
DIGITS = str.maketrans(P.DEVANAGARI_DIGITS, "0123456789")


def fold(x):
    return (x or "").translate(DIGITS)


def squeeze(x):
    return re.sub(WS, " ", x).strip(" ")


def clean(x, chars=" .,:;|/-"):
    return squeeze(x or "").strip(chars)


def label_of(x, dashes="-"):
    x = fold(x).strip(" ").lower()
    x = re.sub(r"[/|.:,;()\[\]{}#\\]", " ", x)
    return squeeze(re.sub(f"[{dashes}]", " ", x))


def value_of(x, kind="text"):
    x = fold(x)
    return re.sub(WS, "", x) if kind == "number" else squeeze(x).strip(".,;:()[]{}").lower()


def is_label(n):
    words = n.split(" ")
    return n in P.GENERIC_HEADERS or (n != "" and all(w in P.LABEL_WORDS for w in words)) or any(w in n and not re.search("[0-9]", n) for w in P.NUMBERLESS_WORDS) or any(p in n for p in P.LABEL_PHRASES)


def has_letter(x):
    return re.search("[A-Za-zऀ-ॿ]", x or "") is not None


def valid_text(x, field):
    c = clean(x)
    n = label_of(c)
    inner = any(re.search(re.escape(w) + r"[ \t\n\x0b\f\r]*[:|/-]", c, re.I) for w in P.LABELS_IN_VALUE)
    return 1 <= len(c) <= 120 and n != "" and not is_label(n) and not inner and (field not in P.NAMED_FIELDS or has_letter(c))


def valid_survey(x):
    return re.fullmatch(r"[0-9]+([ \t]*/[ \t]*[0-9]+)*", fold(clean(x))) is not None


def valid_positive(x):
    n = value_of(x, "number")
    return re.fullmatch(r"[0-9]+([.,][0-9]+)?", n) is not None and float(n.replace(",", ".")) > 0


def number(x):
    return re.fullmatch("[0-9]+", fold(x)) is not None


def normal(name, v):
    return value_of(v, "number" if name in ("survey_number", "khata_number", "area") else "text")


def confidence(conf, method):
    return min(100.0, max(0.0, min(100.0, conf or 0.0)) + P.METHOD_BONUS.get(method, 0.0))


def field(name, value, norm, conf, method, b):
    return {"field_name": name, "value": value, "normalized_value": norm, "confidence": conf, "method": method, "block": b["block_id"], "position": b["position"]}


def ordered(blocks):
    """Blocks of a page in reading order, numbered from 1."""
    out = sorted(blocks, key=lambda b: (b["y"], b["x"], b["block_number"], b["block_id"]))
    return [{**b, "position": i + 1} for i, b in enumerate(out)]


def inline(blocks):
    out = []
    for b in blocks:
        c = clean(b["text"])
        if not re.search("[:|/-]", b["text"] or ""):
            continue
        found = None
        for name, labels in P.INLINE_LABELS.items():
            for x in sorted(labels, key=len, reverse=True):  # the longest label that fits
                loose = r"\s*".join(map(re.escape, "".join(x.split())))
                m = re.match(rf"(?i){loose}\s*[:|/-]\s*(.+)$", c)
                if m and (found is None or len(x) > len(found[1])):
                    found = (name, x, m[1])
        if not found:
            continue
        name, x, v = found
        if name == "survey_number":
            ok = re.fullmatch(r"[0-9]+(\s*/\s*[0-9]+)*", fold(v))
        elif name == "khata_number":
            ok = number(v)
        elif name == "area":
            m = re.fullmatch(r"([0-9०-९]+(?:[.,][0-9०-९]+)?)\s*(.*)", v)
            ok = m and (m[2] == "" or "".join(m[2].lower().split()) in ["".join(u.split()) for u in P.AREA_UNITS[x]])
            v = m[1] if ok else v
        else:
            ok = True
        v = clean(v)
        if ok and v and (valid_survey(v) if name == "survey_number" else True if name == "khata_number" else valid_positive(v) if name == "area" else valid_text(v, name)):
            out.append(field(name, v, normal(name, v), confidence(b["confidence"], "regex_label"), "regex_label", b))
    return out


def level(a, b):
    return abs((b["y"] + b["height"] / 2) - (a["y"] + a["height"] / 2))


def adjacent(blocks):
    out = []
    for a, b in zip(blocks, blocks[1:]):
        name = next((f for f, xs in P.ADJACENT_LABELS.items() if label_of(a["text"]) in xs), None)
        if name is None or not 0 <= b["x"] - (a["x"] + a["width"]) <= 1400 or level(a, b) > max(18.0, 0.9 * min(a["height"], b["height"])):
            continue
        v = clean(b["text"])
        if not v:
            continue
        ok = valid_survey(v) if name == "survey_number" else number(v) if name == "khata_number" else valid_positive(v) if name == "area" else valid_text(v, name)
        if ok:
            out.append(field(name, v, normal(name, v), confidence(b["confidence"], "spatial_label_value"), "spatial_label_value", b))
        elif name in ("mutation", "registration") and is_label(label_of(v)):
            out.append(field(name, v, normal(name, v), 25.0, "spatial_label_value_suspect", b))
    return out


def below(blocks, name, headers, ok, norm, method, dy, width, k):
    out = []
    for h in blocks:
        if label_of(h["text"]) not in headers:
            continue
        under = [b for b in blocks if b is not h and ok(clean(b["text"])) and 0 < b["y"] - (h["y"] + h["height"]) <= dy and h["x"] - 20 <= b["x"] <= h["x"] + max(h["width"], width) + 40]
        for b in sorted(under, key=lambda b: (b["y"], b["x"], b["block_number"], b["block_id"]))[:k]:
            v = clean(b["text"])
            out.append(field(name, v, norm(v), confidence(b["confidence"], method), method, b))
    return out


def owner_rows(blocks):
    return below(blocks, "owner", P.OWNER_HEADERS, lambda v: valid_text(v, "owner") and not is_label(label_of(v)), value_of, "owner_table_row", 260, 240, 2)


def area_rows(blocks):
    return below(blocks, "area", P.AREA_HEADERS, valid_positive, lambda v: value_of(v, "number"), "area_table_row", 280, 180, 10)


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


_scores = {}


def label_score(n, label):
    if n == "" or n == label:
        return float(n == label)
    if label in n or n in label:
        return 0.94
    if (n, label) not in _scores:
        a, b = set(n.split(" ")), set(label.split(" "))
        _scores[n, label] = 0.65 * (1 - edits(n, label) / max(len(n), len(label))) + 0.35 * len(a & b) / max(1, len(a | b))
    return _scores[n, label]


LABELS = [(f, i, label_of(x, "–—-")) for i, (f, xs) in enumerate(P.TABLE_LABELS.items()) for x in xs]


def could(n, label, least):
    """Whether the score may reach ``least`` at all: a ratio of edits is at most the shorter length over the longer."""
    return n in label or label in n or 0.65 * min(len(n), len(label)) / max(len(n), len(label)) + 0.35 >= least


def valid_table(f, x):
    c = clean(x, " .,:;|/")
    d, n = fold(c), label_of(c, "–—-")
    header = any(w in n for w in P.TABLE_HEADER_WORDS) and len(n.split(" ")) <= 8
    form = {
        "survey_number": lambda: re.fullmatch(r"[0-9]+(\s*/\s*[0-9]+)*", d),
        "subdivision": lambda: re.fullmatch(r"[0-9]+(\s*/\s*[0-9]+)*|-", d),
        "account_number": lambda: re.fullmatch("[0-9]+", d),
        "cultivable_area": lambda: re.fullmatch("[0-9]+([.,][0-9]+)?", d),
        "land_tenure": lambda: has_letter(c),
    }.get(f, lambda: has_letter(c) and not header)
    return 1 <= len(c) <= 180 and n not in P.TABLE_GENERIC and bool(form())


def table_fields(blocks):
    rows = sorted((b for b in blocks if (b["text"] or "").strip(" ")), key=lambda b: (b["y"] + b["height"] / 2, b["x"], b["block_number"], b["block_id"]))
    if len(rows) < 2:
        return []
    at, last = [0], rows[0]
    for b in rows[1:]:
        gap = (b["y"] + b["height"] / 2) - (last["y"] + last["height"] / 2)
        at.append(at[-1] + (gap > max(18.0, 0.9 * min(b["height"], last["height"]))))
        last = b
    row = {b["block_id"]: i for b, i in zip(rows, at)}
    size = {i: at.count(i) for i in set(at)}
    heads = {}
    for b in rows:
        n = label_of(b["text"], "–—-")
        if not n:
            continue
        best = min(((-label_score(n, x), i, x, f) for f, i, x in LABELS if could(n, x, 0.70)), default=None)
        if best and -best[0] >= P.TABLE_THRESHOLDS.get(best[3], 0.70):
            mine = (best[0], b["block_number"], b["block_id"], b)
            if best[3] not in heads or mine[:3] < heads[best[3]][:3]:
                heads[best[3]] = mine
    out = []
    for f, (score, _, _, h) in heads.items():
        found = []
        for v in rows:
            step = row[v["block_id"]] - row[h["block_id"]]
            if v is h or not 0 <= step <= 4 or not valid_table(f, v["text"]):
                continue
            dx = abs((v["x"] + v["width"] / 2) - (h["x"] + h["width"] / 2))
            limit = max(90.0, 2.2 * h["width"], 0.18 * max(h["width"], v["width"]))
            gap = v["x"] - (h["x"] + h["width"])
            if step >= 1 and dx <= limit and v["y"] - (h["y"] + h["height"]) <= 520:
                s = 0.55 * (1 - step / 5) + 0.45 * (1 - dx / limit)
            elif step == 0 and size[row[h["block_id"]]] <= 2 and gap >= -10 and level(h, v) <= max(24.0, min(h["height"], v["height"])) and not any(label_score(label_of(v["text"], "–—-"), x) >= 0.82 for _, _, x in LABELS):
                s = 0.65 + 0.35 * max(0.0, 1 - gap / 1000)
            else:
                continue
            found.append((-s, -v["confidence"], v["position"], v))
        if not found:
            continue
        s, _, _, v = min(found, key=lambda x: x[:3])
        c = clean(v["text"], " .,:;|/")
        if f in ("survey_number", "account_number", "cultivable_area"):
            norm = value_of(c, "number").strip(".-")
        else:
            norm = value_of(c, "number") if f == "subdivision" else clean(fold(c)).lower()
        if norm:
            out.append(field(P.TABLE_FIELD_NAMES.get(f, f), c, norm, max(0.0, min(100.0, 0.65 * v["confidence"] - 25 * score - 10 * s)), "table_header_value", v))
    return strongest(out)


def strongest(fields):
    best = {}
    for x in fields:
        k = (x["field_name"], x["normalized_value"])
        rank = (-x["confidence"], x["position"], x["block"])
        if k not in best or rank < best[k][0]:
            best[k] = (rank, x)
    return [x for _, x in best.values()]


def everything(blocks):
    """All extractors on a page, strongest first of equal values, in reading order."""
    b = ordered(blocks)
    out = strongest([x for f in (table_fields, inline, adjacent, owner_rows, area_rows) for x in f(b)])
    return sorted(out, key=lambda x: (x["position"], x["field_name"], x["normalized_value"]))
