"""Boxes and confidences."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from folioframe import presets as P
from folioframe.functions.text import let

BOX = "struct<x: double, y: double, width: double, height: double>"


def box(x: Column, y: Column, width: Column, height: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"), width.cast("double").alias("width"), height.cast("double").alias("height"))


def has_box(b: Column) -> Column:
    parts = [b[k] for k in ("x", "y", "width", "height")]
    finite = [p.isNotNull() & ~F.isnan(p) for p in parts]
    return F.coalesce(finite[0] & finite[1] & finite[2] & finite[3] & (b["width"] > 0) & (b["height"] > 0), F.lit(False))


def normalize_bbox(json: Column) -> Column:
    """Box of JSON text: x/y/width/height, left/top/right/bottom, either nested in bbox or bounding_box, or an [x1, y1, x2, y2] array."""
    get = lambda *paths: F.coalesce(*[F.get_json_object(json, p).try_cast("double") for p in paths])
    at = lambda *names: get(*[f"$.{o}{n}" for o in ("bbox.", "bounding_box.", "") for n in names])
    corner = lambda i: get(f"$[{i}]", f"$.bbox[{i}]", f"$.bounding_box[{i}]", f"$.bbox_xyxy[{i}]")
    parts = F.array(*[corner(i) for i in range(4)], at("x", "left", "x1"), at("y", "top", "y1"), at("width", "w"), at("height", "h"), at("right", "x2"), at("bottom", "y2"))

    def shape(p: Column) -> Column:
        x, y = F.coalesce(p[4], F.lit(0.0)), F.coalesce(p[5], F.lit(0.0))
        named = box(x, y, F.coalesce(p[6], p[8] - x), F.coalesce(p[7], p[9] - y))
        corners = p[0].isNotNull() & p[1].isNotNull() & p[2].isNotNull() & p[3].isNotNull()
        return F.when(corners, box(p[0], p[1], p[2] - p[0], p[3] - p[1])).otherwise(named)

    return let(let(parts, shape), lambda b: F.when(has_box(b), b))


def right_of_same_row(a: Column, b: Column, reach: float = 1400.0) -> Column:
    """b starts at most ``reach`` to the right of a's end, and the centres lie within max(18, 0.9 x the smaller height)."""
    gap = b["x"] - (a["x"] + a["width"])
    dy = F.abs((b["y"] + b["height"] / 2) - (a["y"] + a["height"] / 2))
    return has_box(a) & has_box(b) & gap.between(0, reach) & (dy <= F.greatest(F.lit(18.0), F.least(a["height"], b["height"]) * 0.9))


def unit_confidence(c: Column) -> Column:
    """0 to 1 from either scale: above 1 is a percentage."""
    return F.when(c.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(c > 1, c / 100).otherwise(c))))


def method_confidence(conf: Column, method: Column, bonus: dict[str, float] = P.METHOD_BONUS) -> Column:
    base = F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.coalesce(conf, F.lit(0.0))))
    more = F.coalesce(F.create_map(*[F.lit(x) for kv in bonus.items() for x in kv])[method], F.lit(0.0))
    return F.least(F.lit(100.0), base + more)


def table_confidence(ocr: Column, header: Column, relation: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), 0.65 * F.coalesce(ocr, F.lit(0.0)) + 25 * header + 10 * relation))
