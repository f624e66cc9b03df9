"""Rectangles as structs (x0, y0, x1, y1), origin at the top left."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rect(x0, y0, x1, y1) -> Column:
    return F.struct(*[(F.lit(v) if isinstance(v, (int, float)) else v).cast("double").alias(n) for n, v in zip(("x0", "y0", "x1", "y1"), (x0, y0, x1, y1))])


def pad(r: Column, by: float = 2.0) -> Column:
    return rect(r["x0"] - by, r["y0"] - by, r["x1"] + by, r["y1"] + by)


def quad_to_rect(quad: Column) -> Column:
    """Bounding box of an array of points (x, y)."""
    x, y = F.transform(quad, lambda p: p["x"]), F.transform(quad, lambda p: p["y"])
    return rect(F.array_min(x), F.array_min(y), F.array_max(x), F.array_max(y))


def pixel_box(quad: Column) -> Column:
    """Bounding box of a quad in whole pixels, as scanned pages and images are masked."""
    r = quad_to_rect(quad)
    return rect(*[r[c].cast("int") for c in ("x0", "y0", "x1", "y1")])


def mask_box(r: Column) -> Column:
    """Box that is painted over on a raster."""
    return pad(r, 4.0)


def pixels_to_page(r: Column, placed: Column, width, height, by: float = 2.0) -> Column:
    """A box in an image's pixels to page points, by the image's placement, padded."""
    sx, sy = (placed["x1"] - placed["x0"]) / width, (placed["y1"] - placed["y0"]) / height
    return rect(placed["x0"] + r["x0"] * sx - by, placed["y0"] + r["y0"] * sy - by, placed["x0"] + r["x1"] * sx + by, placed["y0"] + r["y1"] * sy + by)


def pad_face(r: Column, page_width, page_height, factor: float = 0.20) -> Column:
    """A face box widened by a share of its width, more so in height, clamped to the page."""
    dx, dy = (r["x1"] - r["x0"]) * factor, (r["y1"] - r["y0"]) * factor * 1.25
    zero = F.lit(0.0)
    return rect(F.greatest(zero, r["x0"] - dx), F.greatest(zero, r["y0"] - dy), F.least(page_width, r["x1"] + dx), F.least(page_height, r["y1"] + dy))


def contains(a: Column, b: Column) -> Column:
    return (a["x0"] <= b["x0"]) & (a["y0"] <= b["y0"]) & (a["x1"] >= b["x1"]) & (a["y1"] >= b["y1"])


def intersects(a: Column, b: Column) -> Column:
    return (a["x0"] < b["x1"]) & (b["x0"] < a["x1"]) & (a["y0"] < b["y1"]) & (b["y0"] < a["y1"])


def face_size_ok(r: Column, px_w, px_h, on_page: bool, score, page_points: tuple[float, float] = (25.0, 160.0)) -> Column:
    """Size and score limits of face boxes: both sides on a page, the width alone in an embedded image."""
    lo, hi = page_points
    w, h = r["x1"] - r["x0"], r["y1"] - r["y0"]
    size = w.between(lo, hi) & (h.between(lo, hi) if on_page else F.lit(True))
    return (px_w >= 25) & (px_h >= 25) & size & (score >= 0.60)


def photo_size_ok(r: Column) -> Column:
    """Whether an embedded image is large enough to hold a portrait; icons are not."""
    return (r["x1"] - r["x0"] >= 40) & (r["y1"] - r["y0"] >= 40)
