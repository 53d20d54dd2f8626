"""Page geometry on arrays of boxes, as expressions; sizes are shares of the page, origin at its top left."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

ROW_TOLERANCE = 0.008
BRUSH_REACH = 0.02
BOX = "struct<x:double,y:double,w:double,h:double>"


def clamp(v: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), v))


def interval_gap(p: Column, left: Column, right: Column) -> Column:
    """How far a point lies outside an interval."""
    return F.greatest(left - p, p - right, F.lit(0.0))


def contains(box: Column, px: Column, py: Column) -> Column:
    return (px >= box["x"]) & (px <= box["x"] + box["w"]) & (py >= box["y"]) & (py <= box["y"] + box["h"])


def first_containing(boxes: Column, px: Column, py: Column) -> Column:
    """0-based place of the first box that holds the point, -1 if none does."""
    hits = F.transform(boxes, lambda b: contains(b, px, py))
    return (F.coalesce(F.array_position(hits, True), F.lit(0)) - 1).cast("int")


def nearest(boxes: Column, px: Column, py: Column) -> Column:
    """0-based place of the box nearest to the point among those in its row, the first of several; -1 if its row has none."""
    costs = F.transform(
        boxes,
        lambda b, i: F.when(
            F.abs(py - (b["y"] + b["h"] / 2)) <= b["h"] / 2 + ROW_TOLERANCE,
            F.struct((interval_gap(px, b["x"], b["x"] + b["w"]) * 4 + F.abs(py - (b["y"] + b["h"] / 2))).alias("cost"), i.alias("i")),
        ),
    )
    return F.coalesce(F.array_min(F.filter(costs, lambda c: c.isNotNull()))["i"], F.lit(-1)).cast("int")


def segment_distance(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """From a point to a segment, by its clamped projection."""
    dx, dy = bx - ax, by - ay
    square = dx * dx + dy * dy
    t = F.when(square == 0, 0.0).otherwise(clamp(((px - ax) * dx + (py - ay) * dy) / F.when(square == 0, 1.0).otherwise(square), 0.0, 1.0))
    return F.sqrt(F.pow(px - (ax + t * dx), 2) + F.pow(py - (ay + t * dy), 2))


def bounds(boxes: Column) -> Column:
    """The smallest box around all; null for none."""
    x, y = F.array_min(F.transform(boxes, lambda b: b["x"])), F.array_min(F.transform(boxes, lambda b: b["y"]))
    r, d = F.array_max(F.transform(boxes, lambda b: b["x"] + b["w"])), F.array_max(F.transform(boxes, lambda b: b["y"] + b["h"]))
    return F.when(F.size(boxes) > 0, F.struct(x.alias("x"), y.alias("y"), (r - x).alias("w"), (d - y).alias("h")))


def line_rects(boxes: Column) -> Column:
    """The rectangles of visual lines, from top to bottom: boxes join the first line whose vertical range they overlap, and widen it."""
    line = "array<struct<top:double,bottom:double,left:double,right:double>>"

    def place(lines: Column, b: Column) -> Column:
        hit = F.array_position(F.transform(lines, lambda v: (b["y"] < v["bottom"]) & (v["top"] < b["y"] + b["h"])), True)
        grown = F.transform(
            lines,
            lambda v, i: F.when(
                i + 1 == hit,
                F.struct(
                    F.least(v["top"], b["y"]).alias("top"), F.greatest(v["bottom"], b["y"] + b["h"]).alias("bottom"), F.least(v["left"], b["x"]).alias("left"),
                    F.greatest(v["right"], b["x"] + b["w"]).alias("right")
                ),
            ).otherwise(v),
        )
        fresh = F.struct(b["y"].alias("top"), (b["y"] + b["h"]).alias("bottom"), b["x"].alias("left"), (b["x"] + b["w"]).alias("right"))
        return F.when(hit > 0, grown).otherwise(F.array_append(lines, fresh))

    found = F.aggregate(boxes, F.array().cast(line), place)
    return F.transform(F.array_sort(found), lambda v: F.struct(v["left"].alias("x"), v["top"].alias("y"), (v["right"] - v["left"]).alias("w"), (v["bottom"] - v["top"]).alias("h")))


def selection(boxes: Column, start: Column, end: Column) -> Column:
    """The boxes of a range given by its ends in either order, both included, kept within the page."""
    last = F.size(boxes) - 1
    lo, hi = F.greatest(F.lit(0), F.least(start, end, last)), F.least(F.greatest(start, end, F.lit(0)), last)
    return F.when(last >= 0, F.slice(boxes, lo + 1, hi - lo + 1)).otherwise(boxes)


def quad_rect(quad: Column, width: Column, height: Column) -> Column:
    """A quad of inclusive pixel corners as a box within [0, 1]."""
    xs, ys = F.transform(quad, lambda p: p[0]), F.transform(quad, lambda p: p[1])
    x, y, r, d = F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)
    return F.struct(clamp(x / width, 0.0, 1.0).alias("x"), clamp(y / height, 0.0, 1.0).alias("y"), clamp((r - x + 1) / width, 0.0, 1.0).alias("w"), clamp((d - y + 1) / height, 0.0, 1.0).alias("h"))


def rotate_back(quad: Column, width: Column, height: Column, rotation: Column) -> Column:
    """Corners found on a page turned by 90 or 270 degrees, on the page as it was (of the given size)."""
    return F.transform(
        quad,
        lambda p: F.when(rotation == 90, F.array(p[1], height - 1 - p[0])).when(rotation == 270, F.array(width - 1 - p[1], p[0])).otherwise(p),
    )


def percentile_by_index(values: Column, q: float) -> Column:
    """sorted[floor(n * q)], null for none: a rank of its own kind, which for n * q whole lies one above the usual one."""
    return F.when(F.size(values) > 0, F.get(F.sort_array(values), F.floor(F.size(values) * q).cast("int")))


def luma(r: Column, g: Column, b: Column) -> Column:
    return r * 0.299 + g * 0.587 + b * 0.114


def stretch(v: Column, lo: Column, hi: Column) -> Column:
    return clamp(F.round((v - lo) / F.greatest(hi - lo, F.lit(1.0)) * 255.0), 0.0, 255.0)


def thumbnail(width: Column, height: Column, longest: int) -> Column:
    """Sides with the longest capped, in proportion, at least 1."""
    scale = F.least(F.lit(1.0), F.lit(float(longest)) / F.greatest(width, height))
    return F.struct(F.greatest(F.round(width * scale), F.lit(1.0)).cast("long").alias("w"), F.greatest(F.round(height * scale), F.lit(1.0)).cast("long").alias("h"))


def render_size(width: Column, height: Column, zoom_: Column, dpi: Column) -> Column:
    """Pixels of a page drawn at a zoom on a screen of so many pixels a point, at least 1."""
    side = lambda v: F.greatest(F.round(v * zoom_ * dpi), F.lit(1.0)).cast("long")
    return F.struct(side(width).alias("w"), side(height).alias("h"))


def zoom(z: Column) -> Column:
    return clamp(z, 0.3, 4.0)


def zoom_step(z: Column, steps: Column) -> Column:
    """A zoom after so many steps of a tenth, in or out."""
    return zoom(F.round(z + steps * 0.1, 1))


def zoom_tier(z: Column) -> Column:
    return clamp(F.round(z * 2) / 2, 0.5, 4.0)


def page_within(page: Column, pages: Column) -> Column:
    return F.greatest(F.lit(1).cast("long"), F.least(page, pages))


def spread_pages(page1: Column, double: Column, pages: Column) -> Column:
    """0-based pages in view of a 1-based page; a spread's left half is odd."""
    left = F.when(double & (page1 % 2 == 0), page1 - 1).otherwise(page1)
    both = F.when(double, F.array(left - 1, left)).otherwise(F.array(left - 1))
    return F.filter(F.array_distinct(both), lambda p: (p >= 0) & (p < pages))
