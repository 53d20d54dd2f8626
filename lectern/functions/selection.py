"""Characters of a page as boxes, and positions, texts and rectangles of selections, as expressions.

Boxes have char, x, y, w and h; those of recognised lines hold a whole line's text each.  Without font metrics, the letters of a line take equal
shares of its width.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import geometry as G, text as T

#: A place in a line is the line's number times this, plus the character's.
PER_LINE = 10000


def char_box(char: Column, left: Column, bottom: Column, width: Column, height: Column, page_width: Column, page_height: Column) -> Column:
    """A character's box in shares of the page, from units with the origin at the bottom left; null for an empty character."""
    w, h = F.greatest(page_width, F.lit(1.0)), F.greatest(page_height, F.lit(1.0))
    y = G.clamp(1.0 - (bottom + height) / h, 0.0, 1.0)
    floor = lambda v: F.greatest(v, F.lit(0.0))
    box = F.struct(char.alias("char"), floor(left / w).alias("x"), y.alias("y"), floor(width / w).alias("w"), floor(height / h).alias("h"))
    return F.when(F.length(char) > 0, box)


def page_chars(boxes: Column) -> Column:
    """The text of a page's boxes in order."""
    return F.array_join(F.transform(boxes, lambda b: F.coalesce(b["char"], F.lit(""))), "")


def letters(boxes: Column) -> Column:
    """Boxes of whole lines as boxes of their letters."""
    each = lambda b: F.transform(
        F.sequence(F.lit(1), F.length(b["char"])),
        lambda i: F.struct(
            F.substring(b["char"], i, F.lit(1)).alias("char"), (b["x"] + b["w"] * (i - 1) / F.length(b["char"])).alias("x"), b["y"].alias("y"), (b["w"] / F.length(b["char"])).alias("w"),
            b["h"].alias("h")
        ),
    )
    return F.flatten(F.transform(F.filter(boxes, lambda b: F.length(b["char"]) > 0), each))


def hit_rects(boxes: Column, query: str) -> Column:
    """The line rectangles of every place of the query among boxes of single characters, case aside, none overlapping another."""
    query = query.strip()
    if not query:
        return F.array().cast(f"array<{G.BOX}>")
    return F.flatten(F.transform(T.occurrences(page_chars(boxes), query), lambda at: G.line_rects(G.selection(boxes, at, at + len(query) - 1))))


def encode(line: Column, offset: Column) -> Column:
    return line * PER_LINE + offset


def line_of(place: Column) -> Column:
    return F.floor(place / PER_LINE).cast("int")


def offset_of(place: Column) -> Column:
    return (place % PER_LINE).cast("int")


def offset_at(box: Column, px: Column) -> Column:
    """The character of a line at a point's x: the last one beyond its end, -1 before its beginning."""
    n = F.length(box["char"])
    return F.when(px < box["x"], -1).otherwise(F.least(F.floor((px - box["x"]) / F.greatest(box["w"], F.lit(1e-9)) * n), n - 1)).cast("int")


def place_at(boxes: Column, px: Column, py: Column) -> Column:
    """The place at a point in the first line whose row holds it; -1 between lines and before a line's beginning."""
    rows = F.transform(boxes, lambda b, i: F.struct((F.abs(py - (b["y"] + b["h"] / 2)) <= b["h"] / 2 + G.ROW_TOLERANCE).alias("hit"), i.alias("i"), offset_at(b, px).alias("o")))
    first = F.get(F.filter(rows, lambda r: r["hit"]), 0)
    return F.coalesce(F.when(first["o"] >= 0, encode(first["i"], first["o"])), F.lit(-1)).cast("int")


def selected(boxes: Column, start: Column, end: Column) -> Column:
    """The text of boxes between two of them, both included, in either order."""
    return page_chars(G.selection(boxes, start, end))


def _spans(boxes: Column, start: Column, end: Column) -> Column:
    """(box, from, to) of each line between two places, in either order."""
    lo, hi = F.least(start, end), F.greatest(start, end)
    some = F.transform(
        boxes, lambda b,
        i: F.struct(b.alias("b"), F.when(i == line_of(lo), offset_of(lo)).otherwise(0).alias("from"), F.when(i == line_of(hi), offset_of(hi)).otherwise(F.length(b["char"]) - 1).alias("to"))
    )
    return F.slice(some, line_of(lo) + 1, line_of(hi) - line_of(lo) + 1)


def selected_lines(boxes: Column, start: Column, end: Column) -> Column:
    """The text between two places, both included, in either order, lines joined without anything between."""
    return F.array_join(F.transform(_spans(boxes, start, end), lambda s: F.substring(s["b"]["char"], s["from"] + 1, F.greatest(s["to"] - s["from"] + 1, F.lit(0)))), "")


def selected_rects(boxes: Column, start: Column, end: Column) -> Column:
    """A rectangle for each line between two places, of its selected letters."""

    def rect(s: Column) -> Column:
        b, n = s["b"], F.length(s["b"]["char"])
        first, last = F.greatest(F.least(s["from"], n - 1), F.lit(0)), F.greatest(F.least(s["to"], n - 1), F.lit(0))
        return F.when((n > 0) & (first <= last), F.struct((b["x"] + b["w"] * first / n).alias("x"), b["y"].alias("y"), (b["w"] * (last - first + 1) / n).alias("w"), b["h"].alias("h")))

    return F.filter(F.transform(_spans(boxes, start, end), rect), lambda r: r.isNotNull())
