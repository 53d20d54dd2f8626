"""What a reader's gestures and requests compute, as expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import geometry as G
from .text import occurrences

MIN_POINTS, MIN_SIDE = 3, 0.01


def hit_pieces(text: Column, query: str) -> Column:
    """The text in pieces (text, hit) around the query's places, case aside, for display in bold."""
    at = occurrences(text, query)
    n = len(query)
    before = F.transform(
        at, lambda p,
        i: F.struct(F.substring(text, F.when(i == 0, 1).otherwise(F.get(at, i - 1) + n + 1), p - F.when(i == 0, 0).otherwise(F.get(at, i - 1) + n)).alias("text"), F.lit(False).alias("hit"))
    )
    hits = F.transform(at, lambda p: F.struct(F.substring(text, p + 1, F.lit(n)).alias("text"), F.lit(True).alias("hit")))
    rest = F.array(F.struct(F.substring(text, F.coalesce(F.get(at, F.size(at) - 1) + n, F.lit(0)) + 1, F.length(text)).alias("text"), F.lit(False).alias("hit")))
    pairs = F.flatten(F.transform(F.arrays_zip(before.alias("b"), hits.alias("h")), lambda z: F.array(z["b"], z["h"])))
    return F.filter(F.concat(pairs, rest), lambda p: p["text"] != "")


def centred_box(x: Column, y: Column, w: Column, h: Column, missing: float) -> Column:
    """A mark's box from its centre; a size that is missing is ``missing``."""
    w, h = F.coalesce(w, F.lit(missing)), F.coalesce(h, F.lit(missing))
    return F.struct((x - w / 2).alias("x"), (y - h / 2).alias("y"), w.alias("w"), h.alias("h"))


def path_distance(points: Column, px: Column, py: Column) -> Column:
    """From a point to a path; null for a path without points."""
    first = F.sqrt(F.pow(px - points[0][0], 2) + F.pow(py - points[0][1], 2))
    legs = F.transform(F.slice(points, 2, F.greatest(F.size(points) - 1, F.lit(0))), lambda p, i: G.segment_distance(px, py, points[i][0], points[i][1], p[0], p[1]))
    return F.when(F.size(points) > 0, F.least(first, F.coalesce(F.array_min(legs), first)))


def corner_at(box: Column, px: Column, py: Column, tolerance: float) -> Column:
    """0 to 3, clockwise from the top left, of the first corner within the tolerance; -1 if there is none."""
    corners = F.array(*(F.struct(x.alias("x"), y.alias("y")) for x, y in ((box["x"], box["y"]), (box["x"] + box["w"], box["y"]), (box["x"] + box["w"], box["y"] + box["h"]), (box["x"], box["y"] + box["h"]))))
    near = F.transform(corners, lambda c: F.sqrt(F.pow(c["x"] - px, 2) + F.pow(c["y"] - py, 2)) <= tolerance)
    return (F.coalesce(F.array_position(near, True), F.lit(0)) - 1).cast("int")


def big_enough(points: Column, w: Column, h: Column, brush: Column) -> Column:
    return F.when(brush, F.size(points) >= MIN_POINTS).otherwise((F.abs(w) >= MIN_SIDE) & (F.abs(h) >= MIN_SIDE))


def resized(size: Column, delta: Column) -> Column:
    return G.clamp(size + 2 * delta, 0.01, 2.0)


def turned(rotation: Column, steps: Column) -> Column:
    """Turned by steps of 15 degrees."""
    return rotation + steps * 15


def row_at(offset: Column, stride: Column) -> Column:
    return F.floor((offset + stride / 2) / stride).cast("long")


def page_step(page: Column, double: Column, pages: Column, forward: bool = True) -> Column:
    move = F.when(double, 2).otherwise(1)
    return G.page_within(page + move if forward else page - move, pages)


def crop(box: Column, ratio: Column, width: Column, height: Column) -> Column:
    """A selection in pixels of the device, kept within the view."""
    x, y = F.greatest(box["x"] * ratio, F.lit(0.0)), F.greatest(box["y"] * ratio, F.lit(0.0))
    r, d = F.least((box["x"] + box["w"]) * ratio, width), F.least((box["y"] + box["h"]) * ratio, height)
    return F.struct(x.alias("x"), y.alias("y"), F.greatest(r - x, F.lit(0.0)).alias("w"), F.greatest(d - y, F.lit(0.0)).alias("h"))


def toggled(kinds: Column, kind: Column) -> Column:
    """A set with one element more or less."""
    return F.when(F.array_contains(kinds, kind), F.array_remove(kinds, kind)).otherwise(F.array_append(kinds, kind))


def brush_payload(points: Column) -> Column:
    return F.to_json(F.struct(points.alias("points")))


def text_payload(text: Column) -> Column:
    return F.to_json(F.struct(text.alias("text")))


def stamp_payload(file: Column) -> Column:
    return F.to_json(F.struct(file.alias("file")))


def shape_payload(kind: Column) -> Column:
    return F.to_json(F.struct(kind.alias("shapeType")))


def follow_up(action: Column) -> Column:
    """A question after a translation is a chat."""
    return F.when(action == "translate", "chat").otherwise(action)


def request_body(model: Column, messages: Column, temperature: Column, effort: Column | None = None) -> Column:
    """A streaming request as JSON; the temperature within [0, 2], what is null left out."""
    fields = [model.alias("model"), messages.alias("messages"), F.lit(True).alias("stream"), G.clamp(temperature, 0.0, 2.0).alias("temperature")]
    return F.to_json(F.struct(*fields, *([effort.alias("reasoning_effort")] if effort is not None else [])))


def search_prompt(enabled: Column, has_key: Column, results: Column, error: Column) -> Column:
    """What a search request is told, by what the search gave: off, no key, failed, nothing, or the results."""
    return (
        F.when(~enabled, F.lit("Answer from what you know; the search is switched off."))
        .when(~has_key, F.lit("Answer from what you know; no key for the search is set."))
        .when(error.isNotNull(), F.concat(F.lit("Answer from what you know; the search failed: "), error))
        .when(F.coalesce(results, F.lit("")) == "", F.lit("Answer from what you know; the search found nothing."))
        .otherwise(F.concat(F.lit("Answer from these results:\n"), results))
    )
