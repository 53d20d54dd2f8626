"""Page images as arrays of pixel values, row by row: sampling, quality, and the enhancement of washed-out pages, as expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import geometry as G

#: Every fourth pixel in each direction is looked at.
STEP = 4
#: Darker than this is ink; a step larger than this is a sharp edge.
INK, EDGE = 200, 120
# Above which median ink is washed out, by how much the background has to be lighter, and below which share of sharp edges a page is blurry.
WASHED_INK, WASHED_SPAN, SHARP = 80, 30, 1e-4


def rgb(rgba: Column) -> Column:
    """Red, green and blue of each pixel, without its opacity."""
    return F.filter(rgba, lambda _, i: i % 4 != 3)


def lumas(values: Column) -> Column:
    """The brightness of each pixel of red, green and blue."""
    return F.transform(F.sequence(F.lit(0), (F.size(values) / 3).cast("int") - 1), lambda i: G.luma(*(F.get(values, (i * 3 + k).cast("int")) for k in range(3))))


def sampled(values: Column, width: Column) -> Column:
    """Every STEP-th pixel of every STEP-th row."""
    return F.filter(values, lambda _, i: (i % width % STEP == 0) & (F.floor(i / width) % STEP == 0))


def quality(values: Column, width: Column) -> Column:
    """(ink_median, p99, ink_fraction) of the sampled pixels; 255 where there are none."""
    seen = sampled(values, width)
    ink = F.filter(seen, lambda v: v < INK)
    return F.struct(
        F.coalesce(G.percentile_by_index(ink, 0.5).cast("double"), F.lit(255.0)).alias("ink_median"),
        F.coalesce(G.percentile_by_index(seen, 0.99).cast("double"), F.lit(255.0)).alias("p99"),
        (F.size(ink) / F.greatest(F.size(seen), F.lit(1))).alias("ink_fraction"),
    )


def sharp_fraction(values: Column, width: Column, height: Column) -> Column:
    """The share of inner pixels, every STEP-th in each direction, of which the steps to the right and down add up to more than EDGE."""
    inner = F.filter(
        F.sequence(F.lit(0), F.greatest(F.size(values) - 1, F.lit(0))),
        lambda i: (i % width >= 1) & (i % width < width - 1) & ((i % width - 1) % STEP == 0) & (i / width >= 1) & (F.floor(i / width) < height - 1) & ((F.floor(i / width) - 1) % STEP == 0),
    )
    at = lambda i: F.get(values, i.cast("int"))
    strong = F.filter(inner, lambda i: F.abs(at(i + 1) - at(i)) + F.abs(at(i + width) - at(i)) > EDGE)
    return F.when((F.size(inner) > 0) & (F.size(values) > 0), F.size(strong) / F.size(inner)).otherwise(0.0)


def washed_out(q: Column) -> Column:
    """Whether a page of that ``quality`` has ink, but pale ink that can be stretched."""
    return (q["ink_fraction"] > 0) & (q["ink_median"] > WASHED_INK) & (q["p99"] - q["ink_median"] > WASHED_SPAN)


def enhanced(values: Column, q: Column) -> Column:
    """The pixels with ink and background stretched apart where the page is washed out, else as they are."""
    return F.when(washed_out(q), F.transform(values, lambda v: G.stretch(v, q["ink_median"], q["p99"]))).otherwise(F.transform(values, lambda v: v.cast("double")))


def blurry(sharp: Column, q: Column) -> Column:
    """Whether a page with ink has hardly any sharp edge; ``sharp`` is measured after ``enhanced``."""
    return (q["ink_fraction"] > 0) & (sharp < SHARP)
