"""Recognised text: review, corrections, layers and the choice of a page's orientation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

REVIEW_BELOW = 0.8
MARGIN = 1.1


def low_confidence(lines: Column) -> Column:
    """Lines to review, each with its 0-based place: (i, text, confidence)."""
    numbered = F.transform(lines, lambda v, i: F.struct(i.alias("i"), v["text"].alias("text"), v["confidence"].alias("confidence")))
    return F.filter(numbered, lambda v: v["confidence"] < REVIEW_BELOW)


def low_count(lines: Column) -> Column:
    return F.size(F.filter(lines, lambda v: v["confidence"] < REVIEW_BELOW))


def page_text(lines: Column, between: str = "") -> Column:
    return F.array_join(F.transform(lines, lambda v: v["text"]), between)


def score(lines: Column) -> Column:
    """Sum of the confidences."""
    return F.aggregate(lines, F.lit(0.0), lambda a, v: a + F.coalesce(v["confidence"], F.lit(0.0)))


def suspicious(n: Column, total: Column) -> Column:
    """A pass that found text, but little of it or uncertainly."""
    return (n > 0) & ((n < 3) | (total / n < 0.6))


def orientation(first: Column, n: Column, cw: Column, ccw: Column) -> Column:
    """0, 90 or 270: a turned pass wins only if it beats the best so far by the margin, 90 being tried before 270."""
    after = F.when(cw > first * MARGIN, cw).otherwise(first)
    return F.when(~suspicious(n, first), 0).when(ccw > after * MARGIN, 270).when(cw > first * MARGIN, 90).otherwise(0)


def in_mode(cache: DataFrame, mode: str) -> DataFrame:
    """(book_id, page, ocr_mode, result): of each page the result in the mode asked for, else in the other."""
    rank = F.when(F.col("ocr_mode") == mode, 0).otherwise(1)
    return cache.groupBy("book_id", "page").agg(F.min(F.struct(rank.alias("r"), "ocr_mode", F.col("result.lines").alias("lines"))).alias("m")).select("book_id", "page", "m.ocr_mode", "m.lines")


def layers(native: DataFrame, ocr: DataFrame) -> DataFrame:
    """The native text of a page, else what was recognised; both (book_id, page, text)."""
    own = native.select("book_id", "page", F.lit("native").alias("layer"), "text")
    rest = ocr.join(own.select("book_id", "page"), ["book_id", "page"], "left_anti").select("book_id", "page", F.lit("ocr").alias("layer"), "text")
    return own.unionByName(rest)


def correct(lines: Column, edits: Column) -> Column:
    """Lines with the texts of ``edits`` (map of 0-based place to text) put in, the geometry kept; blank texts and places out of range change nothing."""
    return F.transform(
        lines, lambda v, i: F.struct(
            F.when(F.length(F.trim(edits[i])) > 0, edits[i]).otherwise(v["text"]).alias("text"), v["x"].alias("x"), v["y"].alias("y"), v["w"].alias("w"), v["h"].alias("h"),
            v["confidence"].alias("confidence")
        )
    )


def boxes(lines: Column) -> Column:
    """Lines as boxes for selection, blank ones left out."""
    return F.transform(
        F.filter(lines, lambda v: F.length(F.trim(v["text"])) > 0), lambda v: F.struct(v["text"].alias("char"), v["x"].alias("x"), v["y"].alias("y"), v["w"].alias("w"), v["h"].alias("h"))
    )
