"""Opening, scanning and indexing documents: which path a file takes, what is fetched, and what is put down about it."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions import decode, text as T

LINES = "array<struct<text: string, x: double, y: double, w: double, h: double, confidence: double>>"
#: (book_id, page, ocr_mode) -> the page's lines as dictionaries
Recogniser = Callable[[int, int, str], list[dict]]


def routes(books: DataFrame, opened: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """(stored_path, book_id, route, page_count): how each of the paths ``opened`` (stored_path) is opened: as an image if its book is one, else as a pdf,
    also where no book has that path.  ``found`` (stored_path, pages): page counts of the files; an image has one page; counts that are known stay."""
    known = books.select(F.col("id").alias("book_id"), "stored_path", decode.file_type(F.col("file_type")).alias("_type"), F.nullif("page_count", F.lit(0).cast("long")).alias("_pages"))
    joined = opened.select("stored_path").join(known, "stored_path", "left")
    joined = joined.join(found.select("stored_path", "pages"), "stored_path", "left") if found is not None else joined.withColumn("pages", F.lit(None).cast("long"))
    route = F.when(F.col("_type") == "image", "image").otherwise("pdf")
    pages = F.when(route == "image", F.lit(1).cast("long")).otherwise(F.coalesce("_pages", "pages", F.lit(0).cast("long")))
    return joined.select("stored_path", "book_id", route.alias("route"), pages.alias("page_count"))


def scan(requests: DataFrame, cache: DataFrame, recogniser: Recogniser | None = None) -> DataFrame:
    """(book_id, page, ocr_mode, lines, origin, error): the requested pages, each once; those in the cache come from there, the others from the recogniser.

    Without one, or where it fails, a page comes back without lines and with its error, and the others go on.
    """
    key = ["book_id", "page", "ocr_mode"]
    wanted = requests.select(*key).distinct()
    kept = cache.select(*key, F.col("result.lines").cast(LINES).alias("lines")).groupBy(*key).agg(F.min("lines").alias("lines"))
    hits = wanted.join(kept, key).withColumn("origin", F.lit("cache")).withColumn("error", F.lit(None).cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("text", pa.string()), *((c, pa.float64()) for c in ("x", "y", "w", "h", "confidence"))]))
        for batch in batches:
            lines, errors = [], []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                try:
                    lines.append(recogniser(*row) if recogniser else [])
                    errors.append(None if recogniser else "no recogniser is installed")
                except Exception as e:  # noqa: BLE001
                    lines.append([])
                    errors.append(f"{type(e).__name__}: {e}"[: T.ERROR_LIMIT])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(lines, type=kind), pa.array(["engine"] * batch.num_rows), pa.array(errors, type=pa.string())], names=[*key, "lines", "origin", "error"]
            )

    missing = wanted.join(kept.select(*key), key, "left_anti")
    kinds = ", ".join(f"{c} {requests.schema[c].dataType.simpleString()}" for c in key)
    return hits.unionByName(missing.mapInArrow(run, f"{kinds}, lines {LINES}, origin string, error string"))


def to_index(status: DataFrame) -> DataFrame:
    """(id): books whose index has to be built: neither there nor being built, nor failed before; ``status`` as of ``library.index_status``."""
    return status.where("status = 'missing'").select("id")


def built(wanted: DataFrame, pages: DataFrame) -> DataFrame:
    """(id, status, pages): what a build puts down for the books ``wanted`` (id): ready with its pages that say something, or failed.

    ``pages`` has (book_id, page, text, error); a book without any row has vanished and leaves no mark.
    """
    sums = pages.groupBy(F.col("book_id").alias("id")).agg(F.count_if(T.has_text(F.col("text"))).alias("pages"), F.max(F.col("error").isNotNull()).alias("_bad"))
    joined = wanted.select("id").distinct().join(sums, "id")
    return joined.select("id", F.when(F.col("_bad"), "failed").otherwise("ready").alias("status"), F.when(F.col("_bad"), F.lit(0).cast("long")).otherwise(F.col("pages")).alias("pages"))
