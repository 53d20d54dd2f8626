"""The document library: catalogue, filters, ingest and index status."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import decode


def books(df: DataFrame) -> DataFrame:
    """The catalogue with decoded types, opened ones first, the latest before."""
    return df.withColumn("file_type", decode.file_type(F.col("file_type"))).orderBy(F.desc_nulls_last("last_opened_at"), F.desc("imported_at"), "id")


def filtered(df: DataFrame, view: str = "all", category_id: int | None = None, search: str = "") -> DataFrame:
    """One view (all, pdf, image, favorite, category), and the title search on top of it."""
    kinds = {"pdf": F.col("file_type") == "pdf", "image": F.col("file_type") == "image", "favorite": F.col("favorite"), "category": F.col("category_id").eqNullSafe(F.lit(category_id))}
    if view in kinds:
        df = df.where(kinds[view])
    if search.strip():
        df = df.where(F.contains(F.lower("title"), F.lit(search.strip().lower())))
    return df


def import_candidates(paths: DataFrame) -> DataFrame:
    """(original_path, file_type, title, page_count, has_cover): of each path what an import would store; file_type null: refused."""
    path = F.col("original_path")
    kind = decode.type_of_path(path)
    return paths.select(
        "original_path", kind.alias("file_type"), decode.stem(path).alias("title"), F.when(kind == "image", 1).otherwise(0).cast("long").alias("page_count"), (kind == "image").alias("has_cover")
    )


def import_outcomes(paths: DataFrame, catalogue: DataFrame) -> DataFrame:
    """(original_path, outcome): imported, existed or failed; equal new paths are imported once."""
    known = catalogue.select("original_path").distinct().withColumn("_known", F.lit(True))
    counted = import_candidates(paths).groupBy("original_path").agg(F.max("file_type").alias("file_type"), F.count("*").alias("times"))
    joined = counted.join(known, "original_path", "left")
    outcome = F.when(F.col("_known"), "existed").when(F.col("file_type").isNull(), "failed").otherwise("imported")
    return joined.select("original_path", outcome.alias("outcome"), "times")


def index_status(books: DataFrame, indexed: DataFrame, failed: DataFrame, building: DataFrame | None = None) -> DataFrame:
    """(id, status): building before ready (pages indexed) before failed before missing; only pdf books are indexed."""
    has = indexed.select(F.col("book_id").alias("id")).distinct().withColumn("_has", F.lit(True))
    bad = failed.select(F.col("book_id").alias("id")).distinct().withColumn("_bad", F.lit(True))
    joined = books.where("file_type = 'pdf'").select("id").join(has, "id", "left").join(bad, "id", "left")
    busy = F.lit(False)
    if building is not None:
        joined = joined.join(building.select(F.col("book_id").alias("id")).distinct().withColumn("_busy", F.lit(True)), "id", "left")
        busy = F.coalesce("_busy", F.lit(False))
    return joined.select("id", F.when(busy, "building").when(F.col("_has"), "ready").when(F.col("_bad"), "failed").otherwise("missing").alias("status"))


def heal_on_open(books: DataFrame, found: DataFrame) -> DataFrame:
    """``books`` with a page count that was 0 taken from ``found`` (id, pages)."""
    joined = books.join(found.select(F.col("id").alias("_id"), "pages"), F.col("id") == F.col("_id"), "left")
    return joined.withColumn("page_count", F.coalesce(F.nullif("page_count", F.lit(0).cast("long")), "pages", F.lit(0).cast("long"))).select(*books.columns)
