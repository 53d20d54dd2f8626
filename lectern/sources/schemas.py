"""Explicit schemas of the library's tables, empty tables of them, and the chain that brings older ones up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

RECTS = "array<struct<x: double, y: double, w: double, h: double>>"
LINES = "struct<lines: array<struct<text: string, x: double, y: double, w: double, h: double, confidence: double>>, mode: string>"
SCHEMAS = {
    "books": "id long, title string, original_path string, stored_path string, file_type string, page_count long, cover_path string, favorite boolean, category_id long, last_opened_at timestamp_ntz, imported_at timestamp_ntz",
    "categories": "id long, name string, sort_order long, created_at timestamp_ntz",
    "reading_progress": "book_id long, page long, zoom double, view_mode string, updated_at timestamp_ntz",
    "annotations": f"id long, book_id long, page long, kind string, text string, content string, rects {RECTS}, color string, created_at timestamp_ntz, updated_at timestamp_ntz",
    "image_annotations": "id long, book_id long, page long, kind string, x double, y double, w double, h double, rotation double, payload string, style string, created_at timestamp_ntz",
    "page_ocr_cache": f"book_id long, page long, ocr_mode string, result {LINES}, created_at timestamp_ntz",
    "page_text_index": "book_id long, page long, source string, raw_text string, original_text string, indexed_at timestamp_ntz",
    "ai_threads": "id long, title string, action_type string, book_id long, created_at timestamp_ntz, updated_at timestamp_ntz",
    "ai_messages": "id long, thread_id long, role string, content string, image_path string, action_type string, created_at timestamp_ntz",
    "settings": "key string, value string, updated_at timestamp_ntz",
}
#: Key of each table, and the table and column that its rows vanish with.
KEYS = {
    "books": ["id"], "categories": ["id"], "reading_progress": ["book_id"], "annotations": ["id"], "image_annotations": ["id"], "page_ocr_cache": ["book_id", "page", "ocr_mode"],
    "page_text_index": ["book_id", "page"], "ai_threads": ["id"], "ai_messages": ["id"], "settings": ["key"]
}
OWNED_BY_BOOK = ["reading_progress", "annotations", "image_annotations", "page_ocr_cache", "page_text_index"]
LATEST_VERSION = 6


def empty(spark: SparkSession, table: str) -> DataFrame:
    return spark.createDataFrame([], SCHEMAS[table])


def _with_missing(df: DataFrame, table: str) -> DataFrame:
    """All columns of the table, those that are missing null."""
    fields = df.sparkSession.createDataFrame([], SCHEMAS[table]).schema
    return df.select(*(F.col(f.name).cast(f.dataType).alias(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in fields))


def migrate(spark: SparkSession, tables: dict[str, DataFrame], version: int) -> dict[str, DataFrame]:
    """Tables of an older version with every later step applied: before 3, conversations had no book and are cleared; whatever is missing is added."""
    out = {}
    for name in SCHEMAS:
        df = tables.get(name)
        if df is None or (version < 3 and name in ("ai_threads", "ai_messages")):
            out[name] = empty(spark, name)
        else:
            out[name] = _with_missing(df, name)
    return out


def recorded_version(versions: DataFrame) -> DataFrame:
    """(version): the newest version put down, null where none is."""
    return versions.agg(F.max("version").alias("version"))


def migrate_recorded(spark: SparkSession, tables: dict[str, DataFrame], versions: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """``migrate`` from the version put down, and ``versions`` with the latest one added unless it is there; a version that isn't known yet is an error."""
    now = recorded_version(versions).first().version
    if now is not None and now > LATEST_VERSION:
        raise ValueError(f"version {now} is newer than {LATEST_VERSION}")
    done = versions if now == LATEST_VERSION else versions.unionByName(spark.createDataFrame([(LATEST_VERSION,)], versions.select("version").schema))
    return migrate(spark, tables, LATEST_VERSION if now is None else now), done
