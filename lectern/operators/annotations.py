"""Annotations: lists, visibility and the exports by page."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import decode
from ..ordering import rank_in_groups

# Fixed values of the export format: headings, placeholder, icons and labels.
HEADING, EMPTY, PAGE = "# 阅读标注\n", "\n> 暂无标注\n", "\n## 第 {} 页\n\n"
KIND_LABELS = {"highlight": "🔆 高亮", "underline": "➖ 下划线", "strikethrough": "🚫 删除线", "note": "📝 笔记"}
MARK_LABELS = {"brush": "🖌 画笔", "shape": "⬜ 形状", "sticky": "📌 便签", "stamp": "🔖 图章"}
POINTS = "（{} 个点）"


def _choose(value: Column, labels: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for kv in labels.items() for x in kv))[value]


def _quoted(text: Column) -> Column:
    return F.when(F.coalesce(text, F.lit("")) != "", F.concat(F.lit("  > "), F.replace(text, F.lit("\n"), F.lit("\n  > ")), F.lit("\n"))).otherwise("")


def annotation_line(kind: Column, text: Column, content: Column) -> Column:
    return F.concat(F.lit("- "), _choose(decode.one_of(kind, decode.TEXT_KINDS, "highlight"), KIND_LABELS), F.lit("："), F.coalesce(text, F.lit("")), F.lit("\n"), _quoted(content))


def mark_line(kind: Column, payload: Column) -> Column:
    kind = decode.one_of(kind, decode.MARK_KINDS, "brush")
    before, after = POINTS.split("{}")
    text, file, shape = (decode.payload_text(payload, k) for k in ("text", "file", "shapeType"))
    detail = F.when(kind == "sticky", F.coalesce(text, F.lit(""))).when(kind == "stamp", F.coalesce(file, F.lit(""))).when(kind == "shape", F.coalesce(F.concat(F.lit("（"), shape, F.lit("）")), F.lit(""))).otherwise(F.concat(F.lit(before), decode.payload_points(payload).cast("string"), F.lit(after)))
    return F.concat(F.lit("- "), _choose(kind, MARK_LABELS), detail, F.lit("\n"), F.when(kind == "sticky", _quoted(text)).otherwise(""))


def items(annotations: DataFrame, marks: DataFrame | None = None, hidden: list[str] | None = None) -> DataFrame:
    """(book_id, page, src, created_at, id, kind, line): both sorts in one shape, hidden kinds left out; replayed rows once."""
    own = annotations.dropDuplicates(["id"]).withColumn("kind", decode.one_of(F.col("kind"), decode.TEXT_KINDS, "highlight"))
    parts = [own.select("book_id", "page", F.lit(0).alias("src"), "created_at", "id", "kind", annotation_line(F.col("kind"), F.col("text"), F.col("content")).alias("line"))]
    if marks is not None:
        parts.append(marks.select("book_id", "page", F.lit(1).alias("src"), "created_at", "id", "kind", mark_line(F.col("kind"), F.col("payload")).alias("line")))
    both = reduce(DataFrame.unionByName, parts)
    return both.where(~F.col("kind").isin(hidden)) if hidden else both


def markdown(annotations: DataFrame, marks: DataFrame | None = None) -> DataFrame:
    """(book_id, markdown): each book's export; first each page is joined, then the pages, so no task holds more than one page's lines."""
    lines = items(annotations, marks)
    before, after = PAGE.split("{}")
    page = lines.groupBy("book_id", "page").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("src", "created_at", "id", "line"))), lambda x: x["line"]), "").alias("body"))
    page = page.select("book_id", "page", F.concat(F.lit(before), (F.col("page") + 1).cast("string"), F.lit(after), F.col("body")).alias("body"))
    return page.groupBy("book_id").agg(F.concat(F.lit(HEADING), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("page", "body"))), lambda x: x["body"]), "")).alias("markdown"))


def markdown_for(books: DataFrame, annotations: DataFrame, marks: DataFrame | None = None) -> DataFrame:
    """``markdown`` for all of ``books`` (id), with the placeholder where there is nothing."""
    done = markdown(annotations, marks)
    return books.select(F.col("id").alias("book_id")).join(done, "book_id", "left").withColumn("markdown", F.coalesce("markdown", F.lit(HEADING + EMPTY)))


#: Fields of the export, in its order.
ANNOTATION_FIELDS = ["id", "book_id", "page", "kind", "text", "content", "rects", "color", "created_at", "updated_at"]
MARK_FIELDS = ["id", "book_id", "page", "kind", "x", "y", "w", "h", "rotation", "payload", "style", "created_at"]


def _listed(df: DataFrame, fields: list[str], out: str) -> DataFrame:
    have = [F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in fields]
    row = F.struct(F.col("page").alias("_page"), F.col("created_at").alias("_at"), F.col("id").alias("_id"), F.struct(*have).alias("row"))
    return df.dropDuplicates(["id"]).groupBy(F.col("book_id").alias("_book")).agg(F.transform(F.sort_array(F.collect_list(row)), lambda v: v["row"]).alias(out))


def export_json(annotations: DataFrame, marks: DataFrame | None = None) -> DataFrame:
    """(book_id, json): the annotations and image marks of each book that has any, all their fields, nulls included, in order of page, time and id; printed for reading."""
    both = _listed(annotations, ANNOTATION_FIELDS, "annotations")
    if marks is not None:
        other = _listed(marks, MARK_FIELDS, "image_marks")
        both = both.join(other, "_book", "full")
        none = F.array().cast(other.schema["image_marks"].dataType)
    else:
        both, none = both.withColumn("image_marks", F.array().cast("array<string>")), F.array().cast("array<string>")
    lists = [F.coalesce("annotations", F.array().cast(both.schema["annotations"].dataType)).alias("annotations"), F.coalesce("image_marks", none).alias("image_marks")]
    body = F.to_json(F.struct(F.col("_book").alias("book_id"), *lists), {"ignoreNullFields": "false", "pretty": "true"})
    return both.select(F.col("_book").alias("book_id"), body.alias("json"))


def rail(items: DataFrame) -> DataFrame:
    """``items`` with place, 0-based: the order of a book's list, by page, annotations before marks, then by time and id."""
    return rank_in_groups(items, ["book_id"], ["page", "src", "created_at", "id"], "place")


def on_page(items: DataFrame, page: int) -> DataFrame:
    return items.where(F.col("page") == page)


def stamp_files(marks: DataFrame, files: DataFrame) -> DataFrame:
    """(id, file, size): each stamp with its image among ``files`` (file, size), null where it is gone."""
    stamps = marks.where("kind = 'stamp'").select("id", decode.payload_text(F.col("payload"), "file").alias("file"))
    return stamps.join(files.select("file", "size"), "file", "left").select("id", "file", "size")
