"""The whole library as one value: its tables, and the functions of the data interface on them.

Not among them are those that draw pages (pages, thumbnails and covers as pixels), those that hold a document open, and those that talk to a network
(chat and vision streams), for which ``streaming.events`` decodes what comes back.

Reads give DataFrames; changes give a new ``Library`` and leave the old one as it is.  ``load`` and ``save`` keep the tables as parquet.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, replace

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from .functions import decode, text as T
from .operators import annotations as A, conversations as C, library as L, ocr as O, opening, search as S, tables as tb
from .ordering import rank_in_groups
from .sources import documents, schemas


@dataclass(frozen=True)
class Library:
    spark: SparkSession
    tables: dict[str, DataFrame]
    now: dt.datetime = dt.datetime(1970, 1, 1)

    @classmethod
    def create(cls, spark: SparkSession) -> Library:
        return cls(spark, {t: schemas.empty(spark, t) for t in schemas.SCHEMAS})

    @classmethod
    def load(cls, spark: SparkSession, folder: str) -> Library:
        """Tables below a folder; those that are missing are empty, missing columns null."""
        there = {}
        for t in schemas.SCHEMAS:
            try:
                there[t] = spark.read.parquet(f"{folder}/{t}.parquet")
            except AnalysisException:  # no such table
                pass
        return cls(spark, schemas.migrate(spark, there, schemas.LATEST_VERSION))

    def save(self, folder: str) -> None:
        """Writes all tables below a folder, which must be another than the one they are read from."""
        for t, df in self.tables.items():
            df.write.mode("overwrite").parquet(f"{folder}/{t}.parquet")

    def at(self, now: dt.datetime) -> Library:
        """The same library with its clock set; changes carry this time."""
        return replace(self, now=now)

    def table(self, name: str) -> DataFrame:
        return self.tables[name]

    def _with(self, **tables: DataFrame) -> Library:
        return replace(self, tables=self.tables | tables)

    def _rows(self, table: str, rows: list[tuple]) -> DataFrame:
        return self.spark.createDataFrame(rows, schemas.SCHEMAS[table])

    def _next_id(self, table: str) -> int:
        return (self.table(table).agg(F.max("id")).first()[0] or 0) + 1

    def _set(self, table: str, id_: int, **values) -> Library:
        df = self.table(table)
        return self._with(**{table: df.select(*(F.when(F.col("id") == id_, F.lit(values[c]).cast(df.schema[c].dataType)).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in df.columns))})

    # settings and configuration
    def get_setting(self, key: str) -> str | None:
        row = self.table("settings").where(F.col("key") == key).first()
        return row.value if row else None

    def set_setting(self, key: str, value: str) -> Library:
        new = self._rows("settings", [(key, value, self.now)])
        return self._with(settings=tb.upsert(self.table("settings"), new, ["key"], ["updated_at"]))

    def get_ai_config(self) -> DataFrame:
        """One row: the stored configuration with defaults."""
        stored = self.get_setting("ai_config")
        return self.spark.createDataFrame([(stored,)], "value string").select(decode.config(F.col("value")).alias("config")).select("config.*")

    def set_ai_config(self, json: str) -> Library:
        return self.set_setting("ai_config", json)

    # books and categories
    def list_books(self, view: str = "all", category_id: int | None = None, search: str = "") -> DataFrame:
        return L.filtered(L.books(self.table("books")), view, category_id, search)

    def get_book(self, id_: int) -> DataFrame:
        return self.table("books").where(F.col("id") == id_)

    def find_book(self, original_path: str | None = None, stored_path: str | None = None) -> DataFrame:
        col, value = ("original_path", original_path) if original_path is not None else ("stored_path", stored_path)
        return self.table("books").where(F.col(col) == value)

    def import_books(self, paths: DataFrame) -> tuple[Library, DataFrame]:
        """New files added (of ``paths`` (original_path)), and the outcome of each path."""
        outcome = L.import_outcomes(paths, self.table("books"))
        new = L.import_candidates(paths).join(outcome.where("outcome = 'imported'").select("original_path"), "original_path", "left_semi").dropDuplicates(["original_path"])
        first = self._next_id("books")
        numbered = rank_in_groups(new.withColumn("_g", F.lit(0)), ["_g"], ["original_path"])
        now = F.lit(self.now).cast("timestamp_ntz")
        rows = numbered.select(
            (F.col("rank") + first).cast("long").alias("id"), "title", "original_path", F.concat(F.lit("documents/"), F.lpad((F.col("rank") + first).cast("string"), 8, "0"), F.lit("."), decode.extension(F.col("original_path"))).alias("stored_path"), "file_type", "page_count",
            F.when(F.col("has_cover"), F.col("original_path")).alias("cover_path"), F.lit(False).alias("favorite"), F.lit(None).cast("long").alias("category_id"), F.lit(None).cast("timestamp_ntz").alias("last_opened_at"), now.alias("imported_at"),
        )
        return self._with(books=self.table("books").unionByName(rows)), outcome

    def delete_book(self, id_: int) -> Library:
        gone = self.spark.createDataFrame([(id_,)], "id long")
        kept = tb.cascade({t: (self.table(t), "book_id") for t in schemas.OWNED_BY_BOOK} | {"books": (self.table("books"), "id")}, gone)
        markers = self.table("settings").where(~F.col("key").isin(f"index_ready:{id_}", f"index_failed:{id_}"))
        return self._with(**kept, settings=markers)

    def toggle_favorite(self, id_: int) -> Library:
        b = self.table("books")
        return self._with(books=b.withColumn("favorite", F.when(F.col("id") == id_, ~F.col("favorite")).otherwise(F.col("favorite"))))

    def touch_last_opened(self, id_: int) -> Library:
        return self._set("books", id_, last_opened_at=self.now)

    def assign_category(self, id_: int, category_id: int | None) -> Library:
        return self._set("books", id_, category_id=category_id)

    def list_categories(self) -> DataFrame:
        return self.table("categories").orderBy("sort_order", "created_at")

    def create_category(self, name: str) -> Library:
        order = tb.next_position(self.table("categories"), "sort_order").first()[0]
        new = self._rows("categories", [(self._next_id("categories"), name, order, self.now)])
        return self._with(categories=tb.insert(self.table("categories"), new, ["name"]))

    def rename_category(self, id_: int, name: str) -> Library:
        if self.table("categories").where((F.col("name") == name) & (F.col("id") != id_)).first():
            raise ValueError(f"a category {name!r} exists")
        return self._set("categories", id_, name=name)

    def delete_category(self, id_: int) -> Library:
        gone = self.spark.createDataFrame([(id_,)], "id long")
        return self._with(categories=tb.delete(self.table("categories"), gone, "id"), books=tb.set_null(self.table("books"), gone, "category_id"))

    # reading
    def get_progress(self, book_id: int) -> DataFrame:
        return self.table("reading_progress").where(F.col("book_id") == book_id).withColumn("view_mode", decode.view_mode(F.col("view_mode")))

    def save_progress(self, book_id: int, page: int, zoom: float, view_mode: str) -> Library:
        new = self._rows("reading_progress", [(book_id, page, zoom, view_mode, self.now)])
        return self._with(reading_progress=tb.upsert(self.table("reading_progress"), new, ["book_id"], ["updated_at"]))

    # annotations
    def list_annotations(self, book_id: int) -> DataFrame:
        return self.table("annotations").where(F.col("book_id") == book_id).withColumn("kind", decode.one_of(F.col("kind"), decode.TEXT_KINDS, "highlight")).orderBy("page", "created_at", "id")

    def create_annotation(self, book_id: int, page: int, kind: str, text: str | None = None, content: str | None = None, rects: list | None = None, color: str | None = None) -> Library:
        new = self._rows("annotations", [(self._next_id("annotations"), book_id, page, kind, text, content, rects or [], color, self.now, self.now)])
        return self._with(annotations=self.table("annotations").unionByName(new))

    def update_annotation_content(self, id_: int, content: str | None) -> Library:
        return self._set("annotations", id_, content=content, updated_at=self.now)

    def delete_annotation(self, id_: int) -> Library:
        return self._with(annotations=self.table("annotations").where(F.col("id") != id_))

    def list_image_annotations(self, book_id: int) -> DataFrame:
        return self.table("image_annotations").where(F.col("book_id") == book_id).orderBy("page", "created_at", "id")

    def create_image_annotation(self, book_id: int, page: int, kind: str, x: float, y: float, payload: str, w: float | None = None, h: float | None = None, rotation: float = 0.0, style: str = "{}") -> Library:
        new = self._rows("image_annotations", [(self._next_id("image_annotations"), book_id, page, kind, x, y, w, h, rotation, payload, style, self.now)])
        return self._with(image_annotations=self.table("image_annotations").unionByName(new))

    def update_image_annotation(self, id_: int, **values) -> Library:
        return self._set("image_annotations", id_, **values)

    def delete_image_annotation(self, id_: int) -> Library:
        return self._with(image_annotations=self.table("image_annotations").where(F.col("id") != id_))

    def export_annotations_markdown(self, book_id: int) -> str:
        own = self.spark.createDataFrame([(book_id,)], "id long")
        return A.markdown_for(own, self.list_annotations(book_id), self.list_image_annotations(book_id)).first().markdown

    def export_annotations_json(self, book_id: int) -> str | None:
        """The annotations and image marks of a book, null if it has none."""
        row = A.export_json(self.list_annotations(book_id), self.list_image_annotations(book_id)).first()
        return row.json if row else None

    def notes_rail(self, book_id: int) -> DataFrame:
        return A.rail(A.items(self.list_annotations(book_id), self.list_image_annotations(book_id))).orderBy("place")

    # documents
    def open_book(self, stored_path: str, pages: int | None = None) -> tuple[Library, DataFrame]:
        """How a stored path is opened (see ``opening.routes``), and the library with a page count that was missing put right; ``pages``: those of the file."""
        opened = self.spark.createDataFrame([(stored_path, pages)], "stored_path string, pages long")
        route = opening.routes(self.table("books"), opened, opened)
        found = route.where("book_id IS NOT NULL").select(F.col("book_id").alias("id"), F.col("page_count").alias("pages"))
        return self._with(books=L.heal_on_open(self.table("books"), found)), route

    def extract_text(self, files: DataFrame, extractor: documents.Extractor = documents.simple_pdf_pages) -> DataFrame:
        return documents.page_texts(files, extractor)

    def page_has_text(self, book_id: int, page: int) -> bool:
        some = self.table("page_text_index").where((F.col("book_id") == book_id) & (F.col("page") == page))
        return bool(some.where(T.has_text(F.col("original_text"))).first())

    def scan_page(self, book_id: int, page: int, mode: str, recogniser: opening.Recogniser | None = None) -> tuple[Library, DataFrame]:
        """A page's lines, from the cache or else from the recogniser, whose result is kept and indexed."""
        asked = self.spark.createDataFrame([(book_id, page, mode)], "book_id long, page long, ocr_mode string")
        done = opening.scan(asked, self.table("page_ocr_cache"), recogniser)
        fresh = done.where("origin = 'engine' AND error IS NULL").select("book_id", "page", "ocr_mode", F.struct(F.col("lines").alias("lines"), F.col("ocr_mode").alias("mode")).alias("result"), F.lit(self.now).cast("timestamp_ntz").alias("created_at"))
        return self.save_page_ocr(fresh), done

    def ensure_book_index(self, book_id: int, pages: DataFrame) -> Library:
        """The index of a book built from its ``pages`` (book_id, page, text, error), unless it is there or a build has failed; how that went is put down."""
        wanted = opening.to_index(self.search_index_status()).where(F.col("id") == book_id)
        mark = opening.built(wanted, pages).first()
        if mark is None:
            return self
        marked = self.set_setting(f"index_{mark.status}:{book_id}", str(mark.pages))
        return marked.index_pages(pages.where("error IS NULL").select("book_id", "page", F.lit("native").alias("source"), "text")) if mark.status == "ready" else marked

    def template_default_text(self, chosen: str) -> str:
        return C.ROLE_TEMPLATES.get(chosen, "")

    # recognised text and search
    def get_page_ocr(self, book_id: int, page: int, mode: str) -> DataFrame:
        return self.table("page_ocr_cache").where((F.col("book_id") == book_id) & (F.col("page") == page) & (F.col("ocr_mode") == mode))

    def save_page_ocr(self, rows: DataFrame) -> Library:
        """Results of pages stored, and the pages' texts indexed, the last source to come being the one that counts."""
        lines = F.col("result.lines")
        texts = rows.select(
            "book_id", "page", F.lit("ocr").alias("source"), T.token_text(O.page_text(lines)).alias("raw_text"), O.page_text(lines).alias("original_text"),
            F.lit(self.now).cast("timestamp_ntz").alias("indexed_at")
        ).where(T.has_text(F.col("original_text")))
        return self._with(
            page_ocr_cache=tb.upsert(self.table("page_ocr_cache"), rows, ["book_id", "page", "ocr_mode"], ["created_at"]),
            page_text_index=tb.upsert(self.table("page_text_index"), texts, ["book_id", "page"], ["indexed_at"])
        )

    def update_page_ocr_lines(self, book_id: int, page: int, mode: str, edits: dict[int, str]) -> Library:
        kinds = F.create_map(*(F.lit(x) for kv in edits.items() for x in kv)) if edits else F.create_map().cast("map<int,string>")
        own = self.get_page_ocr(book_id, page, mode)
        fixed = own.withColumn(
            "result", F.struct(O.correct(F.col("result.lines"), kinds).alias("lines"), F.col("result.mode").alias("mode"))
        ).withColumn("created_at", F.lit(self.now).cast("timestamp_ntz"))
        return self.save_page_ocr(fixed)

    def index_pages(self, pages: DataFrame) -> Library:
        """Pages' texts (book_id, page, source, text) put into the index, blank ones left out."""
        body = T.trim_white(F.col("text"))
        new = pages.where(T.has_text(F.col("text"))).select("book_id", "page", "source", T.token_text(body).alias("raw_text"), body.alias("original_text"), F.lit(self.now).cast("timestamp_ntz").alias("indexed_at"))
        return self._with(page_text_index=tb.upsert(self.table("page_text_index"), new, ["book_id", "page"], ["indexed_at"]))

    def search_books(self, query: str, limit: int | None = None) -> DataFrame:
        return S.search(self.table("page_text_index"), query, limit)

    def search_index_status(self) -> DataFrame:
        failed = self.table("settings").where("key LIKE 'index_failed:%'").select(F.regexp_extract("key", r":(\d+)$", 1).cast("long").alias("book_id"))
        ready = self.table("settings").where("key LIKE 'index_ready:%'").select(F.regexp_extract("key", r":(\d+)$", 1).cast("long").alias("book_id"))
        return L.index_status(self.table("books"), self.table("page_text_index").select("book_id").unionByName(ready), failed)

    # conversations
    def list_ai_threads(self) -> DataFrame:
        return self.table("ai_threads").orderBy(F.desc("updated_at"), F.desc("id"))

    def list_ai_messages(self, thread_id: int) -> DataFrame:
        return C.messages(self.table("ai_messages")).where(F.col("thread_id") == thread_id).orderBy("created_at", "id")

    def create_ai_thread(self, title: str, action_type: str, book_id: int | None) -> Library:
        if book_id is not None and self.table("ai_threads").where(F.col("book_id") == book_id).first():
            raise ValueError(f"book {book_id} has a thread")
        new = self._rows("ai_threads", [(self._next_id("ai_threads"), title.strip() or "untitled", action_type, book_id, self.now, self.now)])
        return self._with(ai_threads=self.table("ai_threads").unionByName(new))

    def append_ai_message(self, thread_id: int, role: str, content: str, image_path: str | None = None, action_type: str | None = None) -> Library:
        """A message added and its thread brought up to date; an action that is null keeps the thread's."""
        if not content.strip() and not image_path:
            return self
        new = self._rows("ai_messages", [(self._next_id("ai_messages"), thread_id, role, content, image_path, action_type, self.now)])
        changed = {"updated_at": self.now} | ({"action_type": action_type} if action_type else {})
        return self._with(ai_messages=self.table("ai_messages").unionByName(new))._set("ai_threads", thread_id, **changed)

    def delete_ai_thread(self, id_: int) -> Library:
        return self._with(ai_threads=self.table("ai_threads").where(F.col("id") != id_), ai_messages=self.table("ai_messages").where(F.col("thread_id") != id_))
