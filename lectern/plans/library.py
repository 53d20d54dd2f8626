"""Queries on the catalogue, with their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..cluster import load
from ..functions import decode, geometry as G
from ..operators import library as L, tables as T

_TYPE = "CASE WHEN file_type IN ('pdf','image') THEN file_type ELSE 'image' END"
_STAMP = "strftime({}, '%Y-%m-%d %H:%M:%S')"


def _stamp(c: str):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def _short(df: DataFrame) -> DataFrame:
    return df.select("id", "title", "file_type", "favorite", "category_id")


def library_recent_first(s, d):
    return L.books(load(s, d, "books")).select("id", "title", "file_type", _stamp("last_opened_at").alias("opened"), _stamp("imported_at").alias("imported"))


def library_filter_title(s, d):
    return _short(L.filtered(load(s, d, "books"), "all", search="TIDES"))


def library_filter_type(s, d):
    return _short(L.filtered(load(s, d, "books"), "image"))


def library_filter_favorite(s, d):
    return _short(L.filtered(load(s, d, "books"), "favorite", search="salt"))


def library_filter_category(s, d):
    return _short(L.filtered(load(s, d, "books"), "category", 2, search="o"))


def book_lookup(s, d):
    b = load(s, d, "books")
    return b.where("id = 7").unionByName(b.where(F.col("stored_path") == "documents/00000012.pdf")).select("id", "title", "original_path", "stored_path")


def category_list(s, d):
    return load(s, d, "categories").orderBy("sort_order", "created_at").select("id", "name", "sort_order")


def category_next_order(s, d):
    return T.next_position(load(s, d, "categories"), "sort_order")


def category_delete_set_null(s, d):
    gone = load(s, d, "categories").where("sort_order <= 2")
    return T.set_null(load(s, d, "books"), gone, "category_id").select("id", "category_id")


def category_rename_collisions(s, d):
    renamed = load(s, d, "categories").select(F.substring(F.lower("name"), 1, 1).alias("name"))
    return T.duplicates(renamed, ["name"])


def import_classify(s, d):
    return L.import_candidates(load(s, d, "books").select("original_path"))


def _incoming(s, d):
    b = load(s, d, "books")
    return reduce(
        DataFrame.unionByName,
        [b.select("original_path"), b.select(F.concat("original_path", F.lit(".PNG")).alias("original_path")), b.select(F.concat("title", F.lit(".docx")).alias("original_path")), b.where("favorite").select(F.concat("original_path", F.lit(".PNG")).alias("original_path"))]
    )


_INCOMING = """WITH incoming AS (SELECT original_path FROM books UNION ALL SELECT original_path || '.PNG' FROM books UNION ALL SELECT title || '.docx' FROM books UNION ALL SELECT original_path || '.PNG' FROM books WHERE favorite),
counted AS (SELECT original_path, count(*) AS times FROM incoming GROUP BY 1),
outcomes AS (SELECT original_path, times, CASE WHEN original_path IN (SELECT original_path FROM books) THEN 'existed' WHEN regexp_matches(lower(original_path), '\\.(pdf|png|jpg|jpeg|webp|bmp|gif|tiff|tif)$') THEN 'imported' ELSE 'failed' END AS outcome FROM counted)"""


def import_dedup(s, d):
    return L.import_outcomes(_incoming(s, d), load(s, d, "books"))


def import_summary(s, d):
    return import_dedup(s, d).groupBy("outcome").agg(F.count("*").alias("paths"), F.sum("times").alias("files"))


def cascade_delete_book(s, d):
    gone = load(s, d, "books").where("favorite")
    kept = T.cascade({t: (load(s, d, t), "book_id") for t in ("annotations", "page_ocr_cache", "search_hits", "ai_threads")} | {"books": (load(s, d, "books"), "id")}, gone)
    kept["ai_threads"] = load(s, d, "ai_threads")  # a conversation outlives its book
    return reduce(DataFrame.unionByName, [df.select(F.lit(t).alias("table_name")).groupBy("table_name").agg(F.count("*").alias("rows")) for t, df in kept.items()])


def favorite_toggle(s, d):
    b = load(s, d, "books")
    return T.update(b, b.where("category_id = 3").select("id", (~F.col("favorite")).alias("favorite")), "id", ["favorite"]).select("id", "favorite")


def book_open_heal(s, d):
    pages = load(s, d, "page_ocr_cache").groupBy(F.col("book_id").alias("id")).agg((F.max("page") + 1).alias("pages"))
    return L.heal_on_open(load(s, d, "books"), pages).select("id", "page_count")


def index_status(s, d):
    failed = load(s, d, "books").where("page_count = 0").select(F.col("id").alias("book_id"))
    return L.index_status(load(s, d, "books"), load(s, d, "page_ocr_cache"), failed)


def progress_latest(s, d):
    e = load(s, d, "events").select(F.col("user_id").alias("book_id"), "event_id", "ts", "value")
    p = T.latest(e, ["book_id"], ["ts", "event_id"])
    return p.select(
        "book_id", G.zoom(F.col("value")).alias("zoom"), G.page_within((F.col("event_id") % 50).cast("long"), F.lit(40).cast("long")).alias("page"),
        decode.view_mode(F.lit("doubleScroll")).alias("view_mode")
    )


def progress_debounced(s, d):
    """Bursts of changes less than a minute apart, of which the last one persists."""
    e = load(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    b = e.groupBy("user_id", F.session_window("ts", "1 minute").alias("w")).agg(F.max(F.struct("ts", "event_id", "value")).alias("m"), F.count("*").alias("changes"))
    return b.select(F.col("user_id").alias("book_id"), F.col("m.event_id").alias("event_id"), F.col("m.value").alias("value"), "changes")


def zoom_tiers(s, d):
    return load(s, d, "events").groupBy(G.zoom_tier(F.col("value") / 5).alias("tier")).agg(F.count("*").alias("n"))


def page_spreads(s, d):
    page = (F.col("event_id") % 41).cast("long")
    rows = load(s, d, "events").select("event_id", F.explode(G.spread_pages(page, F.lit(True), F.lit(40).cast("long"))).alias("page0"))
    return rows.select("event_id", "page0", F.floor(F.col("page0") / 2).cast("long").alias("pair"))


def settings_json(s, d):
    c = decode.config(F.regexp_replace(F.col("props"), "\"k\"", "\"temperature\""))
    return load(s, d, "events").select("event_id", c["temperature"].alias("temperature"), c["include_book_history"].alias("history"), c["ocr_mode"].alias("ocr_mode"), F.get_json_object("props", "$.k").cast("long").alias("k"))


def books_by_category(s, d):
    b = load(s, d, "books").join(load(s, d, "categories").select(F.col("id").alias("category_id"), "name"), "category_id", "left")
    return b.groupBy(F.coalesce("name", F.lit("none")).alias("category")).agg(F.count("*").alias("books"), F.count_if(F.col("last_opened_at").isNotNull()).alias("opened"))


_S = "SELECT id, title, file_type, favorite, category_id FROM books WHERE "
QUERIES = {
    "library_recent_first": (
        library_recent_first,
        f"SELECT id, title, {_TYPE} AS file_type, {_STAMP.format('last_opened_at')} AS opened, {_STAMP.format('imported_at')} AS imported FROM books ORDER BY last_opened_at DESC NULLS LAST, imported_at DESC, id"
    ),
    "library_filter_title": (library_filter_title, _S + "contains(lower(title), 'tides')"),
    "library_filter_type": (library_filter_type, _S + "file_type = 'image'"),
    "library_filter_favorite": (library_filter_favorite, _S + "favorite AND contains(lower(title), 'salt')"),
    "library_filter_category": (library_filter_category, _S + "category_id IS NOT DISTINCT FROM 2 AND contains(lower(title), 'o')"),
    "book_lookup": (
        book_lookup,
        "SELECT id, title, original_path, stored_path FROM books WHERE id = 7 UNION ALL SELECT id, title, original_path, stored_path FROM books WHERE stored_path = 'documents/00000012.pdf'"
    ),
    "category_list": (category_list, "SELECT id, name, sort_order FROM categories ORDER BY sort_order, created_at"),
    "category_next_order": (category_next_order, "SELECT coalesce(max(sort_order), -1) + 1 AS next_position FROM categories"),
    "category_delete_set_null": (
        category_delete_set_null,
        "SELECT b.id, CASE WHEN c.id IS NULL THEN b.category_id END AS category_id FROM books b LEFT JOIN (SELECT id FROM categories WHERE sort_order <= 2) c ON b.category_id = c.id"
    ),
    "category_rename_collisions": (category_rename_collisions, "SELECT substr(lower(name), 1, 1) AS name, count(*) AS rows FROM categories GROUP BY 1 HAVING count(*) > 1"),
    "import_classify": (
        import_classify,
        r"""WITH p AS (SELECT original_path, lower(regexp_extract(original_path, '\.([A-Za-z0-9]+)$', 1)) AS ext, regexp_extract(original_path, '([^/\\]*)$', 1) AS name FROM books)
SELECT original_path, CASE WHEN ext = 'pdf' THEN 'pdf' WHEN ext IN ('png','jpg','jpeg','webp','bmp','gif','tiff','tif') THEN 'image' END AS file_type,
coalesce(nullif(regexp_replace(name, '(.)\.[^.]*$', '\1'), ''), 'untitled') AS title, CASE WHEN ext IN ('png','jpg','jpeg','webp','bmp','gif','tiff','tif') THEN 1 ELSE 0 END::BIGINT AS page_count,
CASE WHEN ext = 'pdf' THEN false WHEN ext IN ('png','jpg','jpeg','webp','bmp','gif','tiff','tif') THEN true END AS has_cover FROM p""",
    ),
    "import_dedup": (import_dedup, _INCOMING + " SELECT original_path, outcome, times FROM outcomes"),
    "import_summary": (import_summary, _INCOMING + " SELECT outcome, count(*) AS paths, sum(times)::BIGINT AS files FROM outcomes GROUP BY 1"),
    "cascade_delete_book": (
        cascade_delete_book,
        " UNION ALL ".join(
            f"SELECT '{t}' AS table_name, count(*) AS rows FROM {t} WHERE {k} IS NULL OR {k} NOT IN (SELECT id FROM books WHERE favorite)" for t,
            k in (("annotations", "book_id"), ("page_ocr_cache", "book_id"), ("search_hits", "book_id"), ("books", "id"))
        ) + " UNION ALL SELECT 'ai_threads' AS table_name, count(*) AS rows FROM ai_threads",
    ),
    "favorite_toggle": (favorite_toggle, "SELECT id, CASE WHEN category_id = 3 THEN NOT favorite ELSE favorite END AS favorite FROM books"),
    "book_open_heal": (
        book_open_heal,
        "SELECT b.id, coalesce(nullif(b.page_count, 0), p.pages, 0) AS page_count FROM books b LEFT JOIN (SELECT book_id, max(page) + 1 AS pages FROM page_ocr_cache GROUP BY 1) p ON b.id = p.book_id"
    ),
    "index_status": (
        index_status, "SELECT id, CASE WHEN id IN (SELECT book_id FROM page_ocr_cache) THEN 'ready' WHEN page_count = 0 THEN 'failed' ELSE 'missing' END AS status FROM books WHERE file_type = 'pdf'"
    ),
    "progress_latest": (
        progress_latest,
        "SELECT user_id AS book_id, greatest(0.3, least(4.0, value))::DOUBLE AS zoom, greatest(1, least(event_id % 50, 40))::BIGINT AS page, 'double_scroll' AS view_mode FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1",
    ),
    "progress_debounced": (
        progress_debounced,
        """WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 1 MINUTE THEN 0 ELSE 1 END AS fresh FROM events),
i AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS burst FROM g)
SELECT user_id AS book_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(value, (ts, event_id)) AS value, count(*) AS changes FROM i GROUP BY user_id, burst""",
    ),
    "zoom_tiers": (zoom_tiers, "SELECT greatest(0.5, least(4.0, round(value / 5 * 2) / 2))::DOUBLE AS tier, count(*) AS n FROM events GROUP BY 1"),
    "page_spreads": (
        page_spreads,
        """WITH p AS (SELECT event_id, CASE WHEN (event_id % 41) % 2 = 0 THEN event_id % 41 - 1 ELSE event_id % 41 END AS l FROM events), q AS (SELECT event_id, unnest([l - 1, l]) AS page0 FROM p)
SELECT event_id, page0, page0 // 2 AS pair FROM q WHERE page0 >= 0 AND page0 < 40""",
    ),
    "settings_json": (
        settings_json,
        "SELECT event_id, greatest(0.0, least(2.0, json_extract(props, '$.k')::DOUBLE)) AS temperature, true AS history, 'high_precision' AS ocr_mode, json_extract(props, '$.k')::BIGINT AS k FROM events"
    ),
    "books_by_category": (
        books_by_category, "SELECT coalesce(c.name, 'none') AS category, count(*) AS books, count(b.last_opened_at) AS opened FROM books b LEFT JOIN categories c ON b.category_id = c.id GROUP BY 1"
    ),
}
