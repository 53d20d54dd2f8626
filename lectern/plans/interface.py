"""Queries on gestures, payloads, changes of tables and requests, with their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..cluster import load
from ..functions import decode, geometry as G, interaction as I, text as T
from ..operators import tables as tb
from ..sources import documents, schemas, web


def _vectors(s, d):
    return load(s, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.round(F.abs(x.cast("double")), 4)).alias("e"))


def book_by_original_path(s, d):
    """Each book found again by its path."""
    b = load(s, d, "books")
    asked = b.select(F.col("original_path").alias("path"))
    return asked.join(b, F.col("path") == F.col("original_path"), "left").select("path", "id", "title")


def marks_of_books(s, d):
    """Image marks by book and page in their order's first and last."""
    m = load(s, d, "annotations").dropDuplicates(["id"]).where("kind IN ('note', 'highlight')")
    return m.groupBy("book_id").agg(F.min(F.struct("page", "created_at", "id"))["id"].alias("first_id"), F.max(F.struct("page", "created_at", "id"))["id"].alias("last_id"), F.count("*").alias("marks"))


def ocr_lookup(s, d):
    """The cached result of each page that is marked, in the fast mode."""
    asked = load(s, d, "annotations").select("book_id", "page").distinct().withColumn("ocr_mode", F.lit("fast"))
    cached = load(s, d, "page_ocr_cache").select("book_id", "page", "ocr_mode", F.size("result.lines").cast("long").alias("n_lines"))
    return asked.join(cached, ["book_id", "page", "ocr_mode"])


def progress_upserts(s, d):
    """Orders as changes of a customer's progress over a table that has some customers."""
    o = load(s, d, "orders")
    changes = o.select(F.col("o_custkey").alias("book_id"), F.col("o_orderkey").alias("page"), F.col("o_orderdate").alias("at"))
    table = load(s, d, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("book_id"), F.lit(-1).cast("long").alias("page"), F.lit(None).cast(changes.schema["at"].dataType).alias("at"))
    return tb.upsert(table, changes, ["book_id"], ["at", "page"]).select("book_id", F.col("page").cast("long").alias("page"))


def category_inserts(s, d):
    """Books' titles as new category names, those that are there left out."""
    names = load(s, d, "categories").select("name")
    new = load(s, d, "books").select(F.coalesce(F.when(F.col("id") % 3 == 0, F.lit("Fiction")), F.trim("title")).alias("name"))
    return tb.insert(names, new, ["name"])


def message_appends(s, d):
    """Messages appended to threads: those with something to say bring their thread up to date."""
    m = load(s, d, "ai_messages").where("id IS NOT NULL").dropDuplicates(["id"]).where(T.has_text(F.col("content")) | F.col("image_path").isNotNull())
    bumps = m.groupBy(F.col("thread_id").alias("id")).agg(F.max("created_at").alias("updated_at"))
    return tb.update(load(s, d, "ai_threads"), bumps, "id", ["updated_at"]).select("id", F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss").alias("updated"))


def removed_annotations(s, d):
    n = load(s, d, "annotations")
    return tb.delete(n, n.where("kind = 'note'").select("id").distinct(), "id").select("id", "book_id")


def migrated_tables(s, d):
    """Old rows without the newer columns, brought up to date."""
    old = {"ai_threads": load(s, d, "ai_threads").select("id", "title"), "annotations": load(s, d, "annotations").drop("text", "content")}
    new = schemas.migrate(s, old, 2)
    return reduce(lambda a, b: a.unionByName(b), [new[t].agg(F.lit(t).alias("name"), F.count("*").alias("rows"), F.lit(len(new[t].columns)).alias("columns")) for t in ("annotations", "ai_threads")])


def page_numbers(s, d):
    """Pages of a text divided by form feeds, 0-based; the first book's scans stand for files."""
    files = load(s, d, "documents").where("text IS NOT NULL").select(F.col("doc_id").cast("string").alias("original_path"), F.encode(F.concat("text", F.lit("\f"), F.lit("end")), "utf-8").alias("content"))
    p = documents.page_texts(files, documents.plain_pages)
    return p.groupBy("original_path").agg(F.count("*").alias("pages"), F.max("page").alias("last_page"), F.max_by("text", "page").alias("last_text"))


def web_results(s, d):
    """Search payloads made of the hits of a book, decoded and numbered."""
    value = F.array(F.struct(F.col("search_text").alias("name"), F.concat(F.lit("https://x/"), "book_id").alias("url"), F.col("snippet").alias("snippet")))
    hits = load(s, d, "search_hits").dropDuplicates(["hit_id"])
    payload = F.to_json(F.struct(F.struct(F.struct(value.alias("value")).alias("webPages")).alias("data")))
    return web.readable(hits.select("hit_id", payload.alias("payload"))).select("hit_id", F.md5("results").alias("digest"))


def hit_pieces(s, d):
    p = I.hit_pieces(F.col("snippet"), "the")
    h = load(s, d, "search_hits").dropDuplicates(["hit_id"]).select("hit_id", "snippet", p.alias("p"))
    whole = F.array_join(F.transform("p", lambda x: x["text"]), "")
    return h.select("hit_id", F.size(F.filter("p", lambda x: x["hit"])).cast("long").alias("hits"), (whole == F.col("snippet")).alias("whole"))


def corner_handles(s, d):
    box = F.struct(F.get("e", 0).alias("x"), F.get("e", 1).alias("y"), F.get("e", 2).alias("w"), F.get("e", 3).alias("h"))
    return _vectors(s, d).select("vec_id", I.corner_at(box, F.get("e", 4), F.get("e", 5), 0.1).cast("long").alias("corner"))


def mark_gestures(s, d):
    """Sizes and turns of marks, their guards, and the row at a scroll offset."""
    e = [F.get("e", i) for i in range(6)]
    box = I.centred_box(e[0], e[1], F.when(F.col("vec_id") % 2 == 0, e[2]), e[3], 0.2)
    return _vectors(s, d).select(
        "vec_id", F.round(I.resized(e[0], e[1]), 4).alias("size"), I.turned(F.lit(30), F.col("vec_id") % 7).cast("long").alias("rotation"), I.big_enough(F.slice("e", 1, F.lit(1) + (F.col("vec_id") % 4).cast("int")), e[0] - 0.05, e[1], F.col("vec_id") % 2 == 0).alias("kept"),
        I.row_at(e[4] * 1000, F.lit(37.0)).alias("row"), F.round(box["x"], 6).alias("x"), F.round(box["w"], 6).alias("w"),
    )


def screen_crops(s, d):
    e = [F.get("e", i) for i in range(4)]
    box = I.crop(F.struct((e[0] - 0.02).alias("x"), e[1].alias("y"), e[2].alias("w"), e[3].alias("h")), F.lit(1500.0), F.lit(200.0), F.lit(150.0))
    return _vectors(s, d).select("vec_id", *(F.round(box[k], 3).alias(k) for k in "xywh"))


def path_hits(s, d):
    """From a vector's first two values to the path of all others."""
    points = F.transform(F.sequence(F.lit(1), F.lit(31)), lambda i: F.array(F.get("e", i * 2), F.get("e", i * 2 + 1)))
    laid = _vectors(s, d).select("vec_id", F.get("e", 0).alias("x"), F.get("e", 1).alias("y"), points.alias("p"))
    return laid.select("vec_id", F.round(I.path_distance(F.col("p"), F.col("x"), F.col("y")), 5).alias("distance"))


def kind_toggles(s, d):
    kinds = F.array(F.lit("note"), F.lit("underline"))
    return load(s, d, "annotations").dropDuplicates(["id"]).select("id", F.array_join(F.array_sort(I.toggled(kinds, F.col("kind"))), ",").alias("kinds"))


def mark_payloads(s, d):
    n = load(s, d, "annotations").dropDuplicates(["id"])
    made = F.array(I.text_payload(F.coalesce("content", F.lit("-"))), I.stamp_payload(F.lit("s.png")), I.shape_payload(F.col("kind")), I.brush_payload(F.array(F.array(F.lit(0), F.lit(1)))))
    return n.select(
        "id", decode.payload_text(made[0], "text").alias("text"), decode.payload_text(made[1], "file").alias("file"), decode.payload_text(made[2], "shapeType").alias("shape"),
        decode.payload_points(made[3]).cast("long").alias("points")
    )


def rect_lists(s, d):
    """Rectangles to JSON and back; what can't be read is an empty list."""
    text = F.when(F.col("id") % 5 == 0, "[{").otherwise(F.to_json("rects"))
    r = decode.rects(text)
    return load(s, d, "annotations").dropDuplicates(["id"]).select("id", F.size(r).cast("long").alias("n"), F.round(F.aggregate(r, F.lit(0.0), lambda a, v: a + v["x"] + v["h"]), 5).alias("total"))


def requests(s, d):
    """Requests of messages, read again; the temperature is kept within its bounds."""
    m = load(s, d, "ai_messages").where("id IS NOT NULL").dropDuplicates(["id"])
    body = I.request_body(
        F.lit("m"), F.array(F.struct(F.lit("user").alias("role"), F.coalesce("content", F.lit("")).alias("content"))), (F.col("id") % 40) / 10 - 1, F.when(F.col("id") % 2 == 0, "high")
    )
    v = F.from_json("body", "model string, stream boolean, temperature double, reasoning_effort string, messages array<struct<role:string,content:string>>")
    return m.select("id", body.alias("body")).select("id", v.alias("v")).select("id", "v.model", "v.stream", "v.temperature", "v.reasoning_effort", F.md5(F.col("v.messages")[0]["content"]).alias("digest"))


def search_prompts(s, d):
    i = F.col("hit_id")
    p = I.search_prompt(i % 5 > 0, i % 5 > 1, F.when(i % 5 == 4, F.col("snippet")).otherwise(""), F.when(i % 5 == 2, "down"))
    return load(s, d, "search_hits").dropDuplicates(["hit_id"]).select("hit_id", F.md5(p).alias("digest"), I.follow_up(F.when(i % 2 == 0, "translate").otherwise("explain")).alias("next"))


def data_urls(s, d):
    return load(s, d, "documents").where("text IS NOT NULL").select("doc_id", F.md5(T.data_url(F.encode("text", "utf-8"))).alias("digest"))


def file_stamps(s, d):
    return load(s, d, "annotations").dropDuplicates(["id"]).select("id", T.file_stamp(F.col("created_at"), F.col("page").cast("int") + 800, F.lit(600)).alias("name"))


def view_modes(s, d):
    """Stored modes in either spelling and unknown ones."""
    i = F.col("event_id") % 6
    raw = F.when(i == 0, "single").when(i == 1, "doublePage").when(i == 2, "double_page").when(i == 3, "singleScroll").when(i == 4, "DOUBLE_SCROLL").otherwise("grid")
    return load(s, d, "events").select("event_id", decode.view_mode(raw).alias("mode"), G.page_within(I.page_step(i + 1, i % 2 == 0, F.lit(5).cast("long")), F.lit(5).cast("long")).alias("page"))


_N = "WITH n AS (SELECT DISTINCT * FROM annotations)"
_V = "WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: round(abs(x::DOUBLE), 4)) AS e FROM embeddings)"
_M = "WITH m AS (SELECT DISTINCT ON (id) * FROM ai_messages WHERE id IS NOT NULL)"
_H = "WITH h AS (SELECT DISTINCT * FROM search_hits)"
_DIST = "sqrt((e[1] - (ax + t * dx)) ** 2 + (e[2] - (ay + t * dy)) ** 2)"
QUERIES = {
    "book_by_original_path": (book_by_original_path, "SELECT original_path AS path, id, title FROM books"),
    "marks_of_books": (
        marks_of_books,
        _N + " SELECT book_id, arg_min(id, (page, created_at, id)) AS first_id, arg_max(id, (page, created_at, id)) AS last_id, count(*) AS marks FROM n WHERE kind IN ('note', 'highlight') GROUP BY 1"
    ),
    "ocr_lookup": (
        ocr_lookup, "SELECT DISTINCT c.book_id, c.page, 'fast' AS ocr_mode, len(c.result.lines) AS n_lines FROM page_ocr_cache c JOIN annotations a USING (book_id, page) WHERE c.ocr_mode = 'fast'"
    ),
    "progress_upserts": (
        progress_upserts,
        "WITH c AS (SELECT o_custkey AS book_id, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS page FROM orders GROUP BY 1) SELECT book_id, page FROM c UNION ALL SELECT c_custkey, -1 FROM customer WHERE c_custkey % 2 = 0 AND c_custkey NOT IN (SELECT book_id FROM c)",
    ),
    "category_inserts": (
        category_inserts,
        "SELECT name FROM categories UNION ALL SELECT DISTINCT CASE WHEN id % 3 = 0 THEN 'Fiction' ELSE trim(title, ' ') END AS name FROM books WHERE name NOT IN (SELECT name FROM categories)"
    ),
    "message_appends": (
        message_appends,
        "WITH b AS (SELECT thread_id, max(created_at) AS at FROM (SELECT id, thread_id, min(created_at) AS created_at FROM ai_messages WHERE id IS NOT NULL AND (length(regexp_replace(content, '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g')) > 0 OR image_path IS NOT NULL) GROUP BY 1, 2) GROUP BY 1) "
        "SELECT id, strftime(CASE WHEN b.thread_id IS NULL THEN updated_at ELSE b.at END, '%Y-%m-%d %H:%M:%S') AS updated FROM ai_threads LEFT JOIN b ON b.thread_id = id",
    ),
    "removed_annotations": (removed_annotations, "SELECT id, book_id FROM annotations WHERE id NOT IN (SELECT id FROM annotations WHERE kind = 'note')"),
    "migrated_tables": (migrated_tables, "SELECT 'annotations' AS name, count(*) AS rows, 10 AS columns FROM annotations UNION ALL SELECT 'ai_threads', 0, 6"),
    "page_numbers": (
        page_numbers,
        "SELECT doc_id::VARCHAR AS original_path, 2 + length(text) - length(replace(text, chr(12), '')) AS pages, pages - 1 AS last_page, 'end' AS last_text FROM documents WHERE text IS NOT NULL"
    ),
    "web_results": (web_results, _H + " SELECT hit_id, md5('1. ' || search_text || chr(10) || 'https://x/' || book_id || chr(10) || snippet) AS digest FROM h"),
    "hit_pieces": (hit_pieces, _H + " SELECT hit_id, (length(snippet) - length(replace(lower(snippet), 'the', ''))) // 3 AS hits, true AS whole FROM h"),
    "corner_handles": (
        corner_handles,
        _V + ", c AS (SELECT vec_id, e, [[e[1], e[2]], [e[1] + e[3], e[2]], [e[1] + e[3], e[2] + e[4]], [e[1], e[2] + e[4]]] AS c FROM e) SELECT vec_id, coalesce(list_position(list_transform(c, lambda p: sqrt((p[1] - e[5]) ** 2 + (p[2] - e[6]) ** 2) <= 0.1::DOUBLE), true), 0) - 1 AS corner FROM c",
    ),
    "mark_gestures": (
        mark_gestures,
        _V + " SELECT vec_id, round(greatest(0.01, least(2.0, e[1] + 2 * e[2])), 4) AS size, 30 + (vec_id % 7) * 15 AS rotation, CASE WHEN vec_id % 2 = 0 THEN 1 + vec_id % 4 >= 3 ELSE abs(e[1] - 0.05::DOUBLE) >= 0.01::DOUBLE AND e[2] >= 0.01::DOUBLE END AS kept, floor((e[5] * 1000 + 18.5) / 37)::BIGINT AS row, "
        "round(e[1] - CASE WHEN vec_id % 2 = 0 THEN e[3] ELSE 0.2::DOUBLE END / 2, 6) AS x, round(CASE WHEN vec_id % 2 = 0 THEN e[3] ELSE 0.2::DOUBLE END, 6) AS w FROM e",
    ),
    "screen_crops": (
        screen_crops,
        _V + ", c AS (SELECT vec_id, greatest((e[1] - 0.02::DOUBLE) * 1500, 0.0) AS x, e[2] * 1500 AS y, least((e[1] - 0.02::DOUBLE + e[3]) * 1500, 200.0) AS r, least((e[2] + e[4]) * 1500, 150.0) AS d FROM e) SELECT vec_id, round(x, 3) AS x, round(y, 3) AS y, round(greatest(r - x, 0.0), 3) AS w, round(greatest(d - y, 0.0), 3) AS h FROM c",
    ),
    "path_hits": (
        path_hits,
        _V + ", l AS (SELECT vec_id, e, unnest(range(1, 31)) AS i FROM e), s AS (SELECT vec_id, e, e[i * 2 + 1] AS ax, e[i * 2 + 2] AS ay, e[i * 2 + 3] - e[i * 2 + 1] AS dx, e[i * 2 + 4] - e[i * 2 + 2] AS dy FROM l), "
        f"t AS (SELECT *, CASE WHEN dx * dx + dy * dy = 0 THEN 0 ELSE greatest(0.0, least(1.0, ((e[1] - ax) * dx + (e[2] - ay) * dy) / (dx * dx + dy * dy))) END AS t FROM s) SELECT vec_id, round(min({_DIST}), 5) AS distance FROM t GROUP BY 1",
    ),
    "kind_toggles": (
        kind_toggles, _N + " SELECT id, CASE kind WHEN 'note' THEN 'underline' WHEN 'underline' THEN 'note' ELSE array_to_string(list_sort(['note', 'underline', kind]), ',') END AS kinds FROM n"
    ),
    "mark_payloads": (mark_payloads, _N + " SELECT id, coalesce(content, '-') AS text, 's.png' AS file, kind AS shape, 1 AS points FROM n"),
    "rect_lists": (
        rect_lists,
        _N + " SELECT id, CASE WHEN id % 5 = 0 THEN 0 ELSE coalesce(len(rects), 0) END AS n, CASE WHEN id % 5 = 0 THEN 0.0 ELSE coalesce(round(list_sum(list_transform(rects, lambda r: r.x + r.h)), 5), 0.0) END::DOUBLE AS total FROM n"
    ),
    "requests": (
        requests,
        _M + " SELECT id, 'm' AS model, true AS stream, greatest(0.0, least(2.0, (id % 40) / 10.0::DOUBLE - 1)) AS temperature, CASE WHEN id % 2 = 0 THEN 'high' END AS reasoning_effort, md5(coalesce(content, '')) AS digest FROM m"
    ),
    "search_prompts": (
        search_prompts,
        _H + " SELECT hit_id, md5(CASE hit_id % 5 WHEN 0 THEN 'Answer from what you know; the search is switched off.' WHEN 1 THEN 'Answer from what you know; no key for the search is set.' WHEN 2 THEN 'Answer from what you know; the search failed: down' "
        "WHEN 3 THEN 'Answer from what you know; the search found nothing.' ELSE 'Answer from these results:' || chr(10) || snippet END) AS digest, CASE WHEN hit_id % 2 = 0 THEN 'chat' ELSE 'explain' END AS next FROM h",
    ),
    "data_urls": (data_urls, "SELECT doc_id, md5('data:image/png;base64,' || to_base64(encode(text))) AS digest FROM documents WHERE text IS NOT NULL"),
    "file_stamps": (file_stamps, _N + " SELECT id, 'shot_' || strftime(created_at, '%Y%m%d_%H%M%S') || '_' || (page + 800) || 'x600.png' AS name FROM n"),
    "view_modes": (
        view_modes,
        "SELECT event_id, CASE event_id % 6 WHEN 1 THEN 'double_page' WHEN 2 THEN 'double_page' WHEN 3 THEN 'single_scroll' WHEN 4 THEN 'double_scroll' ELSE 'single' END AS mode, least(5, event_id % 6 + 1 + CASE WHEN event_id % 2 = 0 THEN 2 ELSE 1 END) AS page FROM events",
    ),
}
