"""Queries on what a reader does with pages: selections, hits, images, opening, scanning, indexing, configurations, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..cluster import load
from ..functions import decode, geometry as G, pixels as P, selection as S
from ..operators import annotations as A, conversations as C, library as L, ocr as O, opening
from ..sources import schemas
from ..streaming import events as E, live
from . import pages

SIDE = 8


def _lines(s, d):
    lines = F.transform("result.lines", lambda v: F.struct(v["text"].alias("char"), v["x"].alias("x"), v["y"].alias("y"), v["w"].alias("w"), v["h"].alias("h"), v["confidence"].alias("confidence")))
    return load(s, d, "page_ocr_cache").select("book_id", "page", "ocr_mode", lines.alias("b")).where("size(b) > 2")


def _rects(col):
    return F.array_join(F.transform(col, lambda r: F.format_string("%.4f %.4f %.4f", r["x"], r["y"], r["w"])), ";")


def selection_texts(s, d):
    """From the fifth letter of the third line back to the third of the first."""
    return _lines(s, d).select("book_id", "page", "ocr_mode", F.md5(S.selected_lines(F.col("b"), S.encode(F.lit(2), F.lit(4)), S.encode(F.lit(0), F.lit(2)))).alias("digest"))


def selection_line_rects(s, d):
    r = S.selected_rects(F.col("b"), S.encode(F.lit(2), F.lit(4)), S.encode(F.lit(0), F.lit(2)))

    def total(k: str):
        return F.round(F.aggregate(r, F.lit(0.0), lambda a, v: a + v[k]), 4).alias(k)

    return _lines(s, d).select("book_id", "page", "ocr_mode", F.size(r).cast("long").alias("n"), *map(total, "xyw"))


def line_places(s, d):
    at = S.place_at(F.col("b"), F.lit(0.4), F.lit(0.5))
    some = _lines(s, d).select("book_id", "page", "ocr_mode", at.cast("long").alias("place"))
    return some.select("*", F.when(F.col("place") >= 0, S.line_of(F.col("place"))).cast("long").alias("line"), F.when(F.col("place") >= 0, S.offset_of(F.col("place"))).cast("long").alias("offset"))


def hit_rectangles(s, d):
    """Every place of "lighthouse" or its like, in boxes of single letters."""
    r = S.hit_rects(S.letters(F.col("b")), "light")
    return _lines(s, d).select("book_id", "page", "ocr_mode", F.size(r).cast("long").alias("n"), F.round(F.aggregate(r, F.lit(0.0), lambda a, v: a + v["w"]), 4).alias("width")).where("n > 0")


def char_boxes(s, d):
    e = lambda i: F.abs(F.col("embedding")[i].cast("double")) * 1000
    box = S.char_box(F.when(F.col("vec_id") % 5 > 0, F.lit("x")).otherwise(""), e(0), e(1), e(2), e(3), F.lit(400.0), F.lit(300.0))
    return load(s, d, "embeddings").select("vec_id", box.alias("b")).where("b IS NOT NULL").select("vec_id", *(F.round(f"b.{k}", 6).alias(k) for k in "xywh"))


def _pixels(s, d):
    return load(s, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.least(F.floor(F.abs(x.cast("double")) * 1000), F.lit(255))).alias("v"))


def page_enhancement(s, d):
    """Vectors as images of 8 by 8 pixels."""
    w, h = F.lit(SIDE), F.lit(SIDE)
    q = _pixels(s, d).withColumn("q", P.quality(F.col("v"), w))
    out = q.withColumn("out", P.enhanced(F.col("v"), F.col("q")))
    out = out.withColumn("sharp", P.sharp_fraction(F.col("out"), w, h))
    return out.select(
        "vec_id", "q.ink_median", "q.p99", F.round("q.ink_fraction", 6).alias("ink_fraction"), P.washed_out(F.col("q")).alias("washed"), F.round("sharp", 6).alias("sharp"),
        P.blurry(F.col("sharp"), F.col("q")).alias("blurry"), F.md5(F.array_join(F.transform("out", lambda x: x.cast("long").cast("string")), ",")).alias("digest")
    )


def rgb_pixels(s, d):
    """Vectors as 16 pixels of four values."""
    rgb = P.rgb(F.col("v"))
    return _pixels(s, d).select("vec_id", F.md5(F.array_join(F.transform(rgb, lambda x: x.cast("string")), ",")).alias("digest"), F.round(F.aggregate(P.lumas(rgb), F.lit(0.0), lambda a, x: a + x), 3).alias("luma"))


def render_sizes(s, d):
    t = G.render_size(F.lit(595.0), F.size("b") * 30.0, G.zoom_step(F.lit(1.2), F.col("page") % 40), F.lit(1.5))
    return _lines(s, d).select("book_id", "page", "ocr_mode", t["w"].alias("w"), t["h"].alias("h"))


def low_confidence_hit(s, d):
    low = F.filter("b", lambda v: v["confidence"] < O.REVIEW_BELOW)
    return _lines(s, d).select("book_id", "page", "ocr_mode", F.get(low, G.first_containing(low, F.lit(0.3), F.lit(0.5)))["char"].alias("text")).where("text IS NOT NULL")


def _stored(s, d):
    """Configurations of threads: some fields set, some missing, some of the wrong kind."""
    i = F.col("id")
    fields = {
        "text_model": F.col("title"), "temperature": (i % 40) / 10.0, "ocr_mode": F.when(i % 2 == 0, "fast").when(i % 5 == 0, "odd"), "include_book_history": F.when(i % 3 == 0, False),
        "web_search_enabled": F.when(i % 4 == 0, True), "translate_target_lang": F.when(i % 7 == 0, "de"), "vision_base_url": F.when(i % 6 == 0, "https://v"),
        "prompt_template": F.when(i % 2 == 1, "tech")
    }
    body = F.struct(*(c.alias(k) for k, c in fields.items()), F.when(i % 8 == 0, F.create_map(F.lit("tech"), F.lit(" own "))).alias("template_overrides"))
    return load(s, d, "ai_threads").select("id", F.when(i % 11 == 0, "broken {").otherwise(F.to_json(body)).alias("value"))


def config_fields(s, d):
    c = _stored(s, d).select("id", decode.config(F.col("value")).alias("c"))
    names = ["text_model", "base_url", "temperature", "ocr_mode", "include_book_history", "web_search_enabled", "translate_target_lang", "vision_base_url", "reasoning_effort", "prompt_template"]
    return c.select("id", *(f"c.{n}" for n in names), F.size("c.template_overrides").cast("long").alias("overrides"))


def role_templates(s, d):
    c = _stored(s, d).select("id", decode.config(F.col("value")).alias("c"))
    chosen = F.when(F.col("id") % 9 == 0, "custom").when(F.col("id") % 9 == 1, "nothing").otherwise(F.col("c.prompt_template"))
    return c.select("id", C.role_template(chosen, F.lit("  mine "), F.col("c.template_overrides")).alias("text"))


def _marks(s, d):
    notes = load(s, d, "annotations").dropDuplicates(["id"])
    kind = F.when(F.col("id") % 3 == 0, "stamp").otherwise("brush")
    return notes.where("id % 2 = 0").select("id", "book_id", "page", kind.alias("kind"), F.lit(0.5).alias("x"), F.lit(0.25).alias("y"), F.when(kind == "stamp", F.to_json(F.struct(F.concat("color", F.lit(".png")).alias("file")))).otherwise("{}").alias("payload"), "created_at")


def annotations_export(s, d):
    """The JSON of each book, read again."""
    j = A.export_json(load(s, d, "annotations"), _marks(s, d))
    read = "book_id long, annotations array<struct<id:long,page:long,kind:string,text:string,content:string,rects:array<struct<x:double>>,color:string>>, image_marks array<struct<id:long,kind:string,x:double,rotation:double,payload:string>>"
    v = j.select("book_id", F.from_json("json", read).alias("v"), F.contains("json", F.lit('\n  "annotations" : [')).alias("printed"))
    text = F.array_join(
        F.transform("v.annotations", lambda a: F.concat_ws("|", a["id"].cast("string"), a["page"].cast("string"), a["kind"], F.coalesce(a["text"], F.lit("~")), F.coalesce(a["content"], F.lit("~")), F.coalesce(a["color"], F.lit("~")), F.size(a["rects"]).cast("string"))),
        "\n"
    )
    marks = F.array_join(F.transform("v.image_marks", lambda a: F.concat_ws("|", a["id"].cast("string"), a["kind"], a["payload"])), "\n")
    return v.select("book_id", F.md5(text).alias("annotations"), F.md5(marks).alias("marks"), "printed")


def notes_rail(s, d):
    return A.rail(A.items(load(s, d, "annotations"), _marks(s, d))).select("book_id", "id", "src", F.col("place").cast("long").alias("place"))


def page_items(s, d):
    return A.on_page(A.items(load(s, d, "annotations"), _marks(s, d)), 2).select("book_id", "id", "src")


def stamp_images(s, d):
    files = load(s, d, "annotations").where("color IS NOT NULL AND color <> upper(color)").select(F.concat("color", F.lit(".png")).alias("file"), F.lit(1).alias("size")).distinct()
    return A.stamp_files(_marks(s, d), files)


def open_routes(s, d):
    books = load(s, d, "books")
    opened = books.where("id % 2 = 0").select("stored_path").unionByName(books.where("id % 50 = 1").select(F.concat(F.lit("gone/"), "stored_path").alias("stored_path")))
    found = load(s, d, "page_ocr_cache").groupBy("book_id").agg((F.max("page") + 1).alias("pages")).join(books.select(F.col("id").alias("book_id"), "stored_path"), "book_id")
    return opening.routes(books, opened, found)


def scan_requests(s, d):
    asked = load(s, d, "annotations").select("book_id", "page", F.lit("fast").alias("ocr_mode"))
    lines = opening.scan(asked, load(s, d, "page_ocr_cache"), None)
    return lines.select("book_id", "page", "origin", F.size("lines").cast("long").alias("n_lines"), "error")


def index_builds(s, d):
    """Books without index among those with documents; documents without text stand for files that can't be read."""
    docs = load(s, d, "documents").where("book_id IS NOT NULL")
    status = L.index_status(load(s, d, "books"), docs.where("book_id % 3 = 0").select("book_id"), docs.where("book_id % 3 = 1 AND page = 0").select("book_id"))
    return opening.built(opening.to_index(status), docs.select("book_id", "page", "text", F.when(F.col("text").isNull(), "unreadable").alias("error")))


def stream_answers(s, d):
    """Events as streams by user."""
    kind = F.create_map(*(F.lit(x) for kv in {"purchase": "done", "error": "error", "signup": "cancel"}.items() for x in kv))[F.col("event_type")]
    log = load(s, d, "events").select(F.col("user_id").alias("stream"), F.col("event_id").alias("seq"), F.coalesce(kind, F.lit("chunk")).alias("event"), F.concat(F.col("event_id").cast("string"), F.lit(" ")).alias("chunk"))
    return E.finished(log, "stream", "seq")


def debounced_events(s, d):
    return live.last_of_bursts(load(s, d, "events").select("user_id", "ts", "event_id"), "user_id", "ts", "event_id", 3600.0).select("user_id", "event_id")


def throttled_events(s, d):
    return live.first_of_bursts(load(s, d, "events").select("user_id", "ts", "event_id"), "user_id", "ts", "event_id", 3600.0).select("user_id", "event_id")


def merged_threads(s, d):
    t = load(s, d, "ai_threads")
    local = t.where("id % 10 = 0").select((-F.col("id")).alias("id"), F.concat(F.lit("new "), "title").alias("title"))
    return C.merged_threads(t.select("id", "title", "book_id"), local)


def newest_version(s, d):
    return schemas.recorded_version(load(s, d, "categories").select(F.col("sort_order").alias("version")))


_B = "WITH b AS (SELECT book_id, page, ocr_mode, result.lines AS b FROM page_ocr_cache WHERE len(result.lines) > 2)"
_PX = "WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: least(floor(abs(x::DOUBLE) * 1000)::BIGINT, 255)) AS v FROM embeddings)"
_K = "n AS (SELECT DISTINCT * FROM annotations), k AS (SELECT id, book_id, page, CASE WHEN id % 3 = 0 THEN 'stamp' ELSE 'brush' END AS kind, CASE WHEN id % 3 = 0 THEN '{\"file\":\"' || color || '.png\"}' ELSE '{}' END AS payload, color, created_at FROM n WHERE id % 2 = 0)"
_I = "i AS (SELECT book_id, page, 0 AS src, created_at, id FROM n UNION ALL SELECT book_id, page, 1, created_at, id FROM k)"
_T = "t AS (SELECT *, id % 11 = 0 AS bad FROM ai_threads)"
_OUT = ", o AS (SELECT *, CASE WHEN washed THEN list_transform(v, lambda x: greatest(0, least(255, round((x - ink_median) / greatest(p99 - ink_median, 1) * 255.0::DOUBLE)))::BIGINT) ELSE v END AS out FROM w)"
QUERIES = {
    "selection_texts": (selection_texts, _B + " SELECT book_id, page, ocr_mode, md5(substr(b[1].text, 3) || b[2].text || substr(b[3].text, 1, 5)) AS digest FROM b"),
    "selection_line_rects": (
        selection_line_rects,
        _B + """, s AS (SELECT *, [{'b': b[1], 'f': least(2, length(b[1].text) - 1), 't': length(b[1].text) - 1}, {'b': b[2], 'f': 0, 't': length(b[2].text) - 1}, {'b': b[3], 'f': 0, 't': least(4, length(b[3].text) - 1)}] AS s FROM b), f AS (SELECT book_id, page, ocr_mode, list_filter(s, lambda x: length(x.b.text) > 0) AS s FROM s)
SELECT book_id, page, ocr_mode, len(s) AS n, coalesce(round(list_sum(list_transform(s, lambda x: x.b.x + x.b.w * x.f / length(x.b.text))), 4), 0.0) AS x, coalesce(round(list_sum(list_transform(s, lambda x: x.b.y)), 4), 0.0) AS y, coalesce(round(list_sum(list_transform(s, lambda x: x.b.w * (x.t - x.f + 1) / length(x.b.text))), 4), 0.0) AS w FROM f""",
    ),
    "line_places": (
        line_places,
        _B + """, u AS (SELECT book_id, page, ocr_mode, unnest(b) AS v, generate_subscripts(b, 1) - 1 AS i FROM b), h AS (SELECT book_id, page, ocr_mode, min(CASE WHEN abs(0.5::DOUBLE - (v.y + v.h / 2)) <= v.h / 2 + 0.008::DOUBLE THEN i END) AS i FROM u GROUP BY ALL),
p AS (SELECT h.book_id, h.page, h.ocr_mode, CASE WHEN h.i IS NULL OR 0.4 < v.x THEN -1 ELSE h.i * 10000 + least(floor((0.4::DOUBLE - v.x) / greatest(v.w, 1e-9) * length(v.text)), length(v.text) - 1) END::BIGINT AS place FROM h LEFT JOIN u ON u.book_id = h.book_id AND u.page = h.page AND u.ocr_mode = h.ocr_mode AND u.i = h.i)
SELECT *, CASE WHEN place >= 0 THEN place // 10000 END AS line, CASE WHEN place >= 0 THEN place % 10000 END AS offset FROM p""",
    ),
    "hit_rectangles": (
        hit_rectangles,
        _B + ", c AS (SELECT book_id, page, ocr_mode, flatten(list_transform(b, lambda v: list_transform(range(1, length(v.text) + 1), lambda i: {'c': substr(v.text, i::INT, 1), 'x': v.x + v.w * (i - 1) / length(v.text), 'y': v.y, 'w': v.w / length(v.text), 'h': v.h}))) AS c FROM b), "
        "t AS (SELECT *, lower(array_to_string(list_transform(c, lambda v: v.c), '')) AS t FROM c), o AS (SELECT book_id, page, ocr_mode, c, unnest(list_filter(range(1, length(t) + 1), lambda i: substr(t, i::INT, 5) = 'light')) AS i FROM t), "
        f"z AS (SELECT book_id, page, ocr_mode, unnest({pages.line_fold('c[i:i + 4]')}) AS box FROM o) SELECT book_id, page, ocr_mode, count(*) AS n, round(sum(box.r - box.l), 4) AS width FROM z GROUP BY ALL",
    ),
    "char_boxes": (
        char_boxes,
        "WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: abs(x::DOUBLE) * 1000) AS v FROM embeddings WHERE vec_id % 5 > 0) SELECT vec_id, round(v[1] / 400, 6) AS x, round(greatest(0.0, least(1.0, 1 - (v[2] + v[4]) / 300)), 6) AS y, round(v[3] / 400, 6) AS w, round(v[4] / 300, 6) AS h FROM e",
    ),
    "page_enhancement": (
        page_enhancement,
        _PX + """, s AS (SELECT *, list_sort([v[1], v[5], v[33], v[37]]) AS s FROM e), i AS (SELECT *, list_filter(s, lambda x: x < 200) AS ink FROM s),
q AS (SELECT vec_id, v, len(ink) AS n, coalesce(ink[floor(len(ink) * 0.5)::INT + 1], 255)::DOUBLE AS ink_median, s[floor(4 * 0.99)::INT + 1]::DOUBLE AS p99 FROM i), w AS (SELECT *, n > 0 AND ink_median > 80 AND p99 - ink_median > 30 AS washed FROM q)""" + _OUT + """,
g AS (SELECT *, len(list_filter([10, 14, 42, 46], lambda j: abs(out[j + 1] - out[j]) + abs(out[j + 8] - out[j]) > 120)) / 4.0::DOUBLE AS sharp FROM o)
SELECT vec_id, ink_median, p99, round(n / 4.0::DOUBLE, 6) AS ink_fraction, washed, round(sharp, 6) AS sharp, n > 0 AND sharp < 1e-4 AS blurry, md5(array_to_string(out, ',')) AS digest FROM g""",
    ),
    "rgb_pixels": (
        rgb_pixels,
        _PX + ", f AS (SELECT vec_id, list_filter(v, lambda x, i: (i - 1) % 4 <> 3) AS r FROM e) SELECT vec_id, md5(array_to_string(r, ',')) AS digest, round(list_sum(list_transform(range(0, 16), lambda i: r[i * 3 + 1] * 0.299::DOUBLE + r[i * 3 + 2] * 0.587::DOUBLE + r[i * 3 + 3] * 0.114::DOUBLE)), 3) AS luma FROM f",
    ),
    "render_sizes": (
        render_sizes,
        _B + ", z AS (SELECT *, greatest(0.3, least(4.0, round(1.2::DOUBLE + (page % 40) * 0.1::DOUBLE, 1)))::DOUBLE AS z FROM b) SELECT book_id, page, ocr_mode, greatest(round(595.0::DOUBLE * z * 1.5::DOUBLE), 1)::BIGINT AS w, greatest(round(len(b) * 30.0::DOUBLE * z * 1.5::DOUBLE), 1)::BIGINT AS h FROM z",
    ),
    "low_confidence_hit": (
        low_confidence_hit,
        _B + " SELECT book_id, page, ocr_mode, list_filter(b, lambda v: v.confidence < 0.8 AND 0.3 >= v.x AND 0.3 <= v.x + v.w AND 0.5 >= v.y AND 0.5 <= v.y + v.h)[1].text AS text FROM b WHERE text IS NOT NULL",
    ),
    "config_fields": (
        config_fields,
        f"WITH {_T} SELECT id, CASE WHEN bad THEN '' ELSE coalesce(title, '') END AS text_model, '' AS base_url, CASE WHEN bad THEN 0.7 ELSE least(2.0, (id % 40) / 10.0) END::DOUBLE AS temperature, CASE WHEN NOT bad AND id % 2 = 0 THEN 'fast' ELSE 'high_precision' END AS ocr_mode, "
        "bad OR id % 3 <> 0 AS include_book_history, NOT bad AND id % 4 = 0 AS web_search_enabled, CASE WHEN NOT bad AND id % 7 = 0 THEN 'de' ELSE '中文' END AS translate_target_lang, CASE WHEN NOT bad AND id % 6 = 0 THEN 'https://v' END AS vision_base_url, 'medium' AS reasoning_effort, "
        "CASE WHEN NOT bad AND id % 2 = 1 THEN 'tech' ELSE 'general' END AS prompt_template, CASE WHEN NOT bad AND id % 8 = 0 THEN 1 ELSE 0 END::BIGINT AS overrides FROM t",
    ),
    "role_templates": (
        role_templates,
        f"WITH {_T} SELECT id, CASE WHEN id % 9 = 0 THEN 'mine' WHEN id % 9 = 1 THEN '' WHEN NOT bad AND id % 2 = 1 THEN 'You advise on technical documentation: be exact and lead with what to do.' ELSE 'You help a reader with a document.' END AS text FROM t",
    ),
    "annotations_export": (
        annotations_export,
        f"WITH {_K}, x AS (SELECT book_id, string_agg(id || '|' || page || '|' || kind || '|' || coalesce(text, '~') || '|' || coalesce(content, '~') || '|' || coalesce(color, '~') || '|' || coalesce(len(rects), -1), chr(10) ORDER BY page, created_at, id) AS a FROM n GROUP BY 1), "
        "y AS (SELECT book_id, string_agg(id || '|' || kind || '|' || coalesce(payload, '{}'), chr(10) ORDER BY page, created_at, id) AS m FROM k GROUP BY 1) SELECT book_id, md5(coalesce(a, '')) AS annotations, md5(coalesce(m, '')) AS marks, true AS printed FROM x FULL JOIN y USING (book_id)",
    ),
    "notes_rail": (notes_rail, f"WITH {_K}, {_I} SELECT book_id, id, src, row_number() OVER (PARTITION BY book_id ORDER BY page, src, created_at, id) - 1 AS place FROM i"),
    "page_items": (page_items, f"WITH {_K}, {_I} SELECT book_id, id, src FROM i WHERE page = 2"),
    "stamp_images": (
        stamp_images,
        f"WITH {_K}, f AS (SELECT DISTINCT color || '.png' AS file, 1 AS size FROM annotations WHERE color <> upper(color)) SELECT id, color || '.png' AS file, size FROM k LEFT JOIN f ON f.file = k.color || '.png' WHERE kind = 'stamp'"
    ),
    "open_routes": (
        open_routes,
        "WITH o AS (SELECT stored_path FROM books WHERE id % 2 = 0 UNION ALL SELECT 'gone/' || stored_path FROM books WHERE id % 50 = 1), p AS (SELECT book_id, max(page) + 1 AS pages FROM page_ocr_cache GROUP BY 1) "
        "SELECT o.stored_path, b.id AS book_id, CASE WHEN b.id IS NOT NULL AND coalesce(file_type, '') <> 'pdf' THEN 'image' ELSE 'pdf' END AS route, CASE WHEN b.id IS NOT NULL AND coalesce(file_type, '') <> 'pdf' THEN 1 ELSE coalesce(nullif(page_count, 0), pages, 0) END AS page_count FROM o LEFT JOIN books b USING (stored_path) LEFT JOIN p ON p.book_id = b.id",
    ),
    "scan_requests": (
        scan_requests,
        "WITH a AS (SELECT DISTINCT book_id, page FROM annotations), c AS (SELECT book_id, page, max(len(result.lines)) AS n FROM page_ocr_cache WHERE ocr_mode = 'fast' GROUP BY 1, 2) "
        "SELECT book_id, page, CASE WHEN n IS NOT NULL THEN 'cache' ELSE 'engine' END AS origin, coalesce(n, 0) AS n_lines, CASE WHEN n IS NULL THEN 'no recogniser is installed' END AS error FROM a LEFT JOIN c USING (book_id, page)",
    ),
    "index_builds": (
        index_builds,
        r"WITH d AS (SELECT * FROM documents WHERE book_id IS NOT NULL), w AS (SELECT id FROM books WHERE file_type = 'pdf' AND id NOT IN (SELECT book_id FROM d WHERE book_id % 3 = 0) AND id NOT IN (SELECT book_id FROM d WHERE book_id % 3 = 1 AND page = 0)), "
        r"s AS (SELECT book_id AS id, count(*) FILTER (WHERE length(regexp_replace(text, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')) > 0) AS pages, bool_or(text IS NULL) AS bad FROM d GROUP BY 1) "
        "SELECT id, CASE WHEN bad THEN 'failed' ELSE 'ready' END AS status, CASE WHEN bad THEN 0 ELSE pages END AS pages FROM w JOIN s USING (id)",
    ),
    "stream_answers": (
        stream_answers,
        "WITH e AS (SELECT user_id AS stream, event_id AS seq, CASE event_type WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'error' WHEN 'signup' THEN 'cancel' ELSE 'chunk' END AS event FROM events), s AS (SELECT *, min(seq) FILTER (WHERE event <> 'chunk') OVER (PARTITION BY stream) AS stop FROM e) "
        "SELECT stream, coalesce(max(CASE WHEN seq = stop THEN event END), 'open') AS how, count(*) FILTER (WHERE event = 'chunk' AND (stop IS NULL OR seq < stop)) AS chunks, coalesce(string_agg(CASE WHEN event = 'chunk' AND (stop IS NULL OR seq < stop) THEN seq || ' ' END, '' ORDER BY seq), '') AS answer FROM s GROUP BY 1",
    ),
    "debounced_events": (
        debounced_events, "SELECT user_id, event_id FROM (SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM events) WHERE nxt IS NULL OR nxt - ts > INTERVAL 1 HOUR"
    ),
    "throttled_events": (
        throttled_events, "SELECT user_id, event_id FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prv FROM events) WHERE prv IS NULL OR ts - prv > INTERVAL 1 HOUR"
    ),
    "merged_threads": (merged_threads, "SELECT id, title, book_id FROM ai_threads UNION ALL SELECT -id, 'new ' || title, NULL FROM ai_threads WHERE id % 10 = 0"),
    "newest_version": (newest_version, "SELECT max(sort_order) AS version FROM categories"),
}
