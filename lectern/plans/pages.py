"""Queries on recognised pages, geometry, annotations and page images, with their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..cluster import load
from ..functions import decode, geometry as G
from ..operators import annotations as A, ocr as O

_L = "WITH l AS (SELECT book_id, page, ocr_mode, result.lines AS lines FROM page_ocr_cache)"


def _ocr(s, d):
    return load(s, d, "page_ocr_cache").select("book_id", "page", "ocr_mode", F.col("result.lines").alias("lines"), "result", "created_at")


def low_confidence_lines(s, d):
    return _ocr(s, d).select("book_id", "page", "ocr_mode", F.explode(O.low_confidence(F.col("lines"))).alias("v")).select("book_id", "page", "ocr_mode", F.col("v.i").cast("long").alias("line_no"), "v.text", "v.confidence")


def low_confidence_count(s, d):
    return _ocr(s, d).select("book_id", "page", "ocr_mode", O.low_count(F.col("lines")).cast("long").alias("low"), F.size("lines").cast("long").alias("n_lines"))


def ocr_page_text(s, d):
    return _ocr(s, d).select("book_id", "page", "ocr_mode", F.md5(O.page_text(F.col("lines"))).alias("digest"))


def ocr_mode_fallback(s, d):
    return O.in_mode(load(s, d, "page_ocr_cache"), "high_precision").select("book_id", "page", "ocr_mode", F.size("lines").cast("long").alias("n_lines"))


def text_layer_fallback(s, d):
    native = load(s, d, "documents").where("book_id IS NOT NULL AND page IS NOT NULL AND length(trim(text)) > 0").select("book_id", "page", "text").groupBy("book_id", "page").agg(F.max("text").alias("text"))
    ocr = O.in_mode(load(s, d, "page_ocr_cache"), "fast").select("book_id", "page", O.page_text(F.col("lines")).alias("text"))
    return O.layers(native, ocr).select("book_id", "page", "layer", F.md5("text").alias("digest"))


def ocr_correct_lines(s, d):
    edits = F.create_map(F.lit(0), F.lit("corrected"), F.lit(2), F.lit("  "), F.lit(999), F.lit("beyond"))
    return _ocr(s, d).select("book_id", "page", "ocr_mode", F.md5(O.page_text(O.correct(F.col("lines"), edits), "\n")).alias("digest"))


def pass_scores(s, d):
    n, total = F.size("lines"), F.round(O.score(F.col("lines")), 6)
    return _ocr(s, d).select("book_id", "page", "ocr_mode", total.alias("score"), O.suspicious(n, total).alias("suspicious"))


def orientation_choice(s, d):
    e = F.transform("embedding", lambda x: F.abs(x.cast("double")))
    a, b, c = (F.round(F.aggregate(F.slice(e, i, 20), F.lit(0.0), lambda t, x: t + x), 6) for i in (1, 21, 41))
    return load(s, d, "embeddings").select("vec_id", O.orientation(a, F.lit(2), b, c).cast("long").alias("rotation"))


def line_boxes(s, d):
    return _ocr(s, d).select("book_id", "page", "ocr_mode", F.size(O.boxes(F.col("lines"))).cast("long").alias("boxes"), F.exists("lines", lambda v: F.length(v["text"]) > 1).alias("line_level"))


def union_bounds(s, d):
    b = G.bounds(F.col("lines"))
    return _ocr(s, d).select("book_id", "page", "ocr_mode", *(F.round(b[k], 6).alias(k) for k in "xywh"))


def _tap():
    return F.lit(0.4), F.lit(0.5)


def rect_contains_point(s, d):
    return _ocr(s, d).select("book_id", "page", "ocr_mode", G.first_containing(F.col("lines"), *_tap()).cast("long").alias("line_no"))


def hit_test_nearest(s, d):
    return _ocr(s, d).select("book_id", "page", "ocr_mode", G.nearest(F.col("lines"), *_tap()).cast("long").alias("line_no"))


def _rects_text(rects):
    return F.array_join(F.transform(rects, lambda r: F.format_string("%.4f %.4f %.4f %.4f", r["x"], r["y"], r["w"], r["h"])), ";")


def line_clusters(s, d):
    return load(s, d, "annotations").dropDuplicates(["id"]).select("id", F.size(G.line_rects(F.col("rects"))).cast("long").alias("lines"))


def selection_rects(s, d):
    r = G.line_rects(G.selection(F.col("lines"), F.lit(5), F.lit(2)))
    return _ocr(s, d).select("book_id", "page", "ocr_mode", F.size(r).cast("long").alias("rects"), _rects_text(r).alias("places"))


def _quads(s, d):
    px = F.transform("embedding", lambda x: F.round(F.abs(x.cast("double")) * 1000))
    quad = F.array(*(F.array(px[2 * i], px[2 * i + 1]) for i in range(4)))
    return load(s, d, "embeddings").select("vec_id", quad.alias("q"), (F.col("vec_id") % 3 * 90 + F.when(F.col("vec_id") % 3 == 2, 90).otherwise(0)).alias("rot"))


def boxes_normalized(s, d):
    b = G.quad_rect(F.col("q"), F.lit(400.0), F.lit(200.0))
    return _quads(s, d).select("vec_id", *(F.round(b[k], 6).alias(k) for k in "xywh"))


def quads_rotated_back(s, d):
    q = G.rotate_back(F.col("q"), F.lit(400.0), F.lit(200.0), F.col("rot"))
    return _quads(s, d).select("vec_id", F.array_join(F.transform(q, lambda p: F.concat_ws(",", p[0].cast("long"), p[1].cast("long"))), ";").alias("corners"))


def mark_hit_distance(s, d):
    e = [F.col("embedding")[i].cast("double") for i in range(6)]
    return load(s, d, "embeddings").select("vec_id", F.round(G.segment_distance(*e), 6).alias("distance"), (G.segment_distance(*e) < G.BRUSH_REACH).alias("hit"))


def _luma(s, d):
    return load(s, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.floor(F.abs(x.cast("double")) * 1000)).alias("v"))


def percentile_by_index(s, d):
    return _luma(s, d).select("vec_id", *(G.percentile_by_index(F.col("v"), q).alias(f"p{int(q * 100)}") for q in (0.5, 0.9, 0.99)))


def page_quality(s, d):
    ink = F.filter("v", lambda x: x < 200)
    return _luma(s, d).select("vec_id", F.coalesce(G.percentile_by_index(ink, 0.5), F.lit(255)).alias("ink_median"), F.coalesce(G.percentile_by_index(F.col("v"), 0.99), F.lit(255)).alias("p99"), F.round(F.size(ink) / F.size("v"), 6).alias("ink_fraction"))


def contrast_stretch_image(s, d):
    lo, hi = F.array_min("v"), F.array_max("v")
    return _luma(s, d).select("vec_id", F.array_join(F.transform("v", lambda x: G.stretch(x, lo, hi).cast("long")), ",").alias("stretched"))


def thumbnail_sizes(s, d):
    w, h = F.size("lines") * 40, F.lit(1000)
    t = G.thumbnail(w, h, 400)
    return _ocr(s, d).select("book_id", "page", "ocr_mode", t["w"].alias("w"), t["h"].alias("h"))


def _notes(s, d):
    return load(s, d, "annotations").dropDuplicates(["id"])


def annotations_list(s, d):
    return _notes(s, d).orderBy("book_id", "page", "created_at", "id").select("id", "book_id", "page", "kind", decode.colour(F.col("color")).alias("colour"), F.size("rects").cast("long").alias("rects"))


def annotation_replays(s, d):
    return load(s, d, "annotations").groupBy("id").agg(F.count("*").alias("rows")).where("rows > 1")


def _marks(s, d):
    """Sticky notes made of annotations with content, and stamps and brushes of the others, as image marks."""
    kind = F.when(F.col("content").isNotNull(), "sticky").when(F.col("id") % 2 == 0, "stamp").otherwise("brush")
    payload = F.when(kind == "sticky", F.to_json(F.struct(F.col("content").alias("text")))).when(kind == "stamp", F.to_json(F.struct(F.concat(F.col("color"), F.lit(".png")).alias("file")))).otherwise(F.to_json(F.struct(F.transform("rects", lambda r: F.array(r["x"], r["y"])).alias("points"))))
    return _notes(s, d).select("id", "book_id", "page", "created_at", kind.alias("kind"), payload.alias("payload"))


def annotations_markdown(s, d):
    return A.markdown_for(load(s, d, "books"), _notes(s, d), _marks(s, d)).select("book_id", F.md5("markdown").alias("digest"), F.length("markdown").cast("long").alias("chars"))


def annotation_visibility(s, d):
    return A.items(load(s, d, "annotations"), None, ["underline", "note"]).select("book_id", "page", "id", "kind")


def mark_payload_fields(s, d):
    p = F.col("payload")
    return _marks(s, d).select("id", "kind", decode.payload_text(p, "text").alias("text"), decode.payload_text(p, "file").alias("file"), decode.payload_points(p).cast("long").alias("points"))


def mark_styles(s, d):
    st = decode.style(F.regexp_replace("props", "\"k\"", "\"strokeWidth\""))
    return load(s, d, "events").select("event_id", st["stroke_width"].alias("stroke_width"), st["fill"].alias("fill"), st["font_size"].alias("font_size"))


_N = "WITH n AS (SELECT DISTINCT * FROM annotations)"
_NM = _N + """, k AS (SELECT *, CASE WHEN content IS NOT NULL THEN 'sticky' WHEN id % 2 = 0 THEN 'stamp' ELSE 'brush' END AS mark FROM n)"""
_Q = "WITH p AS (SELECT vec_id, list_transform(embedding, lambda x: round(abs(x::DOUBLE) * 1000)) AS v, [0, 90, 270][vec_id % 3 + 1] AS rot FROM embeddings), x AS (SELECT vec_id, rot, [v[1], v[3], v[5], v[7]] AS xs, [v[2], v[4], v[6], v[8]] AS ys FROM p)"
_V = "WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor(abs(x::DOUBLE) * 1000)::BIGINT) AS v FROM embeddings)"
_C = "greatest(0.0, least(1.0, {}))"
_LABELS = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in A.KIND_LABELS.items())


def line_fold(boxes: str) -> str:
    """SQL for the lines (t, b, l, r) that a list of boxes makes: each joins the first line whose rows it overlaps, and widens it."""
    one = "[{'t': v.y, 'b': v.y + v.h, 'l': v.x, 'r': v.x + v.w}]"
    hit = "list_position(list_transform(s, lambda u: x[1].t < u.b AND u.t < x[1].b), true)"
    grown = "{'t': least(v.t, x[1].t), 'b': greatest(v.b, x[1].b), 'l': least(v.l, x[1].l), 'r': greatest(v.r, x[1].r)}"
    return (
        f"list_reduce(list_prepend([]::STRUCT(t DOUBLE, b DOUBLE, l DOUBLE, r DOUBLE)[], list_transform({boxes}, lambda v: {one})), "
        f"lambda s, x: CASE WHEN {hit} > 0 THEN list_transform(s, lambda v, i: CASE WHEN i = {hit} THEN {grown} ELSE v END) ELSE list_concat(s, x) END)"
    )


QUERIES = {
    "low_confidence_lines": (
        low_confidence_lines,
        _L + ", u AS (SELECT book_id, page, ocr_mode, unnest(lines) AS v, generate_subscripts(lines, 1) - 1 AS line_no FROM l) SELECT book_id, page, ocr_mode, line_no, v.text AS text, v.confidence AS confidence FROM u WHERE v.confidence < 0.8"
    ),
    "low_confidence_count": (low_confidence_count, _L + " SELECT book_id, page, ocr_mode, len(list_filter(lines, lambda v: v.confidence < 0.8)) AS low, len(lines) AS n_lines FROM l"),
    "ocr_page_text": (ocr_page_text, _L + " SELECT book_id, page, ocr_mode, md5(array_to_string(list_transform(lines, lambda v: v.text), '')) AS digest FROM l"),
    "ocr_mode_fallback": (
        ocr_mode_fallback,
        _L + " SELECT book_id, page, ocr_mode, len(lines) AS n_lines FROM (SELECT *, row_number() OVER (PARTITION BY book_id, page ORDER BY CASE WHEN ocr_mode = 'high_precision' THEN 0 ELSE 1 END) AS rn FROM l) WHERE rn = 1"
    ),
    "text_layer_fallback": (
        text_layer_fallback,
        _L + """, n AS (SELECT book_id, page, max(text) AS text FROM documents WHERE book_id IS NOT NULL AND page IS NOT NULL AND length(trim(text)) > 0 GROUP BY 1, 2), o AS (SELECT book_id, page, array_to_string(list_transform(lines, lambda v: v.text), '') AS text FROM (SELECT *, row_number() OVER (PARTITION BY book_id, page ORDER BY CASE WHEN ocr_mode = 'fast' THEN 0 ELSE 1 END) AS rn FROM l) WHERE rn = 1)
SELECT book_id, page, 'native' AS layer, md5(text) AS digest FROM n UNION ALL SELECT book_id, page, 'ocr' AS layer, md5(text) AS digest FROM o WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.book_id = o.book_id AND n.page = o.page)""",
    ),
    "ocr_correct_lines": (
        ocr_correct_lines, _L + " SELECT book_id, page, ocr_mode, md5(array_to_string(list_transform(lines, lambda v, i: CASE WHEN i = 1 THEN 'corrected' ELSE v.text END), chr(10))) AS digest FROM l"
    ),
    "pass_scores": (
        pass_scores,
        _L + ", t AS (SELECT *, round(coalesce(list_sum(list_transform(lines, lambda v: coalesce(v.confidence, 0.0))), 0.0), 6) AS score FROM l) SELECT book_id, page, ocr_mode, score, len(lines) > 0 AND (len(lines) < 3 OR score / len(lines) < 0.6) AS suspicious FROM t"
    ),
    "orientation_choice": (
        orientation_choice,
        "WITH t AS (SELECT vec_id, " + ", ".join(f"round(list_sum(list_transform(embedding[{i}:{i + 19}], lambda x: abs(x::DOUBLE))), 6) AS {c}" for i, c in ((1, "a"), (21, "b"), (41, "c"))) + " FROM embeddings) SELECT vec_id, CASE WHEN c > (CASE WHEN b > a * 1.1::DOUBLE THEN b ELSE a END) * 1.1::DOUBLE THEN 270 WHEN b > a * 1.1::DOUBLE THEN 90 ELSE 0 END::BIGINT AS rotation FROM t",
    ),
    "line_boxes": (
        line_boxes,
        _L + " SELECT book_id, page, ocr_mode, len(list_filter(lines, lambda v: length(trim(v.text, ' ')) > 0)) AS boxes, len(list_filter(lines, lambda v: length(v.text) > 1)) > 0 AS line_level FROM l"
    ),
    "union_bounds": (
        union_bounds,
        _L + ", u AS (SELECT book_id, page, ocr_mode, unnest(lines) AS v FROM l) SELECT book_id, page, ocr_mode, round(min(v.x), 6) AS x, round(min(v.y), 6) AS y, round(max(v.x + v.w) - min(v.x), 6) AS w, round(max(v.y + v.h) - min(v.y), 6) AS h FROM u GROUP BY ALL",
    ),
    "rect_contains_point": (
        rect_contains_point,
        _L + " SELECT book_id, page, ocr_mode, coalesce(list_position(list_transform(lines, lambda v: 0.4 >= v.x AND 0.4 <= v.x + v.w AND 0.5 >= v.y AND 0.5 <= v.y + v.h), true), 0)::BIGINT - 1 AS line_no FROM l"
    ),
    "hit_test_nearest": (
        hit_test_nearest,
        _L + ", u AS (SELECT book_id, page, ocr_mode, unnest(lines) AS v, generate_subscripts(lines, 1) - 1 AS i FROM l), c AS (SELECT *, abs(0.5::DOUBLE - (v.y + v.h / 2)) AS dy FROM u), b AS (SELECT book_id, page, ocr_mode, min((greatest(v.x - 0.4::DOUBLE, 0.4::DOUBLE - (v.x + v.w), 0.0) * 4 + dy, i)) FILTER (WHERE dy <= v.h / 2 + 0.008::DOUBLE) AS m FROM c GROUP BY ALL) SELECT book_id, page, ocr_mode, coalesce(m[2], -1)::BIGINT AS line_no FROM b",
    ),
    "line_clusters": (line_clusters, _N + f" SELECT id, len({line_fold('rects')}) AS lines FROM n"),
    "selection_rects": (
        selection_rects,
        _L + f", r AS (SELECT book_id, page, ocr_mode, list_sort({line_fold('lines[least(2, len(lines) - 1) + 1:least(5, len(lines) - 1) + 1]')}) AS r FROM l) "
        "SELECT book_id, page, ocr_mode, len(r) AS rects, array_to_string(list_transform(r, lambda v: printf('%.4f %.4f %.4f %.4f', v.l, v.t, v.r - v.l, v.b - v.t)), ';') AS places FROM r",
    ),
    "boxes_normalized": (
        boxes_normalized,
        _Q + f" SELECT vec_id, round({_C.format('list_min(xs) / 400')}, 6) AS x, round({_C.format('list_min(ys) / 200')}, 6) AS y, round({_C.format('(list_max(xs) - list_min(xs) + 1) / 400')}, 6) AS w, round({_C.format('(list_max(ys) - list_min(ys) + 1) / 200')}, 6) AS h FROM x"
    ),
    "quads_rotated_back": (
        quads_rotated_back,
        _Q + " SELECT vec_id, array_to_string(list_transform([1, 2, 3, 4], lambda i: CASE rot WHEN 90 THEN ys[i]::BIGINT || ',' || (199 - xs[i])::BIGINT WHEN 270 THEN (399 - ys[i])::BIGINT || ',' || xs[i]::BIGINT ELSE xs[i]::BIGINT || ',' || ys[i]::BIGINT END), ';') AS corners FROM x",
    ),
    "mark_hit_distance": (
        mark_hit_distance,
        "WITH e AS (SELECT vec_id, " + ", ".join(f"embedding[{i + 1}]::DOUBLE AS {c}" for i, c in enumerate(("px", "py", "ax", "ay", "bx", "byy"))) + " FROM embeddings), t AS (SELECT *, greatest(0.0, least(1.0, ((px - ax) * (bx - ax) + (py - ay) * (byy - ay)) / ((bx - ax) ** 2 + (byy - ay) ** 2))) AS t FROM e), r AS (SELECT vec_id, sqrt((px - (ax + t * (bx - ax))) ** 2 + (py - (ay + t * (byy - ay))) ** 2) AS dist FROM t) SELECT vec_id, round(dist, 6) AS distance, dist < 0.02 AS hit FROM r",
    ),
    "percentile_by_index": (percentile_by_index, _V + " SELECT vec_id, " + ", ".join(f"list_sort(v)[floor(64 * {q})::INT + 1] AS p{int(q * 100)}" for q in (0.5, 0.9, 0.99)) + " FROM e"),
    "page_quality": (
        page_quality,
        _V + ", i AS (SELECT *, list_sort(list_filter(v, lambda x: x < 200)) AS ink FROM e) SELECT vec_id, coalesce(ink[floor(len(ink) * 0.5)::INT + 1], 255) AS ink_median, list_sort(v)[floor(64 * 0.99)::INT + 1] AS p99, round(len(ink) / 64.0::DOUBLE, 6) AS ink_fraction FROM i"
    ),
    "contrast_stretch_image": (
        contrast_stretch_image,
        _V + " SELECT vec_id, array_to_string(list_transform(v, lambda x: greatest(0, least(255, round((x - list_min(v)) / greatest(list_max(v) - list_min(v), 1)::DOUBLE * 255.0::DOUBLE)))::BIGINT), ',') AS stretched FROM e"
    ),
    "thumbnail_sizes": (
        thumbnail_sizes,
        _L + ", t AS (SELECT *, len(lines) * 40 AS w0, least(1.0, 400.0 / greatest(len(lines) * 40, 1000))::DOUBLE AS sc FROM l) SELECT book_id, page, ocr_mode, greatest(round(w0 * sc), 1)::BIGINT AS w, greatest(round(1000 * sc), 1)::BIGINT AS h FROM t"
    ),
    "annotations_list": (
        annotations_list,
        _N + " SELECT id, book_id, page, kind, CASE WHEN regexp_full_match(color, '#[0-9A-Fa-f]{6}') THEN ('0x' || substr(color, 2))::BIGINT END AS colour, len(rects) AS rects FROM n"
    ),
    "annotation_replays": (annotation_replays, "SELECT id, count(*) AS rows FROM annotations GROUP BY 1 HAVING count(*) > 1"),
    "annotations_markdown": (
        annotations_markdown,
        _NM + f""", i AS (SELECT book_id, page, 0 AS src, created_at, id, '- ' || CASE kind {_LABELS} ELSE '{A.KIND_LABELS['highlight']}' END || '：' || coalesce(text, '') || chr(10) || CASE WHEN coalesce(content, '') <> '' THEN '  > ' || replace(content, chr(10), chr(10) || '  > ') || chr(10) ELSE '' END AS line FROM n
UNION ALL SELECT book_id, page, 1 AS src, created_at, id, CASE mark WHEN 'sticky' THEN '- {A.MARK_LABELS['sticky']}' || content || chr(10) || CASE WHEN content <> '' THEN '  > ' || replace(content, chr(10), chr(10) || '  > ') || chr(10) ELSE '' END WHEN 'stamp' THEN '- {A.MARK_LABELS['stamp']}' || coalesce(color || '.png', '') || chr(10) ELSE '- {A.MARK_LABELS['brush']}（' || coalesce(len(rects), 0) || ' 个点）' || chr(10) END AS line FROM k),
p AS (SELECT book_id, page, chr(10) || '## 第 ' || (page + 1) || ' 页' || chr(10) || chr(10) || string_agg(line, '' ORDER BY src, created_at, id, line) AS body FROM i GROUP BY 1, 2), b AS (SELECT book_id, '# 阅读标注' || chr(10) || string_agg(body, '' ORDER BY page) AS md FROM p GROUP BY 1)
SELECT books.id AS book_id, md5(coalesce(md, '# 阅读标注' || chr(10) || chr(10) || '> 暂无标注' || chr(10))) AS digest, length(coalesce(md, '# 阅读标注' || chr(10) || chr(10) || '> 暂无标注' || chr(10))) AS chars FROM books LEFT JOIN b ON books.id = b.book_id""",
    ),
    "annotation_visibility": (
        annotation_visibility,
        _N + " SELECT book_id, page, id, CASE WHEN kind IN ('highlight','underline','strikethrough','note') THEN kind ELSE 'highlight' END AS kind FROM n WHERE kind NOT IN ('underline', 'note')"
    ),
    "mark_payload_fields": (
        mark_payload_fields,
        _NM + " SELECT id, mark AS kind, CASE WHEN mark = 'sticky' THEN content END AS text, CASE WHEN mark = 'stamp' THEN color || '.png' END AS file, CASE WHEN mark = 'brush' THEN coalesce(len(rects), 0) ELSE 0 END::BIGINT AS points FROM k"
    ),
    "mark_styles": (mark_styles, "SELECT event_id, json_extract(props, '$.k')::DOUBLE AS stroke_width, false AS fill, 14.0::DOUBLE AS font_size FROM events"),
}
