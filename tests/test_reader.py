import random

import pytest
from pyspark.sql import functions as F

from lectern.functions import geometry as G, pixels as P, selection as S, text as T
from lectern.operators import annotations as A, conversations as C

BOX = "array<struct<char:string,x:double,y:double,w:double,h:double>>"


def clusters(boxes):
    """Brute force: boxes join the first line whose rows they overlap."""
    lines = []
    for x, y, w, h in boxes:
        for v in lines:
            if y < v[1] and v[0] < y + h:
                v[0], v[1], v[2], v[3] = min(v[0], y), max(v[1], y + h), min(v[2], x), max(v[3], x + w)
                break
        else:
            lines.append([y, y + h, x, x + w])
    return [(left, top, right - left, bottom - top) for top, bottom, left, right in sorted(lines)]


def test_hit_rects_and_selections_equal_brute_force(spark):
    r = random.Random(3)
    pages = []
    for i in range(25):
        text = "".join(r.choice("abAB ") for _ in range(r.randrange(0, 60)))
        pages.append((i, [(c, 0.02 * (k % 20), 0.1 + 0.05 * (k // 20) + r.random() * 0.01, 0.018, 0.03) for k, c in enumerate(text)], r.randrange(-2, 62), r.randrange(-2, 62)))
    df = spark.createDataFrame(pages, f"id int, b {BOX}, s int, e int")
    got = df.select("id", S.hit_rects(F.col("b"), " aB ").alias("hits"), S.selected(F.col("b"), F.col("s"), F.col("e")).alias("text"), G.line_rects(G.selection(F.col("b"), F.col("s"), F.col("e"))).alias("lines")).collect()
    close = lambda a, b: len(a) == len(b) and all(abs(x - y) < 1e-9 for p, q in zip(a, b) for x, y in zip(p, q))
    for (_, boxes, s, e), row in zip(pages, sorted(got, key=lambda x: x.id)):
        text, want, at = "".join(b[0] for b in boxes).lower(), [], 0
        while (at := text.find("ab", at)) >= 0:
            want += clusters(b[1:] for b in boxes[at : at + 2])
            at += 2
        assert close([tuple(h) for h in row.hits], want)
        lo, hi = sorted((s, e))
        some = boxes[max(0, min(lo, len(boxes) - 1)) : max(0, min(max(hi, 0), len(boxes) - 1)) + 1]
        assert row.text == "".join(b[0] for b in some) and close([tuple(x) for x in row.lines], clusters(b[1:] for b in some))


def test_line_selections(spark):
    b = F.array(*(F.struct(F.lit(t).alias("char"), F.lit(0.1).alias("x"), F.lit(y).alias("y"), F.lit(0.5).alias("w"), F.lit(0.03).alias("h")) for t, y in (("abcde", 0.1), ("", 0.2), ("fghij", 0.3))))
    one = lambda c: spark.range(1).select(c.alias("v")).first().v
    place = lambda line, o: S.encode(F.lit(line), F.lit(o))
    assert one(S.selected_lines(b, place(0, 3), place(2, 1))) == one(S.selected_lines(b, place(2, 1), place(0, 3))) == "defg"
    assert one(S.selected_lines(b, place(0, 1), place(0, 2))) == "bc" and one(S.selected_lines(b, place(0, 4), place(0, 99))) == "e"
    assert [tuple(round(x, 6) for x in r) for r in one(S.selected_rects(b, place(0, 3), place(2, 1)))] == [(0.4, 0.1, 0.2, 0.03), (0.1, 0.3, 0.2, 0.03)]
    assert [one(S.place_at(b, F.lit(x), F.lit(y))) for x, y in ((0.31, 0.11), (0.9, 0.31), (0.05, 0.11), (0.3, 0.26))] == [2, 20004, -1, -1]
    assert one(S.line_of(F.lit(20004))) == 2 and one(S.offset_of(F.lit(20004))) == 4
    assert one(S.page_chars(S.letters(b))) == "abcdefghij" and one(S.hit_rects(b, "  ")) == []
    assert one(S.char_box(F.lit(""), *map(F.lit, (1.0, 1.0, 1.0, 1.0, 9.0, 9.0)))) is None
    assert tuple(one(S.char_box(F.lit("x"), *map(F.lit, (10.0, 20.0, 30.0, 40.0, 100.0, 200.0))))) == ("x", 0.1, 0.7, 0.3, 0.2)


def _image(w, h, f):
    return [f(x, y) for y in range(h) for x in range(w)]


@pytest.mark.parametrize("w,h", [(8, 8), (13, 9), (3, 3), (2, 2), (1, 1)])
def test_pixels_equal_brute_force(spark, w, h):
    r = random.Random(w)
    for kind in ("noise", "washed", "blank"):
        img = _image(w, h, lambda x, y, k=kind: r.randrange(256) if k == "noise" else (130 if (x + y) % 3 == 0 else 230) if k == "washed" else 255)
        v, wc, hc = F.array(*map(F.lit, img)), F.lit(w), F.lit(h)
        q = P.quality(v, wc)
        got = spark.range(1).select(q.alias("q"), P.washed_out(q).alias("washed"), P.enhanced(v, q).alias("out"), P.sharp_fraction(v, wc, hc).alias("sharp"), P.sampled(v, wc).alias("s")).first()
        seen = [img[y * w + x] for y in range(0, h, 4) for x in range(0, w, 4)]
        ink = sorted(x for x in seen if x < 200)
        assert got.s == seen and got.q.ink_fraction == len(ink) / len(seen) and got.q.p99 == sorted(seen)[int(len(seen) * 0.99)]
        assert got.q.ink_median == (ink[int(len(ink) * 0.5)] if ink else 255)
        points = [(x, y) for y in range(1, h - 1, 4) for x in range(1, w - 1, 4)]
        strong = sum(abs(img[y * w + x + 1] - img[y * w + x]) + abs(img[(y + 1) * w + x] - img[y * w + x]) > 120 for x, y in points)
        assert got.sharp == (strong / len(points) if points else 0.0)
        lo, hi = got.q.ink_median, got.q.p99
        assert got.washed == (bool(ink) and lo > 80 and hi - lo > 30)
        assert got.out == ([min(255.0, max(0.0, float(int((x - lo) / max(hi - lo, 1) * 255 + 0.5)) if x >= lo else 0.0)) for x in img] if got.washed else [float(x) for x in img])


def test_rgb(spark):
    row = spark.range(1).select(P.rgb(F.array(*map(F.lit, [1, 2, 3, 9, 4, 5, 6, 9]))).alias("v")).select("v", P.lumas(F.col("v")).alias("l")).first()
    assert row.v == [1, 2, 3, 4, 5, 6] and [round(x, 3) for x in row.l] == [1.815, 4.815]


def test_texts_and_sizes(spark):
    one = lambda c: spark.range(1).select(c.alias("v")).first().v
    assert one(T.error_text(F.lit("Exception: x"))) == " x" and one(T.error_text(F.lit("an Exception: x"))) == "an Exception: x"
    assert one(T.http_error(F.lit(404), F.lit("é" * 700))) == "HTTP 404: " + "é" * 600 and one(T.http_error(F.lit(500), F.lit(None).cast("string"))) == "HTTP 500: "
    assert one(T.search_endpoint(F.lit(" https://s/x/ "), "d")) == "https://s/x" and one(T.search_endpoint(F.lit(" "), "d")) == "d"
    assert tuple(one(G.render_size(F.lit(100.0), F.lit(0.2), F.lit(1.5), F.lit(2.0)))) == (300, 1)
    assert one(G.zoom_step(F.lit(1.2), F.lit(-3))) == 0.9 and one(G.zoom_step(F.lit(3.95), F.lit(3))) == 4.0
    over = F.create_map(F.lit("tech"), F.lit(" own "), F.lit("novel"), F.lit(" "))
    assert [one(C.role_template(F.lit(x), F.lit(" mine "), over)) for x in ("custom", "tech", "novel", "none")] == ["mine", "own", C.ROLE_TEMPLATES["novel"], ""]


def test_rail_and_stamps(spark):
    items = spark.createDataFrame([(1, 2, 0, 5, 1), (1, 0, 1, 1, 2), (1, 0, 0, 9, 3), (2, 0, 0, 1, 4)], "book_id long, page long, src int, created_at long, id long")
    assert {r.id: r.place for r in A.rail(items).collect()} == {3: 0, 2: 1, 1: 2, 4: 0}
    assert {r.id for r in A.on_page(items, 0).collect()} == {2, 3, 4}
    marks = spark.createDataFrame([(1, "stamp", '{"file":"a"}'), (2, "stamp", '{"file":"b"}'), (3, "brush", "{}")], "id long, kind string, payload string")
    files = spark.createDataFrame([("a", 7)], "file string, size int")
    assert {(r.id, r.size) for r in A.stamp_files(marks, files).collect()} == {(1, 7), (2, None)}
