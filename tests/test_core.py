import datetime as dt
import random

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from lectern.functions import decode, geometry as G, text as T
from lectern.functions.segment import DictionarySegmenter, segmented
from lectern.operators import annotations as A, conversations as C, library as L, ocr as O, search as S, tables as tb
from lectern.sources import documents as docs, web
from lectern.streaming import events as E, folds, live

BOX = "array<struct<char:string,x:double,y:double,w:double,h:double>>"


def one(spark, expr):
    return spark.range(1).select(expr.alias("v")).first().v


def boxes(rows):
    return F.from_json(F.lit(str([dict(zip(("char", "x", "y", "w", "h"), r)) for r in rows]).replace("'", '"')), BOX)


SAMPLE = [(c, 0.1 * (i + 1), 0.1, 0.01, 0.02) for i, c in enumerate("abcd")] + [(c, 0.1 * (i + 1), 0.2, 0.01, 0.02) for i, c in enumerate("efg")]


@pytest.mark.parametrize("p,want", [((0.21, 0.11), 1), ((0.34, 0.11), 2), ((0.15, 0.21), 4), ((0.31, 0.21), 6), ((0.25, 0.16), -1), ((0.9, 0.9), -1)])
def test_nearest(spark, p, want):
    assert one(spark, G.nearest(boxes(SAMPLE), F.lit(p[0]), F.lit(p[1]))) == want


def rects(spark, rows, a=0, b=999):
    return [tuple(round(v, 4) for v in r) for r in one(spark, G.line_rects(G.selection(boxes(rows), F.lit(a), F.lit(b))))]


def test_line_rects(spark):
    assert rects(spark, SAMPLE, 0, 3) == [(0.1, 0.1, 0.31, 0.02)]
    assert rects(spark, SAMPLE, 1, 6) == rects(spark, SAMPLE, 6, 1) == [(0.2, 0.1, 0.21, 0.02), (0.1, 0.2, 0.21, 0.02)]
    mixed = [("D", 0.0974, 0.0860, 0.0162, 0.0137), ("u", 0.1169, 0.0897, 0.0128, 0.0101), ("m", 0.1332, 0.0895, 0.0206, 0.0101), ("m", 0.1572, 0.0895, 0.0206, 0.0101), ("y", 0.1799, 0.0897, 0.0144, 0.0139)]
    assert rects(spark, mixed) == [(0.0974, 0.086, 0.0969, 0.0176)]
    assert len(rects(spark, [("a", 0.1, 0.1, 0.1, 0.03), ("b", 0.1, 0.135, 0.1, 0.03)])) == 2
    assert rects(spark, []) == []


def test_line_rects_equal_a_plain_fold(spark):
    r = random.Random(3)
    for _ in range(12):
        rows = [("x", round(r.random(), 2), round(r.random() / 3, 2), 0.05, round(r.uniform(0.01, 0.08), 2)) for _ in range(r.randint(1, 9))]
        lines = []
        for _, x, y, w, h in rows:
            hit = next((v for v in lines if y < v[1] and v[0] < y + h), None)
            if hit is None:
                lines.append([y, y + h, x, x + w])
            else:
                hit[:] = [min(hit[0], y), max(hit[1], y + h), min(hit[2], x), max(hit[3], x + w)]
        want = sorted((t, b, lo, hi) for t, b, lo, hi in lines)
        assert rects(spark, rows) == [tuple(round(v, 4) for v in (lo, t, hi - lo, b - t)) for t, b, lo, hi in want]


def test_geometry_values(spark):
    quad = F.array(*(F.array(F.lit(float(a)), F.lit(float(b))) for a, b in ((100, 50), (200, 50), (200, 60), (100, 60))))
    b = one(spark, G.quad_rect(quad, F.lit(1000.0), F.lit(500.0)))
    assert [round(v, 4) for v in b] == [0.1, 0.1, 0.101, 0.022]
    off = F.array(*(F.array(F.lit(float(a)), F.lit(float(b))) for a, b in ((-5, -3), (10, 8))))
    assert [round(v, 4) for v in one(spark, G.quad_rect(off, F.lit(100.0), F.lit(100.0)))] == [0.0, 0.0, 0.16, 0.12]
    assert one(spark, G.percentile_by_index(F.array(*map(F.lit, [4, 1, 3, 2])), 0.5)) == 3
    assert one(spark, G.percentile_by_index(F.array().cast("array<int>"), 0.5)) is None
    assert round(one(spark, G.segment_distance(*map(F.lit, (0.0, 1.0, 0.0, 0.0, 2.0, 0.0)))), 6) == 1.0
    assert one(spark, G.segment_distance(*map(F.lit, (3.0, 4.0, 0.0, 0.0, 0.0, 0.0)))) == 5.0
    assert [one(spark, G.zoom_tier(F.lit(z))) for z in (0.1, 1.3, 9.0)] == [0.5, 1.5, 4.0]
    assert one(spark, G.spread_pages(F.lit(4), F.lit(True), F.lit(9))) == [2, 3]
    assert one(spark, G.spread_pages(F.lit(9), F.lit(True), F.lit(9))) == [8]
    for rot in (90, 270):  # a corner on the page as it was goes there and back
        turned = F.array(F.lit(49.0), F.lit(10.0)) if rot == 90 else F.array(F.lit(30.0), F.lit(89.0))
        assert [tuple(p) for p in one(spark, G.rotate_back(F.array(turned), F.lit(100.0), F.lit(80.0), F.lit(rot)))] == [(10.0, 30.0)]


@pytest.mark.parametrize("n,mean,want", [(0, 0, False), (3, 0.9, False), (2, 0.9, True), (3, 0.4, True)])
def test_suspicious(spark, n, mean, want):
    assert one(spark, O.suspicious(F.lit(n), F.lit(float(n * mean)))) is want


def test_orientation(spark):
    f = lambda *v: one(spark, O.orientation(F.lit(v[0]), F.lit(1), F.lit(v[1]), F.lit(v[2])))
    assert (f(1.0, 1.05, 1.05), f(1.0, 1.2, 1.25), f(1.0, 1.2, 1.4), f(1.0, 1.0, 1.2)) == (0, 90, 270, 270)


def test_snippets(spark):
    body = "abcdefghij" * 4 + "量子计算" + "klmnopqrst" * 4
    s = one(spark, T.snippet(F.lit(body), "量子计算"))
    assert s == "…" + body[10:74] + "…"
    assert one(spark, T.snippet(F.lit(body), "missing")) == body[:60]
    assert one(spark, T.snippet(F.lit("  short text "), "text")) == "short text"
    assert one(spark, T.snippet(F.lit("Deep Water"), "deep")) == "Deep Water"
    assert one(spark, T.snippet(F.lit(None).cast("string"), "x")) is None


@settings(max_examples=25, deadline=None)
@given(st.text("ab cé量", max_size=30), st.text("ab量", min_size=1, max_size=3))
def test_occurrences(spark, text, query):
    want, at, low = [], 0, text.lower()
    while (i := low.find(query, at)) >= 0:
        want.append(i)
        at = i + len(query)
    assert one(spark, T.occurrences(F.lit(text), query)) == want


PAGES = [(1, 0, "x", "量子 计算 入门"), (1, 1, "x", "深度 学习 基础"), (2, 0, "x", "Un Café au-lait, ABC"), (2, 1, "x", "lait au chocolat")]


def search(spark, query, rows=PAGES):
    df = spark.createDataFrame(rows, "book_id long, page long, source string, original_text string")
    found = sorted((r.book_id, r.page) for r in S.search(df, query).collect())
    assert found == sorted((r.book_id, r.page) for r in S.search_postings(S.postings(df), query).collect())
    return found


def test_search(spark):
    assert search(spark, "量子") == [(1, 0)]
    assert search(spark, "cafe abc") == search(spark, '"ABC" CAFÉ') == [(2, 0)]
    assert search(spark, "au-lait") == [(2, 0)] and search(spark, "lait-au") == [(2, 1)]
    assert search(spark, "laits") == search(spark, "lai") == search(spark, "abc OR chocolat") == []
    assert search(spark, "") == search(spark, ' "" -- ') == [] and search(spark, "abc --") == [(2, 0)]
    assert S.clamp_limit(None) == 200 and S.clamp_limit(0) == 1 and S.clamp_limit(9999) == 500


def test_search_agrees_with_sqlite_fts5(spark):
    import sqlite3

    con = sqlite3.connect(":memory:")
    try:
        con.execute("CREATE VIRTUAL TABLE t USING fts5(x, tokenize='unicode61')")
    except sqlite3.OperationalError:
        pytest.skip("no FTS5 here")
    r = random.Random(8)
    words = ["abc", "ABC", "Café", "cafe", "au-lait", "lait", "au", "x1", "naïve", "no.", "(map)", "rock'n'roll"]
    rows = [(1, i, "x", " ".join(r.choice(words) for _ in range(r.randint(1, 6)))) for i in range(60)]
    con.executemany("INSERT INTO t(rowid, x) VALUES (?, ?)", [(p + 1, t) for _, p, _, t in rows])
    for q in ["abc cafe", "au-lait", "lait-au", "naive", "map no", "rock'n'roll", "x1 OR"]:
        expression = " ".join(f'"{w}"' for w in q.split())
        want = sorted(i - 1 for (i,) in con.execute("SELECT rowid FROM t WHERE t MATCH ?", (expression,)))
        assert [p for _, p in search(spark, q, rows)] == want, q


def test_pages_keep_the_latest_text(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [(1, " old ", "a", 1, 0, t), (2, "new", "b", 1, 0, t + dt.timedelta(1)), (3, "  ", "c", 1, 1, t), (4, "x", "d", None, 0, t), (5, None, "e", 2, 0, t)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, book_id long, page long, indexed_at timestamp_ntz")
    assert [(r.book_id, r.page, r.original_text) for r in S.pages(df).collect()] == [(1, 0, "new")]


BOOKS = [(1, "Alpha", "pdf", False, 1), (2, "Beta", "image", False, None), (3, "Gamma", "pdf", True, 2)]


@pytest.mark.parametrize("args,want", [(("all",), {1, 2, 3}), (("pdf",), {1, 3}), (("image",), {2}), (("favorite",), {3}), (("category", 1), {1}), (("category", 1, "gam"), set()), (("category", 2, "GAM"), {3}), (("category", None), {2})])
def test_filters(spark, args, want):
    df = spark.createDataFrame(BOOKS, "id long, title string, file_type string, favorite boolean, category_id long")
    assert {r.id for r in L.filtered(df, *args).collect()} == want


def test_imports_and_status(spark):
    paths = spark.createDataFrame([("/a/b.PDF",), ("/a/c.jpeg",), ("/a/c.jpeg",), ("/a/d.docx",), ("/a/old.pdf",), ("/x/.pdf",)], "original_path string")
    known = spark.createDataFrame([("/a/old.pdf",)], "original_path string")
    got = {r.original_path: (r.outcome, r.times) for r in L.import_outcomes(paths, known).collect()}
    assert got == {"/a/b.PDF": ("imported", 1), "/a/c.jpeg": ("imported", 2), "/a/d.docx": ("failed", 1), "/a/old.pdf": ("existed", 1), "/x/.pdf": ("imported", 1)}
    assert {r.title for r in L.import_candidates(paths).collect()} == {"b", "c", "d", "old", ".pdf"}
    books = spark.createDataFrame([(i, "pdf" if i < 5 else "image") for i in range(1, 6)], "id long, file_type string")
    ids = lambda *v: spark.createDataFrame([(x,) for x in v], "book_id long")
    assert {r.id: r.status for r in L.index_status(books, ids(1, 2), ids(2, 3), ids(1)).collect()} == {1: "building", 2: "ready", 3: "failed", 4: "missing"}


def test_tables(spark):
    t = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "id long, v string, seq int")
    c = spark.createDataFrame([(2, "c", 5), (2, "d", 7), (3, "e", 1), (3, "e", 1)], "id long, v string, seq int")
    assert sorted((r.id, r.v) for r in tb.upsert(t, c, ["id"], ["seq"]).collect()) == [(1, "a"), (2, "d"), (3, "e")]
    assert sorted((r.id, r.v) for r in tb.insert(t, c, ["id"]).select("id", "v").where("id <> 2 OR v = 'b'").collect()) == [(1, "a"), (2, "b"), (3, "e")]
    assert sorted((r.id, r.v) for r in tb.update(t, spark.createDataFrame([(2, None)], "id long, v string"), "id", ["v"]).collect()) == [(1, "a"), (2, None)]
    assert [r.id for r in tb.delete(t, spark.createDataFrame([(1,)], "id long"), "id").collect()] == [2]
    assert {(r.id, r.v) for r in tb.set_null(t, spark.createDataFrame([("a",)], "id string"), "v").collect()} == {(1, None), (2, "b")}
    assert [r.id for r in tb.duplicates(c, ["id"]).orderBy("id").collect()] == [2, 3]
    assert tb.next_position(t.limit(0), "seq").first()[0] == 0 and tb.next_position(t, "seq").first()[0] == 2


def test_decoders(spark):
    assert [one(spark, decode.view_mode(F.lit(v))) for v in ("doubleScroll", "double_page", "odd", None)] == ["double_scroll", "double_page", "single", "single"]
    assert one(spark, decode.colour(F.lit("#ff8000"))) == 0xFF8000 and one(spark, decode.colour(F.lit("red"))) is None
    assert one(spark, decode.colour_text(F.lit(0xFF80).cast("long"))) == "#00ff80"
    assert [one(spark, decode.payload_text(F.lit(v), "text")) for v in ('{"text":"a"}', '{"text":5}', "bad", "{}")] == ["a", None, None, None]
    assert [one(spark, decode.payload_points(F.lit(v))) for v in ('{"points":[[0,0],[1,1]]}', "bad", "{}")] == [2, 0, 0]
    c = one(spark, decode.config(F.lit('{"temperature": 7, "text_model": "m", "ocr_mode": "other", "custom_prompts": [{"name": "a", "text": "b"}]}')))
    assert c.temperature == 2.0 and c.text_model == "m" and c.include_book_history is True and c.template_overrides == {} and c.ocr_mode == "high_precision"
    assert len(c) == 20 and c.custom_prompts[0].text == "b" and c.vision_base_url is None and c.reasoning_effort == "medium"
    assert one(spark, decode.config(F.lit("broken"))).translate_target_lang == "中文"
    assert tuple(one(spark, decode.style(F.lit("[]")))) == (3.0, None, False, 14.0)
    assert one(spark, decode.rects(F.lit("bad"))) == []


def test_exports(spark):
    t = dt.datetime(2024, 1, 1)
    notes = [(1, 9, 0, "highlight", "a", None, t), (2, 9, 0, "underline", None, None, t), (3, 9, 2, "note", "c", "one\ntwo", t), (4, 9, 2, "odd", "d", "", t), (4, 9, 2, "odd", "d", "", t)]
    marks = [(7, 9, 0, "sticky", '{"text":"s\\nt"}', t), (8, 9, 1, "stamp", '{"file":"f"}', t), (9, 9, 1, "brush", '{"points":[[0,0],[1,1]]}', t), (10, 9, 1, "shape", '{"shapeType":"arrow"}', t)]
    n = spark.createDataFrame(notes, "id long, book_id long, page long, kind string, text string, content string, created_at timestamp_ntz")
    m = spark.createDataFrame(marks, "id long, book_id long, page long, kind string, payload string, created_at timestamp_ntz")
    books = spark.createDataFrame([(9,), (5,)], "id long")
    got = {r.book_id: r.markdown for r in A.markdown_for(books, n, m).collect()}
    assert got[5] == A.HEADING + A.EMPTY
    lines = got[9].split("\n")
    assert [x for x in lines if x.startswith("## ")] == ["## 第 1 页", "## 第 2 页", "## 第 3 页"]
    assert "  > one" in lines and "  > two" in lines and "- 🔖 图章f" in lines and "- 🖌 画笔（2 个点）" in lines and "- ⬜ 形状（arrow）" in lines
    assert got[9].index("高亮") < got[9].index("便签") and got[9].count("：d\n") == 1
    assert {r.kind for r in A.items(n, None, ["note"]).collect()} == {"highlight", "underline"}
    j = A.export_json(n.withColumn("rects", F.lit(None).cast("array<struct<x:double>>")).withColumn("color", F.lit("#fff"))).first().json
    assert '"book_id" : 9' in j and '"rects" : null' in j and '\n  "image_marks" : [ ]' in j


def test_conversations(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [(1, 1, "User ", "q", None, "Translate", t), (2, 1, "assistant", "a", None, None, t), (3, 1, "user", "q2", None, "odd", t + dt.timedelta(1)), (4, 1, "assistant", "a2", None, "vision", t + dt.timedelta(2)), (1, 1, "User ", "q", None, "Translate", t + dt.timedelta(9)), (5, 2, None, "s", None, None, t)]
    m = C.messages(spark.createDataFrame(rows, "id long, thread_id long, role string, content string, image_path string, action_type string, created_at timestamp_ntz"))
    assert {(r.id, r.role, r.action_type) for r in m.collect()} == {(1, "user", "translate"), (2, "assistant", None), (3, "user", None), (4, "assistant", "vision"), (5, "user", None)}
    assert {r.id: r.action for r in C.inherited_actions(m).collect()} == {2: "translate", 4: None}
    assert sorted(r.id for r in C.without_last(m).collect()) == [1, 2, 3]
    threads = spark.createDataFrame([(1, "t", "chat", 3, t, t), (2, "u", None, None, t, t), (3, "v", "x", None, t, t)], "id long, title string, action_type string, book_id long, created_at timestamp_ntz, updated_at timestamp_ntz")
    s = {r.id: (r.action, r.messages) for r in C.thread_summaries(threads, m).collect()}
    assert s == {1: ("vision", 4), 2: ("chat", 1), 3: ("chat", 0)}
    assert C.window_of(threads, None).first().id == 2 and C.window_of(threads, 3).first().id == 1
    assert one(spark, C.system_prompt(F.lit("translate"))) == C.TEMPLATES["translate"]
    own = F.create_map(F.lit("chat"), F.lit("mine"), F.lit("explain"), F.lit("  "))
    assert one(spark, C.system_prompt(F.lit("chat"), own)).endswith("mine") and one(spark, C.system_prompt(F.lit("explain"), own)).endswith(C.TEMPLATES["explain"])
    assert one(spark, C.wrap_untrusted(F.lit("chat"), F.lit("x"))) == "x" and one(spark, C.wrap_untrusted(F.lit("explain"), F.lit("x"))) != "x"


def test_recognised_text(spark):
    lines = "array<struct<text:string,x:double,y:double,w:double,h:double,confidence:double>>"
    rows = [(1, 0, "fast", ([("a", 0.1, 0.2, 0.5, 0.03, 0.9), (" ", 0.0, 0.0, 0.0, 0.0, 0.5), ("c", 0.0, 0.0, 0.0, 0.0, None)],)), (1, 0, "high_precision", ([("z", 0.1, 0.2, 0.5, 0.03, 0.7)],)), (1, 1, "fast", ([],))]
    df = spark.createDataFrame(rows, f"book_id long, page long, ocr_mode string, result struct<lines:{lines}>")
    assert {(r.page, r.ocr_mode) for r in O.in_mode(df, "high_precision").collect()} == {(0, "high_precision"), (1, "fast")}
    first = df.where("ocr_mode = 'fast' AND page = 0").select(F.col("result.lines").alias("l"))
    assert first.select(O.low_count(F.col("l"))).first()[0] == 1 and [v.i for v in first.select(O.low_confidence(F.col("l"))).first()[0]] == [1]
    fixed = first.select(O.correct(F.col("l"), F.create_map(F.lit(0), F.lit("A"), F.lit(2), F.lit(" "), F.lit(9), F.lit("x"))).alias("l")).first().l
    assert [v.text for v in fixed] == ["A", " ", "c"] and fixed[0].x == 0.1 and fixed[0].confidence == 0.9
    assert len(first.select(O.boxes(F.col("l"))).first()[0]) == 2
    native = spark.createDataFrame([(1, 0, "native text")], "book_id long, page long, text string")
    other = spark.createDataFrame([(1, 0, "x"), (1, 1, "y")], "book_id long, page long, text string")
    assert {(r.page, r.layer) for r in O.layers(native, other).collect()} == {(0, "native"), (1, "ocr")}


def test_events(spark):
    cases = {'data: {"choices":[{"delta":{"content":"hi"}}]}': "hi", "data: [DONE]": None, 'data: {"choices":[{"delta":{"role":"assistant"}}]}': None, "data: bad": None, ": comment": None, "event: x\ndata: {\"choices\":[{\"delta\":{\"content\":\"y\"}}]}": "y"}
    df = spark.createDataFrame([(e,) for e in cases], "e string")
    assert {r.e: r.v for r in df.select("e", E.chat_delta(F.col("e")).alias("v")).collect()} == cases
    assert E.split_frames("data: a\n\ndata: b\r\n\r\ndata: c") == (["data: a", "data: b"], "data: c")
    rows = spark.createDataFrame([("s", 1, "he", None), ("s", 2, "llo", None), ("s", 3, None, "broken")], "k string, seq int, c string, e string")
    ev = rows.select("k", "seq", F.when(F.col("e").isNull(), E.delta_event(F.col("c"))).otherwise(E.failed_event(F.col("e"))).alias("event"))
    r = E.transcripts(ev, "k", ["seq"]).first()
    assert (r.transcript, r.failed) == ("hello\n\n> broken", True)
    late = ev.unionByName(spark.createDataFrame([("s", 4, "x"), ("t", 1, "y")], "k string, seq int, c string").select("k", "seq", E.delta_event(F.col("c")).alias("event")))
    assert {x.k: (x.transcript, x.failed) for x in E.transcripts(late, "k", ["seq"]).collect()} == {"s": ("hello\n\n> broken", True), "t": ("y", False)}


def test_folds(spark):
    log = [(1, 0, 1, "check_no_text"), (1, 0, 2, "scan"), (1, 0, 3, "check_text"), (1, 0, 4, "scanned"), (1, 1, 1, "check_cached"), (1, 2, 1, "scanned"), (1, 3, 1, "scan"), (1, 3, 2, "failed"), (1, 3, 3, "dismiss"), (1, 4, 1, "dismiss")]
    df = spark.createDataFrame(log, "book_id long, page long, seq long, event string")
    assert {r.page: r.phase for r in folds.scan_states(df).collect()} == {0: "success", 1: "success", 2: "", 3: "dismissed", 4: ""}
    edits = [(1, i, op, i) for i, op in enumerate(["edit", "edit", "undo", "undo", "undo", "redo", "edit", "redo"])]
    r = folds.replay_edits(spark.createDataFrame(edits, "log_id long, seq long, op string, edit long")).first()
    assert (r.applied, r.redoable) == ("0,6", 0)


def test_sources(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.4\nstream\nBT (Dummy text) Tj ET\nendstream\nstream\nBT [(Pa) -20 (ge)] TJ ET\nendstream")
    (tmp_path / "b.pdf").write_bytes(b"nothing")
    (tmp_path / "c.txt").write_text("# One\ntext\n## Two\n# Three\f second")
    f = docs.files(spark, str(tmp_path))
    pages = docs.page_texts(f.where("file_type = 'pdf'"), docs.simple_pdf_pages).collect()
    assert sorted((r.page, r.text) for r in pages if r.error is None) == [(0, "Dummy text"), (1, "Page")]
    assert [r.original_path[-5:] for r in pages if r.error] == ["b.pdf"]
    text = docs.page_texts(docs.files(spark, str(tmp_path), "*.txt"), docs.plain_pages)
    flat = docs.outline(text.select("original_path", "page", "text").where("page = 0"))
    tree = docs.outline_tree(flat, "original_path").orderBy("node").collect()
    assert [(r.title, r.depth, r.parent) for r in tree] == [("One", 1, None), ("Two", 2, 0), ("Three", 1, None)]
    payload = '{"data":{"webPages":{"value":[{"name":"N","url":"u","snippet":"s"},{"name":"M","url":"v"}]}}}'
    df = spark.createDataFrame([(payload,), ("bad",)], "payload string")
    assert {r.results for r in web.readable(df).collect()} == {"1. N\nu\ns\n\n2. M\nv", None}


def test_segmenter(spark):
    seg = DictionarySegmenter({"量子": 5, "计算": 5, "算法": 4, "介绍": 3, "本文": 2})
    assert seg("本文介绍算法 and QuBit-2, 未知词") == ["本文", "介绍", "算法", "and", "QuBit-2", "未知", "知词"]
    df = spark.createDataFrame([("量子计算",), (None,), (" ",)], "t string")
    assert [r.v for r in df.select(segmented(F.col("t"), seg).alias("v")).collect()] == ["量子 计算", None, ""]


def test_streams(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    ts = lambda s: t + dt.timedelta(seconds=s)
    rows = [(1, ts(0), 1), (1, ts(0.5), 2), (1, ts(9), 3), (2, ts(1), 4), (1, ts(600), 5)]
    spark.createDataFrame(rows, "book_id long, ts timestamp, page int").write.parquet(str(tmp_path / "in"))
    src = spark.readStream.schema("book_id long, ts timestamp, page int").parquet(str(tmp_path / "in"))
    q = live.debounced(src).writeStream.format("memory").queryName("progress").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(r.book_id, r.page, r.changes) for r in spark.table("progress").collect()} >= {(1, 2, 2), (1, 3, 1), (2, 4, 1)}

    page = "book_id long, page long, source string, original_text string, seq long"
    for i, text in enumerate(["old words", "new words"]):
        spark.createDataFrame([(1, 0, "x", text, i)], page).write.mode("append").parquet(str(tmp_path / "pages"))
        live.index_incrementally(spark.readStream.schema(page).parquet(str(tmp_path / "pages")), str(tmp_path / "index"), str(tmp_path / "state")).awaitTermination(120)
    index = live.current(spark.read.parquet(str(tmp_path / "index")))
    assert {r.token for r in index.collect()} == {"new", "words"}
    assert S.search_postings(index, "new words").count() == 1 and S.search_postings(index, "old").count() == 0

    spark.createDataFrame([("s", 0, "data: a\n"), ("s", 1, "\ndata: b")], "k string, seq long, chunk string").coalesce(1).write.parquet(str(tmp_path / "sse"))
    q = E.framed(spark.readStream.schema("k string, seq long, chunk string").parquet(str(tmp_path / "sse")), "k").writeStream.format("memory").queryName("frames").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [r.event for r in spark.table("frames").collect()] == ["data: a"]

    log = "book_id long, page long, seq long, event string"
    spark.createDataFrame([(1, 0, 1, "check_no_text"), (1, 0, 2, "scan"), (1, 0, 3, "scanned")], log).coalesce(1).write.parquet(str(tmp_path / "log"))
    q = live.page_states(spark.readStream.schema(log).parquet(str(tmp_path / "log"))).writeStream.format("memory").queryName("states").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [r.phase for r in spark.table("states").collect()] == ["success"]
