import datetime as dt

import pytest
from pyspark.sql import functions as F

from lectern.functions import interaction as I
from lectern.library import Library
from lectern.sources import schemas

T0 = dt.datetime(2024, 1, 1)


def one(spark, expr):
    return spark.range(1).select(expr.alias("v")).first().v


def test_books_and_categories(spark, tmp_path):
    lib = Library.create(spark).at(T0)
    paths = spark.createDataFrame([("/a/one.pdf",), ("/a/two.png",), ("/a/no.docx",)], "original_path string")
    lib, outcome = lib.import_books(paths)
    assert {r.original_path: r.outcome for r in outcome.collect()} == {"/a/one.pdf": "imported", "/a/two.png": "imported", "/a/no.docx": "failed"}
    lib = lib.create_category("A").create_category("B").create_category("A")
    assert [(r.name, r.sort_order) for r in lib.list_categories().collect()] == [("A", 0), ("B", 1)]
    lib = lib.assign_category(1, 1).toggle_favorite(2).at(T0 + dt.timedelta(1)).touch_last_opened(2)
    assert [r.id for r in lib.list_books().collect()] == [2, 1]
    assert [r.id for r in lib.list_books("favorite").collect()] == [2]
    with pytest.raises(ValueError):
        lib.rename_category(2, "A")
    lib = lib.delete_category(1)
    assert lib.get_book(1).first().category_id is None
    lib.save(str(tmp_path / "lib"))
    again = Library.load(spark, str(tmp_path / "lib"))
    assert again.table("books").count() == 2 and again.find_book(stored_path="documents/00000001.pdf").first().title == "one"


def test_pages_search_and_cascade(spark):
    lib = Library.create(spark).at(T0)
    lib, _ = lib.import_books(spark.createDataFrame([("/a/one.pdf",)], "original_path string"))
    row = [(1, 0, "fast", ([("Dummy text", 0.1, 0.2, 0.5, 0.03, 0.9)], "fast"), T0)]
    lib = lib.save_page_ocr(spark.createDataFrame(row, schemas.SCHEMAS["page_ocr_cache"]))
    assert [(r.book_id, r.page) for r in lib.search_books("dummy").collect()] == [(1, 0)]
    assert lib.search_index_status().first().status == "ready"
    lib = lib.at(T0 + dt.timedelta(1)).update_page_ocr_lines(1, 0, "fast", {0: "Fixed text"})
    assert lib.search_books("dummy").count() == 0 and lib.search_books("fixed").count() == 1
    lib = lib.create_annotation(1, 0, "note", "a", "b").save_progress(1, 3, 1.5, "doubleScroll").save_progress(1, 4, 1.5, "odd")
    assert lib.get_progress(1).first().page in (3, 4) and "📝" in lib.export_annotations_markdown(1) and '"text" : "a"' in lib.export_annotations_json(1)
    lib = lib.update_annotation_content(1, "c").create_image_annotation(1, 0, "sticky", 0.5, 0.5, '{"text":"x"}').update_image_annotation(1, rotation=15.0)
    assert lib.list_image_annotations(1).first().rotation == 15.0
    gone = lib.delete_book(1)
    assert all(gone.table(t).count() == 0 for t in ["books", *schemas.OWNED_BY_BOOK]) and lib.table("books").count() == 1


def test_settings_and_conversations(spark):
    lib = Library.create(spark).at(T0)
    assert lib.get_setting("x") is None and lib.set_setting("x", "1").at(T0 + dt.timedelta(1)).set_setting("x", "2").get_setting("x") == "2"
    assert lib.get_ai_config().first().temperature == 0.7 and lib.set_ai_config('{"temperature": 9}').get_ai_config().first().temperature == 2.0
    lib = lib.create_ai_thread(" ", "chat", 7).create_ai_thread("b", "chat", None).create_ai_thread("c", "chat", None)
    with pytest.raises(ValueError):
        lib.create_ai_thread("d", "chat", 7)
    lib = lib.at(T0 + dt.timedelta(1)).append_ai_message(1, "user", "hi", action_type="vision").append_ai_message(1, "assistant", "yes").append_ai_message(1, "user", "  ")
    assert [r.content for r in lib.list_ai_messages(1).collect()] == ["hi", "yes"]
    first = lib.list_ai_threads().first()
    assert (first.id, first.title, first.action_type) == (1, "untitled", "vision")
    assert lib.delete_ai_thread(1).table("ai_messages").count() == 0


def test_migration(spark):
    old = {"ai_threads": spark.createDataFrame([(1, "t")], "id long, title string"), "page_text_index": spark.createDataFrame([(1, 0, "x")], "book_id long, page long, raw_text string")}
    new = schemas.migrate(spark, old, 2)
    assert new["ai_threads"].count() == 0 and "book_id" in new["ai_threads"].columns and new["page_text_index"].first().original_text is None
    assert schemas.migrate(spark, old, 4)["ai_threads"].first().book_id is None


def test_interaction(spark):
    assert [(p.text, p.hit) for p in one(spark, I.hit_pieces(F.lit("a The cat, the end"), "the"))] == [("a ", False), ("The", True), (" cat, ", False), ("the", True), (" end", False)]
    assert [(p.text, p.hit) for p in one(spark, I.hit_pieces(F.lit("none"), "the"))] == [("none", False)]
    points = F.array(*(F.array(F.lit(a), F.lit(b)) for a, b in ((0.0, 0.0), (1.0, 0.0), (1.0, 1.0))))
    assert one(spark, I.path_distance(points, F.lit(0.5), F.lit(0.25))) == 0.25 and one(spark, I.path_distance(F.array().cast("array<array<double>>"), F.lit(0.0), F.lit(0.0))) is None
    box = I.centred_box(F.lit(0.5), F.lit(0.5), F.lit(None).cast("double"), F.lit(0.4), 0.2)
    assert [round(v, 6) for v in one(spark, box)] == [0.4, 0.3, 0.2, 0.4] and one(spark, I.corner_at(box, F.lit(0.6), F.lit(0.7), 0.01)) == 2 and one(spark, I.corner_at(box, F.lit(0.5), F.lit(0.5), 0.01)) == -1
    assert one(spark, I.resized(F.lit(0.5), F.lit(5.0))) == 2.0 and one(spark, I.turned(F.lit(10), F.lit(2))) == 40 and one(spark, I.row_at(F.lit(149.0), F.lit(100.0))) == 1
    assert one(spark, I.toggled(F.array(F.lit("a")), F.lit("a"))) == [] and one(spark, I.toggled(F.array(F.lit("a")), F.lit("b"))) == ["a", "b"]
    assert one(spark, I.page_step(F.lit(8).cast("long"), F.lit(True), F.lit(9).cast("long"))) == 9 and one(spark, I.follow_up(F.lit("translate"))) == "chat"
    assert one(spark, I.brush_payload(F.array(F.array(F.lit(0.1), F.lit(0.2))))) == '{"points":[[0.1,0.2]]}' and one(spark, I.shape_payload(F.lit("arrow"))) == '{"shapeType":"arrow"}'
    body = one(spark, I.request_body(F.lit("m"), F.array(F.struct(F.lit("user").alias("role"))), F.lit(3.0), F.lit(None).cast("string")))
    assert body == '{"model":"m","messages":[{"role":"user"}],"stream":true,"temperature":2.0}'
    s = lambda *v: one(spark, I.search_prompt(*(F.lit(x) for x in v)))
    assert s(True, True, "R", None).endswith("R") and "failed: E" in s(True, True, None, "E") and "key" in s(True, False, "R", None) and "off" in s(False, True, "R", None)
    assert one(spark, I.big_enough(points, F.lit(0.0), F.lit(0.0), F.lit(True))) is True and one(spark, I.big_enough(points, F.lit(0.005), F.lit(1.0), F.lit(False))) is False
    c = one(spark, I.crop(F.struct(F.lit(-1.0).alias("x"), F.lit(1.0).alias("y"), F.lit(5.0).alias("w"), F.lit(5.0).alias("h")), F.lit(2.0), F.lit(6.0), F.lit(100.0)))
    assert tuple(c) == (0.0, 2.0, 6.0, 10.0)


def test_opening_scanning_and_indexing(spark):
    lib = Library.create(spark).at(T0)
    lib, _ = lib.import_books(spark.createDataFrame([("/a/One.pdf",), ("/a/Two.png",), ("/a/Three.pdf",)], "original_path string"))
    books = {r.title: r for r in lib.table("books").collect()}
    lib, route = lib.open_book(books["One"].stored_path, 7)
    assert (route.first().route, route.first().page_count) == ("pdf", 7) and lib.get_book(books["One"].id).first().page_count == 7
    assert lib.open_book(books["Two"].stored_path)[1].first().route == "image"
    assert tuple(lib.open_book("nowhere.pdf")[1].first())[1:] == (None, "pdf", 0)
    line = {"text": "scanned words", "x": 0.1, "y": 0.1, "w": 0.5, "h": 0.02, "confidence": 0.9}
    calls = spark.sparkContext.accumulator(0)

    def recognise(book, page, mode):
        calls.add(1)
        if page == 5:
            raise OSError("no image")
        return [line]

    lib, none = lib.scan_page(books["One"].id, 0, "fast")
    assert none.first().error and lib.table("page_ocr_cache").count() == 0
    lib, bad = lib.scan_page(books["One"].id, 5, "fast", recognise)
    assert bad.first().error == "OSError: no image"
    lib, done = lib.scan_page(books["One"].id, 0, "fast", recognise)
    kept = lib.table("page_ocr_cache").collect()
    assert done.first().origin == "engine" and lib.search_books("scanned").count() == 1 and lib.page_has_text(books["One"].id, 0)
    lib = lib._with(page_ocr_cache=spark.createDataFrame(kept, schemas.SCHEMAS["page_ocr_cache"]))
    before = calls.value
    assert lib.scan_page(books["One"].id, 0, "fast", recognise)[1].first().origin == "cache" and calls.value == before
    three = books["Three"].id
    pages = spark.createDataFrame([(three, 0, "alpha beta", None), (three, 1, " ", None)], "book_id long, page long, text string, error string")
    failed = lib.ensure_book_index(three, pages.withColumn("error", F.lit("broken")))
    assert {r.id: r.status for r in failed.search_index_status().collect()}[three] == "failed"
    assert failed.ensure_book_index(three, pages).search_books("alpha").count() == 0
    ready = lib.ensure_book_index(three, pages)
    assert ready.search_books("alpha").count() == 1 and ready.get_setting(f"index_ready:{three}") == "1"
    assert lib.ensure_book_index(999, pages) is lib and lib.template_default_text("general") and lib.template_default_text("x") == ""


def test_versions(spark):
    none = spark.createDataFrame([], "version int")
    assert schemas.recorded_version(none).first().version is None
    tables, versions = schemas.migrate_recorded(spark, {}, none)
    assert [r.version for r in versions.collect()] == [schemas.LATEST_VERSION] and schemas.migrate_recorded(spark, tables, versions)[1] is versions
    threads = spark.createDataFrame([(1, "t")], "id long, title string")
    two = spark.createDataFrame([(1,), (2,)], "version int")
    moved, versions = schemas.migrate_recorded(spark, {"ai_threads": threads}, two)
    assert moved["ai_threads"].count() == 0 and versions.count() == 3
    with pytest.raises(ValueError):
        schemas.migrate_recorded(spark, {}, spark.createDataFrame([(99,)], "version int"))
