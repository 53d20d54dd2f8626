import random

import pytest
from pyspark.sql import functions as F

from lectern.llm import scans as S

TITLE = "The Salt Road of Pelistad"
TEXT = "The reading society showed the route across the marsh and measured the angle of the light for the people of Karesdorn. "


def line(text, x=0.12, y=0.1, w=0.5, c=0.9):
    return {"text": text, "x": x, "y": y, "w": w, "h": 0.02, "confidence": c}


def book(n_pages=12, book_id=1):
    """Pages of a running head, broken words, a number at the foot; the cases as (page, line_no, kind)."""
    words, at, pages, cases = (TEXT * 60).split(), 0, [], set()
    for page in range(n_pages):
        lines = [line(TITLE, 0.3, 0.05, 0.3)]
        cases.add((page, 0, "running_head"))
        for k in range(12):
            text = " ".join(words[at : at + 7])
            at += 7
            if k % 4 == 2 and len(words[at]) > 6:
                text += f" {words[at][:3]}-"
                words[at] = words[at][3:]
                cases.add((page, len(lines), "hyphen"))
            lines.append(line(text, 0.15 if k == 0 else 0.12, 0.1 + 0.034 * k))
        lines.append(line(f"- {page + 1} -", 0.47, 0.96, 0.05))
        cases.add((page, len(lines) - 1, "page_number"))
        pages.append((book_id, page, "fast", {"lines": lines, "mode": "fast"}, "clash"))
    return pages, cases


SCHEMA = "book_id long, page long, ocr_mode string, result struct<lines: array<struct<text string, x double, y double, w double, h double, confidence double>>, mode string>, word string"


def frames(spark, pages, books=((1, TITLE + ".pdf"),)):
    return spark.createDataFrame(pages, SCHEMA), spark.createDataFrame([(*b, "x") for b in books], "id long, title string, kind string")


def test_noise_of_a_book(spark):
    pages, cases = book()
    lines = pages[3][3]["lines"]
    i = next(i for i, x in enumerate(lines) if " marsh " in x["text"])
    lines[i]["text"] = lines[i]["text"].replace("marsh", "rnarsh")
    cases.add((3, i, "misread"))
    pages += [pages[0], (1, 50, "fast", {"lines": [], "mode": "fast"}, "x"), (None, 1, "fast", {"lines": [line("x")], "mode": "fast"}, "x"), (2, 0, None, {"lines": [line(None), line("")], "mode": None}, "x"), (2, 1, "fast", None, "x")]
    got = {(r.page, r.line_no, r.kind) for r in S.noisy_lines(*frames(spark, pages)).where("book_id = 1").collect()}
    assert got == cases


def test_paragraphs_join_pages_and_words(spark):
    pages, _ = book(3)
    rows = S.paragraphs(*frames(spark, pages)).orderBy("page", "line_no").collect()
    assert len(rows) == 3
    whole = " ".join(r.text for r in rows)
    assert whole.split() == (TEXT * 60).split()[: len(whole.split())]
    assert "-" not in whole and TITLE not in whole


def test_paragraphs_put_right_misread_words_that_are_broken(spark):
    pages, _ = book(12)
    lines = pages[4][3]["lines"]
    i = next(i for i, x in enumerate(lines) if i > 2 and x["text"] == "the marsh and measured the angle of")
    lines[i]["text"], lines[i + 1]["text"] = "the marsh and mea-", f"surcd the angle of {lines[i + 1]['text']}"
    whole = " ".join(r.text for r in S.paragraphs(*frames(spark, pages)).orderBy("page", "line_no").collect())
    assert "surcd" not in whole and whole.split() == (TEXT * 60).split()[: len(whole.split())]


def test_empty(spark):
    scans, books = frames(spark, book(1)[0])
    assert S.noisy_lines(scans.limit(0), books.limit(0)).collect() == []
    assert S.paragraphs(scans.limit(0), books).collect() == []


@pytest.mark.parametrize("word,right,want", [("rnarket", "market", True), ("clock", "dock", True), ("mil1", "mill", True), ("northem", "northern", True), ("iridex", "index", True), ("cat", "dog", False), ("in", "in", False), ("fan", "tan", True), ("instriiment", "instrument", True)])
def test_confusions(word, right, want):
    assert S.explains(word, right) is want
    if want:
        assert S.skeleton(word) == S.skeleton(right)


@pytest.mark.parametrize("text", ["- 12 -", "Page l2 of 55", "iv", "— 8 —", "12/60", "第9页 共56页", "[0]", "S. 6"])
def test_numbers(text):
    assert S.observe(line(text, 0.47, 0.96, 0.05), {"left": 0.12, "top": 0.1, "bottom": 0.9, "leading": 0.03, "usual_top": 0.1}, "")[2] == "numbered"


def test_broken_words(spark):
    joins = spark.createDataFrame([("low", "-", "water"), ("pass", "-", "age"), ("insc", "", "ription"), ("the", "", "road"), ("zzz", "-", None), ("half", "-", None)], "tail string, mark string, next string")
    words = spark.createDataFrame([("low-water", 9), ("low", 9), ("water", 9), ("passage", 5), ("inscription", 8), ("the", 99), ("road", 50), ("theroad", 3)], "word string, n long")
    got = {(r.tail, r.next) for r in S.broken_words(joins, words).collect()}
    assert got == {("pass", "age"), ("insc", "ription"), ("zzz", None), ("half", None)}


def test_held_out_accuracy_of_misread_words(spark):
    r = random.Random(2)
    true = ["market", "observatory", "measurement", "harbour", "signature", "drawings", "lighthouse", "committee", "keeper", "warehouse"]
    rows = [(w, 200) for w in true]
    wrong = {}
    for w in true:
        for printed, read in r.sample(S.CONFUSIONS, len(S.CONFUSIONS)):
            if printed in w:
                bad = w.replace(printed, read, 1)
                wrong[bad] = w
                rows.append((bad, 2))
                break
    got = {x.word: x.right for x in S.misread_words(spark.createDataFrame(rows, "word string, n long")).collect()}
    assert got == wrong


def part(text, fixes=(), broken=False, over=None):
    return {"page": 0, "line_no": 0, "text": text, "broken": broken, "fixes": [{"at": a, "word": w, "right": r} for a, w, r in fixes], "over": over}


def test_misread_words_are_put_right_where_they_stand():
    assert S.assemble([part("the bc was bcaten", [(4, "bc", "be")])]) == "the be was bcaten"
    assert S.assemble([part("a fine ine day", [(7, "ine", "me")])]) == "a fine me day"
    assert S.assemble([part("打开丁门", [(2, "1开丁门", "1开了门")]), part("再走")]) == "打开了门再走"
    over = {"tail": "mea", "next": "surcd", "right": "measured"}
    assert S.assemble([part("we mea-", broken=True, over=over), part("surcd tbe road", [(6, "tbe", "the")])]) == "we measured the road"
    assert S.assemble([part(""), part("x")]) == "x"


def test_paragraphs_equal_the_source_of_a_noisy_book(spark):
    """Brute force: the text is set into lines with breaks and misreadings, and has to come back as it was."""
    r = random.Random(4)
    words = [w for _ in range(230) for w in TEXT.split()]
    noisy = [w.replace("m", "rn", 1) if r.random() < 0.02 else w.replace("e", "c", 1) if r.random() < 0.02 and len(w) > 4 else w for w in words]
    pages, at, rest = [], 0, ""
    for page in range(24):
        lines = [line(TITLE, 0.3, 0.05, 0.3)]
        for k in range(22):
            own = ([rest] if rest else []) + noisy[at : at + 8]
            at, rest = at + 8, ""
            if len(own[-1]) > 7 and own[-1].isalpha() and own[-1] in words:
                own[-1], rest = own[-1][:4] + "-", own[-1][4:]
            lines.append(line(" ".join(own), 0.15 if k == 0 and page % 3 == 0 else 0.12, 0.1 + 0.034 * k))
        pages.append((1, page, "fast", {"lines": lines, "mode": "fast"}, ""))
    rows = S.paragraphs(*frames(spark, pages)).orderBy("page", "line_no").collect()
    got = " ".join(x.text for x in rows).split()
    assert got == words[: len(got)] and len(got) >= at - 1


def test_confusions_are_learned_without_prior_shapes(spark):
    from lectern.llm import confusions as C

    true = ["market", "observatory", "measurement", "harbour", "signature", "drawings", "lighthouse", "committee", "keeper", "warehouse", "monument", "number", "member", "summer", "merchant", "mountain"]
    rows = [(w, 400) for w in true] + [(w.replace("m", "xx", 1), 3) for w in true if "m" in w] + [("hxrbour", 2), ("1的旳的", 1)]
    table = C.learn(spark.createDataFrame(rows, "word string, n long"), prior=[])
    assert table.directed == [("m", "xx")]
    assert table.explains("xxarket", "market") and table.skeleton("xxarket") == table.skeleton("market") and not table.explains("hxrbour", "harbour")
    assert C.learn(spark.createDataFrame([], "word string, n long"), prior=[("m", "rn")]).directed == [("m", "rn")]


def test_line_model_estimates_itself(spark):
    """Pages of a layout that the first beliefs get wrong: heads are indented text within the page, told by what surrounds them."""
    from lectern.llm import linemodel as M

    body, head, number = ("within", "left", "text", "sure"), ("top", "inset", "text", "doubtful"), ("bottom", "middle", "numbered", "sure")
    page = bytes(map(M.code, [head, *[body] * 9, number]))
    frame = spark.createDataFrame([(bytearray(page),)] * 50 + [(bytearray(),)], "codes binary")
    model = M.fit(frame)
    want = bytes([M.STATES.index(M.HEAD), *[M.STATES.index(M.BODY)] * 9, M.STATES.index(M.NUMBER)])
    assert model.label([page, b"", page[:1]]) == [want, b"", want[:1]]
    counts = M.count([page, b""], [want, b""])
    assert counts.sum() == 1 + 10 + 11 and M.fit(frame.limit(0)).label([page])


def test_line_model_equals_brute_force():
    import itertools

    import numpy as np
    from lectern.llm import linemodel as M

    model, r = M.LineModel.believed(), random.Random(1)
    for _ in range(5):
        page = [r.randrange(M.CODES) for _ in range(4)]
        score = lambda path: model.start[path[0]] + sum(model.step[a, b] for a, b in zip(path, path[1:])) + sum(model.emit[c, s] for c, s in zip(page, path))  # noqa: E731, B023
        best = max(map(score, itertools.product(range(5), repeat=4)))
        assert np.isclose(score(list(model.label([bytes(page)])[0])), best)
