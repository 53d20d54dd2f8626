import pytest
from hypothesis import given, settings, strategies as st

from lectern.llm import personal as P

CASES = [
    ("Please write to ann_lee+2@mail.example.org before noon.", [("email", "ann_lee+2@mail.example.org")]),
    ("邮箱ann@reader.test东侧小径", [("email", "ann@reader.test")]),
    ("Write to ann [at] mail [dot] example [dot] org now", [("email", "ann [at] mail [dot] example [dot] org")]),
    ("Write to ann(at)mail.example.org now", [("email", "ann(at)mail.example.org")]),
    ("Write to ann @ example.com now", [("email", "ann @ example.com")]),
    ("Write to ann at example dot com now", [("email", "ann at example dot com")]),
    ("mailto:ANN＠EXAMPLE.COM,", [("email", "ANN＠EXAMPLE.COM")]),
    ("See @tidewatch and tide_822@2x.png here", []),
    ("Tel +44 (0)20 7946 0748 · (01632) 960867, 617-555-0152 ext. 33.", [("phone", "+44 (0)20 7946 0748"), ("phone", "(01632) 960867"), ("phone", "617-555-0152 ext. 33")]),
    ("电话是０２０ ７９４６ ０８８７。", [("phone", "０２０ ７９４６ ０８８７")]),
    ("call five five five zero one four two nine eight now", [("phone", "five five five zero one four two nine eight")]),
    ("ISBN 978-0-00-286-114, 808.066-1717/B, 2021-03-12 at 12:05:33, Version 10.2.13.1, Order no. 2021/128-242", []),
    ("number QQ 12 34 56 C; 000-55-1430; 1 94 00 99 000 234 03; 00.008.658-X; L0000HG833", [("identity", x) for x in ("QQ 12 34 56 C", "000-55-1430", "1 94 00 99 000 234 03", "00.008.658-X", "L0000HG833")]),
    ("身份证号992302199805241305已核对", [("identity", "992302199805241305")]),
    ("Send to Flat 7B, 196 Gorsewell Row, Velostad QX13 4QV. Then", [("address", "Flat 7B, 196 Gorsewell Row, Velostad QX13 4QV")]),
    ("an Mühlkampstr. 119b,\n00189 Ithostad. Am Ende", [("address", "Mühlkampstr. 119b,\n00189 Ithostad")]),
    ("au 73 bis quai de la Saline, 00101 Soroveth. Le", [("address", "73 bis quai de la Saline, 00101 Soroveth")]),
    ("a C/ de la Salina n.º 115, 2.º B, 00062 Quoensund.", [("address", "C/ de la Salina n.º 115, 2.º B, 00062 Quoensund")]),
    ("请寄到砚浦市芦花路15号4单元1189室。", [("address", "砚浦市芦花路15号4单元1189室")]),
    ("Dear Ann M. Lee-Roe, hello", [("name", "Ann M. Lee-Roe")]),
    ("The margin is signed “Roe, Ann”.", [("name", "Roe, Ann")]),
    ("Frau ann\nroe ist da. Mr. J. Roe left.", [("name", "ann\nroe"), ("name", "J. Roe")]),
    ("联系人令狐珩芮，逄芮女士来了。此书借给了Ann Roe。", [("name", "令狐珩芮"), ("name", "逄芮"), ("name", "Ann Roe")]),
    ("The unsigned letter was signed by the mill owner. Dear reader, thank you. 一封没有署名的信", []),
    ("", []),
    ("mail john dot smith at example dot co dot uk today", [("email", "john dot smith at example dot co dot uk")]),
    ("mail john dot smith@example dot co dot uk, or a.b punkt c at mail dot example dot org.", [("email", "john dot smith@example dot co dot uk"), ("email", "a.b punkt c at mail dot example dot org")]),
    ("My name is Peter Hansen. Ich heiße Karl Meier. Je m'appelle Paul Durand.", [("name", "Peter Hansen"), ("name", "Karl Meier"), ("name", "Paul Durand")]),
    ("Best regards,\nPeter Hansen", [("name", "Peter Hansen")]),
    ("The author Peter Hansen wrote it. The author of it is known. Peter Hansen is at home.", [("name", "Peter Hansen"), ("name", "Peter Hansen")]),
    ("ref 555123456 in the catalogue, order 0123 456789", []),
    ("The point at issue is the dot at the end. We met at noon.", []),
]


@pytest.mark.parametrize("text,want", CASES)
def test_find(text, want):
    assert [(k, text[a:b]) for a, b, k in P.find(text)] == want


def test_open_chinese_name_needs_given_characters():
    text = "签名：逄芮笙东侧小径在"
    assert [text[a:b] for a, b, _ in P.find(text, frozenset("芮笙"))] == ["逄芮笙"]
    assert [text[a:b] for a, b, _ in P.find("签名：逄芮东侧小径在", frozenset("芮笙"))] == ["逄芮"]


def test_disguises_map_back():
    text = "x​y Аnn＠еxample.com ٣ z"  # invisible character, Cyrillic letters, wide sign
    assert [text[a:b] for a, b, _ in P.find(text)] == ["Аnn＠еxample.com"]
    assert P.masked(text) == "x​y [EMAIL] ٣ z"


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["ann", "@", " at ", "[dot]", "example", ".com", " ", "​", "１２", "5", "-", "(", "é", "漢", "\n", "Dear ", "Lee", "five ", "ﬁ", "＠", "٣"]), max_size=25).map("".join))
def test_rest_is_unchanged(text):
    found = P.find(text)
    traced = P.normalise(text)
    sources = [traced.source(i) for i in range(len(traced.text) + 1)]
    assert sources == sorted(sources) and sources[-1] == len(text)
    assert all(0 <= a < b <= len(text) for a, b, _ in found) and all(x[1] <= y[0] for x, y in zip(found, found[1:]))
    out, rest = P.masked(text), text
    for a, b, k in reversed(found):
        rest = rest[:a] + f"[{k.upper()}]" + rest[b:]
    assert out == rest


def test_frames(spark):
    rows = [(1, "Dear Ann Roe, write to a@b.org", "k"), (1, "Dear Ann Roe, write to a@b.org", "k"), (2, None, "k"), (3, "", "k"), (None, "x" * 300000 + " a@b.org", "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, kind string")
    got = sorted((str(r.doc_id), r.kind, r.found_text) for r in P.pieces(df).collect())
    assert got == [("1", "email", "a@b.org")] * 2 + [("1", "name", "Ann Roe")] * 2 + [("None", "email", "a@b.org")]
    assert [r.text for r in P.mask(df).collect()][:4] == ["Dear [NAME], write to [EMAIL]"] * 2 + [None, ""]
    assert P.pieces(df.limit(0)).collect() == []


def test_masks_leave_no_part_of_a_piece():
    assert P.masked("write to john dot smith at example dot co dot uk today") == "write to [EMAIL] today"
    assert P.masked("Call five five five zero one four two nine eight, or Peter Hansen. My name is Peter Hansen.") == "Call [PHONE], or [NAME]. My name is [NAME]."
