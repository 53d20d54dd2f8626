import itertools
import random

from lectern.llm import lookalike as L

SAME = [("Elephant", "Ｅｌｅｐｈａｎｔ"), ("scope", "ѕсоре"), ("café", "café"), ("a b", "a b"), ("a b", "a b"), ("word", "wo​rd"), ("find", "ﬁnd"), ("difficult", "diﬃcult"), ("一人", "⼀⼈"), ("half-tide", "half‑tide"), ("x", "  x ")]
OTHER = [("cafe", "café"), ("page 12", "page ¹²"), ("end.", "end!"), ("Word", "word"), ("one", "two"), ("rn", "m"), ("0", "o")]


def to_for(texts):
    counts = {}
    for t in texts:
        for c in t or "":
            counts[c] = counts.get(c, 0) + 1
    return L.rules(counts)


def test_forms():
    texts = [x for p in SAME + OTHER for x in p] + ["plain latin text is what occurs most often, é a e i o u " * 3]
    rewrite = L.Rewriter(to_for(texts))
    for a, b in SAME:
        assert rewrite(a) == rewrite(b), (a, b)
    for a, b in OTHER:
        assert rewrite(a) != rewrite(b), (a, b)


def test_classes_are_transitive_and_take_the_most_frequent():
    to = L.rules({"Е": 5, "Ｅ": 2, "E": 1, "Ε": 1})  # Cyrillic, wide, Latin, Greek
    assert to == {"Ｅ": "Е", "E": "Е", "Ε": "Е"}
    rewrite = L.Rewriter(to)
    assert {rewrite(c) for c in "ЕＥEΕ"} == {"Е"}


def test_accent_on_a_look_alike_letter():
    to = to_for(["é e e e", "е́", "ｅ́"])
    assert len({L.Rewriter(to)(t) for t in ["é", "е́", "ｅ́", "é"]}) == 1


def rows(spark, data):
    return spark.createDataFrame(data, "key string, book_id long, page long, text string")


def brute(data, to):
    form = L.Rewriter(to)
    data = sorted(set(r for r in data if None not in r))
    return {tuple(sorted((a[0], b[0]))) for a, b in itertools.combinations(data, 2) if a[1:3] == b[1:3] and a[3] != b[3] and a[0] != b[0] and form(a[3]) == form(b[3])}


def test_pairs_equal_brute_force(spark):
    r = random.Random(3)
    variants = ["word", "ｗord", "wοrd", "wo​rd", "word ", "WORD", "", "​", " "]
    data = [(f"k{i}", r.choice([1, 2, None]), r.choice([0, 1]), r.choice(variants + [None])) for i in range(150)]
    data += data[:20]
    to = to_for([d[3] for d in data])
    got = [tuple(x) for x in L.look_alike_pairs(rows(spark, data).where("text IS NOT NULL"), to).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(data, to)


def test_group_of_copies_pairs_only_with_other_characters(spark):
    data = [(f"k{i:05d}", 1, 1, "the same words") for i in range(20000)] + [("z", 1, 1, "the same words")]
    got = L.look_alike_pairs(rows(spark, data), to_for(["the same words" * 9, " "])).count()
    assert got == 20000


def test_unify_edge_cases(spark):
    df = spark.createDataFrame([("a", None), ("b", ""), ("c", "ａ" * 200000), ("c", "ａ" * 200000)], "form string, text string")
    to = L.rules(L.count_characters(df, ["text"]) | {"a": 10**9})
    got = [r.form for r in L.unify(df, "text", "form", to).collect()]
    assert got == [None, "", "a" * 200000, "a" * 200000]
    assert L.unify(df.limit(0), "text", "form", to).collect() == []
    assert L.count_characters(df.limit(0), ["text"]) == {}


def test_classes_agree_with_pairs(spark):
    rows = [("a:1", 1, 0, "Ａbc"), ("a:2", 1, 0, "Abc"), ("a:3", 1, 0, "Abc "), ("h:1", 1, 1, "Abc"), ("h:2", 1, 0, "abc"), ("o:1", 2, 0, "ᎪᏴ"), ("o:2", 2, 0, "AB"), ("o:2", 2, 0, "AB"), ("o:3", None, 0, "AB")]
    df = spark.createDataFrame(rows, "key string, book_id long, page long, text string")
    to = L.rules(L.count_characters(df, ["text"]))
    classes = {r.key: r["class"] for r in L.look_alike_classes(df, to).collect()}
    pairs = {(r.key_a, r.key_b) for r in L.look_alike_pairs(df, to).collect()}
    assert classes == {"a:1": "a:1", "a:2": "a:1", "a:3": "a:1", "o:1": "o:1", "o:2": "o:1"}
    assert pairs == {("a:1", "a:2"), ("a:1", "a:3"), ("a:2", "a:3"), ("o:1", "o:2")}
    assert L.look_alike_classes(df.limit(0), to).collect() == []


def test_letters_and_their_latin_ones_stand_at_the_same_places():
    assert all(len(others) == len(latin) for others, latin in L.LOOK_ALIKE_LETTERS)
