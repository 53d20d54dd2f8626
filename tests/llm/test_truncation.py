from lectern.llm import truncation as T


def found(spark, texts, role="assistant"):
    df = spark.createDataFrame([(i, t, role) for i, t in enumerate(texts)], "id long, content string, role string")
    return sorted(r.id for r in T.truncated(df).collect())


def test_whole_texts_are_compared(spark):
    texts = ["- the mill\n-", "- the mill\n- a young printer", "See it. https://docs.example.org/ti", "See it. https://docs.example.org/tides", "See it. https://docs.example.org/tides/3167",
             "It is “old: the mill | map", "It is “old: the mill | mapped” now."]
    assert found(spark, texts) == [0, 2, 5]
    assert found(spark, texts[:1] + texts[3:5]) == []
    assert found(spark, ["-", "- the mill\n- a young printer"]) == []


def test_a_blank_or_mark_before_the_letter_does_not_mask_it(spark):
    texts = ["The bookbinder's cat", "The bookbinder's cat - grey", "The bookbinder's cat (old) sat.", "The bookbinder's catalogue is here.", "Die alte Mühle von Un", "Die alte Mühle von Un - dort.", "Die alte Mühle von Undostad war leer."]
    assert {0, 4} <= set(found(spark, texts))


def test_planted_copies_are_found_without_rules_of_the_end(spark):
    import random

    r = random.Random(5)
    subjects, verbs, objects = ["The lamp keeper", "A young printer", "The ferry company", "The canal inspector", "The harbour office"], ["counted", "repaired", "described", "measured", "painted"], ["every lantern on the quay", "the wooden bridge in spring", "the height of the water", "two copies of the map", "the shallow channel"]
    say = lambda: f"{r.choice(subjects)} {r.choice(verbs)} {r.choice(objects)}."
    whole = [" ".join(say() for _ in range(3)) for _ in range(400)]
    cut_off = [(t := r.choice(whole))[: r.randrange(len(t) - 60, len(t) - 8)].rstrip(" .") for _ in range(40)]
    cut_off = [t for t in cut_off if not any(t.endswith(o) for o in objects)]
    titles = ["Old maps of Pelistad", "The Painted Bridge", "tide tables 1896"]
    rows = [(i, t, "assistant", None) for i, t in enumerate(whole + cut_off + titles)]
    got = {x.id: x.evidence for x in T.judgements(spark.createDataFrame(rows, "id long, content string, role string, action_type string")).collect()}
    assert set(got) == set(range(len(whole), len(whole) + len(cut_off)))
    assert {*got.values()} <= {"copy", "fragment", "goes_on"}


def test_evidence_equals_brute_force(spark):
    import random

    from lectern.llm import continuation as C

    r = random.Random(6)
    words = ["mill", "mills", "road", "roads", "salt", "quay", "桥", "旧"]
    texts = list(dict.fromkeys(" ".join(r.choice(words) + r.choice(["", "", "", ","]) for _ in range(r.randrange(1, 9))) + r.choice(["", ".", "\n7"]) for _ in range(200)))
    ends = [(i, i, *C.end_of(t)) for i, t in enumerate(texts) if C.end_of(t)]
    got = {x.id: x for x in C.evidence(spark.createDataFrame([(t,) for t in texts], "text string"), spark.createDataFrame(ends, "id long, text_hash long, contexts array<long>, word string"), lambda t: t).collect()}
    laid = [["^"] * 3 + C.tokens(t) for t in texts]
    alone = [(x[i + 1][0].isalnum(), 1) for x in laid for i in range(3, len(x) - 1) if x[i][0].isalnum()]
    for i, *_ in ends:
        closing, fragment, seen = sum(not on for on, _ in alone) / len(alone), False, False
        for k in range(4):
            context, word = laid[i][len(laid[i]) - 1 - k : -1], laid[i][-1]
            on = closed = longer = 0
            for j, x in enumerate(laid):
                for at in range(3, len(x)):
                    if x[at - k : at] != context or not x[at][0].isalnum():
                        continue
                    if at == len(x) - 1:
                        closed += j != i and x[at] == word
                    elif x[at] == word:
                        on, closed = on + x[at + 1][0].isalnum(), closed + (not x[at + 1][0].isalnum())
                    elif x[at].startswith(word) and x[at][len(word)].isalpha():
                        longer += 1
            if on + closed:
                closing, seen = (closed + C.WEIGHT * closing) / (on + closed + C.WEIGHT), True
            if on + closed + longer:
                fragment = longer > C.FRAGMENT * (on + closed)
        assert abs(got[i].closing - closing) < 1e-9 and got[i].fragment == fragment and got[i].seen == seen, texts[i]


def test_length_limits(spark):
    rows = [(i, "x" * (20 + i % 60), "Chat ") for i in range(600)] + [(1000 + i, "y" * 50, "chat") for i in range(60)] + [(2000, None, "chat"), (2001, " ", None)]
    df = spark.createDataFrame(rows, "id long, content string, action_type string")
    got = [tuple(x) for x in T.length_limits(df).collect()]
    assert got == [("chat", 50, 70, 10.0)]
    assert T.length_limits(df.limit(0)).collect() == [] and T.whole_prefixes(df.limit(0)).collect() == []
    assert [x.id for x in T.whole_prefixes(spark.createDataFrame([(1, "the mill"), (2, "the mill is old"), (1, "the mill"), (3, "the mill!"), (None, "the")], "id long, content string")).collect()] == [1]
