import base64
import os
import random

import pytest
from hypothesis import given, settings, strategies as st

from lectern.llm import packing, tokens

FOLDER = os.environ.get("TOKENIZER_DIR", tokens.TOKENIZER_DIR)


@pytest.fixture(scope="module")
def plain():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(f"{FOLDER}/byte_bpe_50k.tiktoken", "rb"))}
    return tiktoken.Encoding("own", pat_str=tokens.WORD_PATTERN, mergeable_ranks=ranks, special_tokens={})


TEXTS = ["", None, "   ", "aaaaaaaaa aaaa", "<|endoftext|>", "Höhe über 漪堤渡 ​\n\n x", "it's 1234567 ..!", "ab" * 3000, "hello hello hello"]


def test_encode_equals_plain_bpe(spark, plain):
    rows = [(i, t, "clash") for i, t in enumerate(TEXTS)] + [(None, "hello", "x"), (0, "", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = tokens.encode(df, folder=FOLDER).collect()
    assert sorted((str(r.doc_id), r.ids) for r in got) == sorted((str(i), plain.encode_ordinary(t or "")) for i, t, _ in rows)
    assert tokens.encode(df.limit(0), folder=FOLDER).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="abc é漢\n1'st", max_size=30), max_size=8))
def test_blocks_equal_plain_bpe(plain, texts):
    coder = tokens.BlockEncoder(FOLDER, tokens.TOKENIZER)
    for _ in range(2):  # the second time all words are known
        ids, sizes = coder.encode(texts)
        assert ids.tolist() == [x for t in texts for x in plain.encode_ordinary(t)]
        assert sizes.tolist() == [len(plain.encode_ordinary(t)) for t in texts]


def expand(patterns):
    return [s for p, n in patterns for s, k in p.items() for _ in range(k * n)]


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 9), max_size=12))
def test_plan_holds_every_item_once(counts):
    patterns = packing.plan(counts, 40)
    assert sorted(expand(patterns)) == sorted(s for s, n in counts.items() for _ in range(n))
    assert all(sum(s * k for s, k in p.items()) <= 40 for p, _ in patterns)
    # first fit in any order uses at most twice the least possible, and so must this
    assert sum(n for _, n in patterns) <= 2 * -(-sum(s * n for s, n in counts.items()) // 40)


def best_fit_one_by_one(items, capacity):
    bins = []
    for s in sorted(items, reverse=True):
        fit = [b for b in bins if capacity - sum(b) >= s]
        if fit:
            min(fit, key=lambda b: capacity - sum(b)).append(s)
        else:
            bins.append([s])
    return bins


def test_best_fit_equals_placing_one_by_one():
    r = random.Random(4)
    for _ in range(200):
        counts = {r.randint(1, 60): r.randint(1, 12) for _ in range(r.randint(0, 12))}
        ours = packing.best_fit(counts, 60)
        items = [s for s, n in counts.items() for _ in range(n)]
        assert sorted(expand(ours)) == sorted(items)
        assert sum(n for _, n in ours) == len(best_fit_one_by_one(items, 60))


def optimum(items, capacity):
    items, best = sorted(items, reverse=True), [len(items)]

    def go(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(items):
            best[0] = len(rooms)
            return
        for room in sorted({x for x in rooms if x >= items[i]}):
            k = rooms.index(room)
            go(i + 1, rooms[:k] + [room - items[i]] + rooms[k + 1 :])
        go(i + 1, rooms + [capacity - items[i]])

    go(0, [])
    return best[0]


def test_reduction_loses_no_optimum():
    r = random.Random(9)
    for _ in range(150):
        items = [r.randint(3, 20) for _ in range(r.randint(1, 8))]
        counts = {s: items.count(s) for s in items}
        fixed, rest = packing.reduce_by_dominance(counts, 20)
        assert sum(n for _, n in fixed) + optimum([s for s, n in rest.items() for _ in range(n)], 20) == optimum(items, 20)


def test_pack_edge_cases(spark):
    rows = [(1, 0), (2, None), (3, 2048), (4, 5000), (5, 1000), (5, 1000), (None, 48), (7, 4096)]
    df = spark.createDataFrame([(i, n, 7) for i, n in rows], "doc_id long, n_tokens long, container int")
    got = packing.pack(df).collect()
    used = {}
    for r in got:
        used[r.container] = used.get(r.container, 0) + r.n_tokens
    assert max(used.values()) <= 2048
    assert sorted((str(r.doc_id), r.part, r.n_tokens) for r in got) == sorted(
        [("1", 0, 0), ("2", 0, 0), ("3", 0, 2048), ("4", 0, 2048), ("4", 1, 2048), ("4", 2, 904), ("5", 0, 1000), ("5", 0, 1000), ("None", 0, 48), ("7", 0, 2048), ("7", 1, 2048)]
    )
    assert packing.pack(df.limit(0)).collect() == []


def test_pack_skewed_size(spark):
    df = spark.range(3000).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN 700 ELSE 1 + id % 2048 END AS n_tokens")
    got = packing.pack(df).toPandas()
    sums = got.groupby("container").n_tokens.sum()
    assert len(got) == 3000 and sums.max() <= 2048
    counts = got.n_tokens.value_counts().to_dict()
    assert len(sums) <= sum(n for _, n in packing.best_fit(counts, 2048))
