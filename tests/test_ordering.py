import random

from lectern.ordering import fill_forward, rank_in_groups, with_neighbour


def data(n=400, seed=1):
    r = random.Random(seed)
    return [(r.choice(["hot", "hot", "a", "b", None]), r.randint(0, 50), i) for i in range(n)]


def test_ranks(spark):
    rows = data()
    df = spark.createDataFrame(rows, "g string, t int, id int")
    got = {(r.g, r.id): r["rank"] for r in rank_in_groups(df, ["g"], ["t", "id"]).collect()}
    assert len(got) == len(rows)
    for g in {r[0] for r in rows}:
        for k, (_, i) in enumerate(sorted((t, i) for h, t, i in rows if h == g)):
            assert got[(g, i)] == k


def test_neighbours(spark):
    rows = [r for r in data(seed=2) if r[0]]
    df = spark.createDataFrame(rows, "g string, t int, id int")
    order = sorted(rows)
    for before in (True, False):
        name = ("prev_" if before else "next_") + "id"
        got = {r.id: r[name] for r in with_neighbour(df, ["g", "t", "id"], ["id"], before).collect()}
        ids = [r[2] for r in order]
        want = dict(zip(ids, [None, *ids[:-1]] if before else [*ids[1:], None]))
        assert got == want


def test_empty(spark):
    df = spark.createDataFrame([], "g string, t int, id int")
    assert rank_in_groups(df, ["g"], ["t", "id"]).collect() == []
    assert with_neighbour(df, ["g", "t"], ["id"], True).collect() == []
    assert fill_forward(df, "g", ["g", "t", "id"], "t", "last").collect() == []


def test_fill_forward(spark):
    r = random.Random(7)
    rows = [(g, i, r.randint(0, 9) if r.random() < 0.03 else None) for i, g in enumerate(["hot"] * 300 + ["a", "b"] * 20)]
    got = {(x.g, x.id): x["last"] for x in fill_forward(spark.createDataFrame(rows, "g string, id int, v int"), "g", ["g", "id"], "v", "last").collect()}
    last = {}
    for g, i, v in sorted(rows, key=lambda x: (x[0], x[1])):
        if v is not None:
            last[g] = v
        assert got[(g, i)] == last.get(g)
