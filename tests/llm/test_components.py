import random

from strandworks.llm.components import connected_groups


def brute(pairs):
    parent = {}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a is None or b is None or a == b:
            continue
        parent.setdefault(a, a)
        parent.setdefault(b, b)
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    return sorted((x, find(x)) for x in parent)


def check(spark, pairs):
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "c int, p string, q string")
    assert sorted(map(tuple, connected_groups(df, "p", "q").collect())) == brute(pairs)


def test_chain_and_star(spark):
    chain = [(f"n{i:03d}", f"n{i + 1:03d}") for i in range(40)]
    shuffled = [f"s{i:03d}" for i in range(30)]
    random.Random(1).shuffle(shuffled)
    star = [("hub", f"x{i}") for i in range(60)]
    check(spark, chain + list(zip(shuffled, shuffled[1:])) + star + [(b, a) for a, b in chain[:5]] + [(None, "z"), ("z", None), ("y", "y"), ("é", "z"), ("\U0001f600", "￮")])


def test_random(spark):
    r = random.Random(7)
    check(spark, [(f"v{r.randrange(90)}", f"v{r.randrange(90)}") for _ in range(70)])


def test_empty(spark):
    assert connected_groups(spark.createDataFrame([], "a string, b string"), "a", "b").count() == 0


def test_above_the_broadcast_bound(spark, monkeypatch):
    """Without any broadcast of maps the groups are the same, also with a hub."""
    from strandworks import runtime
    from strandworks.llm import components

    for module in (runtime, components):
        monkeypatch.setattr(module, "fits_broadcast", lambda df: False)
    r = random.Random(12)
    check(spark, [(f"n{r.randrange(60):02d}", f"n{r.randrange(60):02d}") for _ in range(45)] + [("hub", f"h{i}") for i in range(80)])
