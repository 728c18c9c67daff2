import random
from collections import deque

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandworks.operators import entities as E
from strandworks.operators import graph as G
from strandworks.operators import merge as M
from strandworks.operators import sampling as S


def graph(seed, n=25, m=30):
    r = random.Random(seed)
    return [(f"N{r.randrange(n)}", f"n{r.randrange(n)} ") for _ in range(m)] + [(None, "x"), ("", "y"), ("q", "Q")]


def test_hops(spark):
    for seed in (1, 2):
        pairs = graph(seed)
        near = {}
        for a, b in pairs:
            a, b = (a or "").strip().lower(), b.strip().lower()
            if a and b and a != b:
                near.setdefault(a, set()).add(b)
                near.setdefault(b, set()).add(a)
        want = dict.fromkeys(near)
        queue = deque()
        for s in ("n1", "n2"):
            if s in want:
                want[s] = 0
                queue.append(s)
        while queue:
            x = queue.popleft()
            for y in near[x]:
                if want[y] is None:
                    want[y] = want[x] + 1
                    queue.append(y)
        df = spark.createDataFrame(pairs, "source string, target string")
        seeds = spark.createDataFrame([("N1",), (" n2",), ("absent",)], "s string")
        assert {r.node: r.hop_distance for r in G.hop_distances(df, seeds, "s").collect()} == want
        hops = G.triple_hops(df, G.hop_distances(df, seeds, "s")).collect()
        assert len(hops) == len(pairs)
    none = G.hop_distances(df, seeds.limit(0), "s").collect()
    assert none and all(r.hop_distance is None for r in none)


def test_paths_against_search(spark):
    r = random.Random(3)
    triples = sorted({(f"n{r.randrange(9)}", r.choice(["a", "stores"]), f"n{r.randrange(9)}") for _ in range(40)})
    triples = [t for t in triples if t[0] != t[2]]
    df = spark.createDataFrame(triples, "source string, relation string, target string")
    hubs = {"n1"}
    out = {}
    for s, rel, t in triples:
        out.setdefault(s, []).append((rel, t))

    def walk(path, rels, used):
        if len(rels) == 3:
            yield tuple(path), tuple(rels)
            return
        for rel, t in out.get(path[-1], []):
            cost = used + (rel == "stores") + (t in hubs)
            if cost <= 1 and t not in path and not (rels and t in {x for _, x in out.get(path[0], [])}):
                yield from walk([*path, t], [*rels, rel], cost)

    starts = ["n0", "n1", "n2"]
    want = sorted(x for s in starts for x in walk([s], [], int(s in hubs)))
    got = G.k_hop_paths(df, spark.createDataFrame([(s,) for s in starts], "s string"), 3, "stores", spark.createDataFrame([(h,) for h in hubs], "h string")).collect()
    assert sorted((tuple([p.steps[0].start, *[s.end for s in p.steps]]), tuple(s.relation for s in p.steps)) for p in got) == want


def test_sampled_paths(spark):
    """One valid path for every start that has any, also where the beam loses all of a start's paths."""
    r = random.Random(11)
    triples = sorted({(f"n{r.randrange(12)}", "a", f"n{r.randrange(12)}") for _ in range(40)})
    df = spark.createDataFrame([t for t in triples if t[0] != t[2]], "source string, relation string, target string")
    starts, hubs = spark.createDataFrame([(f"n{i}",) for i in range(12)], "s string"), spark.createDataFrame([("n1",)], "h string")
    every = {}
    for p in G.k_hop_paths(df, starts, 3, "stores", hubs).collect():
        every.setdefault(p.start, set()).add(tuple(s.end for s in p.steps))
    for beam in (1, 16):
        got = {p.start: tuple(s.end for s in p.steps) for p in G.sampled_paths(df, starts, 3, "stores", hubs, beam).collect()}
        assert set(got) == set(every) and all(got[s] in every[s] for s in got)


def test_draws_and_subsets(spark):
    df = spark.range(10).select(F.col("id").alias("k"))
    rows = S.requeued(df, "k", 5).orderBy("attempt").collect()
    assert [r.attempt for r in rows] == list(range(25)) and [sorted(r.k for r in rows[a : a + 10]) for a in (0, 10)] == [list(range(10))] * 2
    assert S.requeued(df.limit(0), "k", 5).count() == 0
    assert sorted(r.k for r in S.first_rows(df, "k", 3).collect()) == [0, 1, 2] and sorted(r.k for r in S.last_rows(df, "k", 3).collect()) == [7, 8, 9] and S.first_rows(df, "k", 0).count() == 10
    lines = spark.createDataFrame([(0, "a"), (1, "b")], "n int, w string")
    over = spark.createDataFrame([("b", 5), ("z", 2)], "w string, f int")
    assert sorted(map(str, G.source_vocabulary(lines, "n", "w", over).collect())) == sorted(map(str, [*G.source_vocabulary(lines.limit(1), "n", "w").collect(), *spark.createDataFrame([(1, "b", 5), (None, "z", 2)], "id bigint, name string, frequency bigint").collect()]))
    edges = spark.createDataFrame([("x", "y", 3)], "a string, b string, w int")
    paths = spark.createDataFrame([(1, ["x", "y", "q"]), (2, ["x"])], "id int, n array<string>")
    assert sorted(map(tuple, G.path_edges(paths, "id", "n", edges, "a", "b").collect()), key=str) == [(1, 0, "x", "y", 3), (1, 1, "y", "q", None)]


def test_matrices():
    m = np.zeros((5, 5), int)
    for a, b in ((0, 1), (1, 2), (2, 3)):
        m[a, b] = m[b, a] = 1
    d, before = G.shortest_matrix(m)
    assert d[0, 3] == 3 and d[0, 4] == G.UNREACHABLE and d[2, 2] == 0
    assert G.walk_back(before, 0, 3) == [0, 1, 2, 3] and G.walk_back(before, 0, 4) == [] and G.walk_back(before, 1, 1) == [1]
    assert G.lattice(2, 2) == [(0, 1), (0, 2), (0, 3), (1, 4), (1, 5)]
    assert list(G.batches(iter(range(5)), 2)) == [[0, 1], [2, 3], [4]]


ROWS = [(1, "NMDA-receptors", "Axon", "feeds", 1.0, 2.0, "u2,u1"), (2, "nmda receptor", "axons", "Feeds", 5.0, None, "u3"), (3, "nmda_receptor", "axon", "feeds", 4.0, 2.0, "u1"), (4, "a", "a", "feeds", 1.0, 1.0, ""), (5, None, "b", "x", float("nan"), float("nan"), None), (6, "c", "b", None, None, None, None), (7, "c", "b", "x y", None, None, "z")]


def test_collapse(spark):
    df = spark.createDataFrame(ROWS, "n bigint, source string, target string, relation string, weight double, combined_degree double, text_unit_ids string")
    t = M.coerce_triples(df, "n")
    assert t.filter("weight = 1.0").count() == 5 and t.count() == 7
    c = {(r.source, r.target): r for r in M.fast_collapse(M.valid_triples(t)).collect()}
    assert set(c) == {("nmda_receptor", "axon"), ("c", "b")}
    assert M.valid_triples(M.coerce_triples(spark.createDataFrame([(1, " Axon", "axon", "feeds")], "n bigint, source string, target string, relation string"), "n")).count() == 0
    r = c["nmda_receptor", "axon"]
    assert (r.weight, r.combined_degree, r.text_unit_ids, r.n_rows) == (5.0, 2.0, ["u1", "u2", "u3"], 3) and c["c", "b"].weight == 1.0
    again = M.fast_collapse(M.fast_collapse(M.valid_triples(t)).drop("n_rows"))
    assert sorted((x.source, x.target, x.weight) for x in again.collect()) == sorted((x.source, x.target, x.weight) for x in c.values())
    assert M.fast_collapse(t.limit(0)).count() == 0
    merged = M.merge_graphs(df, df.limit(3), "n", least=1)
    assert merged.count() == 2


def greedy(names, threshold):
    """The rule in plain words: one map, in which a shorter name takes over the representative and all that point at it."""
    from difflib import SequenceMatcher
    import re

    def key(x):
        words = re.sub(r"\s+", " ", re.sub(r"[^\w\s]+", " ", re.sub("[_-]", " ", x.lower()))).strip().split(" ")
        if len(words[-1]) > 3 and words[-1].endswith("s") and not words[-1].endswith("ss"):
            words[-1] = words[-1][:-1]
        return " ".join(words)

    reps, canon = {}, {}
    for e in sorted(set(names)):
        k = key(e)
        mine = reps.setdefault((k[:3], len(k) // 5), [])
        for rep in mine:
            r = key(rep)
            if r and k and abs(len(k) - len(r)) / max(len(k), len(r)) > 0.25:
                continue
            if SequenceMatcher(None, k, r).ratio() >= threshold:
                chosen, other = (rep, e) if len(rep) <= len(e) else (e, rep)
                canon[e] = canon[other] = chosen
                for x in canon:
                    if canon[x] == other:
                        canon[x] = chosen
                break
        else:
            mine.append(e)
            canon[e] = e
    return canon


def test_canonical_names(spark):
    r = random.Random(5)
    base = ["hippocampal formation", "hippocampus", "dentate gyrus", "dentate-gyrus", "!!", "??", "tide", "diet", "abcd", "abcds", "granule cell layers", "granule cell layer"]
    names = [b[:i] + r.choice("abc") + b[i + r.randrange(2) :] for b in base for i in range(len(b)) for _ in range(3)] + base
    df = spark.createDataFrame([(n,) for n in names] + [(None,)], "n string")
    for threshold in (0.9, 0.8):
        want = greedy(names, threshold)
        assert {x.name: x.canonical for x in M.canonical_names(df, threshold).collect()} == want
        closed = {x.name: x.canonical for x in M.canonical_names(df, threshold, closed=True).collect()}
        assert set(closed) == set(want) and all(closed[c] == c for c in closed.values())
    assert want["abcds"] == "abcd"


def test_collapse_orders(spark):
    """Equals of the second collapse are ranked by the first one's place, not by the input."""
    rows = [(1, "dentate gyrus a", "x", "feeds", 1.0, 1.0, "u1"), (2, "dentate gyrus b", "x", "feeds", 1.0, 5.0, "u2"), (3, "dentate gyrus b", "y", "feeds", 2.0, 5.0, "u3")]
    df = spark.createDataFrame(rows, "n bigint, source string, target string, relation string, weight double, combined_degree double, text_unit_ids string")
    t = M.numbered(M.merge_graphs(df, None, "n", least=1), ["place"])
    assert [(r.source, r.target, r.text_unit_ids) for r in t.orderBy("human_readable_id").collect()] == [("dentate gyrus a", "y", "u3"), ("dentate gyrus a", "x", "u1,u2")]
    assert M.removed_relations(df, 3).count() == 0 and [(r.relation, r.pairs) for r in M.removed_relations(df, 4).collect()] == [("feeds", 3)]


def test_small_operators(spark):
    df = spark.createDataFrame([("b", 2), ("a", 1), ("c", 3)], "k string, v int")
    assert [(r.k, r.human_readable_id) for r in M.numbered(df, ["k"]).orderBy("k").collect()] == [("a", 0), ("b", 1), ("c", 2)]
    t = spark.createDataFrame([("a", "b"), ("a", "b"), ("b", "a"), ("a", "c")], "source string, target string")
    assert {r.title: r.degree for r in M.degrees(t).collect()} == {"a": 3, "b": 2, "c": 1}
    e = spark.createDataFrame([("x", "t1", "d1", ["u2"], 2), ("x", None, "", None, 1), ("x", "t2", "d2", ["u1"], 3)], "title string, type string, description string, text_unit_ids array<string>, n int")
    r = E.merge_entities(e, "n").first()
    assert (r.descriptions, r.text_unit_ids, r.type) == (["d1", "d2"], ["u1", "u2"], "t1")
    rows = spark.range(100).withColumn("g", F.col("id") % 3).withColumn("f", F.lit(1.0))
    assert S.per_group(rows, "g", "id", 2).count() == 6 and S.sample_rows(rows, "id", 7).count() == 7 and S.weighted_sample(rows, "id", "f", 5).count() == 5
    assert S.head_holdout(rows, "id", 0.02, 200).filter("is_eval").count() == 2 and S.tail_holdout(rows, "id", 5).filter("is_eval").agg(F.min("id")).first()[0] == 95
    assert S.percent_split(rows, "id", 10).filter("is_validation").count() == 10
    split = S.random_split(rows, "id", 0.3).filter("is_test").count()
    assert 15 < split < 45 and S.random_split(rows.repartition(7), "id", 0.3).filter("is_test").count() == split
    names = spark.createDataFrame([("checkpoint-20",), ("checkpoint-100",), ("x",)], "m string").select(S.checkpoint_step(F.col("m")).alias("s"))
    assert sorted((r.s for r in names.collect()), key=lambda x: (x is None, x)) == [20, 100, None]
    a, b = spark.createDataFrame([(0, "a0"), (1, "a1")], "n int, x string"), spark.createDataFrame([(0, "b0")], "n int, x string")
    assert [r.x for r in S.interleave([a, b], "n").collect()] == ["a0", "b0", "a1"]


def test_hop_search_is_not_cut_off(spark):
    df = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(4)], "source string, target string")
    seeds = spark.createDataFrame([("n0",)], "s string")
    assert {r.node: r.hop_distance for r in G.hop_distances(df, seeds, "s", 4).collect()} == {f"n{i}": i for i in range(5)}
    with pytest.raises(ValueError):
        G.hop_distances(df, seeds, "s", 3)
