from datetime import datetime

import pytest
from pyspark.sql import functions as F

from strandworks.llm.representative import Preference, latent_truth, survivors, true_values, usable_number
from strandworks.llm.structural import canonical_triples, collapse_copies, copies_of, nested_records


def test_copies(spark):
    rows = [(1, "A b", "feeds", "C"), (2, "a-B!", "Feeds.", "c"), (3, "c", "feeds", "ab"), (4, "é1", "touches", "x"), (5, "X", "TOUCHES", "é 1"), (6, "e1", "touches", "x"), (7, None, "feeds", "c"), (8, "a", "", "c"), (9, "ab", "feeds", "..."), (2, "a-B!", "Feeds.", "c"), (10, "z" * 9000, "feeds", "y"), (11, "Z" * 9000, "f-e-e-d-s", "y")]
    df = spark.createDataFrame(rows, "h bigint, source string, relation string, target string").withColumn("root", F.lit(1)).withColumn("a", F.lit(2))
    free = spark.createDataFrame([("Touches",), (None,)], "n string")
    c = canonical_triples(df, "h", "source", "relation", "target", free)
    assert sorted(map(tuple, copies_of(c).collect())) == [(1, 2), (1, 2), (4, 5), (10, 11)]
    assert sorted((r.first_row, r.n_copies) for r in collapse_copies(c).collect()) == [(1, 3), (3, 1), (4, 2), (6, 1), (10, 2)]
    assert copies_of(canonical_triples(df.limit(0), "h", "source", "relation", "target", free)).count() == 0
    directed = copies_of(canonical_triples(df, "h", "source", "relation", "target")).collect()
    assert sorted((r.first_row, r.copy_row) for r in directed) == [(1, 2), (1, 2), (10, 11)]


def test_hot_group(spark):
    df = spark.range(6000).select(F.col("id").alias("h"), F.when(F.col("id") % 2 == 0, "Hot One").otherwise(F.concat(F.lit("n"), "id")).alias("s"), F.lit("r").alias("r"), F.lit("t").alias("t"))
    got = copies_of(canonical_triples(df, "h", "s", "r", "t"))
    assert got.count() == 2999 and got.select("first_row").distinct().collect()[0][0] == 0


def test_nested_records(spark):
    kind = "h bigint, r struct<b:string,a:array<struct<y:string,x:int>>,m:map<string,string>>, x int"
    step = lambda *p: [(y, x) for y, x in p]
    rows = [(1, ("A b", step(("u", 1), ("v", 2)), {"k": "1", "l": "2"}), 0), (2, ("a-B", step(("U!", 1), ("v ", 2)), {"l": "2.", "k": "1"}), 0), (3, ("ab", step(("v", 2), ("u", 1)), {"k": "1", "l": "2"}), 0), (4, ("ab", step(("u", 1)), {"k": "1", "l": "2"}), 0), (5, None, 0), (6, ("..", [], {}), 0), (7, (None, None, None), 0), (8, ("ab", step(("u", 1), ("v", 2)), {"k": "2", "l": "1"}), 0)]
    df = spark.createDataFrame(rows, kind)
    assert sorted(map(tuple, copies_of(nested_records(df, "h", "r")).collect())) == [(1, 2)]
    assert sorted(map(tuple, copies_of(nested_records(df, "h", "r", ("a",))).collect())) == [(1, 2), (1, 3)]
    assert nested_records(df, "h", "r").count() == 5 and copies_of(nested_records(df.limit(0), "h", "r")).count() == 0


def test_survivors(spark):
    day = lambda d: datetime(2024, 1, d)
    nan, inf = float("nan"), float("inf")
    rows = [("a", 1, 1.0, 2, day(1)), ("a", 2, nan, 1, day(9)), ("a", 3, 5.0, None, day(3)), ("a", 4, 6.0, 3, day(3)), ("b", 5, -1.0, 1, day(1)), ("b", 6, inf, 1, day(2)), ("c", 7, 1.0, 1, day(1)), (None, 8, 1.0, 1, day(1)), (None, 9, 2.0, 1, day(1))]
    df = spark.createDataFrame(rows, "id string, h bigint, w double, trust int, at timestamp").withColumn("_n", F.lit(0))
    got = {r.id: (r.recent, r.trusted) for r in survivors(df, "id", "h", [Preference("recent", usable_number("w"), F.col("at")), Preference("trusted", usable_number("w"), -F.coalesce("trust", F.lit(99)))]).collect()}
    assert got == {"a": (3, 1), "b": (0, 0), None: (8, 8)}
    assert survivors(df.limit(0), "id", "h", [Preference("w", usable_number("w"), F.col("w"))]).count() == 0


def test_latent_truth(spark):
    import random

    r = random.Random(4)
    claims, truths = set(), {}
    for g in range(300):
        good = {f"g{g}t{i}" for i in range(3)}
        truths[g] = good
        for s, (sens, lies) in {"fine": (0.95, 0.02), "fair": (0.8, 0.05), "lazy": (0.3, 0.01), "liar": (0.7, 0.6)}.items():
            for v in good:
                if r.random() < sens:
                    claims.add((str(g), "units", s, v))
            for i in range(3):
                if r.random() < lies:
                    claims.add((str(g), "units", s, f"g{g}f{i}{s if s == 'liar' else ''}"))
    df = spark.createDataFrame(sorted(claims), "grp string, field string, source string, value string")
    truth, quality = latent_truth(df)
    q = {x.source: x for x in quality.collect()}
    assert q["fine"].sensitivity > q["fair"].sensitivity > q["lazy"].sensitivity and q["liar"].specificity < min(q[s].specificity for s in ("fine", "fair", "lazy"))
    kept = {int(x.grp): set(x["values"]) for x in true_values(truth, ["units"]).collect()}
    hits = sum(len(kept.get(g, set()) & t) for g, t in truths.items())
    assert hits / sum(map(len, truths.values())) > 0.85 and hits / sum(map(len, kept.values())) > 0.9
    single = true_values(truth, []).collect()
    assert all(len(x["values"]) == 1 for x in single)
    empty, none = latent_truth(df.limit(0))
    assert empty.count() == 0 and none.count() == 0


def test_ties_of_single_values(spark):
    rows = [("a", "w", "9.5", ["s1"], 0.5), ("a", "w", "10.2", ["s2"], 0.5), ("b", "w", "9.5", ["s1"], 0.5), ("b", "w", "10.2", ["s1"], 0.5), ("c", "w", "1", ["s2", "x"], 0.5), ("c", "w", "2", ["x"], 0.5), ("d", "w", "b", ["x"], 0.7), ("d", "w", "c", ["s1"], 0.6)]
    truth = spark.createDataFrame(rows, "grp string, field string, value string, stating array<string>, truth double")
    trust = spark.createDataFrame([("s1", 1), ("s2", 2)], "source string, rank int")
    assert {r.grp: r["values"] for r in true_values(truth, [], trust=trust).collect()} == {"a": ["9.5"], "b": ["10.2"], "c": ["1"], "d": ["b"]}
    assert {r.grp: r["values"] for r in true_values(truth, []).collect()} == {"a": ["10.2"], "b": ["10.2"], "c": ["1"], "d": ["b"]}


def test_quality_is_bounded(spark):
    df = spark.createDataFrame([("g", "f", f"s{i}", "v") for i in range(5)], "grp string, field string, source string, value string")
    with pytest.raises(ValueError):
        latent_truth(df, max_sources=3)


def test_truth_is_iterated_to_the_end(spark):
    """Weakly separated sources: eight plain steps stop far from where one more step changes nothing."""
    import random
    from collections import Counter

    r = random.Random(3)
    claims = {(f"g{g}", "units", f"s{s}", f"v{v}") for g in range(150) for v in range(4) for s in range(4) if r.random() < (0.5 + 0.1 * s if v < 2 else 0.3)}
    df = spark.createDataFrame(sorted(claims), "grp string, field string, source string, value string")
    cover, stating = {}, {}
    for g, _, s, v in claims:
        cover.setdefault(g, set()).add(s)
        stating.setdefault((g, v), set()).add(s)
    facts = Counter((frozenset(x), frozenset(cover[g] - x)) for (g, _), x in stating.items() if len(cover[g]) > 1)
    for options, tolerance in (({}, 1e-9), ({"driver_entries": 0, "tolerance": 1e-2}, 1e-2)):  # on the driver, over the table
        q = {x.source: (x.sensitivity, x.specificity) for x in latent_truth(df, **options)[1].collect()}
        sums = {s: [5.0, 7.0, 18.0, 20.0] for s in q}
        for (said, silent), n in facts.items():
            one = zero = 1.0
            for s in said:
                one, zero = one * q[s][0], zero * (1 - q[s][1])
            for s in silent:
                one, zero = one * (1 - q[s][0]), zero * q[s][1]
            t = n * one / (one + zero)
            for s in said | silent:
                sums[s] = [x + y for x, y in zip(sums[s], (t * (s in said), t, (n - t) * (s in silent), n - t))]
        assert max(max(abs(a / b - q[s][0]), abs(c / d - q[s][1])) for s, (a, b, c, d) in sums.items()) < tolerance
    with pytest.raises(RuntimeError):
        latent_truth(df, max_rounds=8)
