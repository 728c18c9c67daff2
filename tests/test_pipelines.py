import random
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from strandworks import pipelines as P
from strandworks.operators import merge as M


def test_extraction_to_curriculum(spark):
    reply = '("entity"<|>Axon<|>cell<|>d)##("entity"<|>Soma<|>part<|>e)##("relationship"<|>Axon<|>Soma<|>Feeds<|>2)'
    df = spark.createDataFrame([(1, reply), (2, reply)], "id int, r string")
    nodes, edges = P.extract_graph(df, "id", "r", P.Extraction(types=("CELL",)))
    assert [r.title for r in nodes.collect()] == ["axon"] and [(r.source, r.target, r.weight, r.relations) for r in edges.collect()] == [("axon", "soma", 4.0, ["feeds"])]
    rows = [(i, f"n{i}", "feeds", f"n{i + 1}") for i in range(6)]
    triples = spark.createDataFrame(rows, "n bigint, source string, relation string, target string")
    merged = P.merge_runs(triples, None, "n", P.Extraction(least_pairs=1, threshold=None))
    assert sorted(r.human_readable_id for r in merged.collect()) == list(range(6))
    paths = P.curriculum(triples, triples.select("source"), P.Curriculum(hub_share=0.0)).collect()
    assert sorted((r.start, r.k_hops) for r in paths if r.start == "n0") == [("n0", 2), ("n0", 3)] and len(paths) == len({r.signature for r in paths})
    chunks = P.text_chunks(spark.createDataFrame([(1, "w " * 3000)], "id int, t string"), "id", "t", P.LONG_CHUNKS)
    assert [r.n_words for r in chunks.orderBy("ordinal").collect()] == [2000, 1100]
    entities, units = spark.createDataFrame([("N1",), ("n2",)], "title string"), spark.createDataFrame([("u", "the n1 meets the n2")], "id string, text string")
    vocabulary = spark.createDataFrame([("feeds", 3)], "relation string, relation_id int")
    assert [(r.snippet_id, r.relation_id, r.head_pos) for r in P.ground_graph(triples, entities, units, vocabulary).collect()] == [("u", 3, 1)]


def test_evaluation_tables(spark):
    v = spark.createDataFrame([(1, 1, "checkpoint-1", "no"), (1, 1, "checkpoint-2", "yes")], "item_id int, k_hops int, model string, verdict string")
    from strandworks.operators.sampling import checkpoint_step

    tables = P.evaluate(v, checkpoint_step(F.col("model")))
    assert tables["gains"]().filter("all_hops = 1").first().gains == 1 and all(t().columns for t in tables.values())


def plain_merge(rows, threshold, least):
    """The merge in plain Python: rows are (source, target, relation, weight, degree or None, ids)."""
    import re

    def key(x):
        w = re.sub(r"\s+", " ", re.sub(r"[^\w\s]+", " ", re.sub("[_-]", " ", x))).strip().split(" ")
        if len(w[-1]) > 3 and w[-1].endswith("s") and not w[-1].endswith("ss"):
            w[-1] = w[-1][:-1]
        return " ".join(w)

    def collapse(rows, name):
        rows = sorted(rows, key=lambda r: (-(r[4] if r[4] is not None else -1.0), -r[3]))
        out = {}
        for s, t, r, w, d, ids in rows:
            k = (name(s), name(t), r)
            if k in out:
                o = out[k]
                out[k] = (*o[:3], max(o[3], w), max((x for x in (o[4], d) if x is not None), default=None), o[5] | ids)
            else:
                out[k] = (s, t, r, w, d, set(ids))
        return list(out.values())

    rows = [(s.strip().lower(), t.strip().lower(), r, w, d, ids) for s, t, r, w, d, ids in rows]
    rows = collapse([x for x in rows if x[0] and x[1] and x[0] != x[1]], key)
    reps, canon = {}, {}
    for e in sorted({x for r in rows for x in r[:2]}):
        mine = reps.setdefault((key(e)[:3], len(key(e)) // 5), [])
        for rep in mine:
            a, b = key(e), key(rep)
            if abs(len(a) - len(b)) / max(len(a), len(b)) <= 0.25 and SequenceMatcher(None, a, b).ratio() >= threshold:
                chosen, other = (rep, e) if len(rep) <= len(e) else (e, rep)
                canon[e] = canon[other] = chosen
                canon = {k: chosen if v == other else v for k, v in canon.items()}
                break
        else:
            mine.append(e)
            canon[e] = e
    rows = collapse([(canon[s], canon[t], *rest) for s, t, *rest in rows], lambda x: x)
    pairs = {}
    for s, t, r, *_ in rows:
        pairs.setdefault(r, set()).add((s, t))
    return [(s, t, r, w, d, ",".join(sorted(ids))) for s, t, r, w, d, ids in rows if len(pairs[r]) >= least]


def test_merge_against_plain_python(spark):
    r = random.Random(9)
    base = ["dentate gyrus", "Dentate-Gyri", "granule cell", "granule cells", "granula cell", "mossy fibre", "mossy fibres", "ca"]
    rows = []
    for _ in range(160):
        s, t = ((lambda x: x[: r.randrange(5, 30)].upper() if r.random() < 0.2 else x)(r.choice(base)) for _ in range(2))
        rows.append((s, f" {t}", r.choice(["feeds", "ends"]), float(r.randrange(1, 4)), r.choice([None, 1.0, 2.0, 3.0]), {f"u{r.randrange(9)}" for _ in range(2)}))
    df = spark.createDataFrame([(i, s, t, rel, w, d, ",".join(ids)) for i, (s, t, rel, w, d, ids) in enumerate(rows)], "n bigint, source string, target string, relation string, weight double, combined_degree double, text_unit_ids string")
    for threshold in (0.9, 0.8):
        got = M.numbered(M.merge_graphs(df, None, "n", threshold, 5), ["place"]).orderBy("human_readable_id").collect()
        assert [(x.source, x.target, x.relation, x.weight, x.combined_degree, x.text_unit_ids) for x in got] == plain_merge(rows, threshold, 5)
