import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from strandworks.operators import evaluation as V
from strandworks.operators import grounding as R
from strandworks.operators import qa as Q
from strandworks.operators import records as P


def test_tuple_records(spark):
    reply = '<think>("entity"<|>No<|>t<|>d)</think>("entity"<|>Axon<|>cell<|>a &amp; b)##("relationship"<|>Axon<|>Soma<|>part_of<|>7.5)##("relationship"<|>Axon<|>Soma<|>feeds<|>2)##("entity"<|>short<|>x)##("odd"<|>a<|>b<|>c<|>d)##("relationship"<|>Soma<|>Nerve<|>ends<|>9)<|COMPLETE|>'
    df = spark.createDataFrame([(1, reply), (2, "nothing"), (3, None)], "id int, r string")
    rec = P.parse_records(df, "id", "r")
    assert [(r.title, r.type, r.description) for r in P.entity_rows(rec, "id").collect()] == [("axon", "CELL", "a & b")]
    rel = P.relationship_rows(rec, "id")
    assert sorted((r.source, r.target, r.weight) for r in rel.collect()) == [("axon", "soma", 2.0), ("axon", "soma", 7.5), ("soma", "nerve", 1.0)]
    edges = P.merge_edges(rel, "id")
    assert sorted((r.relations, r.weight, r.source_id) for r in edges.collect()) == [("ends", 1.0, "1"), ("part_of\nfeeds", 9.5, "1, 1")]
    nodes = {r.title: r for r in P.merge_nodes(P.entity_rows(rec, "id"), rel, "id").collect()}
    assert set(nodes) == {"axon", "soma", "nerve"} and nodes["axon"].type == "CELL" and nodes["soma"].type == ""
    assert P.merge_responses(edges, "id").count() == 2


def test_json(spark):
    rows = [(1, '{" A ":["Feeds","x","feeds"],"b":"ends"}'), (2, "{bad"), (3, '{"c":{"k":1},"d":["x"]}'), (4, '{"K":["feeds"],"k":["ends"]}'), (5, None), (6, "{}"), (7, "[1]")]
    df = spark.createDataFrame(rows, "id int, j string")
    got = sorted((r.id, r.head, r.relations) for r in P.relation_map_rows(df, "id", "j", ["feeds", "ends"]).collect())
    assert got[:2] == [(1, "a", ["feeds"]), (1, "b", ["ends"])] and len(got) == 3 and got[2][:2] == (4, "k")
    assert P.salvage_object('x {"a": 1} y {"b": [2]} z') == '{"b": [2]}'
    assert json.loads(P.salvage_object("```json\n{'a': ('x', None)}\n```")) == {"a": ["x", None]}
    assert json.loads(P.salvage_object('t {"a": {"b": 1}}')) == {"a": {"b": 1}}
    assert P.salvage_object("no") is None and P.salvage_object(None) is None and P.salvage_object("} {") is None
    t = spark.createDataFrame([(1, 'a ```json\n{"x": 1}\n``` {"y"}'), (2, "b {'x'}"), (3, 'c {"x": {"y": 2}} d')], "id int, s string")
    assert [r.o for r in t.select(P.first_json_object(F.col("s")).alias("o")).collect()] == ['{"x": 1}', None, '{"x": {"y": 2}}']
    t = spark.createDataFrame([(1, '<think>[no]</think> [" A","b"] ["c"]'), (2, 'the "X" and "y "'), (3, "none")], "id int, s string")
    assert [r.o for r in t.select(P.json_list(F.col("s")).alias("o")).collect()] == [["a", "b"], ["x", "y"], []]
    blank = spark.createDataFrame([('["a", "", " ", null, 3]',), ('a " " and "B"',)], "s string")
    assert [r.o for r in blank.select(P.json_list(F.col("s")).alias("o")).collect()] == [["a", "none", "3"], ["b"]]
    maps = spark.createDataFrame([(1, '{"axon":["feeds"],"Axon":["ends"]}'), (2, '{"Axon":["feeds"],"axon":["bogus"]}'), (3, '{"z":"ends","Z":7}')], "id int, j string")
    assert sorted((r.id, r.head, r.relations) for r in P.relation_map_rows(maps, "id", "j", ["feeds", "ends"]).collect()) == [(1, "axon", ["ends"]), (2, "axon", ["feeds"]), (3, "z", ["ends"])]
    assert sorted(map(tuple, P.has_relations(df, "id", "j", ["feeds"]).collect())) == [(1, True), (2, False), (3, False), (4, True), (5, False), (6, False), (7, False)]
    t = spark.createDataFrame([(1, ["a", "b"]), (2, []), (3, None)], "id int, tails array<string>")
    assert sorted((r.id, r.tail, r.query_had_no_tails) for r in P.explode_tails(t, "tails").collect()) == [(1, "a", False), (1, "b", False), (2, "", True), (3, "", True)]
    t = spark.createDataFrame([(["A", "a", None, "b", "B", "c"],)], "x array<string>")
    assert t.select(P.distinct_ignoring_case(F.col("x"), 2).alias("y")).first().y == ["A", "b"]
    assert t.select(P.allowed_relations(P.flatten_relations(F.lit(" B\n\nA\nb")), ["b", "a"]).alias("y")).first().y == ["a", "b"]


def test_grounding(spark):
    e = spark.createDataFrame([("Big Cell",), ("axon",), ("",), ("lost",)], "title string")
    u = spark.createDataFrame([("s1", "An axon of the big cell; Axon."), ("s2", "Axons only"), ("s3", None)], "id string, text string")
    assert sorted((r.snippet_id, r.entity, r.pos, r.token_pos) for r in R.mentions(e, u, max_titles=2).collect()) == [("s1", "axon", 3, 1), ("s1", "big cell", 15, 4), ("s2", "axon", 0, 0)]
    m = R.mentions(e, u, whole_words=True)
    assert sorted((r.snippet_id, r.entity, r.pos, r.token_pos) for r in m.collect()) == [("s1", "axon", 3, 1), ("s1", "big cell", 15, 4)]
    t = spark.createDataFrame([(1, "axon", "big CELL", "feeds"), (2, "axon", "lost", "feeds"), (3, "zz", "axon", "feeds"), (4, "axon", "axon", "odd")], "h int, source string, target string, relation string")
    v = spark.createDataFrame([("feeds", 7)], "relation string, relation_id int")
    assert [(r.h, r.snippet_id, r.relation_id, r.head_pos, r.tail_pos) for r in R.ground(t, m, v).collect()] == [(1, "s1", 7, 1, 4)]
    assert tuple(R.grounding_counters(t, m, v, "h").first()) == (4, 1, 1, 1)


def test_arrays(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    ids = F.array(*[F.lit(i) for i in (5, 6, 7)])
    assert one(R.padded(ids, 5)) == [5, 6, 7, 0, 0] and one(R.padded(ids, 2)) == [5, 6]
    slots = one(R.leaf_slots(F.array(*[F.lit(i) for i in (5, 6, 7, 8)]), F.lit(1), 3, 3))
    assert slots == [0, 0, 0, 5, 6, 7, 0, 0, 0] and one(R.one_hot(F.lit(2), F.lit(9), 4)) == [0, 0, 9, 0] and one(R.attention(R.padded(ids, 4))) == [1, 1, 1, 0]
    assert abs(sum(one(R.span_lengths(10))) - 1) < 1e-9 and one(R.span_lengths(3))[0] > one(R.span_lengths(3))[1]
    tokens = F.array(*[F.lit(x) for x in ("ab", "##c", "-", "é", "##f", "##g")])
    assert one(R.word_starts(tokens)) == [True, False, False, True, False, False]
    assert one(R.word_end(tokens, F.lit(1))) == 2 and one(R.word_end(tokens, F.lit(4))) == 6 and one(R.word_end(tokens, F.lit(3))) == 3
    assert one(R.leaf_runs(F.array(*[F.lit(i) for i in (0, 2, 3, 7)]), 3)) == [[0, 2], [3], [7]]
    span = lambda *p: F.array(*[F.struct(F.lit(a).alias("start"), F.lit(b).alias("stop")) for a, b in p])
    assert one(R.spans_overlap(span((5, 6), (0, 2), (2, 3)))) and not one(R.spans_overlap(span((0, 1), (2, 3)))) and not one(R.spans_overlap(span((0, 1))))
    assert [tuple(x) for x in one(R.boundary_pairs(span((1, 2), (0, 1)), 5))] == [(0, 3), (-1, -1)]
    lengths = F.array(F.struct(F.lit(1).alias("start"), F.lit(5).alias("length")))
    assert one(R.padded_spans(ids, lengths, 3)) == [[6, 7, 0]]
    assert len(one(R.token_pairs(ids, F.array(F.lit(1), F.lit(2))))) == 6 and one(R.flatten_leaves(ids, F.array(ids, ids))) == [5, 6, 7] * 3
    m = one(R.masked(F.transform(F.sequence(F.lit(1), F.lit(2000)), lambda i: i + 10), F.lit(3), 1, 500))
    chosen = [x for x in m if x.label != -100]
    assert 200 < len(chosen) < 400 and 0.7 < sum(x.input == 1 for x in chosen) / len(chosen) < 0.9
    leaf = one(R.masked_leaf(F.array(*[F.lit(i) for i in (0, 4, 0, 8)]), F.lit(1), 99))
    assert leaf.label in (4, 8) and leaf.inputs[leaf.slot] == 99
    chunks = spark.createDataFrame([(1, 1, list(range(7))), (1, 0, [50, 51]), (2, 0, [1]), (3, 0, [])], "b int, o int, ids array<int>")
    got = sorted((r.b, r.chunk, r.input_ids) for r in R.token_chunks(chunks, "b", "o", "ids", 6).collect())
    assert got == [(1, 0, [101, 50, 51, 0, 1, 102]), (1, 1, [101, 2, 3, 4, 5, 102]), (2, 0, [101, 1, 102])]
    logits = spark.createDataFrame([(1, "a", 2.0), (1, "b", 1.0), (1, "pad", 9.0)], "row int, token string, s double")
    top = R.top_k(logits, "row", "s", 1, F.col("token") == "pad").first()
    assert top.token == "a" and abs(top.log_probability + 0.3132617) < 1e-6


def test_qa(spark):
    good = "<Question>Why so?</Question>\n<Options>\nA. one\nB. two\nC. three\nD. four\n</Options>\n<Explanation>because it is</Explanation>\n<Answer>: B</Answer>"
    df = spark.createDataFrame([(1, good), (2, good.replace("B. two", "B. x")), (3, good.replace("<Answer>:", "<Answer>")), (4, None), (5, good.replace("D. four", ""))], "id int, q string")
    assert sorted(r.id for r in df.filter(Q.well_formed(F.col("q"))).collect()) == [1, 3]
    bare = good.split("<Explanation>")[0]
    assert spark.createDataFrame([(bare,)], "q string").select(Q.well_formed(F.col("q")).alias("w")).first().w
    judged = Q.distinct_options(df, "q", lambda: lambda prompts: ["No" if p.endswith("<Answer>B</Answer>") or "<Answer>: B" not in p else "yes" for p in prompts])
    assert [r.id for r in judged.collect()] == [1]
    m = {r.id: r.m for r in df.select("id", Q.messages(F.col("q"), F.lit("fb")).alias("m")).collect()}
    assert m[1][1].content == "<think>\nbecause it is\n</think>\nFinal Answer: B" and m[3][1].content == "fb" and m[4][1].content == "fb"
    assert {r.id: r.a for r in df.select("id", Q.rl_answer(F.col("q")).alias("a")).collect()}[3] == "B"
    kept = {r.id: r.k for r in df.select("id", Q.kept_by_length(F.col("q"), 1, 2).alias("k")).collect()}
    assert kept[1] is False
    wide = spark.createDataFrame([("a", "r", "b", "b", "s", "c"), ("a", "r", "b", None, None, None)], "head_1 string, relation_1 string, tail_1 string, head_2 string, relation_2 string, tail_2 string")
    assert sorted(len(r.p) for r in wide.select(Q.long_paths(wide, 3).alias("p")).collect()) == [1, 2]
    p = spark.createDataFrame([("x", "y")], "context_path string, question string")
    assert "Path: x\nQuestion: y" in p.select(Q.validation_prompt(p).alias("v")).first().v
    assert p.select(Q.shorter_trace(F.lit("a " * 400), F.lit("b " * 380)).alias("v")).first().v.startswith("b")


def test_evaluation(spark):
    rows = [(1, 1, "m1", "no"), (1, 1, "m2", "no"), (2, 1, "m1", "yes"), (2, 1, "m2", "no"), (3, 2, "m1", "error"), (3, 2, "m2", "yes"), (4, 2, "m1", "n/a"), (4, 2, "m2", "yes")]
    df = spark.createDataFrame(rows, "item_id int, k_hops int, model string, verdict string")
    acc = {(r.model, r.k_hops): (r.total, r.correct) for r in V.accuracy(df).collect()}
    assert acc["m1", None] == (3, 1) and acc["m2", None] == (4, 2) and acc["m1", 2] == (1, 0)
    assert tuple(V.error_overlap(df).first())[2:5] == (1, 0, 1)
    assert tuple(V.universal(df).first()) == (1, 2, 1)
    assert [r.model for r in V.complete_models(df).select("model").distinct().collect()] == ["m2"]
    best = V.best_and_worst(df).first()
    assert (best.best_model, best.worst_model) == ("m1", "m1")
    step = spark.createDataFrame([(1, 1, "checkpoint-9", "no"), (1, 1, "checkpoint-10", "yes"), (2, 1, "checkpoint-9", "yes"), (2, 1, "checkpoint-10", "no")], df.schema)
    from strandworks.operators.sampling import checkpoint_step

    g = V.gains(step, checkpoint_step(F.col("model"))).filter("all_hops = 1").first()
    assert (g.step, g.gains, g.regressions, g.net) == (10, 1, 1, 0)
    votes = spark.createDataFrame([(1, "a", True), (1, "b", True), (2, "a", True), (3, "a", True), (3, "b", False)], "id int, judge string, accepted boolean")
    assert [r.id for r in V.unanimous(votes, "id").collect()] == [1]
    wide = spark.createDataFrame([(1, 2, "Yes", None)], "item_id int, k_hops int, correctness_a string, correctness_b string")
    assert sorted((r.model, r.verdict) for r in V.to_long(wide, "item_id", "k_hops").collect()) == [("a", "yes"), ("b", None)]
    assert V.accuracy(df.limit(0)).count() == 0


def test_mentions_of_long_titles(spark):
    """Titles of more words than the runs: found whole, not by their first words alone."""
    long = "One two three four five six seven eight"
    e = spark.createDataFrame([(long,), ("two three",)], "title string")
    u = spark.createDataFrame([("a", "Say " + long.lower() + "."), ("b", "One two three four five six seven"), ("c", long + "een"), ("d", None)], "id string, text string")
    got = sorted((r.snippet_id, r.entity, r.pos, r.token_pos) for r in R.mentions(e, u, whole_words=True).collect())
    assert got == [("a", long.lower(), 4, 1), ("a", "two three", 8, 2), ("b", "two three", 4, 1), ("c", "two three", 4, 1)]


def test_chunks_of_a_hot_batch(spark):
    """A batch that holds most ids is cut like any other, in its order."""
    import random

    r = random.Random(4)
    rows = [("hot" if i % 5 else f"b{i % 3}", i, [r.randrange(1000) for _ in range(r.randrange(0, 40))]) for i in range(300)]
    df = spark.createDataFrame(rows, "b string, o int, ids array<int>").repartition(9)
    want = {}
    for b in {x[0] for x in rows}:
        ids = [v for x in sorted(x for x in rows if x[0] == b) for v in x[2]]
        n = len(ids) // 14 if len(ids) >= 14 else int(bool(ids))
        want |= {(b, k): [1, *ids[k * 14 : k * 14 + 14], 2] for k in range(n)}
    assert {(x.b, x.chunk): x.input_ids for x in R.token_chunks(df, "b", "o", "ids", 16, 1, 2).collect()} == want
    assert R.token_chunks(df.limit(0), "b", "o", "ids", 16).count() == 0


@pytest.mark.parametrize("heavy", [0, 1_000_000])
def test_chunks_compute_ids_once(spark, heavy):
    """Ids are computed once a row, and a batch without a name is cut as well."""
    calls = spark.sparkContext.accumulator(0)

    @F.pandas_udf("array<int>")
    def ids(n: pd.Series) -> pd.Series:
        calls.add(len(n))
        return n.map(lambda x: list(range(x)))

    df = spark.createDataFrame([("a", 1, 5), (None, 0, 3), ("a", 0, 4), (None, 1, 6), ("b", 0, 0)], "b string, o int, n int")
    got = {(r.b, r.chunk): r.input_ids for r in R.token_chunks(df.select("b", "o", ids("n").alias("ids")), "b", "o", "ids", 6, 8, 9, heavy=heavy).collect()}
    assert got == {("a", 0): [8, 0, 1, 2, 3, 9], ("a", 1): [8, 0, 1, 2, 3, 9], (None, 0): [8, 0, 1, 2, 0, 9], (None, 1): [8, 1, 2, 3, 4, 9]}
    assert calls.value == 5


@pytest.mark.parametrize("fits", [False, True])
def test_chunks_of_heavy_batches(spark, monkeypatch, fits):
    """Heavy batches and others side by side; places of heavy rows are joined with and without a broadcast."""
    monkeypatch.setattr(R, "fits_broadcast", lambda t: fits)
    df = spark.createDataFrame([(i % 2 if i < 40 else None if i < 60 else i, i, [i] * 3) for i in range(64)], "h int, o int, ids array<int>").repartition(5)
    got = {(r.h, r.chunk): r.input_ids[1:-1] for r in R.token_chunks(df, "h", "o", "ids", 6, heavy=20).collect()}
    want = {h: [i for i in range(h, 40, 2) for _ in range(3)] for h in (0, 1)} | {None: [i for i in range(40, 60) for _ in range(3)]}
    assert got == {(h, k): v[k * 4 : k * 4 + 4] for h, v in want.items() for k in range(15)} | {(h, 0): [h] * 3 for h in range(60, 64)}
    assert R.token_chunks(df.limit(0), "h", "o", "ids", 6, heavy=0).count() == 0


def test_encodings_are_not_kept(monkeypatch):
    """Of a batch of texts, one encoding stands in memory at a time."""
    from strandworks.functions import tokens as K

    alive, most = set(), []

    class Encoding:
        def __init__(self, text):
            self.ids = [len(text), 1]
            alive.add(id(self))
            most.append(len(alive))

        def __del__(self):
            alive.discard(id(self))

    class Tokenizer:
        def encode_batch(self, texts, add_special_tokens):
            return [Encoding(x) for x in texts]

        encode_batch_fast = encode_batch

    monkeypatch.setitem(K._loaded, "counted", Tokenizer())
    got = [list(x) for part in K.token_ids("counted").func(iter([pd.Series(["ab", None] * 50)])) for x in part]
    assert got == [[2, 1], [0, 1]] * 50 and max(most) <= 2


def test_training_samples(spark):
    from strandworks.functions import tokens as K

    g = spark.createDataFrame([(1, "s1", "axon", "big cell body part", 7, 2), (2, "s1", "axon", "x", 9, 600)], "h int, snippet_id string, source string, target string, relation_id int, head_pos int")
    u = spark.createDataFrame([("s1", "An axon of the big cell body part."), ("s2", None)], "id string, text string")
    t = K.load(K.DEFAULT)
    pad, begin = t.token_to_id("<|endoftext|>"), t.token_to_id("<|startoftext|>")
    rows = R.training_samples(g, u, "id", "text", "source", "target").collect()
    assert [r.h for r in rows] == [1]
    r = rows[0]
    ids = lambda x: t.encode(x, add_special_tokens=False).ids
    roots = (ids("An axon of the big cell body part.") + [pad] * 512)[:512]
    leaves = [pad] * 1536
    leaves[6:9] = ids("big cell body part")[:3]
    assert r.input_nodes == roots + leaves and r.attention_mask == [int(x != pad) for x in roots + leaves]
    assert r.leaf_relationships == [7 if i == 2 else 0 for i in range(512)] and r.head_lengths[2] == len(ids("axon")) and sum(r.head_lengths) == r.head_lengths[2]
    assert r.start_indices == [0] * 512 and r.special_tokens_mask == [int(x in (pad, begin)) for x in roots] + [int(x == pad) for x in leaves]
    assert K.special_ids(K.DEFAULT, ("<|endoftext|>",)) == {"<|endoftext|>": pad}
    import pytest

    with pytest.raises(ValueError):
        K.special_ids(K.DEFAULT, ("[PAD]", "[MASK]"))
    texts = spark.createDataFrame([(1, "one two three four"), (2, None), (3, "")], "n int, t string")
    assert {x.n: x.c for x in texts.select("n", K.truncated(most=2)("t").alias("c")).collect()} == {1: "one two", 2: None, 3: ""}
    assert {x.n: len(x.c) for x in texts.select("n", K.token_texts()("t").alias("c")).collect()} == {1: 4, 2: 0, 3: 0}


def test_span_masking(spark):
    ids = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: i + 100)
    spans = F.array(*[F.struct(F.lit(a).alias("start"), F.lit(b).alias("stop")) for a, b in ((1, 3), (7, 7))])
    rows = spark.range(400).select(R.masked_spans(ids, spans, F.col("id"), 1, 50).alias("m")).collect()
    whole = 0
    for r in rows:
        assert [x.label for x in r.m] == [100 + i if i in (1, 2, 3, 7) else -100 for i in range(10)]
        assert all(x.input == 100 + i for i, x in enumerate(r.m) if i not in (1, 2, 3, 7))
        whole += all(r.m[i].input == 1 for i in (1, 2, 3))
    assert 280 < whole < 360
