import random

from strandworks.llm.canonical import BKTree, Canon, LengthTrees, decide, distance, map_to_canonical, match_keys, modifying_words

REF = [("sends_axons_to", "axons leave the source and end in the target; an axonal projection"), ("eases", "the source relieves symptoms of the condition"), ("worsens", "the source aggravates the severity of the condition"), ("borders_on", "the two structures are adjacent and touch along a common edge"), ("same_as", "both names stand for one and the same thing")]


def test_distance_is_a_metric():
    assert [distance(a, b) for a, b in (("", "ab"), ("ab", "ba"), ("ca", "abc"), ("kitten", "sitting"), ("abcd", "abdc"))] == [2, 1, 2, 3, 1]
    r = random.Random(2)
    words = ["".join(r.choice("abc") for _ in range(r.randrange(6))) for _ in range(40)]
    for a in words:
        for b in words:
            assert distance(a, b) == distance(b, a) and (distance(a, b) == 0) == (a == b)
            assert all(distance(a, c) <= distance(a, b) + distance(b, c) for c in words[:12])
    for q, tree in [(q, tree) for tree in (BKTree(words), LengthTrees(words)) for q in words]:
        for t in range(4):
            assert tree.within(q, t) == sorted((distance(q, w), w) for w in set(words) if distance(q, w) <= t)


def test_spelling_and_meaning():
    c = Canon(REF, frozenset({"weakly", "apparently"}))
    for key, want in (("sends axons to weakly", "sends_axons_to"), ("sedns axon to", "sends_axons_to"), ("apparently eases", "eases"), ("its axons leave for", "sends_axons_to"), ("relieves symptoms of", "eases"), ("aggravates the condition", "worsens"), ("is adjacent to", "borders_on"), ("the condition", ""), ("sold to", ""), ("n a", ""), ("", "")):
        assert decide([c.candidates(key)])[0] == want, key


def test_modifiers_are_learnt(spark):
    keys = spark.createDataFrame([(k,) for k in ("eases rarely", "rarely worsens", "borders on rarely", "eases twice", "worsens twice", "in rare cases borders on", "a b c d e eases", "7 eases", "7 worsens", "7 same as")], "k string")
    names = spark.createDataFrame([(n, n.replace("_", " ")) for n, _ in REF], "name string, form string")
    assert modifying_words(keys, names) == {"rarely"}


def test_table(spark):
    values = [" ", None, "", "eases", "Eases", "eases", "EASES ", "?", "wrosens", "z" * 5000, "touch the edge of"] + ["Same_As"] * 400
    df = spark.createDataFrame([(i, v, "x") for i, v in enumerate(values)], "n int, v string, canonical string")
    ref = spark.createDataFrame(REF, "relation string, gloss string")
    want = {4: "eases", 6: "eases", 7: "", 8: "worsens", 9: "", 10: "borders_on"} | {i: "same_as" for i in range(11, 411)}
    assert {r.n: r.canonical for r in map_to_canonical(df, "n", "v", ref).collect()} == want
    assert {r.n: r.canonical for r in map_to_canonical(df.filter("n < 9"), "n", "v", ref, max_reference=3).collect()} == {k: v for k, v in want.items() if k < 9}
    assert map_to_canonical(df.limit(0), "n", "v", ref).count() == 0


def test_shards_answer_like_the_whole(spark):
    """Ties, equal distances and frequencies are those of the whole reference, however it is cut."""
    r = random.Random(6)
    letters = "abcde"
    words = ["".join(r.choice(letters) for _ in range(r.randrange(4, 9))) for _ in range(25)]
    ref = [("_".join(r.sample(words, r.randrange(1, 4))) + str(i), " ".join(r.sample(words, 5)) if i % 4 else None) for i in range(40)]
    values = [" ".join(r.sample(words, r.randrange(1, 5))) for _ in range(150)] + [n.replace("_", " ")[:-1] for n, _ in ref]
    keys = spark.createDataFrame([(v,) for v in sorted(set(values))], "k string")
    table = spark.createDataFrame(ref, "relation string, gloss string")
    whole = {x.k: (x.canonical, x.way) for x in match_keys(keys, table).collect()}
    assert {w for _, w in whole.values()} == {"spelling", "meaning", "none"}
    for bound in (39, 6):
        assert {x.k: (x.canonical, x.way) for x in match_keys(keys, table, max_reference=bound).collect()} == whole
