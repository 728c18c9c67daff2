import pytest
from pyspark.sql import functions as F

from strandworks.functions import text as T


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first()[0]


def many(spark, cases, f):
    rows = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(cases)], "i int, x string").select("i", f(F.col("x")).alias("y")).collect()
    got = {r.i: r.y for r in rows}
    assert [got[i] for i in range(len(cases))] == [b for _, b in cases]


def test_normal_forms(spark):
    many(spark, [(None, ""), ("", ""), ("NMDA-receptors", "nmda receptors"), ("GABA_A", "gaba a"), (" élan-vital\tβ_x! ", "élan vital β x")], T.norm_text)
    many(spark, [("NMDA-receptors", "nmda receptor"), ("glass", "glass"), ("gas", "gas"), ("axons", "axon"), ("the axons go", "the axons go"), (None, "")], T.entity_key)
    many(spark, [(None, ""), (" Projects  To ", "projects_to"), ("a__b", "a_b")], T.norm_relation)
    many(spark, [("projects to", "projects_to"), ("encodes", "encodes_representation_of"), ("x", "x"), (None, None)], T.alias_relation)
    many(spark, [("b, a,,b ", ["a", "b"]), (None, []), ("", [])], T.split_ids)
    many(spark, [('  "a  b" ', "a b"), ("'x", "'x"), ('"', '"'), (None, None)], T.normalize_tail)
    many(spark, [(" abcdefgh ", "ab\n...\ngh"), (" abcd", "abcd"), (None, "")], lambda c: T.clip_middle(c, 4))
    many(spark, [("the A, so B", "B"), ("ABC", ""), (None, ""), ("C", "C")], T.gold_letter)


def test_answers(spark):
    many(spark, [("<answer>: b </ANSWER>", "B"), ("<Answer>E</Answer>", None), (None, None)], T.gold_answer)
    many(spark, [("<think><Answer>A</Answer></think><Answer>B</Answer><Answer>: C</Answer>", "C"), ("<answer>B</answer>", None), ("<think>x <Answer>A</Answer>", None)], T.model_answer)
    many(spark, [("**Final Answer:** c", "C"), ("<answer>B", ""), ("<ANSWER> b </answer>", "B"), ("a</think>so A or B", "A"), ("A", ""), ("", "")], T.extract_answer)
    many(spark, [("<answer>B", "B")], lambda c: T.extract_answer(c, True))
    many(spark, [("x<think>a</think>b", "a"), ("plain ", "plain"), ("<think>a<think>b", "b")], T.thinking)
    many(spark, [("[NO] then [yes]", False), ("so [YES]", True), (None, False)], T.bracket_verdict)
    many(spark, [(" Yes, it is", True), ("true", True), ("no yes", False), (None, False)], T.leading_verdict)
    many(spark, [("correct: yes", "Yes"), ("Correct: No", "No"), ("?", "error"), (None, None)], T.correct_verdict)
    many(spark, [("<Question>Q [x]</Question>\n\n\n\n<Options>A</Options> rest", "Q x\n\nA"), ("none", "none")], T.question_only)


@pytest.mark.parametrize(
    ("text", "flags"),
    [
        ("<think>a</think><explanation>b</explanation><answer>A</answer> ", "11111"),
        ("<think>a</think><think>a</think><explanation>b</explanation><Answer>a</Answer>", "01110"),
        ("<think>a</think><explanation>b</explanation><answer>A</answer> more", "11101"),
        ("<explanation>b</explanation><think>a</think><answer>A</answer>", "11110"),
        ("", "00000"),
    ],
)
def test_format(spark, text, flags):
    row = spark.createDataFrame([(text,)], "x string").select(*[f.cast("int").alias(n) for n, f in T.format_flags(F.col("x")).items()]).first()
    assert "".join(map(str, row)) == flags


def plain_factor(tokens, threshold=0.35):
    if not tokens:
        return 1.0
    share = max(tokens.count(t) for t in tokens) / len(tokens)
    longest = run = 1
    for a, b in zip(tokens, tokens[1:]):
        run = run + 1 if a == b else 1
        longest = max(longest, run)
    return max(0.0, max(0.0, 1 - max(0.0, share - threshold) * 3) * (1 - max(0, longest - 3) * 0.05))


def test_rewards(spark):
    for tokens in ([], ["a"], ["a"] * 4 + list("bcdefghij"), list("abcabcabc"), ["x", "x", "y", "z", "z", "z", "z", "z", "w", "v", "u", "t", "s", "r"]):
        assert one(spark, tokens, T.repetition_factor, "array<string>") == pytest.approx(plain_factor(tokens))
    for n, want in ((550, 0.0), (551, 1 / 950), (1025, 0.5), (1500, 1.0), (9999, 1.0)):
        assert one(spark, n, T.length_penalty, "int") == pytest.approx(want)
    assert one(spark, "The Cat and cat2, THE end", T.reward_tokens) == ["cat", "cat2", "end"]
    assert one(spark, " ".join(["w"] * 500), lambda c: F.size(T.words(T.truncate_words(c)))) == 423
    good = "<think>alpha beta gamma here</think><explanation>e</explanation><answer>B</answer>"
    reward = lambda text, answer, path: spark.createDataFrame([(text, answer, path)], "t string, a string, p string").select(T.alignment_reward(F.col("t"), F.col("a"), F.col("p")).alias("r")).first().r
    recall, precision = 2 / 3, 2 / 4
    assert reward(good, "B", "alpha beta delta") == pytest.approx(0.7 * 2 * recall * precision / (recall + precision) + 0.2)
    assert reward(good, "A", "alpha beta") == 0 and reward(good, "B", None) == 0 and reward(good + "x", "B", "alpha beta") == 0 and reward(good, "B", "the of") == 0
