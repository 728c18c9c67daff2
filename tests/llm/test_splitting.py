import random

import pytest

from strandworks.llm.splitting import split_text, split_texts

WORDS = ["alpha", "beta,", "gamma.", "δελτα", "e.g.", "(cf. Fig. 3.3)", "x" * 37, "终点。", "é", "«q»"]


def check(text, limit, overlap):
    pieces = split_text(text, limit, overlap)
    assert "".join(text[a:b] for a, b, _, _ in pieces) == text
    for k, (a, b, lap, _) in enumerate(pieces):
        assert b > a and b - a + lap <= limit and lap <= overlap and (k or lap == 0)
        assert a - lap >= (pieces[k - 1][0] if k else 0)
    return pieces


@pytest.mark.parametrize("seed", range(25))
def test_round_trip(seed):
    r = random.Random(seed)
    text = "".join(r.choice(WORDS) + r.choice([" ", "\n", "\n\n", "  ", ""]) for _ in range(r.randrange(1, 400)))
    check(text, r.choice([40, 120, 300]), r.choice([0, 10, 30]))


def test_boundaries():
    paragraphs = ["One sentence here. " * 6 + "\n\n" for _ in range(8)]
    pieces = check("".join(paragraphs), 300, 40)
    assert all(s == 5 for *_, s in pieces)
    assert all(s >= 3 for *_, s in check("Short sentence number one. " * 60, 300, 40))
    assert check("a" * 5000, 2400, 200)[0][3] == 0
    marks = check("é" * 3000, 100, 0)
    assert all(("é" * 3000)[a] != "́" for a, *_ in marks)
    assert split_text("", 10, 2) == [] and split_text("ab", 10, 2) == [(0, 2, 0, 5)]


def test_overlap_is_natural():
    text = "Some words stand here, and more follow. " * 100
    for a, _, lap, _ in check(text, 400, 60)[1:]:
        assert lap and text[a - lap - 1] == " "


def test_table(spark):
    long = "Wort für Wort. " * 400
    df = spark.createDataFrame([("a", long, 1), ("b", None, 2), ("c", "", 3), ("d", " ", 4), ("a", long, 5), ("e", "😀" * 2400, 6), ("f", "😀" * 2401, 7)], "id string, text string, piece_no int")
    rows = split_texts(df, "id", "text").collect()
    n = {k: sum(r.id == k for r in rows) for k in "abcdef"}
    assert n["b"] == n["c"] == 0 and n["d"] == n["e"] == 1 and n["f"] == 2 and n["a"] % 2 == 0 and n["a"] >= 6
    assert all(len(r.piece) <= 2400 and len(r.piece) == r.stop - r.start for r in rows)
    assert split_texts(df.limit(0), "id", "text").count() == 0
