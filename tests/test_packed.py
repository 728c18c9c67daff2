import pytest

from strandworks.operators.packed import build_automaton, segment, split_packed, whole_matches

TITLES = ["Ward Case Files; series B, C", 'Collected Theses, "long" form', "Warden's Atlas of Small Nuclei, 3rd ed.", "Forum Threads | Rhythm Group", 'The "Quiet Gyrus" Lectures']


@pytest.mark.parametrize(
    ("packed", "items"),
    [
        ("a", ["a"]),
        ("a,,b, ,a", ["a", "b", "a"]),
        ("['a', 'b']", ["a", "b"]),
        ('"a" ; "b"', ["a", "b"]),
        ("(a/b)", ["a", "b"]),
        ("a\tb\nc d", ["a", "b", "c", "d"]),
        ('""', []),
        ("[]", []),
        (" , ", []),
        ('"x, y",z', ["x, y", "z"]),
        ("7,Ward Case Files; series B, C,8", ["7", TITLES[0], "8"]),
        ('"Collected Theses, ""long"" form",9', [TITLES[1], "9"]),
        ('["1", "Collected Theses, \\"long\\" form"]', ["1", TITLES[1]]),
        ("['Collected Theses, \"long\" form', '2']", [TITLES[1], "2"]),
        ("'Warden's Atlas of Small Nuclei, 3rd ed.',5", [TITLES[2], "5"]),
        ("'Warden''s Atlas of Small Nuclei, 3rd ed.'|5", [TITLES[2], "5"]),
        ('"Forum Threads | Rhythm Group" | 3 |', [TITLES[3], "3"]),
        ('"The ""Quiet Gyrus"" Lectures"/"The ""Quiet Gyrus"" Lectures"/21', [TITLES[4], TITLES[4], "21"]),
        ('"unclosed,b', ["unclosed", "b"]),
    ],
)
def test_segment(packed, items):
    assert segment(packed, whole_matches(packed, build_automaton(TITLES))) == items


def test_table_and_shards(spark):
    df = spark.createDataFrame([(1, "a|b", None, "x"), (2, None, "7, Ward Case Files; series B, C", "y"), (2, None, "7", "y"), (3, "", " ", None)], "k bigint, f string, g string, item string")
    d = spark.createDataFrame([(t,) for t in TITLES], "title string")
    want = sorted([(1, "f", 1, "a"), (1, "f", 2, "b"), (2, "g", 1, "7"), (2, "g", 2, TITLES[0]), (2, "g", 1, "7")])
    for bound in (100, 2 * len(TITLES) - 1, 4):
        assert sorted(map(tuple, split_packed(df, "k", ["f", "g"], d, bound).collect())) == want
    assert split_packed(df.limit(0), "k", ["f", "g"], d).count() == 0
    assert split_packed(df, "k", ["f"], None).count() == 2
