import random

import pytest

from strandworks.llm.mixing import encoder, mix_sources, pair, TOKENIZERS


def test_pair_keeps_mass_and_expectation():
    r = random.Random(3)
    for _ in range(200):
        a, b = (1, r.randrange(1, 50), r.uniform(0.01, 0.99)), (2, r.randrange(1, 50), r.uniform(0.01, 0.99))
        mean = [0.0, 0.0]
        for seed in range(30):
            x, y = pair(seed, a, b)
            assert x[1] * x[2] + y[1] * y[2] == pytest.approx(a[1] * a[2] + b[1] * b[2])
            assert any(p < 1e-9 or p > 1 - 1e-9 for p in (x[2], y[2]))
    for k in range(2000):
        x, y = pair(k, (k, 3, 0.4), (-k, 5, 0.7))
        mean[0] += x[2] / 2000
        mean[1] += y[2] / 2000
    assert mean[0] == pytest.approx(0.4, abs=0.05) and mean[1] == pytest.approx(0.7, abs=0.05)


def test_mix(spark):
    r = random.Random(5)
    rows = [(i, " ".join("word" for _ in range(r.randrange(1, 30))), "big" if i % 3 else r.choice(["mid", "small", None, "other"])) for i in range(900)]
    rows += [(1000, None, "big"), (1001, "", "mid"), (1002, "x " * 3000, "small")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(40)
    goals = spark.createDataFrame([("big", 0.5, 1), ("mid", 0.3, 3), ("small", 0.15, 4), ("gone", 0.05, 2)], "source string, target_share double, max_repeats int")
    mix = mix_sources(docs, "doc_id", "text", "source", goals)
    copies = {x.doc_id: x for x in mix.copies.collect()}
    assert len(copies) == len(rows)
    enc = encoder(f"{TOKENIZERS}/byte_bpe_50k.tiktoken")
    size = {i: len(enc.encode_ordinary(t or "")) for i, t, _ in rows}
    assert all(copies[i].tokens == size[i] for i in size)
    cap = {"big": 1, "mid": 3, "small": 4}
    for i, t, s in rows:
        assert 0 <= copies[i].copies <= cap.get(s, 0) and (t or copies[i].copies == 0)
    held = {s: sum(size[i] for i, _, x in rows if x == s) for s in cap}
    total = min(held["big"] / 0.5, held["mid"] * 3 / 0.3, held["small"] * 4 / 0.15)
    for s, share in (("big", 0.5), ("mid", 0.3), ("small", 0.15)):
        got = sum(copies[i].copies * size[i] for i, _, x in rows if x == s)
        assert abs(got - total * share) <= max(size[i] for i, _, x in rows if x == s)
    shares = {x.source: x for x in mix.shares.collect()}
    assert shares["gone"].mixed_tokens == 0 and sum(x.actual_share for x in shares.values()) == pytest.approx(1)
    capped = {x.source: x for x in mix_sources(docs, "doc_id", "text", "source", goals, total_tokens=10**9).shares.collect()}
    assert capped["big"].capped and capped["big"].mixed_tokens == held["big"]
    assert mix_sources(docs.limit(0), "doc_id", "text", "source", goals).copies.count() == 0
