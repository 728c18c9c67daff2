import random

import numpy as np
import pytest

from strandworks.llm.leaks import SPAN, find_leaks, shared_lengths, words_of


def brute(docs, items):
    """Pairs by the definition: a common run of at least eight words that stands in no other item."""
    tok = {k: words_of(t) for k, t in items if t is not None}
    text = {k: "\x1f" + "\x1f".join(w) + "\x1f" for k, w in tok.items()}
    found = set()
    for d, t in docs:
        if t is None:
            continue
        w = words_of(t)
        for k, x in tok.items():
            for i in range(len(x) - SPAN + 1):
                for j in range(len(w) - SPAN + 1):
                    n = 0
                    while i + n < len(x) and j + n < len(w) and x[i + n] == w[j + n]:
                        n += 1
                    if n >= SPAN and not any("\x1f" + "\x1f".join(x[i : i + n]) + "\x1f" in text[o] for o in text if o != k):
                        found.add((k, d))
    return sorted(found)


def sample(seed):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(30)]
    stock = [r.choice(vocabulary) for _ in range(12)]
    items = []
    for k in range(12):
        w = [r.choice(vocabulary) for _ in range(r.randrange(0, 25))]
        if k % 2:
            at = r.randrange(len(w) + 1)
            w = w[:at] + stock[: r.randrange(6, 13)] + w[at:]
        items.append((k, " ".join(w)))
    items += [(20, items[3][1]), (21, None), (22, "<Q>" + items[1][1] + "</Q>")]
    docs = []
    for d in range(40):
        w = [r.choice(vocabulary) for _ in range(r.randrange(30))]
        x = r.choice(items)[1] or ""
        x = words_of(x)
        a = r.randrange(len(x) + 1)
        cut = x[a : a + r.randrange(5, 20)]
        if cut and d % 3 == 0:
            cut[len(cut) // 2] = "other"
        at = r.randrange(len(w) + 1)
        docs.append((d, r.choice([" ", "&nbsp;", " <b> ", ", "]).join(w[:at] + [c.upper() for c in cut] + w[at:])))
    return docs + [(90, None), (91, ""), (92, " <i> ")], items


def test_against_definition(spark):
    for seed in range(3):
        docs, items = sample(seed)
        d = spark.createDataFrame(docs, "doc_id bigint, text string")
        q = spark.createDataFrame(items, "item_id bigint, text string")
        want = brute(docs, items)
        for block_words in (100_000, 40):
            got = find_leaks(d, "doc_id", "text", q, "item_id", "text", block_words).filter("own_words >= 8")
            assert sorted((r.item_id, r.doc_id) for r in got.collect()) == want
    assert find_leaks(d.limit(0), "doc_id", "text", q, "item_id", "text").count() == 0
    assert find_leaks(d, "doc_id", "text", q.limit(0), "item_id", "text").count() == 0


def test_shared_lengths():
    r = random.Random(8)
    for _ in range(30):
        stock = [r.randrange(4) for _ in range(25)]
        items = [[r.randrange(4) for _ in range(r.randrange(12))] + stock[r.randrange(10) : r.randrange(10, 26)] + [r.randrange(4) for _ in range(r.randrange(12))] for _ in range(7)] + [stock, stock, []]
        got = shared_lengths([np.array(x, dtype=np.int64) for x in items])

        def longest(i, p):
            n = max((next((n for n in range(99) if p + n >= len(items[i]) or q + n >= len(y) or items[i][p + n] != y[q + n]), 0) for j, y in enumerate(items) if j != i for q in range(len(y))), default=0)
            return n if n >= SPAN else 0

        assert [g.tolist() for g in got] == [[longest(i, p) for p in range(len(x))] for i, x in enumerate(items)]
    assert shared_lengths([]) == []


def test_many_items_with_one_stock_sentence(spark):
    """Shared wording is never compared pair by pair; what is an item's own beside it is found."""
    stock = " ".join(f"s{i}" for i in range(12))
    q = spark.createDataFrame([(k, f"{stock} a{k} b{k} c{k} d{k} e{k} f{k} g{k} h{k} i{k} {stock}") for k in range(3000)], "item_id bigint, text string")
    d = spark.createDataFrame([(1, stock), (2, "x a7 b7 c7 d7 e7 f7 g7 h7 i7 y"), (3, "s9 s10 s11 a8 b8 c8 d8 e8"), (4, f"{stock} a9")], "doc_id bigint, text string")
    got = find_leaks(d, "doc_id", "text", q, "item_id", "text").filter("own_words >= 8").collect()
    assert sorted((r.item_id, r.doc_id, r.own_words) for r in got) == [(7, 2, 9), (8, 3, 8), (9, 4, 13)]


@pytest.mark.parametrize("every", [5, 6, 8, 12])
def test_recall_of_altered_passages(spark, every):
    """Passages of 24 words in which every 5th to 12th word was replaced are all found."""
    r = random.Random(every)
    items = [(k, " ".join(f"w{r.randrange(400)}" for _ in range(40))) for k in range(60)]
    docs = []
    for k, t in items:
        w = t.split()
        at, shift = r.randrange(16), r.randrange(every)
        docs.append((k, " ".join([f"x{i}" for i in range(9)] + ["zz" if i % every == shift else x for i, x in enumerate(w[at : at + 24])] + ["y"] * 5)))
    d, q = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    got = find_leaks(d, "doc_id", "text", q, "item_id", "text", altered=True).filter("overlap_words >= 12 AND substitutions > 0")
    assert {r.doc_id for r in got.collect() if r.item_id == r.doc_id} == set(range(60))


def test_bound_raises(spark):
    q = spark.createDataFrame([(1, "a b c d")], "item_id bigint, text string")
    with pytest.raises(ValueError):
        find_leaks(q, "item_id", "text", q, "item_id", "text", max_words=3)


def test_substitutions(spark):
    item = " ".join(f"t{i}" for i in range(20))
    altered = " ".join(f"t{i}" if i % 6 != 3 else "zz" for i in range(20))
    d = spark.createDataFrame([(1, "before " + altered + " after")], "doc_id bigint, text string")
    q = spark.createDataFrame([(5, item)], "item_id bigint, text string")
    r = find_leaks(d, "doc_id", "text", q, "item_id", "text").collect()[0]
    assert (r.item_id, r.doc_id, r.own_words) == (5, 1, 0) and r.overlap_words >= 14 and r.substitutions >= 2


def test_substitutions_in_shared_wording(spark):
    from strandworks.llm import queries

    stock = [f"t{i}" for i in range(24)]
    items = [(k, " ".join([f"a{k}", *stock, f"b{k}"])) for k in (1, 2)]
    text = " ".join("zz" if i == 12 else w for i, w in enumerate(stock))
    docs = spark.createDataFrame([(7, text)], "doc_id bigint, text string")
    q = spark.createDataFrame(items, "item_id bigint, question_and_explanation string")
    tables, read = {"documents": docs, "eval_items": q}, queries.table
    queries.table = lambda spark, sf_dir, name: tables[name]
    try:
        got = queries.p7_altered(spark, "").collect()
        own = queries.p7_found(spark, "").count()
    finally:
        queries.table = read
    assert sorted(map(tuple, got)) == [(1, 7, 23, 1, 12), (2, 7, 23, 1, 12)] and own == 0


def test_words():
    assert words_of("It&#39;s <b>re\xadmade</b>&nbsp;x_y p<3 É") == ["it", "s", "remade", "x", "y", "p", "3", "é"]


def test_repeated_and_missing_keys(spark):
    q = spark.createDataFrame([(5, "b1 b2 b3 b4 b5 b6 b7 b8"), (5, "a1 a2 a3 a4 a5 a6 a7 a8"), (None, "c1 c2 c3 c4 c5 c6 c7 c8")], "item_id bigint, text string")
    d = spark.createDataFrame([(1, "a1 a2 a3 a4 a5 a6 a7 a8 c1 c2 c3 c4 c5 c6 c7 c8 b1 b2 b3 b4 b5 b6 b7 b8")], "doc_id bigint, text string")
    assert [(r.item_id, r.doc_id, r.at_word) for r in find_leaks(d, "doc_id", "text", q, "item_id", "text").collect()] == [(5, 1, 0)]
