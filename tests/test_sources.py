import json

import pytest
from pyspark.sql import functions as F

from strandworks.functions.scoring import judged_by_all, recover, score, with_retry
from strandworks.sources import tables as S
from strandworks.streaming.incremental import merge_stream, windowed_counts


def test_text(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.txt").write_text("one\ntwo\n")
    (tmp_path / "b.txt").write_text("drei")
    (tmp_path / "c.md").write_text("no")
    (tmp_path / "sub" / "d.txt").write_text("x " * 30)
    t = S.read_text_files(spark, str(tmp_path))
    assert sorted(r.doc_id for r in t.collect()) == ["a.txt", "b.txt", "d.txt"]
    lines = S.read_text_lines(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, lines)) == [("a.txt", 0, "one"), ("a.txt", 1, "two"), ("b.txt", 0, "drei")]
    chunks = S.chunk_texts(t, "doc_id", "text", 10, 2).filter("doc_id = 'd.txt'").orderBy("ordinal").collect()
    assert [c.n_words for c in chunks] == [10, 10, 10, 6]
    with pytest.raises(ValueError):
        S.read_text_lines(spark, str(tmp_path / "sub")).count() if (tmp_path / "sub" / "d.txt").unlink() is None else None


def test_triples(spark, tmp_path):
    df = spark.createDataFrame([("a", "r", 'b "q", x', ["u", "v"])], "head string, relation string, tail string, ids array<string>")
    S.write_csv(df, str(tmp_path / "t.csv"))
    r = S.read_triples(spark, str(tmp_path / "t.csv")).collect()[0]
    assert (r.source, r.target, r.ids) == ("a", 'b "q", x', "u,v")
    df.write.parquet(str(tmp_path / "t.parquet"))
    assert set(S.read_triples(spark, str(tmp_path / "t.parquet")).columns) == {"source", "relation", "target", "ids"}


def test_json_and_shards(spark, tmp_path):
    (tmp_path / "x.json").write_text(json.dumps([{"a": 1}, {"a": 2}]))
    (tmp_path / "y.json").write_text(json.dumps({"a": 3}))
    assert sorted(r.a for r in S.read_json_array(spark, S.resolve_inputs(str(tmp_path))).collect()) == [1, 2, 3]
    d = tmp_path / "shards"
    d.mkdir()
    (d / "p_exploded_0.csv").write_text("head,tail\na,b\n")
    (d / "p_exploded_1.csv").write_text("head,tail\nc,d\n")
    (d / "p_queries_0.csv").write_text("head,tail\nx,y\n")
    assert sorted(r.head for r in S.read_shards(spark, str(d)).collect()) == ["a", "c"]
    r = tmp_path / "resp"
    r.mkdir()
    (r / "responses_10-12.json").write_text(json.dumps(["p", "q"]))
    assert sorted(map(tuple, S.read_responses(spark, str(r)).collect())) == [(10, "p"), (11, "q")]
    S.append_json_lines(spark.range(2), str(tmp_path / "log"))
    S.append_json_lines(spark.range(2), str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 4
    S.write_counts(spark.createDataFrame([("b", 2), ("a", 2), ("c", 5)], "relation string, n int"), str(tmp_path / "counts"))
    assert [x.value for x in spark.read.text(str(tmp_path / "counts")).collect()] == ["c\t5", "a\t2", "b\t2"]
    done = spark.createDataFrame([(1,)], "id bigint")
    assert [x.id for x in S.remaining(spark.range(3), done, ["id"]).orderBy("id").collect()] == [0, 2]
    assert len(spark.range(1).select(S.run_tag(F.array(F.lit("b"), F.lit("a"))).alias("t")).collect()[0].t) == 10


def test_new_sinks(spark, tmp_path):
    df = spark.createDataFrame([(2, "b", None), (1, 'a "x"', 1.5), (3, None, 2.0)], "n int, s string, w double")
    S.write_json_array(df, str(tmp_path / "array"), ["n"])
    files = [p for p in (tmp_path / "array").iterdir() if p.name.startswith("part")]
    assert len(files) == 1 and json.loads(files[0].read_text()) == [{"n": 1, "s": 'a "x"', "w": 1.5}, {"n": 2, "s": "b", "w": None}, {"n": 3, "s": None, "w": 2.0}]
    S.write_json_array(df.limit(0), str(tmp_path / "none"), ["n"])
    assert json.loads(next(p for p in (tmp_path / "none").iterdir() if p.name.startswith("part")).read_text()) == []
    for k in (0, 10):
        spark.range(k, k + 2).write.parquet(str(tmp_path / "chunks" / f"chunk_{k}"))
    assert sorted(map(tuple, S.read_chunks(spark, str(tmp_path / "chunks")).collect())) == [(0, 0), (1, 0), (10, 10), (11, 10)]
    seen = []

    def work(t):
        seen.append(t.count())
        return t.withColumn("r", F.lit("x"))

    S.resume(df.filter("n < 3"), str(tmp_path / "done"), ["n"], work)
    assert S.resume(df, str(tmp_path / "done"), ["n"], work).count() == 3 and seen == [2, 1]
    S.write_csv(spark.createDataFrame([(" a ", 1.0)], "source string, weight double"), str(tmp_path / "typed.csv"))
    assert tuple(S.read_triples(spark, str(tmp_path / "typed.csv"), "source string, weight double").first()) == (" a ", 1.0)
    S.write_statistics(df.agg(F.count(F.lit(1)).alias("rows")), str(tmp_path / "stats"))
    assert spark.read.json(str(tmp_path / "stats")).first().rows == 3


def _upper():
    return lambda prompts: [p.upper() if p else None for p in prompts]


def _judge(letter):
    return lambda: lambda prompts: ["Yes" if letter in p else "no" for p in prompts]


def test_scoring(spark):
    df = spark.createDataFrame([(i, p) for i, p in enumerate(["ab", "a", "b", ""])], "i int, p string")
    assert {r.i: r.out for r in score(df, "p", "out", _upper, 2).collect()} == {0: "AB", 1: "A", 2: "B", 3: None}
    assert [r.i for r in judged_by_all(df, "p", [_judge("a"), _judge("b")]).collect()] == [0]
    t = df.withColumn("reply", F.lit("?")).withColumn("parsed", F.when(F.col("i") > 1, "x"))
    assert {r.i: r.reply for r in recover(t, "p", "reply", "parsed", _upper).collect()} == {0: "AB", 1: "A", 2: "?", 3: "?"}
    calls = []

    def flaky(prompts):
        calls.append(1)
        if len(calls) < 3:
            raise RuntimeError
        return prompts

    waits = []
    assert with_retry(flaky, sleep=waits.append)(["a"]) == ["a"] and waits == [4.0, 8.0]
    with pytest.raises(RuntimeError):
        with_retry(lambda p: 1 / 0 if p == 1 else (_ for _ in ()).throw(RuntimeError()), 2, sleep=waits.append)(["a"])


def test_stream(spark, tmp_path):
    src = tmp_path / "src"
    schema = "source string, target string, relation string, weight double, n bigint"
    spark.createDataFrame([("A-b", "c", "feeds", 2.0, 1), ("x", "y", "feeds", 1.0, 2)], schema).coalesce(1).write.parquet(str(src))
    spark.createDataFrame([("a b", "C", "Feeds", 5.0, 3), ("q", "q", "feeds", 1.0, 4)], schema).coalesce(1).write.mode("append").parquet(str(src))
    q = merge_stream(spark, str(src), spark.read.parquet(str(src)).schema, str(tmp_path / "out"), str(tmp_path / "ck"), "n")
    q.awaitTermination(120)
    last = spark.read.parquet(str(tmp_path / "out" / "v1")).collect()
    assert sorted((r.relation, r.weight) for r in last) == [("feeds", 1.0), ("feeds", 5.0)]
    static = spark.sql("SELECT timestamp'2024-01-01 01:00:00' AS ts, 'r' AS relation")
    assert windowed_counts(static, "ts").collect()[0].n == 1
