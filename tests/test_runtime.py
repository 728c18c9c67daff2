from pyspark.sql import functions as F

from strandworks import runtime as R


def test_lookup_ways_agree(spark, monkeypatch):
    work = R.Workspace(spark, "test")
    big = work.cut(spark.range(5000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 900)).alias("k"), F.col("id").alias("v")).unionByName(spark.createDataFrame([(None, -1)], "k string, v bigint")))
    small = work.cut(big.filter("k is not null and k <> 'k7'").select(F.col("k").alias("s"), F.length("k").alias("n")).distinct())
    assert R.fits_broadcast(small) and not R.fits_broadcast(small, rows=10) and not R.fits_broadcast(small, size=10)
    for how in ("left", "inner"):
        want = sorted(map(str, R.skew_lookup(big, "k", small, "s", how).collect()))
        monkeypatch.setattr(R, "fits_broadcast", lambda df: False)
        assert sorted(map(str, R.skew_lookup(big, "k", small, "s", how, share=0.01).collect())) == want
        assert sorted(map(str, R.skew_lookup(big, "k", small, "s", how, share=0.9).collect())) == want
        monkeypatch.undo()
    assert [r[0] for r in R.heavy_keys(big, "k", 0.1).collect()] == ["hot"]
    assert R.spread(spark.range(10).coalesce(1)).rdd.getNumPartitions() > 1


def test_trim(spark):
    text = " \t a b  \n"
    assert spark.createDataFrame([(text,)], "t string").select(R.trim_all(F.col("t"))).first()[0] == "a b"


def test_scratch(spark):
    import os

    with R.scratch():
        kept = R.Workspace(spark, "scratch").cut(spark.range(3), n=F.count(F.lit(1)))
        path = kept._work_path.removeprefix("file:")
        assert kept.count() == 3 and kept._observed == {"n": 3} and os.path.exists(path.replace("///", "/"))
    assert not os.path.exists(path.replace("///", "/"))
    t = R.Workspace(spark, "sizes")
    written = t.cut(spark.range(5).select(F.lit("ab").alias("s")), **R.sizes_of(spark.range(5).select(F.lit("ab").alias("s"))))
    assert written._observed == {"_rows": 5, "_bytes": 10} and R.fits_broadcast(written) and not R.fits_broadcast(written, rows=4) and not R.fits_broadcast(R.renamed(written, "x"), size=9)
