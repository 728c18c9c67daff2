"""Evaluation analytics over long verdict tables ``(item_id, k_hops, model, verdict)``.

Verdicts are yes, no, error, n/a or null. "Answered" means yes or no.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def verdict(predicted: Column, gold: Column) -> Column:
    return F.when(predicted.isNull(), "error").when(predicted == gold, "yes").otherwise("no")


def to_long(df: DataFrame, item: str, hops: str, prefix: str = "correctness_") -> DataFrame:
    """Wide results, one column per model found by its prefix, as rows."""
    models = sorted(c for c in df.columns if c.startswith(prefix))
    if not models:
        return df.select(F.col(item).alias("item_id"), F.col(hops).alias("k_hops"), F.lit("").alias("model"), F.lit("").alias("verdict")).limit(0)
    t = df.select(item, hops, *[F.col(m).cast("string") for m in models]).unpivot([item, hops], models, "model", "verdict")
    return t.select(F.col(item).alias("item_id"), F.col(hops).alias("k_hops"), F.substring("model", F.lit(len(prefix) + 1), F.length("model")).alias("model"), F.lower(F.trim("verdict")).alias("verdict"))


def answered(df: DataFrame) -> DataFrame:
    return df.filter(F.col("verdict").isin("yes", "no"))


def accuracy(df: DataFrame) -> DataFrame:
    """Accuracy per model over all items (k_hops null) and per hop; errors count in the total, n/a does not."""
    t = df.filter(F.col("verdict").isNull() | (F.col("verdict") != "n/a"))
    g = t.groupingSets([["model"], ["model", "k_hops"]], "model", "k_hops")
    out = g.agg(F.grouping("k_hops").alias("all_hops"), F.count(F.lit(1)).alias("total"), F.count_if(F.col("verdict") == "yes").alias("correct"))
    return out.withColumn("accuracy", F.try_divide("correct", "total"))


def coverage(df: DataFrame) -> DataFrame:
    """Answered, right and accuracy among the answered, per model."""
    g = df.groupBy("model").agg(F.count_if(F.col("verdict").isin("yes", "no")).alias("answered"), F.count_if(F.col("verdict") == "yes").alias("correct"), F.count_if(F.col("verdict") == "no").alias("wrong"))
    return g.withColumn("accuracy", F.try_divide("correct", "answered"))


def complete_models(df: DataFrame) -> DataFrame:
    """Rows of models that answered every item."""
    n = df.agg(F.countDistinct("item_id").alias("_n"))
    full = answered(df).groupBy("model").agg(F.countDistinct("item_id").alias("_a")).join(F.broadcast(n)).filter("_a = _n").select("model")
    return df.join(full, "model", "left_semi")


def pairs(df: DataFrame, by_hop: bool = False) -> DataFrame:
    """Rows of two models for the items both answered: ``a, b, k_hops, wrong_a, wrong_b``."""
    t = answered(df).select("item_id", "k_hops", "model", (F.col("verdict") == "no").alias("wrong"))
    a = t.select("item_id", "k_hops", F.col("model").alias("a"), F.col("wrong").alias("wrong_a"))
    b = t.select("item_id", F.col("model").alias("b"), F.col("wrong").alias("wrong_b"))
    return a.join(b, "item_id").filter("a < b")


def error_overlap(df: DataFrame, by_hop: bool = False) -> DataFrame:
    """Common and own errors of every pair of models, Jaccard index and overlap, 0 without errors."""
    keys = ["a", "b", *(["k_hops"] if by_hop else [])]
    g = pairs(df).groupBy(*keys).agg(
        F.count_if(F.col("wrong_a") & F.col("wrong_b")).alias("both_wrong"),
        F.count_if(F.col("wrong_a") & ~F.col("wrong_b")).alias("only_a"),
        F.count_if(~F.col("wrong_a") & F.col("wrong_b")).alias("only_b"),
    )
    g = g.withColumn("jaccard", F.coalesce(F.try_divide(F.col("both_wrong"), F.col("both_wrong") + F.col("only_a") + F.col("only_b")), F.lit(0.0)))
    if by_hop:
        return g
    return g.withColumn("overlap", F.coalesce(F.try_divide(F.col("both_wrong"), F.col("both_wrong") + F.least("only_a", "only_b")), F.lit(0.0)))


def agreement(df: DataFrame) -> DataFrame:
    """Share of equal verdicts among the items both models answered."""
    return pairs(df).groupBy("a", "b").agg(F.count(F.lit(1)).alias("items"), F.avg((F.col("wrong_a") == F.col("wrong_b")).cast("int")).alias("agreement"))


def difficulty(df: DataFrame) -> DataFrame:
    """Items by the number of models that were wrong, overall (k_hops null) and per hop."""
    per = answered(df).groupBy("item_id", "k_hops").agg(F.count_if(F.col("verdict") == "no").alias("models_wrong"))
    g = per.groupingSets([["models_wrong"], ["models_wrong", "k_hops"]], "models_wrong", "k_hops")
    return g.agg(F.grouping("k_hops").alias("all_hops"), F.count(F.lit(1)).alias("items"))


def universal(df: DataFrame) -> DataFrame:
    """Items that all models got wrong, all got right, and the rest."""
    per = answered(df).groupBy("item_id").agg(F.bool_and(F.col("verdict") == "no").alias("w"), F.bool_and(F.col("verdict") == "yes").alias("r"))
    return per.agg(F.count_if("w").alias("all_wrong"), F.count_if("r").alias("all_right"), F.count_if(~F.col("w") & ~F.col("r")).alias("contested"))


def unique_errors(df: DataFrame) -> DataFrame:
    """Items that only this model got wrong, with their share of its errors, per model and hop."""
    t = answered(df).withColumn("wrong", (F.col("verdict") == "no").cast("int"))
    n = t.groupBy("item_id").agg(F.sum("wrong").alias("_n"))
    g = t.filter("wrong = 1").join(n, "item_id").groupBy("model", "k_hops").agg(F.count_if(F.col("_n") == 1).alias("unique_errors"), F.count(F.lit(1)).alias("errors"))
    return g.withColumn("share", F.try_divide("unique_errors", "errors"))


def gains(df: DataFrame, step: Column) -> DataFrame:
    """Gains, regressions and net change from each checkpoint to the next, over all items (k_hops null) and per hop."""
    order = df.select("model", step.alias("step")).distinct().filter("step is not null")
    # one row per checkpoint
    order = order.withColumn("rank", F.dense_rank().over(Window.orderBy("step")))
    t = answered(df).join(order, "model").select("item_id", "k_hops", "rank", "step", (F.col("verdict") == "yes").alias("right"))
    prev = t.select("item_id", (F.col("rank") + 1).alias("rank"), F.col("right").alias("before"))
    g = t.join(prev, ["item_id", "rank"]).groupingSets([["step"], ["step", "k_hops"]], "step", "k_hops")
    g = g.agg(F.grouping("k_hops").alias("all_hops"), F.count_if(~F.col("before") & F.col("right")).alias("gains"), F.count_if(F.col("before") & ~F.col("right")).alias("regressions"))
    return g.withColumn("net", F.col("gains") - F.col("regressions"))


def best_and_worst(df: DataFrame) -> DataFrame:
    """Models of highest and lowest accuracy; the first name on ties."""
    c = coverage(df)
    best = F.min_by("model", F.struct(-F.col("accuracy"), F.col("model"))).alias("best_model")
    return c.filter("accuracy is not null").agg(best, F.min_by("model", F.struct("accuracy", "model")).alias("worst_model"))


def both_judges(df: DataFrame, first: Column, second: Column) -> DataFrame:
    """Rows that both judges accept."""
    return df.filter(F.coalesce(first, F.lit(False)) & F.coalesce(second, F.lit(False)))


def unanimous(votes: DataFrame, key: str, judges: int = 2) -> DataFrame:
    """Keys that exactly ``judges`` judges voted on, all in favour; votes in long form."""
    return votes.groupBy(key).agg(F.bool_and("accepted").alias("_all"), F.countDistinct("judge").alias("_n")).filter((F.col("_n") == judges) & F.col("_all")).select(key)


def percent(num: Column, den: Column) -> Column:
    """One decimal with a percent sign, N/A without a denominator."""
    return F.when(F.coalesce(den, F.lit(0)) == 0, "N/A").otherwise(F.format_string("%.1f%%", F.lit(100.0) * num / F.when(den != 0, den)))


def item_id(df: DataFrame, ordinal: str) -> Column:
    """First id column that is there and not null, else item_<n>."""
    have = [F.col(c).cast("string") for c in ("id", "item_id", "question_id", "idx", "index") if c in df.columns]
    return F.coalesce(*have, F.concat(F.lit("item_"), F.col(ordinal).cast("string")))
