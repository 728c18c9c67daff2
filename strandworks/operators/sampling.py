"""Splits, samples, shards and ranks, all reproducible: order comes from explicit ordinals or hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def range_shard(ordinal: Column, rows: int) -> Column:
    return F.floor(ordinal / rows)


def shard_count(df: DataFrame, rows: int) -> DataFrame:
    """Number of shards of ``rows`` rows that a table needs."""
    return df.agg(F.ceil(F.count(F.lit(1)) / rows).cast("bigint").alias("shards"))


def modulo_shard(ordinal: Column, shards: int) -> Column:
    return F.pmod(ordinal, F.lit(shards))


def hash_order(key: Column, seed: int | None = None) -> list[Column]:
    """A fixed pseudo-random order; without a seed by md5, which other engines share."""
    text = key.cast("string")
    return [F.md5(text) if seed is None else F.xxhash64(text, F.lit(seed)), key]


def per_group(df: DataFrame, group: str, key: str, n: int, seed: int | None = None) -> DataFrame:
    """n rows of every group by hash order. The rank limit is applied before the shuffle as well."""
    w = Window.partitionBy(group).orderBy(*hash_order(F.col(key), seed))
    return df.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= n).drop("_k")


def sample_rows(df: DataFrame, key: str, n: int, seed: int | None = None) -> DataFrame:
    """n rows by hash order: a distributed top-k."""
    return df.orderBy(*hash_order(F.col(key), seed)).limit(n)


def first_rows(df: DataFrame, ordinal: str, n: int) -> DataFrame:
    """The n rows of the smallest ordinals, all if there are fewer; n of 0 and less means all: a distributed top-k."""
    return df.orderBy(ordinal).limit(n) if n > 0 else df


def last_rows(df: DataFrame, ordinal: str, n: int) -> DataFrame:
    """The n rows of the greatest ordinals, all if there are fewer; n of 0 and less means all."""
    return df.orderBy(F.col(ordinal).desc()).limit(n) if n > 0 else df


def requeued(df: DataFrame, key: str, target: int, attempts: int = 5, seed: str = "") -> DataFrame:
    """``(attempt, round, ...)``: the first ``attempts`` x ``target`` draws from a list that is shuffled anew whenever it is used up.

    Rows that were accepted are for the caller to skip; the work ends at the target or with the last draw.
    """
    from strandworks.operators.merge import numbered

    n, draws = df.count(), target * attempts
    rounds = -(-draws // n) if n else 0
    t = df.withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(max(rounds - 1, 0)))))
    t = t.withColumn("_order", F.md5(F.concat_ws("|", F.lit(seed), "round", F.col(key).cast("string"))))
    return numbered(t, ["round", "_order", key], "attempt").filter(F.col("attempt") < draws).drop("_order")


def uniform(key: Column, seed: int | None = None) -> Column:
    """A fixed pseudo-random number in (0, 1) of each key; without a seed from its md5, which other engines share."""
    if seed is None:
        return (F.conv(F.left(F.md5(key.cast("string")), F.lit(8)), 16, 10).cast("double") + 0.5) / float(2**32)
    return (F.pmod(F.xxhash64(key.cast("string"), F.lit(seed)), F.lit(2**53)) + 0.5) / float(2**53)


def weighted_sample(df: DataFrame, key: str, frequency: str, n: int, seed: int | None = 42) -> DataFrame:
    """n rows without replacement, weights 1 / (frequency + 1e-10): smallest exponential keys win."""
    u = uniform(F.col(key), seed)
    return df.withColumn("_e", -F.log(u) * (F.coalesce(F.col(frequency), F.lit(0)) + 1e-10)).orderBy("_e", key).limit(n).drop("_e")


def head_holdout(df: DataFrame, ordinal: str, ratio: float = 0.02, least: int = 200) -> DataFrame:
    """Marks the first min(least, max(1, ratio x n)) rows as evaluation; ordinals are dense from 0."""
    n = df.agg(F.count(F.lit(1)).alias("_n"))
    t = df.join(F.broadcast(n))
    held = F.least(F.lit(least), F.greatest(F.lit(1), F.floor(F.col("_n") * ratio)))
    return t.withColumn("is_eval", F.col(ordinal) < held).drop("_n")


def tail_holdout(df: DataFrame, ordinal: str, percent: int = 5) -> DataFrame:
    """Marks the last max(1, n x percent / 100) rows as evaluation."""
    n = df.agg(F.count(F.lit(1)).alias("_n"))
    t = df.join(F.broadcast(n))
    return t.withColumn("is_eval", F.col(ordinal) >= F.col("_n") - F.greatest(F.lit(1), F.floor(F.col("_n") * percent / 100))).drop("_n")


def percent_split(df: DataFrame, ordinal: str, percent: int = 5) -> DataFrame:
    """Marks the first percent of the rows as validation."""
    n = df.agg(F.count(F.lit(1)).alias("_n"))
    return df.join(F.broadcast(n)).withColumn("is_validation", F.col(ordinal) < F.floor(F.col("_n") * percent / 100)).drop("_n")


def random_split(df: DataFrame, key: str, test: float, seed: int | None = 42) -> DataFrame:
    """Marks about ``test`` of the rows by a hash of their key; independent of partitioning."""
    return df.withColumn("is_test", uniform(F.col(key), seed) < test)


def interleave(tables: list[DataFrame], ordinal: str) -> DataFrame:
    """Round-robin order of several tables by (row, table); shorter ones simply end."""
    out = None
    for i, t in enumerate(tables):
        t = t.withColumns({"_round": F.col(ordinal), "_table": F.lit(i)})
        out = t if out is None else out.unionByName(t)
    return out.orderBy("_round", "_table")


def checkpoint_step(name: Column) -> Column:
    """Number at the end of a checkpoint's name, null without one."""
    return F.nullif(F.regexp_extract(name, r"checkpoint-(\d+)$", 1), F.lit("")).try_cast("int")
