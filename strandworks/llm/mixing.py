"""Mixing sources to target weights by pivotal dependent rounding.

Sizes are tokens of a public tokenizer. For a mix of T tokens each text of source s is wanted
c = T * share / available times (at most the source's cap); the whole part of c is certain, the
rest is a fractional copy probability. Dependent rounding pairs two fractional texts and
transfers mass between them at random, in inverse proportion to their sizes, until one is
integral: expectations and the source's total size stay as they are. Every partition rounds its
own texts and passes on at most one fractional text per source; these residuals meet in a
reduction tree of fan-in ``FAN``, and the very last one of a source is drawn by its probability.
A source's size so misses its target by less than one text.

Without a given total the largest one is taken that every source can fill within its cap.

Randomness is a hash of seed and keys: a task that is run again after a loss gives the same.

Defined results: null and empty texts have no tokens and 0 copies; texts without source, and
of sources without target, get 0 copies and no share; a target without any text is reported
with 0 tokens; repeated texts are texts of their own; an empty table gives no copies; further
columns are not read. One source may hold most rows: nothing is grouped by source without
pre-aggregation.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandworks.runtime import Workspace, collect_bounded, spread

#: Folder of the public tokenizers' files.
TOKENIZERS = "/opt/tokenizers"
#: Fixed value: how the byte-level vocabularies cut a text before their merges.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
FAN = 32
_EPSILON = 1e-9

_encoders: dict = {}


def encoder(path: str, pattern: str = PATTERN):
    """tiktoken encoder of a rank file; kept per worker."""
    if (path, pattern) not in _encoders:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encoders[path, pattern] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path, pattern]


def count_tokens(path: str, pattern: str = PATTERN):
    @F.pandas_udf("bigint")
    def token_count(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = encoder(path, pattern)
        for part in parts:
            yield pd.Series([0 if not t else len(enc.encode_ordinary(t)) for t in part], dtype="int64")

    return token_count


def draw(seed: int, *keys) -> float:
    """Number in [0, 1) fixed by seed and keys."""
    return xxhash.xxh64_intdigest("\x1f".join(map(str, keys)), seed=seed & 0xFFFFFFFF) / 2.0**64


def pair(seed: int, a: tuple, b: tuple) -> tuple[tuple, tuple]:
    """One transfer between two fractional units ``(key, size, p)``; one comes out integral."""
    (ka, wa, pa), (kb, wb, pb) = a, b
    up = min((1 - pa) * wa, pb * wb)
    down = min(pa * wa, (1 - pb) * wb)
    if draw(seed, ka, kb) * (up + down) < down:
        pa, pb = pa + up / wa, pb - up / wb
    else:
        pa, pb = pa - down / wa, pb + down / wb
    return (ka, wa, pa), (kb, wb, pb)


def _settled(p: float) -> bool:
    return p < _EPSILON or p > 1 - _EPSILON


def _round(seed: int, last: bool):
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        carry: dict[str, tuple] = {}
        for part in parts:
            rows = []
            for key, source, size, p in zip(part["key"].tolist(), part["source"].tolist(), part["tokens"].tolist(), part["p"].tolist()):
                unit = (key, size, p)
                if _settled(p):
                    rows.append((key, source, size, p))
                    continue
                if source in carry:
                    a, unit = pair(seed, carry.pop(source), unit)
                    for u in (a, unit):
                        if _settled(u[2]):
                            rows.append((u[0], source, u[1], float(u[2] > 0.5)))
                        else:
                            carry[source] = u
                else:
                    carry[source] = unit
            yield pd.DataFrame(rows, columns=["key", "source", "tokens", "p"])
        rest = [(k, s, w, float(draw(seed, k) < p) if last else p) for s, (k, w, p) in carry.items()]
        yield pd.DataFrame(rest, columns=["key", "source", "tokens", "p"])

    return run


class Mix:
    """``copies``: ``(key, source, tokens, copies)`` of every text; ``shares``: one row per target source."""

    def __init__(self, copies: DataFrame, shares: DataFrame) -> None:
        self.copies, self.shares = copies, shares


def mix_sources(docs: DataFrame, key: str, text: str, source: str, targets: DataFrame, total_tokens: int | None = None, tokenizer: str = f"{TOKENIZERS}/byte_bpe_50k.tiktoken", pattern: str = PATTERN, seed: int = 42, max_sources: int = 100_000) -> Mix:
    """``targets``: columns source, target_share, max_repeats."""
    spark = docs.sparkSession
    work = Workspace(spark, "mix")
    read = spread(docs.select(F.col(key).alias("key"), F.col(source).cast("string").alias("source"), F.col(text).cast("string").alias("text")))
    sized = work.cut(read.select("key", "source", count_tokens(tokenizer, pattern)("text").alias("tokens")))
    goals = {r.source: (r.target_share, r.max_repeats) for r in collect_bounded(targets.select("source", "target_share", "max_repeats").filter("source is not null and target_share > 0 and max_repeats > 0"), max_sources, "targets")}
    names = spark.createDataFrame([(s,) for s in goals], "s string")
    held = sized.filter("tokens > 0").join(F.broadcast(names), F.col("source") == F.col("s"), "left_semi").groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("texts"))
    have = {r.source: (r.tokens, r.texts) for r in collect_bounded(held, max_sources, "sources")}
    share = {s: goals[s][0] / sum(g for g, _ in goals.values()) for s in goals}
    limit = min((have[s][0] * goals[s][1] / share[s] for s in have), default=0.0)
    total = float(total_tokens) if total_tokens is not None else limit
    wanted = {s: min(total * share[s] / have[s][0], float(goals[s][1])) for s in have}
    plan = spark.createDataFrame([(s, c) for s, c in wanted.items()], "s string, wanted double")
    # at most max_sources rows
    planned = sized.join(F.broadcast(plan), F.col("source") == F.col("s"), "left").withColumn("wanted", F.when(F.col("tokens") > 0, F.coalesce("wanted", F.lit(0.0))).otherwise(F.lit(0.0)))
    whole = F.floor(F.col("wanted") + _EPSILON)
    planned = planned.withColumn("p", F.greatest(F.col("wanted") - whole, F.lit(0.0))).withColumn("whole", whole)
    fractional = F.col("p") >= _EPSILON
    kind = f"key {docs.schema[key].dataType.simpleString()}, source string, tokens bigint, p double"
    open_units = planned.filter(fractional).select("key", "source", "tokens", "p")
    done = planned.filter(~fractional).select("key", "source", "tokens", F.lit(0.0).alias("p"), "whole")
    settled = None
    parts = max(1, open_units.rdd.getNumPartitions())
    while True:
        last = parts == 1
        level = work.cut((open_units.coalesce(1) if last else open_units).mapInPandas(_round(seed, last), kind))
        integral = (F.col("p") < _EPSILON) | (F.col("p") > 1 - _EPSILON)
        now = level.filter(integral)
        settled = now if settled is None else settled.unionByName(now)
        if last:
            break
        open_units = level.filter(~integral)
        parts = -(-parts // FAN)
        open_units = open_units.repartition(parts, F.pmod(F.xxhash64("key"), F.lit(parts)))
    floor_of = spark.createDataFrame([(s, int(c + _EPSILON)) for s, c in wanted.items()], "s string, whole bigint")
    drawn = settled.join(F.broadcast(floor_of), F.col("source") == F.col("s"), "left").drop("s")
    copies = done.unionByName(drawn).select("key", "source", "tokens", (F.coalesce("whole", F.lit(0)) + F.round("p").cast("bigint")).alias("copies"))
    copies = work.cut(copies.select(F.col("key").alias(key), "source", "tokens", "copies"))
    per = copies.filter("copies > 0").groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("mixed_tokens"), F.max("copies").alias("most_copies"))
    goal = spark.createDataFrame([(s, share[s], goals[s][1], have.get(s, (0, 0))[0], have.get(s, (0, 0))[1], bool(total * share[s] > have.get(s, (0, 0))[0] * goals[s][1] * (1 + _EPSILON))) for s in sorted(goals)], "source string, target_share double, max_repeats int, available_tokens bigint, texts bigint, capped boolean")
    shares = goal.join(F.broadcast(per), "source", "left").na.fill({"mixed_tokens": 0, "most_copies": 0})
    sums = per.agg(F.sum("mixed_tokens").alias("all_tokens"))
    shares = shares.join(F.broadcast(sums)).select("source", "target_share", F.coalesce(F.col("mixed_tokens") / F.col("all_tokens"), F.lit(0.0)).alias("actual_share"), "mixed_tokens", "available_tokens", "texts", "most_copies", "max_repeats", "capped")
    return Mix(copies, shares)
