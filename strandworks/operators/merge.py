"""Merging knowledge graphs: coercion, exact and fuzzy collapse, count filters, degrees.

Triples are rows ``source, target, relation, weight, combined_degree, text_unit_ids, ord``;
``ord`` is the explicit order by which "first" is decided, as shuffles keep none.
"""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandworks.functions.text import entity_key, norm_relation, split_ids
from strandworks.runtime import Workspace, renamed, sizes_of, skew_lookup, trim_all


def number(c: Column) -> Column:
    """NaN counts as missing."""
    return F.when(~F.isnan(c), c)


def coerce_triples(df: DataFrame, ordinal: str, rank: int = 0) -> DataFrame:
    """Canonical triples from a table that may lack columns.

    Names are trimmed and lower case; relation may be called description; a missing weight is 1.0,
    a missing degree null; ids come from text_unit_ids or source_id, as comma text or array. ``rank``
    orders whole tables.
    """
    have = set(df.columns)
    for needed in ("source", "target"):
        if needed not in have:
            raise ValueError(f"column {needed} is missing")
    if not have & {"relation", "description"}:
        raise ValueError("neither relation nor description is there")
    relation = F.col("relation" if "relation" in have else "description")
    ids = next((F.col(c) for c in ("text_unit_ids", "source_id") if c in have), F.lit(""))
    if isinstance(ids, Column) and any(f.name in ("text_unit_ids", "source_id") and f.dataType.typeName() == "array" for f in df.schema):
        ids = F.array_join(ids, ",")
    return df.select(
        F.lower(F.coalesce(trim_all(F.col("source").cast("string")), F.lit(""))).alias("source"),
        F.lower(F.coalesce(trim_all(F.col("target").cast("string")), F.lit(""))).alias("target"),
        norm_relation(relation.cast("string")).alias("relation"),
        F.coalesce(number(F.col("weight").cast("double")), F.lit(1.0)).alias("weight") if "weight" in have else F.lit(1.0).alias("weight"),
        number(F.col("combined_degree").cast("double")).alias("combined_degree") if "combined_degree" in have else F.lit(None).cast("double").alias("combined_degree"),
        split_ids(ids).alias("text_unit_ids"),
        F.struct(F.lit(rank).alias("rank"), F.col(ordinal).cast("bigint").alias("n")).alias("ord"),
    )


def valid_triples(df: DataFrame) -> DataFrame:
    return df.filter("source <> '' AND target <> '' AND relation <> '' AND source <> target")


def collapse(df: DataFrame, keys: dict[str, Column], tie: str = "ord") -> DataFrame:
    """One triple per key: names of the row with most degree, then weight, then first; maxima; all ids.

    "First" is by ``tie``. ``place`` orders the results: by degree and weight of each one's best row,
    then its tie. Aggregates are partial before the shuffle, so a hot key moves one row per task; ids
    are made distinct before they are gathered.
    """
    best = F.struct((-F.coalesce("combined_degree", F.lit(-1.0))).alias("d"), (-F.col("weight")).alias("w"), F.col(tie).alias("o"))
    names = [f"_k{i}" for i in range(len(keys))]
    t = df.withColumns(dict(zip(names, keys.values()))).withColumn("_best", best)
    row = F.min_by(F.struct("source", "target", "relation", "ord"), "_best").alias("_b")
    out = t.groupBy(*names).agg(row, F.min("_best").alias("place"), F.max("weight").alias("weight"), F.max("combined_degree").alias("combined_degree"), F.count(F.lit(1)).alias("n_rows"))
    ids = t.select(*names, F.explode("text_unit_ids").alias("_id")).distinct().groupBy(*names).agg(F.sort_array(F.collect_list("_id")).alias("text_unit_ids"))
    out = out.join(ids, names, "left")  # both are partitioned by the keys
    return out.select("_b.source", "_b.target", "_b.relation", "weight", "combined_degree", F.coalesce("text_unit_ids", F.array().cast("array<string>")).alias("text_unit_ids"), "n_rows", F.col("_b.ord").alias("ord"), "place")


def fast_collapse(df: DataFrame) -> DataFrame:
    """Collapse on normal forms of names and relation."""
    return collapse(df, {"s": entity_key(F.col("source")), "r": norm_relation(F.col("relation")), "t": entity_key(F.col("target"))})


def ratio(a: str, b: str) -> float:
    return SequenceMatcher(None, a, b).ratio()


_BINS = 64


def _bins(text: str) -> np.ndarray:
    """How often each sign occurs, signs being hashed to bins: equal signs share one."""
    return np.bincount(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32) % _BINS, minlength=_BINS).astype(np.int16)


class _Bucket:
    """Names met so far in one bucket: representatives, and the canonical name of every member.

    A name joins the first representative that is similar enough. The shorter of the two becomes the
    canonical name of both and of all that had the other as theirs; ``closed`` moves every member of
    the representative along.
    """

    def __init__(self, threshold: float, closed: bool) -> None:
        self.threshold, self.closed = threshold, closed
        self.reps: list[tuple[str, str]] = []  # name and key
        self.signs, self.lengths = np.zeros((8, _BINS), dtype=np.int16), np.zeros(8, dtype=np.int64)
        self.canon: dict[str, str] = {}
        self.members: list[list[str]] = []  # names with the representative as canonical name; closed: all

    def add(self, name: str, key: str) -> None:
        n, mine = len(self.reps), _bins(key)
        longest = np.maximum(np.maximum(self.lengths[:n], len(key)), 1)
        near = (np.abs(self.lengths[:n] - len(key)) / longest <= 0.25) | (self.lengths[:n] == 0) | (len(key) == 0)
        # no text can be more similar than its signs allow
        both = np.minimum(self.signs[:n], mine).sum(axis=1)
        near &= 2.0 * both >= self.threshold * (self.lengths[:n] + len(key)) - 1e-9
        for i in np.flatnonzero(near).tolist():
            rep, other = self.reps[i]
            if ratio(key, other) >= self.threshold:
                break
        else:
            if n == len(self.lengths):
                self.signs, self.lengths = np.concatenate([self.signs, np.zeros_like(self.signs)]), np.concatenate([self.lengths, np.zeros_like(self.lengths)])
            self.signs[n], self.lengths[n] = mine, len(key)
            self.reps.append((name, key))
            self.canon[name] = name
            self.members.append([name])
            return
        if self.closed:
            best = self.canon[rep]
            best = best if len(best) <= len(name) else name
            self.members[i].append(name)
            self.canon |= dict.fromkeys(self.members[i], best) if best != self.canon[rep] else {name: best}
        elif len(rep) <= len(name):
            self.canon[name] = rep
            self.members[i].append(name)
        else:
            self.canon |= dict.fromkeys([*self.members[i], rep, name], name)
            self.members[i] = []


def _greedy(threshold: float, closed: bool):
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, bucket = None, _Bucket(threshold, closed)
        for part in parts:
            for b, name, key in zip(part["bucket"], part["name"], part["key"]):
                if b != at:
                    yield pd.DataFrame(list(bucket.canon.items()), columns=["name", "canonical"])
                    at, bucket = b, _Bucket(threshold, closed)
                bucket.add(name, key)
        yield pd.DataFrame(list(bucket.canon.items()), columns=["name", "canonical"])

    return run


def canonical_names(names: DataFrame, threshold: float = 0.90, closed: bool = False) -> DataFrame:
    """``(name, canonical)`` of distinct names, clustered greedily within (three letters, length // 5) buckets of their keys.

    A bucket is worked off in name order by one task, which holds its distinct names; pairs are
    compared sign by sign only where their lengths and their counts of signs allow the threshold.
    ``closed``: the map is closed, every name of a cluster gets the shortest one.
    """
    n = names.columns[0]
    t = names.select(F.col(n).alias("name")).filter("name is not null").distinct().withColumn("key", entity_key(F.col("name")))
    t = t.withColumn("bucket", F.concat_ws("\x1f", F.substring("key", 1, 3), F.floor(F.char_length("key") / 5).cast("string")))
    t = t.repartition("bucket").sortWithinPartitions("bucket", "name")
    return t.mapInPandas(_greedy(threshold, closed), "name string, canonical string")


def fuzzy_collapse(df: DataFrame, threshold: float = 0.90, closed: bool = False) -> DataFrame:
    """Collapse on canonical names; equals are ranked by their place in ``df``. May leave a triple whose ends became one name."""
    work = Workspace(df.sparkSession, "fuzzy")
    df = work.cut(df)  # read several times below
    ends = df.select(F.explode(F.array("source", "target")).alias("n"))
    canon = canonical_names(ends, threshold, closed)
    canon = work.cut(canon, **sizes_of(canon))
    t = skew_lookup(df, "source", renamed(canon, "_sn", "_s"), "_sn")
    t = skew_lookup(t, "target", renamed(canon, "_tn", "_t"), "_tn")
    t = t.withColumns({"source": F.coalesce("_s", "source"), "target": F.coalesce("_t", "target")}).drop("_s", "_t", "n_rows")
    return collapse(t.withColumnRenamed("place", "_before"), {"s": F.col("source"), "t": F.col("target"), "r": F.col("relation")}, "_before")


def whitelisted(df: DataFrame, vocabulary: DataFrame, relation: str = "relation") -> DataFrame:
    """Rows whose relation, in normal form, is in the vocabulary; further columns of the vocabulary come along."""
    v = vocabulary.dropDuplicates(["relation"])
    v = v.select(F.col("relation").alias("_allowed"), *[c for c in v.columns if c != "relation"])
    t = df.withColumn("_form", norm_relation(F.col(relation)))
    return t.join(v, F.col("_form") == F.col("_allowed")).withColumn(relation, F.col("_form")).drop("_form", "_allowed")


def union_of(tables: dict[str, DataFrame], columns: list[str], origin: str = "origin") -> DataFrame:
    """Rows of several tables under one set of columns, each with its table's name."""
    out = None
    for name, t in tables.items():
        t = t.select(*columns, F.lit(name).alias(origin))
        out = t if out is None else out.unionByName(t)
    return out


def name_sets(triples: DataFrame, names: DataFrame) -> DataFrame:
    """Names at the ends of triples against a list of names: numbers of common ones and of those on one side only."""
    t = triples.select(F.explode(F.array("source", "target")).alias("name")).distinct().withColumn("_t", F.lit(1))
    e = names.select(F.col(names.columns[0]).alias("name")).distinct().withColumn("_e", F.lit(1))
    there = lambda c: F.col(c).isNotNull()
    return t.join(e, "name", "full").agg(F.count_if(there("_t") & there("_e")).alias("both_sides"), F.count_if(~there("_e")).alias("only_triples"), F.count_if(~there("_t")).alias("only_entities"))


def distinct_pairs(df: DataFrame) -> DataFrame:
    """Distinct (source, target) pairs per relation."""
    return df.groupBy("relation").agg(F.countDistinct("source", "target").alias("pairs"))


def frequent_relations(df: DataFrame, least: int = 80) -> DataFrame:
    """Triples whose relation has at least ``least`` distinct pairs."""
    keep = distinct_pairs(df).filter(F.col("pairs") >= least).select("relation")
    return df.join(keep, "relation", "left_semi")


def removed_relations(df: DataFrame, least: int = 80) -> DataFrame:
    """``(relation, pairs)`` of the relations that ``frequent_relations`` leaves out."""
    return distinct_pairs(df).filter(F.col("pairs") < least)


def first_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of every key in an explicit order."""
    cols = df.columns
    best = F.min_by(F.struct(*cols), F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])).alias("_b")
    return df.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(best).select("_b.*")


def degrees(df: DataFrame) -> DataFrame:
    """In plus out degree over distinct edges."""
    edges = df.select("source", "target").distinct()
    return edges.select(F.explode(F.array("source", "target")).alias("title")).groupBy("title").agg(F.count(F.lit(1)).alias("degree"))


def combined_degrees(df: DataFrame) -> DataFrame:
    """Sum of both ends' degrees per distinct edge; ends of high degree are looked up without gathering their edges."""
    work = Workspace(df.sparkSession, "degrees")
    edges = work.cut(df.select("source", "target").distinct())
    d = edges.select(F.explode(F.array("source", "target")).alias("title")).groupBy("title").agg(F.count(F.lit(1)).alias("degree"))
    d = work.cut(d, **sizes_of(d))
    t = skew_lookup(edges, "source", renamed(d, "_s", "ds"), "_s")
    t = skew_lookup(t, "target", renamed(d, "_t", "dt"), "_t")
    return t.select("source", "target", (F.coalesce("ds", F.lit(0)) + F.coalesce("dt", F.lit(0))).alias("combined_degree"))


def relation_counts(df: DataFrame, vocabulary: DataFrame | None = None) -> DataFrame:
    """Rows per relation; with a vocabulary, of each of its relations, also those with none."""
    counts = df.groupBy("relation").agg(F.count(F.lit(1)).alias("n"))
    if vocabulary is None:
        return counts
    v = vocabulary.select(F.col(vocabulary.columns[0]).alias("relation")).distinct()
    return v.join(counts, "relation", "left").select("relation", F.coalesce("n", F.lit(0)).alias("n"))


def merge_graphs(new: DataFrame, old: DataFrame | None, ordinal: str, threshold: float | None = 0.90, least: int = 80, closed: bool = False) -> DataFrame:
    """Old and new triples merged: coercion, exact collapse, fuzzy collapse, frequent relations.

    Either collapse leaves every (source, target, relation) once, so no further pass makes them distinct.
    ``place`` is the order in which results are numbered.
    """
    t = coerce_triples(new, ordinal, 1)
    if old is not None:
        t = coerce_triples(old, ordinal, 0).unionByName(t)
    t = fast_collapse(valid_triples(t)).drop("n_rows")
    if threshold is not None:
        t = fuzzy_collapse(t, threshold, closed)
    t = frequent_relations(t, least)
    return t.select("source", "target", "relation", "weight", "combined_degree", F.array_join("text_unit_ids", ",").alias("text_unit_ids"), F.sha2(F.concat_ws("\x1f", "source", "target", "relation"), 256).alias("id"), "place")


def numbered(df: DataFrame, order: list[str], name: str = "human_readable_id") -> DataFrame:
    """Dense numbers from 0 in a total order, without gathering the table in one task.

    Rows are range-partitioned by the order; each partition's rank is offset by the sizes of the
    ones before it (one number per partition is all that is gathered).
    """
    work = Workspace(df.sparkSession, "numbered")
    t = work.cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()))
    sizes = t.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_before"))
    rank = F.row_number().over(Window.partitionBy("_p").orderBy(*order))
    return t.withColumn("_r", rank).join(F.broadcast(before), "_p").withColumn(name, F.col("_before") + F.col("_r") - 1).drop("_p", "_r", "_before")
