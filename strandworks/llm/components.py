"""Consolidating pairwise matches into groups: deterministic Borůvka hooking.

Every component selects its smallest outgoing edge. Edges are ordered by (smaller end,
greater end); a component's smallest edge then leads to its smallest neighbour, so one
pre-aggregated ``min`` per component selects it. The selected edges form trees whose only
cycles are two components that chose each other; the smaller of them becomes the root.
Trees collapse by pointer doubling, edges are relabelled by the roots and deduplicated, and
rounds repeat until no edge is left, at most log2 of the number of names.

Along a pointer chain every second step never grows (the neighbour of a component's
smallest neighbour is the component itself or smaller), so a chain ends in the smaller root
of its tree and this is the tree's smallest name. The final label is therefore the smallest
name of the whole group in code-point order, without a further aggregation.

Defined results: null ends, and pairs of one name with itself, link nothing and give no row;
repeated and reversed pairs count once; an empty input gives an empty result. Any other
column is ignored. A hub that holds a third of all pairs is split by ``skew_lookup``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandworks.runtime import Workspace, fits_broadcast, renamed, sizes_of, skew_lookup


def connected_groups(pairs: DataFrame, source: str, target: str) -> DataFrame:
    """``(member, group_name)``: one row per linked name with the smallest name of its group."""
    spark = pairs.sparkSession
    work = Workspace(spark, "components")
    a, b = F.col(source).cast("string"), F.col(target).cast("string")
    edges = pairs.filter(a.isNotNull() & b.isNotNull() & (a != b)).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()
    edges = work.cut(edges, n=F.count(F.lit(1)))
    maps: list[DataFrame] = []
    while edges._observed.get("n", 0):
        roots = _collapse(work, _hook(edges))
        maps.append(roots)
        ends = skew_lookup(edges, "a", renamed(roots, "ca", "ra"), "ca", "inner").select("ra", "b")
        if not fits_broadcast(roots):  # the second lookup reads its input more than once
            ends = work.cut(ends)
        out = skew_lookup(ends, "b", renamed(roots, "cb", "rb"), "cb", "inner")
        out = out.filter("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct()
        relabelled = work.cut(out, n=F.count(F.lit(1)))
        work.drop(edges, ends)
        edges = relabelled
    if not maps:
        return spark.createDataFrame([], "member string, group_name string")
    top = maps.pop()
    while maps:  # each map is a fraction of the one below it
        below = maps.pop()
        joined = skew_lookup(below, "p", renamed(top, "cc", "root"), "cc", "left").select("c", F.coalesce("root", "p").alias("p"))
        merged = work.cut(joined, **sizes_of(joined))
        work.drop(below, top)
        top = merged
    return renamed(top, "member", "group_name")


def _hook(edges: DataFrame) -> DataFrame:
    """Each component's end of its smallest outgoing edge."""
    both = edges.select(F.explode(F.array(F.struct(F.col("a").alias("c"), F.col("b").alias("o")), F.struct(F.col("b").alias("c"), F.col("a").alias("o")))).alias("e")).select("e.c", "e.o")
    return both.groupBy("c").agg(F.min("o").alias("p"))


def _collapse(work: Workspace, hooks: DataFrame) -> DataFrame:
    """Pointer doubling until every component points at its root."""
    at = work.cut(hooks, **sizes_of(hooks))
    while True:
        # a pair that chose each other: the smaller becomes a root
        step = skew_lookup(at, "p", renamed(at, "q", "g"), "q", "inner")
        step = step.select("c", F.when(F.col("g") == F.col("c"), F.least("c", "p")).otherwise(F.col("g")).alias("n"), (F.col("g") != F.col("p")).alias("moved"))
        doubled = work.cut(step, moves=F.count_if("moved"), **sizes_of(step.select("c", "n")))
        work.drop(at)
        at = renamed(doubled.select("c", "n"), "c", "p")
        at._work_path, at._observed = doubled._work_path, doubled._observed
        if not at._observed.get("moves", 0):
            return at
