"""Graph operators as joins over edge tables: distances, hubs, constrained paths, inverses.

No edge is ever gathered: the one driver-side loop is the breadth-first search, whose rounds
are cut by written tables, and it reads nothing back but whether a frontier is empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandworks.runtime import Workspace, renamed, sizes_of, skew_lookup, trim_all

#: Distance that stands for "unreachable" in dense matrices.
UNREACHABLE = 510


def undirected(df: DataFrame, a: str = "source", b: str = "target") -> DataFrame:
    """Distinct pairs in both directions of trimmed lower-case names, without loops."""
    t = df.select(F.lower(trim_all(F.col(a))).alias("a"), F.lower(trim_all(F.col(b))).alias("b")).filter("a <> '' AND b <> '' AND a <> b")
    return t.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.a", "e.b").distinct()


def hop_distances(edges: DataFrame, seeds: DataFrame, node: str, max_rounds: int | None = None) -> DataFrame:
    """``(node, hop_distance)`` to the nearest seed by one search from all seeds at once; null if unreachable.

    The search goes on until it reaches no further node; if ``max_rounds`` do not suffice, it raises.
    """
    work = Workspace(edges.sparkSession, "hops")
    e = work.cut(undirected(edges))
    nodes = e.select(F.col("a").alias("node")).distinct()
    start = seeds.select(F.lower(trim_all(F.col(node))).alias("node")).distinct()
    frontier = work.cut(nodes.join(start, "node", "left_semi").withColumn("d", F.lit(0)))
    levels = [frontier]
    for d in count(1):
        reached = e.join(frontier.select(F.col("node").alias("a")), "a", "left_semi").select(F.col("b").alias("node")).distinct()
        # edges lead both ways, so a neighbour of a level lies on it, on the one before or on the next
        seen = frontier.select("node") if d == 1 else frontier.select("node").unionByName(levels[-2].select("node"))
        frontier = work.cut(reached.join(seen, "node", "left_anti").withColumn("d", F.lit(d)), n=F.count(F.lit(1)))
        if not frontier._observed.get("n", 0):
            break
        if max_rounds is not None and d > max_rounds:
            raise ValueError(f"hop distances: nodes further away than {max_rounds} hops; raise max_rounds")
        levels.append(frontier)
    found = levels[0]
    for x in levels[1:]:
        found = found.unionByName(x)
    out = nodes.join(found, "node", "left").select("node", F.col("d").alias("hop_distance"))
    return work.cut(out, **sizes_of(out))


def triple_hops(triples: DataFrame, distances: DataFrame) -> DataFrame:
    """Each triple with the smaller distance of its ends; null if neither is reachable. Frequent names are not gathered.

    ``distances``: node and hop_distance.
    """
    t = triples.withColumns({"_a": F.lower(trim_all(F.col("source"))), "_b": F.lower(trim_all(F.col("target")))})
    t = skew_lookup(t, "_a", renamed(distances, "_x", "_dx"), "_x")
    t = skew_lookup(t, "_b", renamed(distances, "_y", "_dy"), "_y")
    return t.withColumn("hop_distance", F.least("_dx", "_dy")).drop("_a", "_b", "_dx", "_dy")


def within_hops(df: DataFrame, least: int, most: int, distance: str = "hop_distance") -> DataFrame:
    """Rows whose distance is a whole number within the range."""
    return df.filter(F.col(distance).cast("string").try_cast("int").between(least, most))


def hop_histogram(df: DataFrame, distance: str = "hop_distance") -> DataFrame:
    """Rows per distance; null counts the unreachable ones."""
    return df.groupBy(distance).agg(F.count(F.lit(1)).alias("n"))


def hubs(degrees: DataFrame, share: float = 0.01) -> DataFrame:
    """The names of highest degree: ``share`` of all, at least one; ties by name. A top-k, not a full sort."""
    n = degrees.count()
    return degrees.orderBy(F.col("degree").desc(), "title").limit(max(1, int(n * share)))


def _walk(triples: DataFrame, starts: DataFrame, k: int, excepted: str, hub_names: DataFrame, beam: int | None = None, seed: str = "") -> DataFrame:
    """``(start, at, nodes, relations, used)`` of all paths, or of at most ``beam`` per start and hop."""
    e = triples.select("source", "relation", "target").distinct()
    hub = hub_names.select(F.col(hub_names.columns[0]).alias("_h"), F.lit(1).alias("_is"))
    edges = e.join(hub, e.target == hub["_h"], "left").select("source", "relation", "target", F.coalesce("_is", F.lit(0)).alias("cost_t")).withColumn("cost", F.col("cost_t") + (F.col("relation") == excepted).cast("int"))
    s = starts.select(F.col(starts.columns[0]).alias("start")).distinct()
    s = s.join(hub, s.start == hub["_h"], "left").select("start", F.coalesce("_is", F.lit(0)).alias("used"))
    near = e.select(F.col("source").alias("start"), F.col("target").alias("_near")).distinct()
    paths = s.select("start", F.col("start").alias("at"), F.array("start").alias("nodes"), F.array().cast("array<string>").alias("relations"), "used")
    for hop in range(1, k + 1):
        step = edges.select(F.col("source").alias("at"), "relation", F.col("target").alias("to"), "cost")
        paths = paths.join(step, "at").filter((F.col("used") + F.col("cost") <= 1) & ~F.array_contains("nodes", F.col("to")))
        if hop > 1:
            paths = paths.join(near.withColumnRenamed("_near", "to"), ["start", "to"], "left_anti")
        paths = paths.select("start", F.col("to").alias("at"), F.concat("nodes", F.array("to")).alias("nodes"), F.concat("relations", F.array("relation")).alias("relations"), (F.col("used") + F.col("cost")).alias("used"))
        if beam and hop < k:
            w = Window.partitionBy("start").orderBy(_path_order(seed), "nodes", "relations")
            paths = paths.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= beam).drop("_r")
    return paths


def _path_columns(k: int) -> list:
    out = ["start"] + [F.element_at("relations", i + 1).alias(f"hop{i + 1}") for i in range(k)] + [F.element_at("nodes", i + 2).alias("end" if i == k - 1 else ("middle" if k == 2 else f"node{i + 1}")) for i in range(k)]
    return [*out, F.transform(F.sequence(F.lit(1), F.lit(k)), lambda i: F.struct(F.element_at("nodes", i).alias("start"), F.element_at("relations", i).alias("relation"), F.element_at("nodes", i + 1).alias("end"))).alias("steps")]


def k_hop_paths(triples: DataFrame, starts: DataFrame, k: int, excepted: str, hub_names: DataFrame) -> DataFrame:
    """Simple directed paths of k hops from the starts, all of them; ``sampled_paths`` gives one per start.

    Hubs on the path (start included) plus edges of the excepted relation are at most one;
    after the first hop no node may be a neighbour of the start. Predicates apply at every hop.
    """
    return _walk(triples, starts, k, excepted, hub_names).select(*_path_columns(k))


def sampled_paths(triples: DataFrame, starts: DataFrame, k: int, excepted: str, hub_names: DataFrame, beam: int = 16, seed: str = "") -> DataFrame:
    """One path of k hops per start, if it has any, under the rules of ``k_hop_paths``.

    At every hop each start keeps at most ``beam`` paths by hash order; starts that so lose all of
    theirs are searched in full. Rows grow with the starts, not with the product of degrees.
    """
    work = Workspace(triples.sparkSession, "paths")
    found = work.cut(_best_path(_walk(triples, starts, k, excepted, hub_names, beam, seed), seed))
    left = starts.select(F.col(starts.columns[0]).alias("start")).distinct().join(found.select("start"), "start", "left_anti")
    return found.unionByName(_best_path(_walk(triples, work.cut(left), k, excepted, hub_names, None, seed), seed)).select(*_path_columns(k))


def _path_order(seed: str) -> Column:
    return F.md5(F.concat_ws("|", F.lit(seed), F.array_join("nodes", "|"), F.array_join("relations", "|")))


def _best_path(paths: DataFrame, seed: str) -> DataFrame:
    best = F.min_by(F.struct("nodes", "relations"), F.struct(_path_order(seed), "nodes", "relations")).alias("b")
    return paths.groupBy("start").agg(best).select("start", "b.nodes", "b.relations")


def source_vocabulary(lines: DataFrame, ordinal: str, name: str, overlay: DataFrame | None = None) -> DataFrame:
    """``(id, name, frequency)``: names numbered by their line; frequencies 0 but where an overlay ``(name, frequency)`` gives one.

    Names of the overlay that stand in no line have no id.
    """
    t = lines.select(F.col(ordinal).cast("bigint").alias("id"), F.col(name).alias("name"))
    if overlay is None:
        return t.withColumn("frequency", F.lit(0).cast("bigint"))
    o = overlay.select(F.col(overlay.columns[0]).alias("name"), F.col(overlay.columns[1]).cast("bigint").alias("_f"))
    return t.join(o, "name", "full").select("id", "name", F.coalesce("_f", F.lit(0)).alias("frequency"))


def path_edges(paths: DataFrame, key: str, nodes: str, edges: DataFrame, a: str, b: str) -> DataFrame:
    """``(key, place, a, b, ...)``: every step of the node lists with the columns of its edge; nulls where there is none."""
    step = F.transform(F.sequence(F.lit(1), F.size(nodes) - 1), lambda i: F.struct(F.element_at(nodes, i).alias("a"), F.element_at(nodes, i + 1).alias("b")))
    t = paths.filter(F.size(nodes) > 1).select(key, F.posexplode(step).alias("place", "_e")).select(key, "place", F.col("_e.a").alias(a), F.col("_e.b").alias(b))
    return t.join(edges, [a, b], "left").select(key, "place", a, b, *[c for c in edges.columns if c not in (a, b)])


def with_inverses(triples: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Both directions of every triple; the inverse relation's number is offset by the largest number."""
    v = vocabulary.select("relation", "relation_id")
    top = vocabulary.agg(F.max("relation_id").alias("m"))
    t = triples.join(v, "relation").join(F.broadcast(top))
    both = F.explode(F.array(F.struct(F.col("source").alias("head"), F.col("target").alias("tail"), F.col("relation_id").alias("rid")), F.struct(F.col("target").alias("head"), F.col("source").alias("tail"), (F.col("relation_id") + F.col("m")).alias("rid"))))
    return t.select(F.col("ord.n").alias("h"), both.alias("e"), "m").select("h", "e.head", "e.tail", "e.rid", (F.when(F.col("e.rid") > F.col("m"), F.col("e.rid") - F.col("m")).otherwise(F.col("e.rid"))).alias("base"))


def shortest_matrix(adjacency: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All-pairs distances of a small graph and, per pair, the node before the last; -1 where there is none."""
    n = len(adjacency)
    dist = np.where(adjacency > 0, 1, UNREACHABLE).astype(np.int64)
    np.fill_diagonal(dist, 0)
    before = np.where(dist == 1, np.arange(n)[:, None], -1)
    for k in range(n):
        through = dist[:, k : k + 1] + dist[k]
        better = through < dist
        dist = np.where(better, through, dist)
        before = np.where(better, before[k], before)
    return np.minimum(dist, UNREACHABLE), before


def walk_back(before: np.ndarray, i: int, j: int) -> list[int]:
    """Nodes of a shortest path from i to j; empty if there is none."""
    path = [j]
    while path[-1] != i:
        p = int(before[i, path[-1]])
        if p < 0:
            return []
        path.append(p)
    return path[::-1]


def group_distances(edges: DataFrame, group: str) -> DataFrame:
    """``(group, a, b, distance)`` of every pair of nodes of small graphs, one graph per group, undirected.

    Groups are bounded graphs by contract (items of a benchmark); each goes to one worker.
    """
    kind = edges.schema[group].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        names = sorted(set(pdf["a"]) | set(pdf["b"]))
        at = {n: i for i, n in enumerate(names)}
        m = np.zeros((len(names), len(names)), dtype=np.int8)
        for a, b in zip(pdf["a"], pdf["b"]):
            m[at[a], at[b]] = m[at[b], at[a]] = 1
        d, _ = shortest_matrix(m)
        i, j = np.triu_indices(len(names), 1)
        return pd.DataFrame({group: pdf[group].iloc[0], "a": [names[x] for x in i], "b": [names[x] for x in j], "distance": d[i, j]})

    return edges.select(group, "a", "b").groupBy(group).applyInPandas(run, f"{group} {kind}, a string, b string, distance bigint")


def lattice(roots: int, leaves: int, chain: bool = True) -> list[tuple[int, int]]:
    """Edges of a fixed architecture: roots in a chain, each root linked to its leaves."""
    edges = [(i, i + 1) for i in range(roots - 1)] if chain else []
    return edges + [(r, roots + r * leaves + k) for r in range(roots) for k in range(leaves)]


def batches(rows: Iterator, size: int) -> Iterator[list]:
    """Lists of at most ``size`` rows."""
    out: list = []
    for r in rows:
        out.append(r)
        if len(out) == size:
            yield out
            out = []
    if out:
        yield out
