"""Queries over triples and entities: coercion, merging, counting, degrees, hops and paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandworks.functions.text import entity_key, norm_relation
from strandworks.operators import entities as E
from strandworks.operators import graph as G
from strandworks.operators import merge as M
from strandworks.operators import sampling as S
from strandworks.runtime import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def raw_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "final_relationships")


def split_graphs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Triples of the old and of the new runs; such without a run count as new."""
    rel = raw_triples(spark, sf_dir)
    runs = table(spark, sf_dir, "kg_runs").select("run_id", "kg_label")
    t = rel.join(runs, "run_id", "left").withColumn("kg_label", F.coalesce("kg_label", F.lit("new")))
    return t.filter("kg_label = 'old'"), t.filter("kg_label = 'new'")


def triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.valid_triples(M.coerce_triples(raw_triples(spark, sf_dir), "human_readable_id"))


_W = r"[\s\x0B\x1C-\x1F\x{85}\p{Z}]"
_TRIM = f"regexp_replace({{0}}, '^{_W.replace('{', '{{').replace('}', '}}')}+|{_W.replace('{', '{{').replace('}', '}}')}+$', '', 'g')"
_REL = "regexp_replace(replace(lower(" + _TRIM + "), ' ', '_'), '_+', '_', 'g')"
_NORM = r"trim(regexp_replace(regexp_replace(regexp_replace(lower({0}), '[_-]', ' ', 'g'), '[^\p{{L}}\p{{N}}_\s]+', ' ', 'g'), '\s+', ' ', 'g'))"
_IDS = "list_sort(list_distinct(list_filter(list_transform(string_split(coalesce({0}, ''), ','), lambda x: trim(x, ' ')), lambda x: x <> '')))"
COERCED = f"""
co AS (SELECT human_readable_id AS h, run_id, lower({_TRIM.format("coalesce(source, '')")}) AS source, lower({_TRIM.format("coalesce(target, '')")}) AS target, {_REL.format("coalesce(relation, '')")} AS relation,
  coalesce(CASE WHEN isnan(weight) THEN NULL ELSE weight END, 1.0) AS weight, CASE WHEN isnan(combined_degree) THEN NULL ELSE combined_degree END AS combined_degree,
  {_IDS.format("text_unit_ids")} AS ids FROM final_relationships),
va AS (SELECT * FROM co WHERE source <> '' AND target <> '' AND relation <> '' AND source <> target),
nn AS (SELECT *, {_NORM.format("source")} AS sn, {_NORM.format("target")} AS tn FROM va),
ke AS (SELECT *, CASE WHEN length(string_split(sn, ' ')[-1]) > 3 AND sn LIKE '%s' AND sn NOT LIKE '%ss' THEN left(sn, length(sn) - 1) ELSE sn END AS sk,
  CASE WHEN length(string_split(tn, ' ')[-1]) > 3 AND tn LIKE '%s' AND tn NOT LIKE '%ss' THEN left(tn, length(tn) - 1) ELSE tn END AS tk FROM nn)
"""
_COLLAPSED = """
ra AS (SELECT *, row_number() OVER (PARTITION BY sk, relation, tk ORDER BY coalesce(combined_degree, -1) DESC, weight DESC, {order}) AS k FROM {src}),
cl AS (SELECT max(source) FILTER (k = 1) AS source, max(target) FILTER (k = 1) AS target, relation, max(weight) AS weight, max(combined_degree) AS combined_degree,
  array_to_string(list_sort(list_distinct(flatten(list(ids)))), ',') AS text_unit_ids, count(*) AS n_rows FROM ra GROUP BY sk, relation, tk)
"""


@query
def f1_coerced_triples(spark, sf_dir):
    """Every triple in canonical form."""
    t = M.coerce_triples(raw_triples(spark, sf_dir), "human_readable_id")
    return t.select(F.col("ord.n").alias("h"), "source", "target", "relation", "weight", "combined_degree", F.array_join("text_unit_ids", ",").alias("text_unit_ids"))


SQL["f1_coerced_triples"] = f"WITH {COERCED} SELECT h, source, target, relation, weight, combined_degree, array_to_string(ids, ',') AS text_unit_ids FROM co"


@query
def f2_valid_triples(spark, sf_dir):
    """Triples with two different, non-empty ends and a relation."""
    return triples(spark, sf_dir).select(F.col("ord.n").alias("h"), "source", "target", "relation")


SQL["f2_valid_triples"] = f"WITH {COERCED} SELECT h, source, target, relation FROM va"


@query
def n1_entity_keys(spark, sf_dir):
    """Normal form and singular key of every entity title."""
    from strandworks.functions.text import norm_text

    return table(spark, sf_dir, "final_entities").select("title", norm_text(F.col("title")).alias("norm"), entity_key(F.col("title")).alias("key"))


SQL["n1_entity_keys"] = f"WITH n AS (SELECT title, {_NORM.format('title')} AS norm FROM final_entities) SELECT title, norm, CASE WHEN length(string_split(norm, ' ')[-1]) > 3 AND norm LIKE '%s' AND norm NOT LIKE '%ss' THEN left(norm, length(norm) - 1) ELSE norm END AS key FROM n"


@query
def n3_relation_forms(spark, sf_dir):
    """Distinct normal forms of predicted relations with their rows."""
    t = table(spark, sf_dir, "predictions").select(norm_relation(F.col("relation")).alias("relation"))
    return t.groupBy("relation").agg(F.count(F.lit(1)).alias("n"))


_PLAIN_RELATION = _REL.format("coalesce(relation, '')")
SQL["n3_relation_forms"] = f"SELECT {_PLAIN_RELATION} AS relation, count(*) AS n FROM predictions GROUP BY 1"


@query
def a1_collapsed_triples(spark, sf_dir):
    """One triple per normal form of its names and relation."""
    c = M.fast_collapse(triples(spark, sf_dir))
    return c.select("source", "target", "relation", "weight", "combined_degree", F.array_join("text_unit_ids", ",").alias("text_unit_ids"), "n_rows")


SQL["a1_collapsed_triples"] = f"WITH {COERCED}, {_COLLAPSED.format(order='h', src='ke')} SELECT source, target, relation, weight, combined_degree, text_unit_ids, n_rows FROM cl"


@query
def u1_merged_exact(spark, sf_dir):
    """Old and new graph merged without fuzzy names; relations of at least 80 pairs stay."""
    old, new = split_graphs(spark, sf_dir)
    return M.merge_graphs(new, old, "human_readable_id", None).drop("id", "place")


SQL["u1_merged_exact"] = f"""WITH {COERCED}, o AS (SELECT ke.*, CASE WHEN kg_label = 'old' THEN 0 ELSE 1 END AS rk FROM ke LEFT JOIN kg_runs USING (run_id)),
{_COLLAPSED.format(order='rk, h', src='o')}, dd AS (SELECT DISTINCT ON (source, target, relation) * FROM cl),
fr AS (SELECT relation FROM dd GROUP BY relation HAVING count(DISTINCT (source, target)) >= 80)
SELECT source, target, relation, weight, combined_degree, text_unit_ids FROM dd WHERE relation IN (SELECT relation FROM fr)"""


@query
def dd3_canonical_names(spark, sf_dir):
    """Canonical name of every name of a valid triple."""
    t = triples(spark, sf_dir)
    return M.canonical_names(t.select(F.explode(F.array("source", "target")).alias("n")))


@query
def a2_merged_fuzzy(spark, sf_dir):
    """The whole merge with fuzzy names."""
    old, new = split_graphs(spark, sf_dir)
    return M.numbered(M.merge_graphs(new, old, "human_readable_id"), ["place"]).drop("place", "_before")


@query
def a4_distinct_pairs(spark, sf_dir):
    """Distinct pairs per relation, also of those below the limit."""
    return M.distinct_pairs(triples(spark, sf_dir)).withColumn("kept", F.col("pairs") >= 80)


SQL["a4_distinct_pairs"] = f"WITH {COERCED} SELECT relation, count(DISTINCT (source, target)) AS pairs, count(DISTINCT (source, target)) >= 80 AS kept FROM va GROUP BY relation"


@query
def a6_relation_counts(spark, sf_dir):
    """Rows per relation."""
    return M.relation_counts(triples(spark, sf_dir))


SQL["a6_relation_counts"] = f"WITH {COERCED} SELECT relation, count(*) AS n FROM va GROUP BY relation"


@query
def a7_vocabulary_counts(spark, sf_dir):
    """Rows per canonical relation, also of those that never occur."""
    return M.relation_counts(triples(spark, sf_dir), table(spark, sf_dir, "relation_map").select("relation"))


SQL["a7_vocabulary_counts"] = f"WITH {COERCED} SELECT m.relation, count(va.h) AS n FROM relation_map m LEFT JOIN va ON va.relation = m.relation GROUP BY m.relation"


@query
def f4_whitelisted(spark, sf_dir):
    """Triples whose relation is in the vocabulary."""
    t = triples(spark, sf_dir)
    return M.whitelisted(t, table(spark, sf_dir, "relation_map").select("relation")).select(F.col("ord.n").alias("h"), "source", "relation", "target")


SQL["f4_whitelisted"] = f"WITH {COERCED} SELECT h, source, relation, target FROM va WHERE relation IN (SELECT relation FROM relation_map)"


@query
def dd1_distinct_triples(spark, sf_dir):
    """First row of every exactly equal triple."""
    t = M.first_by(triples(spark, sf_dir), ["source", "target", "relation"], [F.col("ord.n")])
    return t.select(F.col("ord.n").alias("h"), "source", "target", "relation")


SQL["dd1_distinct_triples"] = f"WITH {COERCED} SELECT min(h) AS h, source, target, relation FROM va GROUP BY source, target, relation"


@query
def k2_numbered_triples(spark, sf_dir):
    """Distinct triples with dense numbers in their order."""
    t = triples(spark, sf_dir).select("source", "target", "relation").distinct()
    return M.numbered(t, ["source", "target", "relation"])


SQL["k2_numbered_triples"] = f"WITH {COERCED}, d AS (SELECT DISTINCT source, target, relation FROM va) SELECT source, target, relation, row_number() OVER (ORDER BY source, target, relation) - 1 AS human_readable_id FROM d"


@query
def a25_degrees(spark, sf_dir):
    """Degree of every name over distinct edges."""
    return M.degrees(triples(spark, sf_dir))


_DEG = "ed AS (SELECT DISTINCT source, target FROM va), dg AS (SELECT title, count(*) AS degree FROM (SELECT source AS title FROM ed UNION ALL SELECT target FROM ed) GROUP BY title)"
SQL["a25_degrees"] = f"WITH {COERCED}, {_DEG} SELECT title, degree FROM dg"


@query
def j2_combined_degrees(spark, sf_dir):
    """Sum of both ends' degrees per distinct edge."""
    return M.combined_degrees(triples(spark, sf_dir))


SQL["j2_combined_degrees"] = f"WITH {COERCED}, {_DEG} SELECT ed.source, ed.target, a.degree + b.degree AS combined_degree FROM ed JOIN dg a ON a.title = ed.source JOIN dg b ON b.title = ed.target"


@query
def j1_entity_degrees(spark, sf_dir):
    """Entities with their degree in the triples, 0 for those without any."""
    return E.with_degrees(table(spark, sf_dir, "final_entities").select("title", "type"), M.degrees(triples(spark, sf_dir)))


SQL["j1_entity_degrees"] = f"WITH {COERCED}, {_DEG} SELECT e.title, e.type, coalesce(dg.degree, 0) AS degree FROM final_entities e LEFT JOIN dg ON dg.title = lower({_TRIM.format('e.title')})"


@query
def f3_entity_filter(spark, sf_dir):
    """Entities of allowed types with a title and a description."""
    return E.typed_entities(table(spark, sf_dir, "final_entities"), ["STRUCTURE", "PATHWAY", "FUNCTION", "CONDITION", "CELL KIND", "SIGNAL MOLECULE"]).select("title", "type", "description")


SQL["f3_entity_filter"] = "SELECT title, upper(trim(type)) AS type, description FROM final_entities WHERE upper(trim(type)) IN ('STRUCTURE', 'PATHWAY', 'FUNCTION', 'CONDITION', 'CELL KIND', 'SIGNAL MOLECULE') AND description <> '' AND title <> ''"


@query
def a5_merged_entities(spark, sf_dir):
    """Entities merged by key: all descriptions and units, type of the first."""
    m = E.merge_entities(table(spark, sf_dir, "final_entities").withColumn("title", entity_key(F.col("title"))), "human_readable_id")
    return m.select("title", "type", F.array_join("descriptions", "\n").alias("descriptions"), F.array_join("text_unit_ids", ",").alias("text_unit_ids"))


_KEY = "CASE WHEN length(string_split(norm, ' ')[-1]) > 3 AND norm LIKE '%s' AND norm NOT LIKE '%ss' THEN left(norm, length(norm) - 1) ELSE norm END"
SQL["a5_merged_entities"] = f"""WITH n AS (SELECT *, {_NORM.format('title')} AS norm FROM final_entities), k AS (SELECT *, {_KEY} AS key FROM n)
SELECT key AS title, first(type ORDER BY human_readable_id) FILTER (type IS NOT NULL) AS type, coalesce(array_to_string(list(description ORDER BY human_readable_id) FILTER (description <> ''), chr(10)), '') AS descriptions,
array_to_string(list_sort(list_distinct(flatten(list(coalesce(text_unit_ids, []))))), ',') AS text_unit_ids FROM k GROUP BY key"""


@query
def j3_unit_lookup(spark, sf_dir):
    """Position numbers in source_id resolved to text unit ids."""
    units = table(spark, sf_dir, "text_units").select("row_no", "id")
    return E.resolve_units(raw_triples(spark, sf_dir), "human_readable_id", "source_id", units)


SQL["j3_unit_lookup"] = """WITH e AS (SELECT human_readable_id, unnest(string_split(source_id, ',')) AS p FROM final_relationships WHERE source_id IS NOT NULL)
SELECT human_readable_id, array_to_string(list_sort(list_distinct(list(u.id))), ',') AS text_unit_ids FROM e JOIN text_units u ON u.row_no = CASE WHEN regexp_full_match(trim(p), '[0-9]{1,18}') THEN CAST(trim(p) AS BIGINT) END GROUP BY human_readable_id"""


# ---- graph


def _seeds(spark, sf_dir):
    """Names in the evaluation items' paths."""
    steps = table(spark, sf_dir, "final_entities").filter("degree >= 10")
    return steps.select(F.lower("title").alias("node"))


@query
def g2_hop_distances(spark, sf_dir):
    """Distance of every name to the nearest well-connected entity; null if none is reachable."""
    return G.hop_distances(triples(spark, sf_dir), _seeds(spark, sf_dir), "node")


_BFS = f"""WITH RECURSIVE {COERCED}, un AS (SELECT lower(source) AS a, lower(target) AS b FROM va WHERE lower(source) <> lower(target) UNION SELECT lower(target), lower(source) FROM va WHERE lower(source) <> lower(target)),
nd AS (SELECT DISTINCT a AS node FROM un), sd AS (SELECT DISTINCT lower({_TRIM.format('title')}) AS node FROM final_entities WHERE degree >= 10),
bf(node, d) AS (SELECT node, 0 FROM sd JOIN nd USING (node) UNION SELECT un.b, bf.d + 1 FROM bf JOIN un ON un.a = bf.node WHERE bf.d < 25),
ds AS (SELECT node, min(d) AS d FROM bf GROUP BY node)"""
SQL["g2_hop_distances"] = _BFS + " SELECT nd.node, ds.d AS hop_distance FROM nd LEFT JOIN ds USING (node)"


@query
def g3_triple_hops(spark, sf_dir):
    """Distance of every valid triple: the nearer of its ends."""
    t = triples(spark, sf_dir)
    return G.triple_hops(t, G.hop_distances(t, _seeds(spark, sf_dir), "node")).select(F.col("ord.n").alias("h"), "hop_distance")


SQL["g3_triple_hops"] = _BFS + " SELECT va.h, least(x.d, y.d) AS hop_distance FROM va LEFT JOIN ds x ON x.node = lower(va.source) LEFT JOIN ds y ON y.node = lower(va.target)"


@query
def a9_hop_histogram(spark, sf_dir):
    """Triples per distance."""
    return G.hop_histogram(g3_triple_hops(spark, sf_dir))


SQL["a9_hop_histogram"] = _BFS + " SELECT least(x.d, y.d) AS hop_distance, count(*) AS n FROM va LEFT JOIN ds x ON x.node = lower(va.source) LEFT JOIN ds y ON y.node = lower(va.target) GROUP BY 1"


@query
def f8_hop_range(spark, sf_dir):
    """Triples at distances from 1 to 2."""
    return G.within_hops(g3_triple_hops(spark, sf_dir), 1, 2)


SQL["f8_hop_range"] = _BFS + " SELECT va.h, least(x.d, y.d) AS hop_distance FROM va LEFT JOIN ds x ON x.node = lower(va.source) LEFT JOIN ds y ON y.node = lower(va.target) WHERE least(x.d, y.d) BETWEEN 1 AND 2"


@query
def g6_hubs(spark, sf_dir):
    """The hundredth part of names with most distinct neighbours."""
    return G.hubs(M.degrees(triples(spark, sf_dir)))


SQL["g6_hubs"] = f"WITH {COERCED}, {_DEG} SELECT title, degree FROM (SELECT *, row_number() OVER (ORDER BY degree DESC, title) AS r, count(*) OVER () AS n FROM dg) WHERE r <= greatest(1, CAST(floor(n * 0.01) AS BIGINT))"


@query
def g4_two_hop_paths(spark, sf_dir):
    """Simple two-hop paths from well-connected entities with at most one hub or excepted relation."""
    t = triples(spark, sf_dir)
    return G.k_hop_paths(t, _seeds(spark, sf_dir), 2, "stores", G.hubs(M.degrees(t)).select("title")).select("start", "hop1", "middle", "hop2", "end")


SQL["g4_two_hop_paths"] = f"""WITH {COERCED}, {_DEG}, hb AS (SELECT title FROM (SELECT *, row_number() OVER (ORDER BY degree DESC, title) AS r, count(*) OVER () AS n FROM dg) WHERE r <= greatest(1, CAST(floor(n * 0.01) AS BIGINT))),
e AS (SELECT DISTINCT source, relation, target FROM va), s AS (SELECT DISTINCT lower(title) AS title FROM final_entities WHERE degree >= 10),
c AS (SELECT title, 1 AS hub FROM hb)
SELECT a.source AS start, a.relation AS hop1, a.target AS middle, b.relation AS hop2, b.target AS "end" FROM e a JOIN s ON s.title = a.source JOIN e b ON b.source = a.target
LEFT JOIN c h0 ON h0.title = a.source LEFT JOIN c h1 ON h1.title = a.target LEFT JOIN c h2 ON h2.title = b.target
WHERE a.source <> b.target AND coalesce(h0.hub, 0) + coalesce(h1.hub, 0) + coalesce(h2.hub, 0) + CAST(a.relation = 'stores' AS INT) + CAST(b.relation = 'stores' AS INT) <= 1
AND NOT EXISTS (SELECT 1 FROM e n WHERE n.source = a.source AND n.target = b.target)"""


@query
def g5_inverse_relations(spark, sf_dir):
    """Relation number of each triple in both directions: the inverse of n is n plus the vocabulary's size."""
    return G.with_inverses(triples(spark, sf_dir), table(spark, sf_dir, "relation_map"))


SQL["g5_inverse_relations"] = f"""WITH {COERCED}, x AS (SELECT h, source, target, relation_id AS rid FROM va JOIN relation_map USING (relation)), n AS (SELECT max(relation_id) AS m FROM relation_map)
SELECT h, source AS head, target AS tail, rid, rid AS base FROM x UNION ALL SELECT h, target, source, rid + m, rid FROM x, n"""


@query
def k8_previews(spark, sf_dir):
    """Two triples of every relation, chosen by hash."""
    t = triples(spark, sf_dir).select(F.col("ord.n").alias("h"), "source", "relation", "target")
    return S.per_group(t, "relation", "h", 2).select("h", "relation")


SQL["k8_previews"] = f"WITH {COERCED} SELECT h, relation FROM (SELECT *, row_number() OVER (PARTITION BY relation ORDER BY md5(CAST(h AS VARCHAR)), h) AS k FROM va) WHERE k <= 2"


@query
def k14_shards(spark, sf_dir):
    """Rows per range shard of 8,000 and per modulo shard of 4."""
    t = raw_triples(spark, sf_dir).select("human_readable_id")
    return t.groupBy(S.range_shard(F.col("human_readable_id"), 8000).alias("range_shard"), S.modulo_shard(F.col("human_readable_id"), 4).alias("modulo_shard")).agg(F.count(F.lit(1)).alias("n"))


SQL["k14_shards"] = "SELECT CAST(floor(human_readable_id / 8000) AS BIGINT) AS range_shard, human_readable_id % 4 AS modulo_shard, count(*) AS n FROM final_relationships GROUP BY 1, 2"


@query
def a8_shard_count(spark, sf_dir):
    """Number of shards that the text units need."""
    return S.shard_count(table(spark, sf_dir, "text_units"), 8000)


SQL["a8_shard_count"] = "SELECT CAST(ceil(count(*) / 8000) AS BIGINT) AS shards FROM text_units"
