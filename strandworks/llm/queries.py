"""Queries of the training-data operators over the project's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandworks.llm.canonical import map_to_canonical
from strandworks.llm.components import connected_groups
from strandworks.llm.language import label_languages
from strandworks.llm.leaks import find_leaks
from strandworks.llm.mixing import mix_sources
from strandworks.llm.representative import Preference, claims_of, latent_truth, survivors, true_values, usable_number
from strandworks.llm.splitting import split_texts
from strandworks.llm.structural import canonical_triples, collapse_copies, composed, copies_of, nested_records
from strandworks.runtime import table, trim_all

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


# ---- 1: best representative of each duplicate group

_UNITS = r"""filter(array_distinct(split(text_unit_ids, '[\\s,;|/"\'\\[\\](){}]+')), x -> x <> '')"""
_LAST_TRUST = 2_147_483_647


def _with_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    rel = table(spark, sf_dir, "final_relationships").select("id", "human_readable_id", "weight", "combined_degree", "text_unit_ids", "run_id", "extracted_at")
    runs = table(spark, sf_dir, "kg_runs").select("run_id", "trust_rank")
    return rel.join(runs, "run_id", "left").withColumn("n_units", F.expr(f"size({_UNITS})"))


@query
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per id delivered more than once, the rows that supply weight, degree and text units."""
    recent = Preference("weight_row", usable_number("weight"), F.col("extracted_at"))
    trusted = Preference("degree_row", usable_number("combined_degree"), -F.coalesce("trust_rank", F.lit(_LAST_TRUST)))
    complete = Preference("units_row", F.col("n_units") > 0, F.col("n_units"))
    return survivors(_with_trust(spark, sf_dir), "id", "human_readable_id", [recent, trusted, complete])


SQL["p1_found"] = r"""
WITH r AS (
  SELECT f.*, coalesce(k.trust_rank, 2147483647) AS trust,
    len(list_distinct(list_filter(regexp_split_to_array(coalesce(text_unit_ids, ''), '[\s,;|/"''\[\](){}]+'), lambda x: x <> ''))) AS n_units
  FROM final_relationships f LEFT JOIN kg_runs k ON f.run_id = k.run_id),
w AS (SELECT id, human_readable_id AS h, row_number() OVER (PARTITION BY id ORDER BY extracted_at DESC, human_readable_id) AS k FROM r WHERE isfinite(weight) AND weight > 0),
d AS (SELECT id, human_readable_id AS h, row_number() OVER (PARTITION BY id ORDER BY trust, human_readable_id) AS k FROM r WHERE isfinite(combined_degree) AND combined_degree > 0),
u AS (SELECT id, human_readable_id AS h, row_number() OVER (PARTITION BY id ORDER BY n_units DESC, human_readable_id) AS k FROM r WHERE n_units > 0)
SELECT g.id, coalesce(w.h, 0) AS weight_row, coalesce(d.h, 0) AS degree_row, coalesce(u.h, 0) AS units_row
FROM (SELECT id FROM final_relationships GROUP BY id HAVING count(*) > 1) g
LEFT JOIN w ON w.id = g.id AND w.k = 1 LEFT JOIN d ON d.id = g.id AND d.k = 1 LEFT JOIN u ON u.id = g.id AND u.k = 1
"""


def _claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    rel = table(spark, sf_dir, "final_relationships").select("id", "run_id", "weight", "combined_degree", "text_unit_ids")
    number = lambda c: F.when(usable_number(c), F.array(F.col(c).cast("string"))).otherwise(F.array().cast("array<string>"))
    units = F.expr(f"coalesce({_UNITS}, cast(array() AS array<string>))")
    return claims_of(rel, "id", "run_id", {"weight": number("weight"), "combined_degree": number("combined_degree"), "text_unit_ids": units})


@query
def p1_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Survivor of every id by the latent quality model: values judged true, field by field."""
    truth, _ = latent_truth(_claims(spark, sf_dir))
    return true_values(truth, ["text_unit_ids"], trust=table(spark, sf_dir, "kg_runs").select("run_id", "trust_rank"))


@query
def p1_source_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sensitivity and specificity of each extraction run."""
    return latent_truth(_claims(spark, sf_dir))[1].select("source", F.round("sensitivity", 6).alias("sensitivity"), F.round("specificity", 6).alias("specificity"))


# ---- 2: consolidating pairwise matches into groups


def _matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rel = table(spark, sf_dir, "final_relationships").select(*[F.lower(trim_all(F.col(c))).alias(c) for c in ("source", "target", "relation")])
    return rel.filter((F.col("relation") == "same_as") & (F.col("source") != "") & (F.col("target") != ""))


@query
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every name matched by a same_as row with the smallest name of its group."""
    return connected_groups(_matches(spark, sf_dir), "source", "target")


_TRIM = r"regexp_replace({0}, '^[\s\x0B\x1C-\x1F\x{{85}}\p{{Z}}]+|[\s\x0B\x1C-\x1F\x{{85}}\p{{Z}}]+$', '', 'g')"
_P2_GROUPS = f"""
WITH RECURSIVE m AS (
  SELECT DISTINCT lower({_TRIM.format("source")}) AS a, lower({_TRIM.format("target")}) AS b FROM final_relationships
  WHERE lower({_TRIM.format("relation")}) = 'same_as'),
e AS (SELECT a, b FROM m WHERE a <> '' AND b <> '' AND a <> b UNION SELECT b, a FROM m WHERE a <> '' AND b <> '' AND a <> b),
reach(x, y) AS (SELECT a, a FROM e UNION SELECT reach.x, e.b FROM reach JOIN e ON reach.y = e.a),
g AS (SELECT x AS member, min(y) AS group_name FROM reach GROUP BY x)
"""
SQL["p2_found"] = _P2_GROUPS + "SELECT member, group_name FROM g"


@query
def p2_group_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size of every group of matched names."""
    return p2_found(spark, sf_dir).groupBy("group_name").agg(F.count(F.lit(1)).alias("members"))


SQL["p2_group_sizes"] = _P2_GROUPS + "SELECT group_name, count(*) AS members FROM g GROUP BY group_name"


# ---- 3: duplicates hidden by formatting differences


def _canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    rel = table(spark, sf_dir, "final_relationships").select("human_readable_id", "source", "relation", "target")
    free = table(spark, sf_dir, "relation_map").filter("NOT directed").select("relation")
    return canonical_triples(rel, "human_readable_id", "source", "relation", "target", free)


@query
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each repeated triple's first row with each of its copies."""
    return copies_of(_canonical(spark, sf_dir))


@query
def p3_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record per triple with its first row and the number of rows that state it."""
    return collapse_copies(_canonical(spark, sf_dir)).select("first_row", F.col("a").alias("source_key"), F.col("rel").alias("relation_key"), F.col("b").alias("target_key"), "n_copies")


_LEAF = r"regexp_replace(regexp_replace(replace(lower(nfc_normalize({0})), 'ς', 'σ'), '(^|[^\p{{L}}\p{{N}}\p{{M}}])\p{{M}}+|[\x{{fe00}}-\x{{fe0f}}\x{{180b}}-\x{{180d}}]', '\1', 'g'), '[^\p{{L}}\p{{N}}\p{{M}}]+', '', 'g')"
_P3_RECORDS = rf"""
WITH l AS (SELECT human_readable_id AS h, {_LEAF.format("source")} AS s, {_LEAF.format("relation")} AS r, {_LEAF.format("target")} AS t FROM final_relationships),
f AS (SELECT DISTINCT {_LEAF.format("relation")} AS n FROM relation_map WHERE NOT directed),
k AS (SELECT h, r, CASE WHEN n IS NOT NULL THEN least(s, t) ELSE s END AS a, CASE WHEN n IS NOT NULL THEN greatest(s, t) ELSE t END AS b
  FROM l LEFT JOIN f ON f.n = l.r WHERE regexp_matches(s, '[\p{{L}}\p{{N}}]') AND regexp_matches(r, '[\p{{L}}\p{{N}}]') AND regexp_matches(t, '[\p{{L}}\p{{N}}]')),
g AS (SELECT a, r, b, min(h) AS first_row, count(*) AS n_copies FROM k GROUP BY ALL)
"""
SQL["p3_found"] = _P3_RECORDS + "SELECT g.first_row, k.h AS copy_row FROM k JOIN g USING (a, r, b) WHERE k.h <> g.first_row"
SQL["p3_records"] = _P3_RECORDS + "SELECT first_row, a AS source_key, r AS relation_key, b AS target_key, n_copies FROM g"



@query
def p3_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies among triples taken as nested records of a relation and two ends without order."""
    rel = composed(table(spark, sf_dir, "final_relationships").select("human_readable_id", "source", "relation", "target"), ["source", "relation", "target"])
    t = rel.select("human_readable_id", F.struct("relation", F.array("source", "target").alias("ends")).alias("record"))
    return copies_of(nested_records(t, "human_readable_id", "record", ("ends",)))


SQL["p3_nested"] = rf"""WITH l AS (SELECT human_readable_id AS h, coalesce({_LEAF.format("source")}, '') AS s, coalesce({_LEAF.format("relation")}, '') AS r, coalesce({_LEAF.format("target")}, '') AS t FROM final_relationships),
k AS (SELECT h, r, least(s, t) AS a, greatest(s, t) AS b FROM l WHERE regexp_matches(s || r || t, '[\p{{L}}\p{{N}}]')), g AS (SELECT a, r, b, min(h) AS first_row FROM k GROUP BY ALL)
SELECT first_row, h AS copy_row FROM k JOIN g USING (a, r, b) WHERE h <> first_row"""

# ---- 4: splitting oversized items at natural boundaries


def _pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_texts(table(spark, sf_dir, "text_units").select("id", "text"), "id", "text", 2400, 200)


@query
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text units that had to be cut."""
    return _pieces(spark, sf_dir).filter("piece_no = 2").select("id")


SQL["p4_found"] = "SELECT id FROM text_units WHERE length(text) > 2400"


@query
def p4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pieces with their place, overlap and the kind of boundary they end at."""
    return _pieces(spark, sf_dir)


# ---- 5: mapping free-entered values to a canonical list


def _relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "relation_map").select("relation", "gloss")


def _entered(spark: SparkSession, sf_dir: str) -> DataFrame:
    rel = table(spark, sf_dir, "final_relationships").select(F.struct(F.lit("final_relationships").alias("table_name"), F.col("human_readable_id").alias("row_no")).alias("at"), "relation")
    pred = table(spark, sf_dir, "predictions").select(F.struct(F.lit("predictions").alias("table_name"), F.col("row_no").alias("row_no")).alias("at"), "relation")
    return rel.unionByName(pred)


@query
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every freely entered relation with the canonical one meant, or the empty string."""
    mapped = map_to_canonical(_entered(spark, sf_dir), "at", "relation", _relations(spark, sf_dir))
    return mapped.select("at.table_name", "at.row_no", "canonical")


@query
def p5_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values that match no canonical relation with their number of rows."""
    mapped = map_to_canonical(_entered(spark, sf_dir), "at", "relation", _relations(spark, sf_dir))
    return mapped.filter("canonical = ''").groupBy(F.col("relation").alias("value")).agg(F.count(F.lit(1)).alias("row_count"))


@query
def p5_ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows answered by spelling, by meaning and not at all."""
    mapped = map_to_canonical(_entered(spark, sf_dir), "at", "relation", _relations(spark, sf_dir))
    return mapped.groupBy("way").agg(F.count(F.lit(1)).alias("row_count"))


# ---- 7: evaluation texts leaking into training text


def _leaks(spark: SparkSession, sf_dir: str, altered: bool = False) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    items = table(spark, sf_dir, "eval_items").select("item_id", "question_and_explanation")
    return find_leaks(docs, "doc_id", "text", items, "item_id", "question_and_explanation", altered=altered)


@query
def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of which a document holds at least eight consecutive words that stand in no other item."""
    return _leaks(spark, sf_dir).filter("own_words >= 8").select("item_id", "doc_id").distinct()


@query
def p7_altered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlaps of twelve equal words and more in which words were replaced."""
    return _leaks(spark, sf_dir, altered=True).filter("overlap_words >= 12 AND substitutions > 0").select("item_id", "doc_id", "overlap_words", "substitutions", "exact_words")


# ---- 8: mixing sources to target weights


def _mix(spark: SparkSession, sf_dir: str):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix_sources(docs, "doc_id", "text", "source", table(spark, sf_dir, "mix_targets"))


@query
def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of copies of every document in the mix."""
    return _mix(spark, sf_dir).copies


@query
def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and actual share of each source."""
    return _mix(spark, sf_dir).shares


# ---- 9: missing or wrong document language labels


def _languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return label_languages(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), "doc_id", "text", "lang")


@query
def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of documents whose label is missing or wrong or that change language."""
    seg = _languages(spark, sf_dir)
    return seg.filter("lang <> 'und'").filter((F.col("segments") > 1) | F.col("label_language").isNull() | (F.col("label_language") != F.col("lang"))).select("doc_id", "segment_no", "lang")


@query
def p9_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language and confidence of every document and of each of its segments."""
    return _languages(spark, sf_dir).select("doc_id", "doc_lang", F.round("doc_confidence", 6).alias("doc_confidence"), "segment_no", "lang", F.round("confidence", 6).alias("confidence"), "sentences")
