"""Queries of whitelists, prompts, splits and record helpers not covered elsewhere."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandworks.functions import text as T
from strandworks.operators import evaluation as V
from strandworks.operators import merge as M
from strandworks.operators import qa as Q
from strandworks.operators import records as P
from strandworks.operators import sampling as S
from strandworks.plans.kg_queries import _PLAIN_RELATION, _REL, _TRIM, COERCED, triples
from strandworks.plans.qa_queries import _FIELDS, items, text_of
from strandworks.runtime import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def f5_allowed_predictions(spark, sf_dir):
    """Predictions whose relation, in normal form, is canonical, with the relation's number."""
    return M.whitelisted(table(spark, sf_dir, "predictions"), table(spark, sf_dir, "relation_map").select("relation", "relation_id")).select("row_no", "relation_id")


_P_RELATION = _REL.format("coalesce(p.relation, '')")
SQL["f5_allowed_predictions"] = f"SELECT row_no, relation_id FROM predictions p JOIN relation_map m ON m.relation = {_P_RELATION}"


@query
def f11_trace_lengths(spark, sf_dir):
    """Text units by whether their length suits a reasoning trace."""
    t = table(spark, sf_dir, "text_units").filter("text is not null").select(Q.trace_in_range(F.col("text")).alias("suits"))
    return t.groupBy("suits").agg(F.count(F.lit(1)).alias("n"))


SQL["f11_trace_lengths"] = r"SELECT len(list_filter(regexp_split_to_array(text, '[\s\x0B\x1C-\x1F\x{85}]+'), lambda x: trim(x, chr(160)) <> '')) BETWEEN 100 AND 350 AS suits, count(*) AS n FROM text_units WHERE text IS NOT NULL GROUP BY 1"


@query
def k12_shuffled_targets(spark, sf_dir):
    """A hundred items in a fixed pseudo-random order: the head of a shuffled work list."""
    t = items(spark, sf_dir).select("item_id", "k_hops").filter("k_hops between 2 and 3")
    return S.sample_rows(t, "item_id", 100).select("item_id", "k_hops")


SQL["k12_shuffled_targets"] = "SELECT item_id, k_hops FROM eval_items WHERE k_hops BETWEEN 2 AND 3 ORDER BY md5(CAST(item_id AS VARCHAR)), item_id LIMIT 100"


@query
def y3_unpacked_descriptions(spark, sf_dir):
    """Descriptions as distinct lines with their place."""
    return P.unpacked_lines(table(spark, sf_dir, "final_entities"), "title", "description")


SQL["y3_unpacked_descriptions"] = """WITH l AS (SELECT title, unnest(list_filter(list_transform(string_split(description, chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '')) AS line, generate_subscripts(list_filter(list_transform(string_split(description, chr(10)), lambda x: trim(x, ' ')), lambda x: x <> ''), 1) AS i FROM final_entities WHERE description IS NOT NULL),
f AS (SELECT title, line, min(i) AS i FROM l GROUP BY 1, 2) SELECT title, CAST(row_number() OVER (PARTITION BY title ORDER BY i) AS INT) AS place, line FROM f"""


@query
def y4_fact_prompts(spark, sf_dir):
    """Prompts that ask for a verdict on a predicted triple."""
    p = table(spark, sf_dir, "predictions").filter("tail is not null and relation is not null")
    return p.select("row_no", Q.fact_prompt(F.col("head"), F.col("relation"), F.col("tail")).alias("prompt"))


SQL["y4_fact_prompts"] = "SELECT row_no, 'Is this true? ' || concat_ws(' | ', head, relation, tail) || ' Answer Yes or No.' AS prompt FROM predictions WHERE tail IS NOT NULL AND relation IS NOT NULL"


@query
def y9_item_ids(spark, sf_dir):
    """Id of every item: from the first id column that has one, else by its number."""
    d = F.col("item_id") % 4
    some = lambda k, prefix: F.when(d == k, F.concat(F.lit(prefix), F.col("item_id")))
    t = items(spark, sf_dir).select(F.col("item_id").alias("n"), "k_hops", some(0, "a").alias("id"), F.when(d <= 1, F.concat(F.lit("q"), "item_id")).alias("question_id"), some(2, "x").alias("index"))
    return t.select("n", V.item_id(t, "n").alias("id"), "k_hops")


SQL["y9_item_ids"] = "SELECT item_id AS n, CASE item_id % 4 WHEN 0 THEN 'a' WHEN 1 THEN 'q' WHEN 2 THEN 'x' ELSE 'item_' END || item_id AS id, k_hops FROM eval_items"


@query
def n29_separated(spark, sf_dir):
    """Question part before the answer tag, for items that have both answer tags."""
    return Q.separated(items(spark, sf_dir), "question_and_explanation").select("item_id", "question_part", "answer")


SQL["n29_separated"] = "SELECT item_id, " + _TRIM.format("split_part(question_and_explanation, '<Answer>', 1)") + r" AS question_part, nullif(upper(regexp_extract(question_and_explanation, '(?i)<Answer>[:\s]*([A-D])[:\s]*</Answer>', 1)), '') AS answer FROM eval_items WHERE contains(question_and_explanation, '<Answer>') AND contains(question_and_explanation, '</Answer>')"


@query
def a22_verdicts(spark, sf_dir):
    """Verdicts of two guesses per item against its answer."""
    f = Q.fields(text_of())["answer"]
    t = items(spark, sf_dir).select("item_id", f.alias("gold"), F.when(F.col("item_id") % 3 == 0, F.lit(None)).when(F.col("item_id") % 3 == 1, "A").otherwise(f).alias("guess"))
    return t.select("item_id", V.verdict(F.col("guess"), F.col("gold")).alias("verdict"))


SQL["a22_verdicts"] = f"WITH {_FIELDS} SELECT item_id, CASE item_id % 3 WHEN 0 THEN 'error' WHEN 1 THEN CASE WHEN answer = 'A' THEN 'yes' ELSE 'no' END ELSE 'yes' END AS verdict FROM fi"


@query
def u2_union_of_shards(spark, sf_dir):
    """Triples of two tables under one set of names, counted per origin and relation."""
    b = table(spark, sf_dir, "predictions").select(F.col("head").alias("source"), T.norm_relation(F.col("relation")).alias("relation"), F.col("tail").alias("target"))
    both = M.union_of({"graph": triples(spark, sf_dir), "predicted": b}, ["source", "relation", "target"])
    return both.groupBy("origin", "relation").agg(F.count(F.lit(1)).alias("n"))


SQL["u2_union_of_shards"] = f"WITH {COERCED} SELECT 'graph' AS origin, relation, count(*) AS n FROM va GROUP BY 2 UNION ALL SELECT 'predicted', {_PLAIN_RELATION}, count(*) FROM predictions GROUP BY 2"
