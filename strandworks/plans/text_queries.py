"""Queries over parsed model output, mentions and grounded triples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandworks.functions import text as T
from strandworks.operators import grounding as R
from strandworks.operators import records as P
from strandworks.operators.merge import first_by
from strandworks.plans.kg_queries import _TRIM, COERCED, triples
from strandworks.runtime import collect_bounded, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


# ---- tuple records


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model replies built of the triples of one id: entity and relationship records, in row order."""
    t = triples(spark, sf_dir).join(table(spark, sf_dir, "final_relationships").select(F.col("human_readable_id").alias("hid"), "id"), F.col("ord.n") == F.col("hid"))
    e = F.concat(F.lit('("entity"<|>'), F.col("source"), F.lit("<|>structure<|>about "), F.col("source"), F.lit(")"))
    r = F.concat(F.lit('("relationship"<|>'), F.col("source"), F.lit("<|>"), F.col("target"), F.lit("<|>"), F.col("relation"), F.lit("<|>"), F.col("weight").cast("decimal(10,2)").cast("string"), F.lit(")"))
    g = t.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("hid", F.concat(e, F.lit("##"), r).alias("x")))).alias("a"))
    body = F.array_join(F.transform("a", lambda x: x["x"]), "##")
    return g.select("id", F.concat(F.lit("<think>notes ## here</think>\n"), body, F.lit("##\n<|COMPLETE|>")).alias("response"))


_ROWS = f"""WITH {COERCED}, vr AS (SELECT va.*, f.id FROM va JOIN final_relationships f ON f.human_readable_id = va.h)"""


@query
def n7_entity_records(spark, sf_dir):
    """Entity records parsed from replies."""
    return P.entity_rows(P.parse_records(responses(spark, sf_dir), "id", "response"), "id").groupBy("id", "title", "type").agg(F.count(F.lit(1)).alias("n"))


SQL["n7_entity_records"] = _ROWS + " SELECT id, lower(source) AS title, 'STRUCTURE' AS type, count(*) AS n FROM vr GROUP BY 1, 2"


@query
def n8_relationship_records(spark, sf_dir):
    """Relationship records parsed from replies, with weights."""
    t = P.relationship_rows(P.parse_records(responses(spark, sf_dir), "id", "response"), "id")
    return t.groupBy("id", "source", "target", "relation").agg(F.round(F.sum("weight"), 4).alias("weight"), F.count(F.lit(1)).alias("n"))


SQL["n8_relationship_records"] = _ROWS + " SELECT id, lower(source) AS source, lower(target) AS target, relation, round(sum(CAST(CAST(weight AS DECIMAL(10,2)) AS DOUBLE)), 4) AS weight, count(*) AS n FROM vr GROUP BY 1, 2, 3, 4"


@query
def a23_response_edges(spark, sf_dir):
    """Edges merged within each reply."""
    t = P.relationship_rows(P.parse_records(responses(spark, sf_dir), "id", "response"), "id")
    return P.merge_edges(t, "id").withColumn("weight", F.round("weight", 4))


SQL["a23_response_edges"] = _ROWS + " SELECT id, lower(source) AS source, lower(target) AS target, string_agg(lower(relation), chr(10) ORDER BY h) AS relations, array_to_string(list(id), ', ') AS source_id, round(sum(CAST(CAST(weight AS DECIMAL(10,2)) AS DOUBLE)), 4) AS weight FROM vr GROUP BY 1, 2, 3"


@query
def a24_merged_responses(spark, sf_dir):
    """Edges merged across replies: relations, number of replies, weight."""
    t = P.merge_edges(P.relationship_rows(P.parse_records(responses(spark, sf_dir), "id", "response"), "id"), "id")
    return P.merge_responses(t, "id").select("source", "target", F.array_join("relations", "|").alias("relations"), F.size("responses").alias("responses"), F.round("weight", 4).alias("weight"))


SQL["a24_merged_responses"] = _ROWS + ", e AS (SELECT id, lower(source) AS source, lower(target) AS target, string_agg(relation, chr(10) ORDER BY h) AS relations, sum(CAST(CAST(weight AS DECIMAL(10,2)) AS DOUBLE)) AS weight FROM vr GROUP BY 1, 2, 3) SELECT source, target, array_to_string(list_sort(list_distinct(list(relations))), '|') AS relations, CAST(count(DISTINCT id) AS INT) AS responses, round(sum(weight), 4) AS weight FROM e GROUP BY 1, 2"


@query
def g12_merged_nodes(spark, sf_dir):
    """Nodes merged across replies, with those only named by edges."""
    r = P.parse_records(responses(spark, sf_dir), "id", "response")
    t = P.merge_nodes(P.entity_rows(r, "id"), P.relationship_rows(r, "id"), "id")
    return t.select("title", "type", F.array_join("descriptions", "|").alias("descriptions"), F.size("responses").alias("responses"))


SQL["g12_merged_nodes"] = _ROWS + ", n AS (SELECT id, lower(source) AS title, 'STRUCTURE' AS type, 'about ' || source AS d FROM vr UNION ALL SELECT id, lower(target), '', NULL FROM vr) SELECT title, max(type) AS type, coalesce(array_to_string(list_sort(list_distinct(list(d) FILTER (d IS NOT NULL))), '|'), '') AS descriptions, CAST(count(DISTINCT id) AS INT) AS responses FROM n GROUP BY title"


def vocabulary(spark: SparkSession, sf_dir: str) -> list[str]:
    """The fixed relation vocabulary; raises if it is larger than the driver should hold."""
    return [r.relation for r in collect_bounded(table(spark, sf_dir, "relation_map").select("relation"), 10_000, "relations")]


@query
def n6_allowed_relations(spark, sf_dir):
    """Sorted allowed relations of cells that hold several, exploded."""
    t = table(spark, sf_dir, "predictions").groupBy("id").agg(F.array_join(F.array_sort(F.collect_list("relation")), "\n").alias("cell"))
    names = vocabulary(spark, sf_dir)
    return t.select("id", F.explode(P.allowed_relations(P.flatten_relations(F.col("cell")), names)).alias("relation"))


SQL["n6_allowed_relations"] = rf"SELECT DISTINCT id, lower({_TRIM.format('relation')}) AS relation FROM predictions WHERE lower({_TRIM.format('relation')}) IN (SELECT relation FROM relation_map)"


@query
def n4_aliases(spark, sf_dir):
    """Relations after alias replacement: by the usual map, some spellings made of row numbers, and by an own map."""
    names = F.array(*[F.lit(a) for a in (*T.RELATION_ALIASES, "stores")])
    t = table(spark, sf_dir, "predictions").select("row_no", F.lower(F.col("relation")).alias("relation"), F.get(names, (F.col("row_no") % (len(T.RELATION_ALIASES) + 1)).cast("int")).alias("usual"))
    return t.select("row_no", T.alias_relation(F.col("usual")).alias("usual"), T.alias_relation(F.col("relation"), {"stores": "keeps", "sends axons to": "sends_axons_to", "excites": "raises"}).alias("relation"))


_ALIAS_CASES = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(T.RELATION_ALIASES.values()))
SQL["n4_aliases"] = f"SELECT row_no, CASE row_no % {len(T.RELATION_ALIASES) + 1} {_ALIAS_CASES} ELSE 'stores' END AS usual, CASE lower(relation) WHEN 'stores' THEN 'keeps' WHEN 'sends axons to' THEN 'sends_axons_to' WHEN 'excites' THEN 'raises' ELSE lower(relation) END AS relation FROM predictions"


# ---- JSON columns


def relation_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON objects {head: [relations]} per snippet; some values scalar, some of another shape, some text broken."""
    p = table(spark, sf_dir, "predictions").filter("head is not null")
    g = p.groupBy("id", "head").agg(F.array_sort(F.collect_set("relation")).alias("rels"))
    m = F.length("head") % 4
    value = F.when(m == 0, F.to_json(F.struct(F.get("rels", F.lit(0)).alias("v")))).otherwise(F.to_json(F.struct(F.col("rels").alias("v"))))
    value = F.when(m == 3, F.lit('{"v":{"odd":1}}')).otherwise(value)
    value = F.when(F.regexp_extract(value, r'^\{"v":(.*)\}$', 1) == "", F.lit("[]")).otherwise(F.regexp_extract(value, r'^\{"v":(.*)\}$', 1))
    pair = F.concat(F.regexp_extract(F.to_json(F.struct(F.concat(F.lit(" "), F.upper("head")).alias("k"))), r'^\{"k":(.*)\}$', 1), F.lit(":"), value)
    out = g.groupBy("id").agg(F.array_join(F.array_sort(F.collect_list(pair)), ",").alias("x"))
    return out.select("id", F.when(F.right("id", F.lit(3)).cast("int") % 7 == 6, F.concat(F.lit("{broken"), "x")).otherwise(F.concat(F.lit("{"), "x", F.lit("}"))).alias("relations_json"))


@query
def r1_relation_maps(spark, sf_dir):
    """Cleaned relations per head from JSON objects."""
    names = vocabulary(spark, sf_dir)
    return P.relation_map_rows(relation_json(spark, sf_dir), "id", "relations_json", names).select("id", "head", F.array_join("relations", ",").alias("relations"))


SQL["r1_relation_maps"] = r"""WITH g AS (SELECT id, head, list_sort(list_distinct(list(relation) FILTER (relation IS NOT NULL))) AS rels FROM predictions WHERE head IS NOT NULL GROUP BY 1, 2),
c AS (SELECT id, head, lower(trim(head)) AS lh, CASE length(head) % 4 WHEN 3 THEN [] WHEN 0 THEN rels[1:1] ELSE rels END AS rels FROM g WHERE CAST(right(id, 3) AS INT) % 7 <> 6),
u AS (SELECT id, lh, unnest(rels) AS r FROM c),
x AS (SELECT DISTINCT id, lh, lower(regexp_replace(r, '^[\s\x0B\x1C-\x1F\x{85}\p{Z}]+|[\s\x0B\x1C-\x1F\x{85}\p{Z}]+$', '', 'g')) AS r FROM u), y AS (SELECT id, lh, list_sort(list(r)) AS rels FROM x WHERE r IN (SELECT relation FROM relation_map) GROUP BY 1, 2)
SELECT id, lh AS head, array_to_string(rels, ',') AS relations FROM y"""


@query
def r2_relation_rows(spark, sf_dir):
    """Head and relation rows with the first relation of each head marked."""
    names = vocabulary(spark, sf_dir)
    t = P.relation_map_rows(relation_json(spark, sf_dir), "id", "relations_json", names)
    return P.relation_rows(t, "id")


SQL["r2_relation_rows"] = SQL["r1_relation_maps"].replace("SELECT id, lh AS head, array_to_string(rels, ',') AS relations FROM y", "SELECT id, lh AS head, unnest(rels) AS relation, generate_subscripts(rels, 1) = 1 AS is_first FROM y")


SQL["f6_has_relations"] = SQL["r1_relation_maps"].replace("SELECT id, lh AS head, array_to_string(rels, ',') AS relations FROM y", "SELECT DISTINCT g.id, g.id IN (SELECT id FROM y) AS has_relations FROM g")


@query
def n11_salvaged_objects(spark, sf_dir):
    """Rightmost object of messy replies."""
    t = relation_json(spark, sf_dir)
    messy = F.when(F.right("id", F.lit(3)).cast("int") % 2 == 0, F.concat(F.lit("Sure: {not it}\n```json\n"), "relations_json", F.lit("\n```\nDone."))).otherwise(F.replace("relations_json", F.lit('"'), F.lit("'")))
    return t.select("id", P.salvaged()(messy).alias("object")).filter("object is not null")


@query
def n12_first_objects(spark, sf_dir):
    """First object of replies: fenced, fenced but broken with a whole one around, and bare."""
    d = F.right("id", F.lit(3)).cast("int") % 3
    whole = F.concat(F.lit('{"id":"'), "id", F.lit('"}'))
    reply = F.when(d == 0, F.concat(F.lit("Here:\n```json\n"), whole, F.lit("\n```"))).when(d == 1, F.concat(F.lit('so {"a": "```json {x} ```", "id":"'), "id", F.lit('"} done'))).otherwise(F.concat(F.lit("{no "), whole))
    t = table(spark, sf_dir, "predictions").select("id").distinct()
    return t.select("id", F.get_json_object(P.first_json_object(reply), "$.id").alias("found"))


SQL["n12_first_objects"] = "SELECT DISTINCT id, CASE WHEN CAST(right(id, 3) AS INT) % 3 < 2 THEN id END AS found FROM predictions"


@query
def f6_has_relations(spark, sf_dir):
    """Whether a snippet keeps any allowed relation."""
    return P.has_relations(relation_json(spark, sf_dir), "id", "relations_json", vocabulary(spark, sf_dir))


@query
def n10_json_lists(spark, sf_dir):
    """Entity lists in replies, as JSON or only quoted."""
    t = table(spark, sf_dir, "eval_items").select("item_id", F.transform("paths", lambda s: s["start"]).alias("a"))
    j = F.to_json(F.concat("a", F.array(F.lit(" "))))  # a blank entry counts for nothing
    reply = F.when(F.col("item_id") % 2 == 0, F.concat(F.lit("<think>[no]</think> "), j)).otherwise(F.concat_ws(" and ", F.transform("a", lambda x: F.concat(F.lit('"'), F.upper(x), F.lit(' "')))))
    return t.select("item_id", F.array_join(P.json_list(reply), "|").alias("names"))


SQL["n10_json_lists"] = "SELECT item_id, array_to_string(list_transform(paths, lambda s: lower(s.start)), '|') AS names FROM eval_items"


@query
def y2_lenient_json(spark, sf_dir):
    """Whether each JSON column parses."""
    return relation_json(spark, sf_dir).select("id", F.try_parse_json("relations_json").isNotNull().alias("parses"))


SQL["y2_lenient_json"] = "SELECT DISTINCT id, CAST(right(id, 3) AS INT) % 7 <> 6 AS parses FROM predictions WHERE head IS NOT NULL"


# ---- predictions


@query
def f7_tails(spark, sf_dir):
    """Predictions with a tail, normalised."""
    return P.with_tails(table(spark, sf_dir, "predictions")).select("row_no", T.normalize_tail(F.col("tail")).alias("tail"))


SQL["f7_tails"] = r"""WITH c AS (SELECT row_no, regexp_replace(regexp_replace(tail, '\s+', ' ', 'g'), '^[\s\x0B\x1C-\x1F\x{85}\p{Z}]+|[\s\x0B\x1C-\x1F\x{85}\p{Z}]+$', '', 'g') AS t FROM predictions WHERE length(trim(tail, ' ')) > 0)
SELECT row_no, CASE WHEN length(t) >= 2 AND left(t, 1) = right(t, 1) AND left(t, 1) IN ('"', '''') THEN trim(substr(t, 2, length(t) - 2), ' ') ELSE t END AS tail FROM c"""


@query
def dd1_distinct_predictions(spark, sf_dir):
    """First row of every predicted triple with a tail."""
    t = table(spark, sf_dir, "predictions").filter(F.length(F.trim("tail")) > 0)
    return first_by(t, ["head", "relation", "tail"], [F.col("row_no")]).select("row_no", "head", "relation", "tail")


SQL["dd1_distinct_predictions"] = "SELECT min(row_no) AS row_no, head, relation, tail FROM predictions WHERE length(trim(tail, ' ')) > 0 GROUP BY head, relation, tail"


@query
def r4_exploded_tails(spark, sf_dir):
    """Tails of each query as rows, with one flagged row where there are none."""
    t = table(spark, sf_dir, "predictions").groupBy("id", "head", "relation").agg(F.array_sort(F.collect_list(F.when(F.length(F.trim("tail")) > 0, F.col("tail")))).alias("tails"))
    return P.explode_tails(t, "tails")


SQL["r4_exploded_tails"] = "SELECT id, head, relation, tail, false AS query_had_no_tails FROM predictions WHERE length(trim(tail, ' ')) > 0 UNION ALL SELECT id, head, relation, '', true FROM predictions GROUP BY ALL HAVING count(*) FILTER (length(trim(tail, ' ')) > 0) = 0"


@query
def dd4_distinct_tails(spark, sf_dir):
    """First spellings of the tails of each query, ignoring case."""
    t = table(spark, sf_dir, "predictions").filter("tail is not null").groupBy("id", "head").agg(F.transform(F.sort_array(F.collect_list(F.struct("row_no", "tail"))), lambda x: x["tail"]).alias("a"))
    return t.select("id", "head", F.array_join(P.distinct_ignoring_case(F.col("a")), "|").alias("tails"))


SQL["dd4_distinct_tails"] = "WITH f AS (SELECT id, head, lower(tail) AS l, min(row_no) AS r, arg_min(tail, row_no) AS t FROM predictions WHERE tail IS NOT NULL GROUP BY 1, 2, 3), k AS (SELECT *, row_number() OVER (PARTITION BY id, head ORDER BY r) AS n FROM f) SELECT id, head, string_agg(t, '|' ORDER BY r) AS tails FROM k WHERE n <= 50 GROUP BY 1, 2"


@query
def k13_prediction_shards(spark, sf_dir):
    """Rows and heads per modulo shard."""
    t = table(spark, sf_dir, "predictions")
    return t.groupBy(F.pmod("row_no", F.lit(4)).alias("shard")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("head").alias("heads"))


SQL["k13_prediction_shards"] = "SELECT row_no % 4 AS shard, count(*) AS n, count(DISTINCT head) AS heads FROM predictions GROUP BY 1"


@query
def n14_clipped_texts(spark, sf_dir):
    """Long texts clipped in the middle."""
    return table(spark, sf_dir, "text_units").select("row_no", T.clip_middle(F.col("text"), 1000).alias("clipped"))


SQL["n14_clipped_texts"] = "WITH t AS (SELECT row_no, " + _TRIM.format("coalesce(text, '')") + " AS t FROM text_units) SELECT row_no, CASE WHEN length(t) > 1000 THEN left(t, 500) || chr(10) || '...' || chr(10) || right(t, 500) ELSE t END AS clipped FROM t"


# ---- mentions and grounding


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.mentions(table(spark, sf_dir, "final_entities").select("title"), table(spark, sf_dir, "text_units").select("id", "text"))


_MENTIONS = r"""me AS (SELECT u.id AS snippet_id, name AS entity, strpos(lower(text), name) - 1 AS pos,
  CAST(least(len(list_filter(regexp_split_to_array(left(lower(text), strpos(lower(text), name) - 1), '\s+'), lambda w: w <> '')), 511) AS INT) AS token_pos
  FROM (SELECT DISTINCT lower(regexp_replace(title, '^[\s\x0B\x1C-\x1F\x{85}\p{Z}]+|[\s\x0B\x1C-\x1F\x{85}\p{Z}]+$', '', 'g')) AS name FROM final_entities) e
  JOIN text_units u ON contains(lower(u.text), e.name) WHERE e.name <> '')"""


@query
def n15_mentions(spark, sf_dir):
    """Places of entities in their text units, in characters and in words."""
    return found(spark, sf_dir)


SQL["n15_mentions"] = f"WITH {_MENTIONS} SELECT * FROM me"


def grounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = R.ground(triples(spark, sf_dir), found(spark, sf_dir), table(spark, sf_dir, "relation_map"))
    return t.select(F.col("ord.n").alias("h"), "snippet_id", "source", "target", "relation_id", "head_pos", "tail_pos")


@query
def j4_grounded(spark, sf_dir):
    """Triples with the snippets that mention both ends."""
    return grounded(spark, sf_dir).drop("source", "target")


SQL["j4_grounded"] = f"WITH {COERCED}, {_MENTIONS} SELECT va.h, a.snippet_id, relation_id, a.token_pos AS head_pos, b.token_pos AS tail_pos FROM va JOIN relation_map USING (relation) JOIN me a ON a.entity = lower(va.source) JOIN me b ON b.entity = lower(va.target) AND b.snippet_id = a.snippet_id"


@query
def a10_grounding_counters(spark, sf_dir):
    """Counters of the grounding."""
    t = triples(spark, sf_dir).select(F.col("ord.n").alias("h"), "source", "target", "relation")
    return R.grounding_counters(t, found(spark, sf_dir), table(spark, sf_dir, "relation_map"), "h")


SQL["a10_grounding_counters"] = f"""WITH {COERCED}, {_MENTIONS}, t AS (SELECT va.h, m.relation IS NOT NULL AS known, a.snippet_id, b.entity IS NOT NULL AS tl FROM va LEFT JOIN relation_map m USING (relation) LEFT JOIN me a ON a.entity = lower(va.source) LEFT JOIN me b ON b.entity = lower(va.target) AND b.snippet_id = a.snippet_id)
SELECT count(DISTINCT h) AS total, count(DISTINCT h) FILTER (snippet_id IS NULL) AS no_head_match, count(*) FILTER (snippet_id IS NOT NULL AND known AND NOT tl) AS no_cooccurrence, count(*) FILTER (snippet_id IS NOT NULL AND known AND tl) AS grounded FROM t"""


@query
def r6_sample_arrays(spark, sf_dir):
    """Leaf slots of grounded triples, word lengths standing for ids: their sum, the first and the place of the relation."""
    ids = F.transform(F.split("target", " "), lambda w: F.length(w) + 1)
    t = grounded(spark, sf_dir).withColumn("leaves", R.leaf_slots(ids, F.col("head_pos")))
    hot = F.array_position(R.one_hot(F.col("head_pos"), F.col("relation_id")), F.col("relation_id"))
    return t.select("h", "snippet_id", F.size("leaves").alias("slots"), F.get("leaves", F.col("head_pos") * 3).alias("first_id"), F.aggregate("leaves", F.lit(0), lambda a, x: a + x).alias("total"), hot.cast("int").alias("hot"))


SQL["r6_sample_arrays"] = SQL["j4_grounded"].replace("SELECT va.h, a.snippet_id, relation_id, a.token_pos AS head_pos, b.token_pos AS tail_pos", "SELECT va.h, a.snippet_id, CAST(1536 AS INT) AS slots, CAST(length(string_split(target, ' ')[1]) + 1 AS INT) AS first_id, CAST(list_sum(list_transform(string_split(target, ' ')[1:3], lambda w: length(w) + 1)) AS INT) AS total, CAST(a.token_pos + 1 AS INT) AS hot")


@query
def r8_token_chunks(spark, sf_dir):
    """Word lengths of text units joined per input file and cut into chunks of 128."""
    t = table(spark, sf_dir, "text_units").filter("text is not null").select("document_id", "row_no", F.transform(T.words(F.col("text")), lambda w: F.length(w)).alias("ids"))
    c = R.token_chunks(t, "document_id", "row_no", "ids", 128)
    return c.select("document_id", "chunk", F.size("input_ids").alias("n"), F.aggregate("input_ids", F.lit(0), lambda a, x: a + x).alias("total"))


SQL["r8_token_chunks"] = r"""WITH w AS (SELECT document_id, row_no, list_transform(list_filter(regexp_split_to_array(regexp_replace(text, '^[\s\x0B\x1C-\x1F\x{85}\p{Z}]+|[\s\x0B\x1C-\x1F\x{85}\p{Z}]+$', '', 'g'), '\s+'), lambda x: x <> ''), lambda x: length(x)) AS ids FROM text_units WHERE text IS NOT NULL),
d AS (SELECT document_id, flatten(list(ids ORDER BY row_no)) AS a FROM w GROUP BY 1), c AS (SELECT document_id, a, unnest(range(CASE WHEN len(a) >= 126 THEN len(a) // 126 WHEN len(a) > 0 THEN 1 ELSE 0 END)) AS chunk FROM d)
SELECT document_id, CAST(chunk AS INT) AS chunk, CAST(len(a[chunk * 126 + 1 : (chunk + 1) * 126]) + 2 AS INT) AS n, CAST(list_sum(a[chunk * 126 + 1 : (chunk + 1) * 126]) + 203 AS INT) AS total FROM c"""
