"""Queries of the remaining text, array, sampling and graph helpers over the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandworks.functions import text as T
from strandworks.functions import tokens as K
from strandworks.functions.scoring import judged_by_all, score
from strandworks.operators import graph as G
from strandworks.operators import grounding as R
from strandworks.operators import qa as Q
from strandworks.operators import records as P
from strandworks.operators import sampling as S
from strandworks.operators.merge import name_sets
from strandworks.plans.kg_queries import _DEG, _TRIM, COERCED, triples
from strandworks.plans.qa_queries import _COMP, _FIELDS, _UNIFORM, _completions, items, text_of
from strandworks.plans.text_queries import _MENTIONS, found
from strandworks.runtime import table
from strandworks.sources.tables import chunk_texts, remaining, run_tag

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def s1_word_chunks(spark, sf_dir):
    """Documents cut into overlapping windows of 120 words."""
    t = chunk_texts(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text", 120, 20)
    return t.select("doc_id", "ordinal", "n_words", F.length("text").alias("n_chars"))


SQL["s1_word_chunks"] = r"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL),
c AS (SELECT doc_id, w, unnest(range(CAST(greatest(1, ceil((len(w) - 20) / 100)) AS BIGINT))) AS o FROM w WHERE len(w) > 0)
SELECT doc_id, CAST(o AS INT) AS ordinal, CAST(len(w[o * 100 + 1 : o * 100 + 120]) AS INT) AS n_words, length(array_to_string(w[o * 100 + 1 : o * 100 + 120], ' ')) AS n_chars FROM c"""


@query
def n9_clean_descriptions(spark, sf_dir):
    """Descriptions with entities unescaped and control characters dropped."""
    return table(spark, sf_dir, "final_entities").select("title", P.clean_text(F.col("description")).alias("description"))


SQL["n9_clean_descriptions"] = "SELECT title, " + _TRIM.format(r"regexp_replace(replace(replace(replace(replace(replace(replace(description, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', chr(39)), '&nbsp;', ' '), '&amp;', '&'), '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]', '', 'g')".replace("{", "{{").replace("}", "}}").replace('\\"', '"')) + " AS description FROM final_entities"


@query
def n17_verdicts(spark, sf_dir):
    """Verdicts parsed three ways from replies built of item numbers."""
    d = F.col("item_id") % 4
    reply = F.when(d == 0, " Yes. [no]").when(d == 1, "so [YES] Correct: no").when(d == 2, "true; correct: Yes").otherwise("none")
    t = items(spark, sf_dir).select("item_id", reply.alias("r"))
    return t.select("item_id", T.bracket_verdict(F.col("r")).alias("bracket"), T.leading_verdict(F.col("r")).alias("leading"), T.correct_verdict(F.col("r")).alias("correct"))


SQL["n17_verdicts"] = "SELECT item_id, item_id % 4 = 1 AS bracket, item_id % 4 IN (0, 2) AS leading, CASE item_id % 4 WHEN 1 THEN 'No' WHEN 2 THEN 'Yes' ELSE 'error' END AS correct FROM eval_items"


@query
def n24_thinking(spark, sf_dir):
    """Thinking part of completions and its number of words."""
    t = _completions(spark, sf_dir)
    return t.select("item_id", T.thinking(F.col("completion")).alias("thinking"), T.word_count(T.outside_think(F.col("completion"))).alias("words_outside"))


SQL["n24_thinking"] = _COMP + " SELECT item_id, " + _TRIM.format("split_part(split_part(c, '<think>', -1), '</think>', 1)") + r" AS thinking, CAST(len(list_filter(regexp_split_to_array(regexp_replace(c, '(?s)<think>.*?</think>', '', 'g'), '\s+'), lambda x: x <> '')) AS INT) AS words_outside FROM co"


@query
def n28_chat_texts(spark, sf_dir):
    """Items in chat form."""
    f = Q.fields(text_of())
    return items(spark, sf_dir).select("item_id", Q.chat("Answer.", f["question"], f["explanation"], f["answer"]).alias("chat"))


SQL["n28_chat_texts"] = f"WITH {_FIELDS} SELECT item_id, '<|system|>' || chr(10) || 'Answer.' || chr(10) || '<|user|>' || chr(10) || question || chr(10) || '<|assistant|>' || chr(10) || '<think>' || chr(10) || explanation || chr(10) || '</think>' || chr(10) || answer AS chat FROM fi"


@query
def n30_combined(spark, sf_dir):
    """Question, explanation and answer combined and parsed again."""
    f = Q.fields(text_of())
    t = items(spark, sf_dir).select("item_id", Q.combine(f["question"], f["explanation"], f["answer"]).alias("question_and_explanation"))
    return t.select("item_id", *[c.alias(n) for n, c in Q.fields(text_of()).items() if n in ("explanation", "answer")])


SQL["n30_combined"] = f"WITH {_FIELDS} SELECT item_id, explanation, answer FROM fi"


@query
def n33_validation_prompts(spark, sf_dir):
    """Prompts for validation."""
    f = Q.fields(text_of())
    t = items(spark, sf_dir).select("item_id", f["question"].alias("question"), f["answer"].alias("answer"), f["explanation"].alias("thinking_trace"), Q.path_text(F.col("paths")).alias("context_path"))
    return t.select("item_id", F.md5(Q.validation_prompt(t)).alias("prompt_md5"))


SQL["n33_validation_prompts"] = f"""WITH {_FIELDS} SELECT item_id, md5('Path: ' || array_to_string(list_transform(paths, lambda s: s.start || ' --' || s.relation || '--> ' || s."end"), '; ') || chr(10) || 'Question: ' || question || chr(10) || 'Answer: ' || answer || chr(10) || 'Explanation: ' || explanation) AS prompt_md5 FROM fi"""


@query
def n34_run_tags(spark, sf_dir):
    """Tags of the input files in short and long form, each alone and with its first unit."""
    t = table(spark, sf_dir, "text_units").filter("document_id is not null").groupBy("document_id").agg(F.min("id").alias("first_id"))
    one = F.array("document_id")
    return t.select("document_id", run_tag(one).alias("tag"), run_tag(one, 16).alias("long_tag"), run_tag(F.array("first_id", "document_id")).alias("pair_tag"))


SQL["n34_run_tags"] = "SELECT document_id, left(md5(document_id), 10) AS tag, left(md5(document_id), 16) AS long_tag, left(md5(least(min(id), document_id) || chr(10) || greatest(min(id), document_id)), 10) AS pair_tag FROM text_units WHERE document_id IS NOT NULL GROUP BY document_id"


@query
def m2_repetition(spark, sf_dir):
    """Tokens and repetition factor of every document."""
    t = table(spark, sf_dir, "documents").select("doc_id", T.reward_tokens(F.col("text")).alias("w"))
    return t.select("doc_id", F.size("w").alias("tokens"), F.round(T.repetition_factor(F.col("w")), 6).alias("factor"))


_STOP = ", ".join(f"'{w}'" for w in T.STOP_WORDS)
SQL["m2_repetition"] = f"""WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z0-9]+'), lambda t: t <> '' AND NOT list_contains([{_STOP}], t)) AS w FROM documents),
u AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM t), g AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, x ORDER BY i) AS run FROM u),
n AS (SELECT doc_id, max(c) AS top FROM (SELECT doc_id, x, count(*) AS c FROM u GROUP BY 1, 2) GROUP BY 1), r AS (SELECT doc_id, max(c) AS most FROM (SELECT doc_id, x, run, count(*) AS c FROM g GROUP BY 1, 2, 3) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS INT) AS tokens, round(CASE WHEN len(w) = 0 THEN 1.0 ELSE greatest(0.0, greatest(0.0, 1 - greatest(0.0, top / len(w) - 0.35) * 3) * (1 - greatest(0, most - 3) * 0.05)) END, 6) AS factor FROM t LEFT JOIN n USING (doc_id) LEFT JOIN r USING (doc_id)"""


@query
def m7_truncated(spark, sf_dir):
    """Text units truncated to 100 tokens' worth of words."""
    return table(spark, sf_dir, "text_units").filter("text is not null").select("row_no", T.word_count(T.truncate_words(F.col("text"), 100)).alias("words"))


SQL["m7_truncated"] = r"SELECT row_no, CAST(least(76, len(list_filter(regexp_split_to_array(text, '[\s\x0B\x1C-\x1F\x{85}]+'), lambda x: trim(x, chr(160)) <> ''))) AS INT) AS words FROM text_units WHERE text IS NOT NULL"


@query
def m10_span_lengths(spark, sf_dir):
    """Distribution of span lengths."""
    return spark.range(1).select(F.posexplode(R.span_lengths(10)).alias("p", "w")).select((F.col("p") + 1).alias("length"), F.round("w", 9).alias("weight"))


SQL["m10_span_lengths"] = "SELECT CAST(i AS INT) AS length, round(pow(0.8, i - 1) * 0.2 / (1 - pow(0.8, 10)), 9) AS weight FROM range(1, 11) t(i)"


@query
def r5_padded_arrays(spark, sf_dir):
    """Path node lengths padded to six, with attention."""
    ids = F.transform("paths", lambda s: F.length(s["start"]))
    return items(spark, sf_dir).select("item_id", F.array_join(R.padded(ids, 6).cast("array<string>"), ",").alias("ids"), F.array_join(R.attention(R.padded(ids, 6)).cast("array<string>"), ",").alias("mask"))


SQL["r5_padded_arrays"] = "WITH i AS (SELECT item_id, list_resize(list_transform(paths, lambda s: length(s.start)), 6, 0) AS a FROM eval_items) SELECT item_id, array_to_string(a, ',') AS ids, array_to_string(list_transform(a, lambda x: CAST(x <> 0 AS INT)), ',') AS mask FROM i"


@query
def r9_long_paths(spark, sf_dir):
    """Paths from wide columns."""
    step = lambda i, f: F.get("paths", F.lit(i - 1))[f]
    t = items(spark, sf_dir).select("item_id", *[step(i, f).alias(f"{n}_{i}") for i in range(1, 6) for n, f in (("head", "start"), ("relation", "relation"), ("tail", "end"))])
    return t.select("item_id", F.posexplode(Q.long_paths(t, 4)).alias("p", "s")).select("item_id", (F.col("p") + 1).alias("step"), "s.start", "s.relation", "s.end")


SQL["r9_long_paths"] = 'SELECT item_id, CAST(i AS INT) AS step, s.start, s.relation, s."end" FROM (SELECT item_id, unnest(paths[1:5]) AS s, generate_subscripts(paths[1:5], 1) AS i FROM eval_items)'


@query
def r11_masked_tokens(spark, sf_dir):
    """Masked positions per text unit."""
    ids = F.transform(T.words(F.col("text")), lambda w: F.length(w) + 10)
    t = table(spark, sf_dir, "text_units").filter("text is not null").select("row_no", R.masked(ids, F.col("row_no"), 1, 30000).alias("m"))
    return t.select("row_no", F.size("m").alias("tokens"), F.size(F.filter("m", lambda x: x["label"] != -100)).alias("chosen"))


@query
def r12_masked_leaves(spark, sf_dir):
    """One masked leaf per item."""
    leaves = F.transform("paths", lambda s: F.length(s["end"]))
    return items(spark, sf_dir).filter(F.size("paths") > 0).select("item_id", R.masked_leaf(leaves, F.col("item_id"), 999).alias("m")).select("item_id", "m.slot", "m.label")


@query
def y18_token_pairs(spark, sf_dir):
    """Pairs of tail and head tokens of triples, counted."""
    t = triples(spark, sf_dir).select(F.col("ord.n").alias("h"), F.size(R.token_pairs(F.split("target", " "), F.split("source", " "))).alias("pairs"))
    return t


SQL["y18_token_pairs"] = f"WITH {COERCED} SELECT h, CAST(len(string_split(target, ' ')) * len(string_split(source, ' ')) AS INT) AS pairs FROM va"


@query
def y12_word_starts(spark, sf_dir):
    """Word starts among whitespace tokens of text units."""
    t = table(spark, sf_dir, "text_units").filter("text is not null").select("row_no", T.words(F.col("text")).alias("w"))
    return t.select("row_no", F.size(F.filter(R.word_starts(F.col("w")), lambda x: x)).alias("starts"))


SQL["y12_word_starts"] = r"SELECT row_no, CAST(len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: NOT starts_with(w, '##') AND regexp_matches(w, '^[\p{L}\p{N}]'))) AS INT) AS starts FROM text_units WHERE text IS NOT NULL"


@query
def k5_percent_split(spark, sf_dir):
    """First twentieth of the predictions as validation part."""
    t = table(spark, sf_dir, "predictions").select("row_no")
    low = t.agg(F.min("row_no").alias("m"))
    return S.percent_split(t.join(F.broadcast(low)).withColumn("n", F.col("row_no") - F.col("m")), "n").select("row_no", "is_validation")


SQL["k5_percent_split"] = "SELECT row_no, row_no - (SELECT min(row_no) FROM predictions) < (SELECT floor(count(*) * 5 / 100) FROM predictions) AS is_validation FROM predictions"


@query
def k9_top_relations(spark, sf_dir):
    """Three most frequent predicted relations per snippet with log-softmax of their counts."""
    t = table(spark, sf_dir, "predictions").filter("relation is not null").groupBy("id", "relation").agg(F.count(F.lit(1)).cast("double").alias("score"))
    return R.top_k(t, "id", "score", 3).select("id", "relation", "rank", F.round("log_probability", 6).alias("log_probability"))


SQL["k9_top_relations"] = "WITH c AS (SELECT id, relation, CAST(count(*) AS DOUBLE) AS s FROM predictions WHERE relation IS NOT NULL GROUP BY 1, 2), z AS (SELECT id, max(s) + ln(sum(exp(s - m))) AS lz FROM (SELECT *, max(s) OVER (PARTITION BY id) AS m FROM c) GROUP BY id) SELECT id, relation, CAST(k AS INT) AS rank, round(s - lz, 6) AS log_probability FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY s DESC, relation) AS k FROM c) JOIN z USING (id) WHERE k <= 3"


@query
def k15_checkpoints(spark, sf_dir):
    """Runs as checkpoints in the order of their number."""
    t = table(spark, sf_dir, "kg_runs").select(F.concat(F.lit("checkpoint-"), F.col("run_id") * 10).alias("name"))
    return t.withColumn("step", S.checkpoint_step(F.col("name"))).withColumn("latest", F.col("step") == F.max("step").over(Window.partitionBy()))


SQL["k15_checkpoints"] = "SELECT 'checkpoint-' || (run_id * 10) AS name, run_id * 10 AS step, run_id = max(run_id) OVER () AS latest FROM kg_runs"


@query
def j7_head_positions(spark, sf_dir):
    """Predictions with the first place of their head in the text units of the same words."""
    p = table(spark, sf_dir, "predictions").select("row_no", F.lower("head").alias("entity"))
    return p.join(R.first_mentions(found(spark, sf_dir)), "entity").select("row_no", "token_pos", "snippet_id")


SQL["j7_head_positions"] = f"WITH {_MENTIONS}, f AS (SELECT entity, token_pos, snippet_id FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY token_pos, snippet_id) AS k FROM me) WHERE k = 1) SELECT row_no, token_pos, snippet_id FROM predictions JOIN f ON f.entity = lower(head)"


@query
def j11_remaining(spark, sf_dir):
    """Items left for a run that has finished those of at most two hops."""
    t = items(spark, sf_dir).select("item_id", "k_hops")
    return remaining(t, t.filter("k_hops <= 2"), ["item_id"]).select("item_id")


SQL["j11_remaining"] = "SELECT item_id FROM eval_items WHERE NOT k_hops <= 2"


@query
def u3_name_sets(spark, sf_dir):
    """Names in triples and among entities: common, only in triples, only among entities."""
    return name_sets(triples(spark, sf_dir), table(spark, sf_dir, "final_entities").select(F.lower("title").alias("name")))


SQL["u3_name_sets"] = f"WITH {COERCED}, t AS (SELECT source AS name FROM va UNION SELECT target FROM va), e AS (SELECT DISTINCT lower(title) AS name FROM final_entities) SELECT count(*) FILTER (t.name IS NOT NULL AND e.name IS NOT NULL) AS both_sides, count(*) FILTER (e.name IS NULL) AS only_triples, count(*) FILTER (t.name IS NULL) AS only_entities FROM t FULL JOIN e ON t.name = e.name"


@query
def g7_sampled_starts(spark, sf_dir):
    """Twenty starts among entities that occur in the graph, rarer ones likelier."""
    from strandworks.operators.merge import degrees

    e = table(spark, sf_dir, "final_entities").select(F.lower("title").alias("title")).distinct().join(degrees(triples(spark, sf_dir)), "title")
    return S.weighted_sample(e, "title", "degree", 20, None)


SQL["g7_sampled_starts"] = f"WITH {COERCED}, {_DEG}, e AS (SELECT DISTINCT lower(title) AS title FROM final_entities) SELECT title, degree FROM e JOIN dg USING (title) ORDER BY -ln({_UNIFORM.format('title')}) * (degree + 1e-10), title LIMIT 20"


@query
def g10_lattice(spark, sf_dir):
    """Edges of the lattice of eight roots with three leaves each."""
    return spark.createDataFrame(G.lattice(8, 3), "a int, b int")


SQL["g10_lattice"] = "SELECT CAST(i AS INT) AS a, CAST(i + 1 AS INT) AS b FROM range(7) t(i) UNION ALL SELECT CAST(r AS INT), CAST(8 + r * 3 + k AS INT) FROM range(8) x(r), range(3) y(k)"


def _length_judge():
    return lambda prompts: ["Yes" if p and len(p) % 3 else "No" for p in prompts]


def _vowel_judge():
    return lambda prompts: ["yes" if p and p[-1] in "aeiour" else "no" for p in prompts]


@query
def x2_judged(spark, sf_dir):
    """Predictions that two batched judges accept, the second seeing only what the first accepted."""
    p = table(spark, sf_dir, "predictions").filter("tail is not null").select("row_no", F.concat_ws(" | ", "head", "relation", "tail").alias("prompt"))
    return judged_by_all(p, "prompt", [_length_judge, _vowel_judge]).select("row_no")


SQL["x2_judged"] = "SELECT row_no FROM (SELECT row_no, concat_ws(' | ', head, relation, tail) AS p FROM predictions WHERE tail IS NOT NULL) WHERE length(p) % 3 <> 0 AND right(p, 1) IN ('a', 'e', 'i', 'o', 'u', 'r')"


def _counter():
    return lambda prompts: [str(len((p or "").split())) for p in prompts]


@query
def x1_batched_map(spark, sf_dir):
    """A batched function over text units that keeps rows and columns."""
    t = table(spark, sf_dir, "text_units").select("row_no", "text")
    return score(t, "text", "reply", _counter).select("row_no", F.col("reply").cast("int").alias("words"))


SQL["x1_batched_map"] = r"SELECT row_no, CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\s\x0B\x1C-\x1F\x{85}\p{Z}]+'), lambda w: w <> '')) AS INT) AS words FROM text_units"


@query
def y1_token_ids(spark, sf_dir):
    """Subword ids of text units: their number, the first and the last."""
    t = table(spark, sf_dir, "text_units").filter("text is not null").select("row_no", K.token_ids()("text").alias("ids"))
    return t.select("row_no", F.size("ids").alias("tokens"), F.try_element_at("ids", F.lit(1)).alias("first_id"), F.try_element_at("ids", F.lit(-1)).alias("last_id"))


@query
def m7_truncated_tokens(spark, sf_dir):
    """Length of text units cut to 100 subword tokens."""
    t = table(spark, sf_dir, "text_units").filter("text is not null")
    return t.select("row_no", F.length(K.truncated(most=100)("text")).alias("n_chars"))


@query
def n16_token_positions(spark, sf_dir):
    """Places of entities in their text units in subword tokens."""
    e, u = table(spark, sf_dir, "final_entities").select("title"), table(spark, sf_dir, "text_units").select("id", "text")
    return R.mentions(e, u, tokenizer=K.DEFAULT)


@query
def r7_training_samples(spark, sf_dir):
    """Sums over the arrays of the training samples of grounded triples."""
    from strandworks.plans.text_queries import grounded

    u = table(spark, sf_dir, "text_units").select("id", "text")
    t = R.training_samples(grounded(spark, sf_dir), u, "id", "text", "source", "target")
    total = lambda c: F.aggregate(c, F.lit(0), lambda a, x: a + x)
    return t.select("h", "snippet_id", F.size("input_nodes").alias("nodes"), total("attention_mask").alias("attended"), total("leaf_relationships").alias("relation_id"), total("head_lengths").alias("head_length"), total("special_tokens_mask").alias("special"))


@query
def r8_subword_chunks(spark, sf_dir):
    """Subword ids of text units joined per input file and cut into chunks of 512."""
    t = table(spark, sf_dir, "text_units").filter("text is not null").select("document_id", "row_no", K.token_ids()("text").alias("ids"))
    special = K.special_ids(K.DEFAULT, ("<|startoftext|>", "<|endoftext|>"))
    c = R.token_chunks(t, "document_id", "row_no", "ids", 512, *special.values())
    return c.select("document_id", "chunk", F.size("input_ids").alias("n"), F.element_at("input_ids", 2).alias("first_id"))


@query
def y8_source_vocabulary(spark, sf_dir):
    """Entities as vocabulary lines with the frequencies of a graph laid over."""
    from strandworks.operators.merge import degrees

    e = table(spark, sf_dir, "final_entities").select("human_readable_id", F.lower("title").alias("title"))
    return G.source_vocabulary(e, "human_readable_id", "title", degrees(triples(spark, sf_dir)))


SQL["y8_source_vocabulary"] = f"WITH {COERCED}, {_DEG} SELECT e.human_readable_id AS id, coalesce(lower(e.title), dg.title) AS name, coalesce(dg.degree, 0) AS frequency FROM final_entities e FULL JOIN dg ON dg.title = lower(e.title)"


@query
def g9_path_edges(spark, sf_dir):
    """Steps of the items' node lists with the relation of their edge."""
    t = items(spark, sf_dir).filter(F.size("paths") > 0).select("item_id", F.concat(F.array(F.col("paths")[0]["start"]), F.transform("paths", lambda s: s["end"])).alias("nodes"))
    e = items(spark, sf_dir).select(F.explode("paths").alias("s")).groupBy(F.col("s.start").alias("a"), F.col("s.end").alias("b")).agg(F.min("s.relation").alias("relation"))
    return G.path_edges(t, "item_id", "nodes", e, "a", "b")


SQL["g9_path_edges"] = """WITH s AS (SELECT item_id, unnest(paths) AS s FROM eval_items), e AS (SELECT s.start AS a, s."end" AS b, min(s.relation) AS relation FROM s GROUP BY 1, 2),
n AS (SELECT item_id, list_concat([paths[1].start], list_transform(paths, lambda s: s."end")) AS n FROM eval_items WHERE len(paths) > 0), p AS (SELECT item_id, unnest(range(len(n) - 1)) AS place, n FROM n)
SELECT item_id, CAST(place AS INT) AS place, n[place + 1] AS a, n[place + 2] AS b, e.relation FROM p LEFT JOIN e ON e.a = n[place + 1] AND e.b = n[place + 2]"""


@query
def g4_sampled_paths(spark, sf_dir):
    """One path of three hops from every well-connected entity that has any."""
    from strandworks.operators.merge import degrees
    from strandworks.plans.kg_queries import _seeds

    t = triples(spark, sf_dir)
    return G.sampled_paths(t, _seeds(spark, sf_dir), 3, "stores", G.hubs(degrees(t)).select("title")).select("start", "hop1", "hop2", "hop3", "end")


@query
def g4_path_starts(spark, sf_dir):
    """The well-connected entities that any path of three hops begins at."""
    return g4_sampled_paths(spark, sf_dir).select("start")


SQL["g4_path_starts"] = f"""WITH {COERCED}, {_DEG}, hb AS (SELECT title FROM (SELECT *, row_number() OVER (ORDER BY degree DESC, title) AS r, count(*) OVER () AS n FROM dg) WHERE r <= greatest(1, CAST(floor(n * 0.01) AS BIGINT))),
ed3 AS (SELECT DISTINCT source, relation, target FROM va), e AS (SELECT source, target, CAST(relation = 'stores' AS INT) + CAST(target IN (SELECT title FROM hb) AS INT) AS cost FROM ed3), f AS (SELECT source, target, min(cost) AS cost FROM e GROUP BY 1, 2),
s AS (SELECT DISTINCT lower(title) AS title FROM final_entities WHERE degree >= 10)
SELECT DISTINCT a.source AS start FROM f a JOIN s ON s.title = a.source JOIN f b ON b.source = a.target JOIN f d ON d.source = b.target
WHERE b.target <> a.source AND d.target NOT IN (a.source, a.target) AND CAST(a.source IN (SELECT title FROM hb) AS INT) + a.cost + b.cost + d.cost <= 1
AND NOT EXISTS (SELECT 1 FROM f n WHERE n.source = a.source AND n.target = b.target) AND NOT EXISTS (SELECT 1 FROM f n WHERE n.source = a.source AND n.target = d.target)"""
