"""Queries over question-answer items and completions made of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandworks.functions import text as T
from strandworks.operators import graph as G
from strandworks.operators import qa as Q
from strandworks.operators import sampling as S
from strandworks.operators.merge import numbered
from strandworks.runtime import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def text_of():
    return F.col("question_and_explanation")


def query(f):
    QUERIES[f.__name__] = f
    return f


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "eval_items")


_Q = "question_and_explanation"
_TR = r"regexp_replace({0}, '^[\s\x0B\x1C-\x1F\x{{85}}\p{{Z}}]+|[\s\x0B\x1C-\x1F\x{{85}}\p{{Z}}]+$', '', 'g')"


def _between(a: str, b: str) -> str:
    return _TR.format(f"CASE WHEN contains({_Q}, '{a}') THEN split_part(substr({_Q}, strpos({_Q}, '{a}') + {len(a)}), '{b}', 1) ELSE '' END")


_FIELDS = f"fi AS (SELECT item_id, k_hops, paths, {_Q}, {_between('<Question>', '</Question>')} AS question, {_between('<Options>', '</Options>')} AS options, {_between('<Explanation>', '</Explanation>')} AS explanation, {_between('<Answer>:', '</Answer>')} AS answer FROM eval_items)"


@query
def n26_fields(spark, sf_dir):
    """Question, options, explanation and answer of every item."""
    return items(spark, sf_dir).select("item_id", *[c.alias(n) for n, c in Q.fields(text_of()).items()])


SQL["n26_fields"] = f"WITH {_FIELDS} SELECT item_id, question, options, explanation, answer FROM fi"


@query
def n26_messages(spark, sf_dir):
    """Training messages of every item."""
    t = items(spark, sf_dir).select("item_id", F.inline(Q.messages(text_of(), F.lit(""))))
    return t


SQL["n26_messages"] = f"WITH {_FIELDS} SELECT item_id, 'user' AS role, question || chr(10) || 'Options:' || options AS content FROM fi UNION ALL SELECT item_id, 'assistant', '<think>' || chr(10) || explanation || chr(10) || '</think>' || chr(10) || 'Final Answer: ' || answer FROM fi"


@query
def n27_rl_prompts(spark, sf_dir):
    """Prompt and answer for reinforcement learning."""
    return items(spark, sf_dir).select("item_id", Q.rl_prompt(text_of(), True).alias("prompt"), Q.rl_answer(text_of()).alias("answer"))


_QONLY = _TR.format(r"regexp_replace(regexp_replace(regexp_replace(CASE WHEN regexp_extract(question_and_explanation, '(?s)(<Question>.*?</Options>)', 1) = '' THEN question_and_explanation ELSE regexp_extract(question_and_explanation, '(?s)(<Question>.*?</Options>)', 1) END, '</?(?:Question|Options)>:?', '', 'g'), '[\[\]]', '', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g')".replace("{{", "{").replace("}}", "}"))
SQL["n27_rl_prompts"] = f"SELECT item_id, {_QONLY} || ' /think' AS prompt, upper(regexp_extract({_Q}, '<Answer>\\s*:?\\s*([A-D])', 1)) AS answer FROM eval_items"


@query
def n19_gold_answers(spark, sf_dir):
    """Gold answer and question text."""
    return items(spark, sf_dir).select("item_id", T.gold_answer(text_of()).alias("gold"), T.question_only(text_of()).alias("question"))


SQL["n19_gold_answers"] = f"SELECT item_id, nullif(upper(regexp_extract({_Q}, '(?i)<Answer>[:\\s]*([A-D])[:\\s]*</Answer>', 1)), '') AS gold, {_QONLY} AS question FROM eval_items"


@query
def f10_well_formed(spark, sf_dir):
    """Items that pass the structural filter, with their option lengths."""
    return items(spark, sf_dir).filter(Q.well_formed(text_of())).select("item_id", F.size(Q.option_lines(text_of())).alias("options"))


_OPT = f"list_transform(list_filter(string_split({_Q}, chr(10)), lambda x: regexp_matches(trim(x, ' '), '^[A-D]\\.')), lambda x: {_TR.format('substr(trim(x, chr(32)), 3)')})"
_TAGS = " AND ".join(f"contains({_Q}, '<{t}>') AND contains({_Q}, '</{t}>')" for t in Q.TAGS)
SQL["f10_well_formed"] = f"WITH o AS (SELECT *, {_OPT} AS op FROM eval_items WHERE {_TAGS} AND contains({_Q}, 'A.') AND contains({_Q}, 'B.') AND contains({_Q}, 'C.') AND contains({_Q}, 'D.')) SELECT item_id, CAST(len(op) AS INT) AS options FROM o WHERE len(list_filter(op, lambda b: b = '' OR (length(b) < 3 AND regexp_full_match(b, '[\\x00-\\x7f]*')))) = 0"


@query
def f12_length_filter(spark, sf_dir):
    """Explanations of 30 to 60 words."""
    e = Q.fields(text_of())["explanation"]
    return items(spark, sf_dir).filter(Q.kept_by_length(text_of(), 30, 60)).select("item_id", T.word_count(e).alias("words"))


SQL["f12_length_filter"] = f"WITH {_FIELDS}, w AS (SELECT item_id, len(list_filter(regexp_split_to_array(explanation, '\\s+'), lambda x: x <> '')) AS words FROM fi) SELECT item_id, CAST(words AS INT) AS words FROM w WHERE words BETWEEN 30 AND 60"


@query
def n31_path_texts(spark, sf_dir):
    """Paths as text in both forms."""
    return items(spark, sf_dir).select("item_id", Q.path_text(F.col("paths")).alias("arrows"), Q.path_text(F.col("paths"), False).alias("tuples"))


SQL["n31_path_texts"] = "SELECT item_id, array_to_string(list_transform(paths, lambda s: s.start || ' --' || s.relation || '--> ' || s.\"end\"), '; ') AS arrows, array_to_string(list_transform(paths, lambda s: '(' || s.start || ', ' || s.relation || ', ' || s.\"end\" || ')'), ', ') AS tuples FROM eval_items"


@query
def n35_path_validity(spark, sf_dir):
    """Validity of every path by a rule verdict on its first relation."""
    v = F.when(F.length(F.col("paths")[0]["relation"]) % 3 == 0, " VALID: yes").when(F.length(F.col("paths")[0]["relation"]) % 3 == 1, "Invalid").otherwise("?")
    return items(spark, sf_dir).filter(F.size("paths") > 0).select("item_id", Q.meaningful(F.col("paths"), v).alias("validity"))


SQL["n35_path_validity"] = "SELECT item_id, CASE WHEN len(paths) <= 2 OR length(paths[1].relation) % 3 = 0 THEN 'Valid' WHEN length(paths[1].relation) % 3 = 1 THEN 'Invalid' ELSE 'Skip' END AS validity FROM eval_items WHERE len(paths) > 0"


@query
def dd5_distinct_paths(spark, sf_dir):
    """First item of every distinct path."""
    return Q.distinct_paths(items(spark, sf_dir), "paths", "item_id")


SQL["dd5_distinct_paths"] = "SELECT min(item_id) AS item_id, count(*) AS n FROM eval_items GROUP BY paths"


@query
def g8_item_distances(spark, sf_dir):
    """Distances between all pairs of nodes of each item's path graph."""
    e = items(spark, sf_dir).select("item_id", F.explode("paths").alias("s")).select("item_id", F.col("s.start").alias("a"), F.col("s.end").alias("b"))
    return G.group_distances(e, "item_id")


SQL["g8_item_distances"] = """WITH RECURSIVE e AS (SELECT item_id, s.start AS a, s."end" AS b FROM (SELECT item_id, unnest(paths) AS s FROM eval_items)), u AS (SELECT item_id, a, b FROM e UNION SELECT item_id, b, a FROM e),
r(item_id, a, b, d) AS (SELECT item_id, a, a, 0 FROM u UNION SELECT r.item_id, r.a, u.b, d + 1 FROM r JOIN u ON u.item_id = r.item_id AND u.a = r.b WHERE d < 12),
m AS (SELECT item_id, a, b, min(d) AS d FROM r GROUP BY ALL), n AS (SELECT DISTINCT item_id, a AS n FROM u)
SELECT x.item_id, x.n AS a, y.n AS b, coalesce(m.d, 510) AS distance FROM n x JOIN n y ON x.item_id = y.item_id AND x.n < y.n LEFT JOIN m ON m.item_id = x.item_id AND m.a = x.n AND m.b = y.n"""


def _completions(spark, sf_dir):
    return Q.completions(items(spark, sf_dir))


_COMP = f"""WITH {_FIELDS}, b AS (SELECT *, '<think>' || question || ' ' || explanation || '</think>' || chr(10) || '<explanation>' || explanation || '</explanation>' || chr(10) AS body FROM fi),
co AS (SELECT item_id, answer, paths, CASE item_id % 6 WHEN 0 THEN body || '<answer>' || answer || '</answer>' WHEN 1 THEN body || '<answer>' || answer || '</answer>' || chr(10) || 'That is all.'
 WHEN 2 THEN '<think>first</think>' || body || '<answer>' || answer || '</answer>' WHEN 3 THEN body || '**Final Answer:** ' || lower(answer) WHEN 4 THEN '<think>' || explanation || '</think> The letter ' || answer || ' fits.' ELSE body || '<Answer>' || answer || '</Answer>' END AS c FROM b)"""


@query
def n23_extracted_answers(spark, sf_dir):
    """Answer by the cascade, by tags outside think blocks, and whether it is right."""
    c = F.col("completion")
    return _completions(spark, sf_dir).select("item_id", T.extract_answer(c).alias("extracted"), T.model_answer(c).alias("tagged"), (T.extract_answer(c) == F.col("answer")).alias("right"))


_EXTRACT = r"upper(coalesce(nullif(regexp_extract(replace(c, '*', ''), '(?i)Final Answer\s*[:\-]\s*([A-D])', 1), ''), nullif(regexp_extract(replace(c, '*', ''), '(?i)<answer>\s*([A-D])\s*</answer>', 1), ''), nullif(regexp_extract(split_part(c, '</think>', -1), '\b([A-D])\b', 1), ''), ''))"
SQL["n23_extracted_answers"] = _COMP + rf" SELECT item_id, {_EXTRACT} AS extracted, regexp_extract_all(regexp_replace(c, '(?s)<think>.*?</think>', '', 'g'), '<Answer>[:\s]*([A-D])[:\s]*</Answer>', 1)[-1] AS tagged, {_EXTRACT} = answer AS right FROM co"
SQL["n23_extracted_answers"] = SQL["n23_extracted_answers"].replace("AS right", 'AS "right"')


@query
def n25_format_flags(spark, sf_dir):
    """Format flags of every completion and the format reward."""
    flags = T.format_flags(F.col("completion"))
    return _completions(spark, sf_dir).select("item_id", *[f.alias(n) for n, f in flags.items()], F.round(T.format_reward(F.col("completion")), 6).alias("format_reward"))


_ONE = r"len(regexp_extract_all(c, '(?s)<think>.*?</think>')) = 1 AS think_once, len(regexp_extract_all(c, '(?s)<explanation>.*?</explanation>')) = 1 AS expl_once, len(regexp_extract_all(c, '(?i)<answer>\s*[A-D]\s*</answer>')) = 1 AS answer_once, contains(lower(c), '</answer>') AND trim(split_part(lower(c), '</answer>', -1), chr(10) || ' ') = '' AS no_trailing"
SQL["n25_format_flags"] = _COMP + f""", o AS (SELECT *, {_ONE} FROM co), f AS (SELECT *, think_once AND expl_once AND answer_once AND strpos(c, '</think>') < strpos(c, '<explanation>') AND strpos(c, '<explanation>') < strpos(c, '</explanation>')
 AND strpos(c, '</explanation>') < strpos(lower(c), '<answer>') AND strpos(lower(c), '<answer>') < strpos(lower(c), '</answer>') AS ordered FROM o)
SELECT item_id, think_once, expl_once, answer_once, no_trailing, ordered, round(CAST(0.04 AS DOUBLE) * (CAST(think_once AS INT) + CAST(expl_once AS INT) + CAST(answer_once AS INT) + CAST(no_trailing AS INT) + CAST(ordered AS INT)), 6) AS format_reward FROM f"""


@query
def m3_correctness_reward(spark, sf_dir):
    """Correctness less the length penalty, with the usual limits and, as texts are short, with softer ones; gold answers in words."""
    c, gold = F.col("completion"), F.concat(F.lit("Answer "), F.col("answer"))
    t = _completions(spark, sf_dir)
    return t.select("item_id", (T.word_count(c) * 2).alias("tokens"), F.round(T.correctness_reward(c, gold), 6).alias("reward"), F.round(T.correctness_reward(c, gold, None, 150, 400), 6).alias("short_reward"))


_PENALTY = "CASE WHEN tokens <= {0} THEN 0.0 WHEN tokens >= {1} THEN 1.0 ELSE (tokens - {0}) / ({1} - {0}) END"
SQL["m3_correctness_reward"] = _COMP + rf", k AS (SELECT item_id, regexp_extract_all('Answer ' || answer, '\b([A-D])\b', 1)[-1] AS gold, {_EXTRACT} AS x, 2 * len(list_filter(regexp_split_to_array(c, '\s+'), lambda w: w <> '')) AS tokens FROM co), r AS (SELECT *, CASE WHEN x = gold AND x <> '' THEN 1.0 ELSE -1.0 END AS ok FROM k) SELECT item_id, CAST(tokens AS INT) AS tokens, round(ok - {_PENALTY.format(550, 1500)}, 6) AS reward, round(ok - {_PENALTY.format(150, 400)}, 6) AS short_reward FROM r"


@query
def m5_alignment_reward(spark, sf_dir):
    """Path alignment reward of every completion."""
    r = T.alignment_reward(F.col("completion"), F.col("answer"), Q.path_text(F.col("paths")))
    return _completions(spark, sf_dir).select("item_id", F.round(r, 6).alias("reward"))


@query
def m6_coverage_reward(spark, sf_dir):
    """Older reward: recall of path tokens."""
    r = T.coverage_reward(T.thinking(F.col("completion")), Q.path_text(F.col("paths")))
    return _completions(spark, sf_dir).select("item_id", F.round(r, 6).alias("reward"))


_STOP = ", ".join(f"'{w}'" for w in T.STOP_WORDS)
_TOK = "list_filter(regexp_split_to_array(lower({0}), '[^a-z0-9]+'), lambda t: t <> '' AND NOT list_contains([" + _STOP + "], t))"
_PATH = "array_to_string(list_transform(paths, lambda s: s.start || ' --' || s.relation || '--> ' || s.\"end\"), '; ')"
SQL["m6_coverage_reward"] = _COMP + f""", t AS (SELECT item_id, {_TOK.format("split_part(split_part(c, '<think>', -1), '</think>', 1)")} AS tk, list_distinct({_TOK.format(_PATH)}) AS pk FROM co),
u AS (SELECT item_id, unnest(tk) AS w, generate_subscripts(tk, 1) AS i FROM t), g AS (SELECT *, i - row_number() OVER (PARTITION BY item_id, w ORDER BY i) AS run FROM u),
n AS (SELECT item_id, max(c) AS top FROM (SELECT item_id, w, count(*) AS c FROM u GROUP BY 1, 2) GROUP BY 1), r AS (SELECT item_id, max(c) AS most FROM (SELECT item_id, w, run, count(*) AS c FROM g GROUP BY 1, 2, 3) GROUP BY 1)
SELECT item_id, round(CASE WHEN len(pk) = 0 OR len(tk) = 0 THEN 0.0 ELSE (0.8 * len(list_intersect(pk, tk)) / len(pk) + CASE WHEN len(list_intersect(pk, tk)) >= 2 THEN 0.3 ELSE 0.0 END)
 * greatest(0.0, greatest(0.0, 1 - greatest(0.0, top / len(tk) - 0.35) * 3) * (1 - greatest(0, most - 3) * 0.05)) END, 6) AS reward FROM t LEFT JOIN n USING (item_id) LEFT JOIN r USING (item_id)"""


_F1 = """n AS (SELECT item_id, max(c) AS top FROM (SELECT item_id, w, count(*) AS c FROM u GROUP BY 1, 2) GROUP BY 1), q AS (SELECT item_id, max(c) AS most FROM (SELECT item_id, w, run, count(*) AS c FROM g GROUP BY 1, 2, 3) GROUP BY 1)"""
_THINK = "split_part(split_part(c, '<think>', -1), '</think>', 1)"
SQL["m5_alignment_reward"] = _COMP + rf""", o AS (SELECT *, {_ONE}, {_EXTRACT} AS x FROM co), f AS (SELECT *, think_once AND expl_once AND answer_once AND strpos(c, '</think>') < strpos(c, '<explanation>') AND strpos(c, '<explanation>') < strpos(c, '</explanation>')
 AND strpos(c, '</explanation>') < strpos(lower(c), '<answer>') AND strpos(lower(c), '<answer>') < strpos(lower(c), '</answer>') AND no_trailing AS valid FROM o),
t AS (SELECT *, {_TOK.format(_THINK)} AS tk, list_distinct({_TOK.format(_PATH)}) AS pk, list_filter(regexp_split_to_array({_THINK}, '\s+'), lambda w: w <> '') AS ws FROM f),
s AS (SELECT *, list_distinct({_TOK.format("array_to_string(ws[1:423], ' ')")}) AS sk FROM t), h AS (SELECT *, len(list_intersect(pk, sk)) AS hits FROM s),
u AS (SELECT item_id, unnest(tk) AS w, generate_subscripts(tk, 1) AS i FROM t), g AS (SELECT *, i - row_number() OVER (PARTITION BY item_id, w ORDER BY i) AS run FROM u), {_F1}
SELECT item_id, round(CASE WHEN x <> '' AND x = answer AND valid AND len(pk) > 0 AND len(sk) > 0 THEN least(0.8, (0.7 * CASE WHEN hits > 0 THEN 2 * (hits / len(pk)) * (hits / len(sk)) / (hits / len(pk) + hits / len(sk)) ELSE 0.0 END + CASE WHEN hits >= 2 THEN 0.2 ELSE 0.0 END)
 * greatest(0.0, greatest(0.0, 1 - greatest(0.0, top / len(tk) - 0.35) * 3) * (1 - greatest(0, most - 3) * 0.05))) ELSE 0.0 END, 6) AS reward FROM h LEFT JOIN n USING (item_id) LEFT JOIN q USING (item_id)"""


@query
def k4_head_holdout(spark, sf_dir):
    """First rows of the items as evaluation part."""
    t = numbered(items(spark, sf_dir).select("item_id"), ["item_id"], "n")
    return S.head_holdout(t, "n").select("item_id", "is_eval")


SQL["k4_head_holdout"] = "SELECT item_id, dense_rank() OVER (ORDER BY item_id) - 1 < least(200, greatest(1, floor((SELECT count(*) FROM eval_items) * 0.02))) AS is_eval FROM eval_items"


@query
def k3_tail_holdout(spark, sf_dir):
    """Last twentieth of the text units as evaluation part."""
    t = table(spark, sf_dir, "text_units").select("row_no", (F.col("row_no") - F.lit(0)).alias("n"))
    least = t.agg(F.min("n").alias("m"))
    t = t.join(F.broadcast(least)).withColumn("n", F.col("n") - F.col("m"))
    return S.tail_holdout(t, "n").select("row_no", "is_eval")


SQL["k3_tail_holdout"] = "SELECT row_no, row_no - (SELECT min(row_no) FROM text_units) >= (SELECT count(*) - greatest(1, floor(count(*) * 5 / 100)) FROM text_units) AS is_eval FROM text_units"


@query
def k7_sampled_items(spark, sf_dir):
    """Fifty items by hash order."""
    return S.sample_rows(items(spark, sf_dir).select("item_id"), "item_id", 50)


SQL["k7_sampled_items"] = "SELECT item_id FROM eval_items ORDER BY md5(CAST(item_id AS VARCHAR)), item_id LIMIT 50"


@query
def k6_random_split(spark, sf_dir):
    """Seeded random split."""
    return S.random_split(items(spark, sf_dir).select("item_id"), "item_id", 0.1, None)


_UNIFORM = "((CAST('0x' || left(md5(CAST({0} AS VARCHAR)), 8) AS BIGINT) + 0.5) / 4294967296.0)"
SQL["k6_random_split"] = f"SELECT item_id, {_UNIFORM.format('item_id')} < 0.1 AS is_test FROM eval_items"


@query
def f12_counts(spark, sf_dir):
    """How many items the length filter keeps and removes."""
    return Q.split_by_length(items(spark, sf_dir), "question_and_explanation", 30, 60)[1]


SQL["f12_counts"] = f"WITH {_FIELDS}, w AS (SELECT len(list_filter(regexp_split_to_array(explanation, '\\s+'), lambda x: x <> '')) BETWEEN 30 AND 60 AS k FROM fi) SELECT count(*) FILTER (k) AS kept, count(*) FILTER (NOT k) AS removed FROM w"


def _no_judge():
    return lambda prompts: ["No " if len(p or "") % 3 == 0 else "no, not quite" for p in prompts]


@query
def y7_distinct_options(spark, sf_dir):
    """Items whose options a rule judge does not call near duplicates."""
    return Q.distinct_options(items(spark, sf_dir), "question_and_explanation", _no_judge).select("item_id")


_ASK = "Are the answer options of this multiple choice question sufficiently distinct? Respond with Yes or No only."
SQL["y7_distinct_options"] = SQL["f10_well_formed"].replace("SELECT item_id, CAST(len(op) AS INT) AS options", "SELECT item_id") + f" AND (length(question_and_explanation) + {len(_ASK) + 1}) % 3 <> 0"


@query
def k11_weighted_sample(spark, sf_dir):
    """Fifty entities, rarer ones likelier."""
    return S.weighted_sample(table(spark, sf_dir, "final_entities").select("title", "degree"), "title", "degree", 50, None)


SQL["k11_weighted_sample"] = f"SELECT title, degree FROM final_entities ORDER BY -ln({_UNIFORM.format('title')}) * (coalesce(degree, 0) + 1e-10), title LIMIT 50"


@query
def f13_subsets(spark, sf_dir):
    """The first hundred items and the last fifty: the subset switch of a trial run."""
    t = items(spark, sf_dir).select("item_id")
    return S.first_rows(t, "item_id", 100).withColumn("part", F.lit("first")).unionByName(S.last_rows(t, "item_id", 50).withColumn("part", F.lit("last")))


SQL["f13_subsets"] = "(SELECT item_id, 'first' AS part FROM eval_items ORDER BY item_id LIMIT 100) UNION ALL (SELECT item_id, 'last' FROM eval_items ORDER BY item_id DESC LIMIT 50)"


@query
def k12_requeued(spark, sf_dir):
    """Draws of items of two and three hops for a target of 150: five times as many, shuffled anew when used up."""
    t = items(spark, sf_dir).filter("k_hops between 2 and 3").select("item_id")
    return S.requeued(t, "item_id", 150)


SQL["k12_requeued"] = "WITH t AS (SELECT item_id FROM eval_items WHERE k_hops BETWEEN 2 AND 3), r AS (SELECT item_id, CAST(r AS INT) AS round FROM t, range(CAST(ceil(750.0 / greatest(1, (SELECT count(*) FROM t))) AS BIGINT)) x(r)), n AS (SELECT *, row_number() OVER (ORDER BY round, md5('|' || round || '|' || item_id), item_id) - 1 AS attempt FROM r) SELECT attempt, round, item_id FROM n WHERE attempt < 750"
