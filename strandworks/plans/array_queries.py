"""Queries of the array helpers of training samples, of retried and recovered model calls, and of ranks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandworks.functions.scoring import recover, score, with_retry
from strandworks.operators import grounding as R
from strandworks.operators import merge as M
from strandworks.plans.kg_queries import _COLLAPSED, COERCED, triples
from strandworks.plans.qa_queries import items
from strandworks.runtime import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def _some(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items(spark, sf_dir).filter(F.size("paths") > 0)


def _text(c):
    return F.array_join(c.cast("array<string>"), ",")


_NODES = "n AS (SELECT item_id, paths, list_transform(paths, lambda s: length(s.start)) AS a FROM eval_items WHERE len(paths) > 0)"


@query
def y13_word_ends(spark, sf_dir):
    """End of the first word of each item's nodes, their further words standing for continuation pieces."""
    pieces = F.flatten(F.transform("paths", lambda s: F.transform(F.split(s["start"], " "), lambda w, i: F.when(i > 0, F.concat(F.lit("##"), w)).otherwise(w))))
    return _some(spark, sf_dir).select("item_id", R.word_end(pieces, F.lit(1)).alias("word_end"))


SQL["y13_word_ends"] = "SELECT item_id, CAST(len(string_split(paths[1].start, ' ')) AS INT) AS word_end FROM eval_items WHERE len(paths) > 0"


@query
def y14_leaf_runs(spark, sf_dir):
    """Positions of leaves grouped by their root of four."""
    runs = R.leaf_runs(F.transform("paths", lambda s: F.length(s["start"])), 4)
    t = _some(spark, sf_dir).select("item_id", F.explode(runs).alias("run"))
    return t.select("item_id", F.floor(F.col("run")[0] / 4).alias("root"), F.size("run").alias("leaves"))


SQL["y14_leaf_runs"] = f"WITH {_NODES}, u AS (SELECT item_id, unnest(a) AS x FROM n) SELECT item_id, CAST(floor(x / 4) AS BIGINT) AS root, CAST(count(*) AS INT) AS leaves FROM u GROUP BY 1, 2"


@query
def y15_overlapping_spans(spark, sf_dir):
    """Whether any two spans of an item share a position."""
    spans = F.transform("paths", lambda s, i: F.struct((i * 12 + F.length(s["relation"])).alias("start"), (i * 12 + F.length(s["relation"]) + F.length(s["start"]) % 9).alias("stop")))
    return _some(spark, sf_dir).select("item_id", R.spans_overlap(spans).alias("overlap"))


SQL["y15_overlapping_spans"] = """WITH s AS (SELECT item_id, i, (i - 1) * 12 + length(p.relation) AS a, (i - 1) * 12 + length(p.relation) + length(p.start) % 9 AS b FROM (SELECT item_id, unnest(paths) AS p, generate_subscripts(paths, 1) AS i FROM eval_items))
SELECT item_id, bool_or(o) AS overlap FROM (SELECT x.item_id, coalesce(y.a <= x.b AND x.a <= y.b, false) AS o FROM s x LEFT JOIN s y ON x.item_id = y.item_id AND x.i < y.i) GROUP BY item_id"""


@query
def y16_boundary_pairs(spark, sf_dir):
    """Neighbours of a span inside eight roots, or a pair of -1."""
    start = (F.col("item_id") % 7).cast("int")
    span = F.array(F.struct(start.alias("start"), (start + F.size("paths") % 3).alias("stop")))
    return _some(spark, sf_dir).select("item_id", F.inline(R.boundary_pairs(span, 8)))


SQL["y16_boundary_pairs"] = "WITH s AS (SELECT item_id, CAST(item_id % 7 AS INT) AS a, CAST(item_id % 7 + len(paths) % 3 AS INT) AS b FROM eval_items WHERE len(paths) > 0) SELECT item_id, CASE WHEN a >= 1 AND b + 1 < 8 THEN a - 1 ELSE -1 END AS \"left\", CASE WHEN a >= 1 AND b + 1 < 8 THEN b + 1 ELSE -1 END AS \"right\" FROM s"


@query
def y17_padded_spans(spark, sf_dir):
    """Two spans of each item's nodes, cut and filled to three."""
    spans = F.array(*[F.struct(F.lit(a).alias("start"), F.lit(n).alias("length")) for a, n in ((0, 2), (1, 5))])
    t = _some(spark, sf_dir).select("item_id", R.padded_spans(F.transform("paths", lambda s: F.length(s["start"])), spans, 3).alias("p"))
    return t.select("item_id", _text(F.col("p")[0]).alias("short"), _text(F.col("p")[1]).alias("long"))


SQL["y17_padded_spans"] = f"WITH {_NODES} SELECT item_id, array_to_string(list_resize(a[1:2], 3, 0), ',') AS short, array_to_string(list_resize(a[2:4], 3, 0), ',') AS long FROM n"


@query
def y19_padded_choices(spark, sf_dir):
    """Word lengths of each node, filled to four."""
    words = F.transform("paths", lambda s: F.transform(F.split(s["end"], " "), lambda w: F.length(w)))
    t = _some(spark, sf_dir).select("item_id", F.posexplode(R.padded_choices(words, 4)).alias("place", "choice"))
    return t.select("item_id", "place", _text(F.col("choice")).alias("choice"))


SQL["y19_padded_choices"] = """WITH s AS (SELECT item_id, unnest(paths) AS p, generate_subscripts(paths, 1) - 1 AS place FROM eval_items)
SELECT item_id, CAST(place AS INT) AS place, array_to_string(list_resize(list_transform(string_split(p."end", ' '), lambda w: length(w))[1:4], 4, 0), ',') AS choice FROM s"""


@query
def r13_flattened_leaves(spark, sf_dir):
    """Roots followed by their leaves."""
    a = F.transform("paths", lambda s: F.length(s["start"]))
    return _some(spark, sf_dir).select("item_id", _text(R.flatten_leaves(a, F.array(a, F.reverse(a)))).alias("nodes"))


SQL["r13_flattened_leaves"] = f"WITH {_NODES} SELECT item_id, array_to_string(list_concat(list_concat(a, a), list_reverse(a)), ',') AS nodes FROM n"


def _flaky():
    calls = []

    def model(prompts):
        calls.append(1)
        if len(calls) % 2:
            raise RuntimeError("busy")
        return [p.upper() if p else None for p in prompts]

    return with_retry(model, sleep=lambda seconds: None)


@query
def x6_retried(spark, sf_dir):
    """Replies of a model of which every other call fails."""
    return score(table(spark, sf_dir, "predictions").select("row_no", "head"), "head", "reply", _flaky).select("row_no", "reply")


SQL["x6_retried"] = "SELECT row_no, nullif(upper(head), '') AS reply FROM predictions"


def _second():
    return lambda prompts: ["again " + (p or "") for p in prompts]


@query
def x7_recovered(spark, sf_dir):
    """A second call only for rows whose first reply could not be parsed."""
    t = table(spark, sf_dir, "predictions").select("row_no", F.coalesce("head", F.lit("")).alias("prompt"), F.lit("first").alias("reply"), F.when(F.col("row_no") % 3 > 0, "ok").alias("parsed"))
    return recover(t, "prompt", "reply", "parsed", _second).select("row_no", "reply")


SQL["x7_recovered"] = "SELECT row_no, CASE WHEN row_no % 3 > 0 THEN 'first' ELSE 'again ' || coalesce(head, '') END AS reply FROM predictions"


@query
def k1_ranked_triples(spark, sf_dir):
    """Collapsed triples numbered by degree, then weight, then the first row."""
    t = M.numbered(M.fast_collapse(triples(spark, sf_dir)), ["place"])
    return t.select("human_readable_id", "source", "target", "relation")


SQL["k1_ranked_triples"] = f"WITH {COERCED}, {_COLLAPSED.format(order='h', src='ke')} SELECT row_number() OVER (ORDER BY coalesce(combined_degree, -1) DESC, weight DESC, h) - 1 AS human_readable_id, source, target, relation FROM ra WHERE k = 1"
