"""Evaluation analytics over verdicts derived from the events table.

An item is a user, a model an event type; the verdict comes from the value of the last event.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandworks.operators import evaluation as V
from strandworks.operators.sampling import checkpoint_step
from strandworks.runtime import collect_bounded, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def verdicts(spark: SparkSession, sf_dir: str, missing_in: str = "%") -> DataFrame:
    """One verdict per item and model; some pairs are missing, some are errors."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    last = e.groupBy("user_id", "event_type").agg(F.max_by("value", "event_id").alias("v"))
    t = last.filter(~F.col("event_type").like(missing_in) | ((F.col("user_id") + F.length("event_type")) % 11 != 0))
    v = F.when(F.col("v") >= 35, "yes").when(F.col("v") < 3, "error").otherwise("no")
    return t.select(F.col("user_id").alias("item_id"), (F.col("user_id") % 5 + 1).alias("k_hops"), F.col("event_type").alias("model"), v.alias("verdict"))


def checkpoints(spark, sf_dir) -> DataFrame:
    """The same with models as checkpoints, numbered by name."""
    t = verdicts(spark, sf_dir)
    names = t.select("model").distinct()
    from pyspark.sql import Window

    names = names.withColumn("ck", F.concat(F.lit("checkpoint-"), F.dense_rank().over(Window.orderBy("model")) * 100))
    return t.join(names, "model").drop("model").withColumnRenamed("ck", "model")


_EV = """ev AS (SELECT user_id AS item_id, user_id % 5 + 1 AS k_hops, event_type AS model, CASE WHEN v >= 35 THEN 'yes' WHEN v < 3 THEN 'error' ELSE 'no' END AS verdict
  FROM (SELECT user_id, event_type, arg_max(value, event_id) AS v FROM events GROUP BY 1, 2) WHERE (user_id + length(event_type)) % 11 <> 0),
an AS (SELECT * FROM ev WHERE verdict IN ('yes', 'no')),
pr AS (SELECT a.item_id, a.k_hops, a.model AS a, b.model AS b, a.verdict = 'no' AS wa, b.verdict = 'no' AS wb FROM an a JOIN an b ON a.item_id = b.item_id AND a.model < b.model)"""


@query
def a11_accuracy(spark, sf_dir):
    """Accuracy per model, overall and by hop."""
    return V.accuracy(verdicts(spark, sf_dir)).withColumn("all_hops", F.col("all_hops").cast("int"))


SQL["a11_accuracy"] = f"WITH {_EV} SELECT model, k_hops, CAST(grouping(k_hops) AS INT) AS all_hops, count(*) AS total, count(*) FILTER (verdict = 'yes') AS correct, count(*) FILTER (verdict = 'yes') / count(*) AS accuracy FROM ev GROUP BY GROUPING SETS ((model), (model, k_hops))"


@query
def a13_coverage(spark, sf_dir):
    """Answered items and accuracy among them."""
    return V.coverage(verdicts(spark, sf_dir)).withColumn("shown", V.percent(F.col("correct"), F.col("answered")))


SQL["a13_coverage"] = f"WITH {_EV}, c AS (SELECT model, count(*) FILTER (verdict IN ('yes', 'no')) AS answered, count(*) FILTER (verdict = 'yes') AS correct, count(*) FILTER (verdict = 'no') AS wrong FROM ev GROUP BY model) SELECT *, correct / answered AS accuracy, CASE WHEN answered = 0 THEN 'N/A' ELSE printf('%.1f%%', 100.0 * correct / answered) END AS shown FROM c"


@query
def a14_error_overlap(spark, sf_dir):
    """Common errors of every pair of models."""
    return V.error_overlap(verdicts(spark, sf_dir))


_OV = "count(*) FILTER (wa AND wb) AS both_wrong, count(*) FILTER (wa AND NOT wb) AS only_a, count(*) FILTER (NOT wa AND wb) AS only_b"
SQL["a14_error_overlap"] = f"WITH {_EV}, o AS (SELECT a, b, {_OV} FROM pr GROUP BY a, b) SELECT *, CASE WHEN both_wrong + only_a + only_b = 0 THEN 0.0 ELSE both_wrong / (both_wrong + only_a + only_b) END AS jaccard, CASE WHEN both_wrong + least(only_a, only_b) = 0 THEN 0.0 ELSE both_wrong / (both_wrong + least(only_a, only_b)) END AS overlap FROM o"


@query
def a15_error_overlap_by_hop(spark, sf_dir):
    """Common errors of every pair of models per hop."""
    return V.error_overlap(verdicts(spark, sf_dir), by_hop=True)


SQL["a15_error_overlap_by_hop"] = f"WITH {_EV}, o AS (SELECT a, b, k_hops, {_OV} FROM pr GROUP BY a, b, k_hops) SELECT *, CASE WHEN both_wrong + only_a + only_b = 0 THEN 0.0 ELSE both_wrong / (both_wrong + only_a + only_b) END AS jaccard FROM o"


@query
def a16_difficulty(spark, sf_dir):
    """Items by number of models that were wrong."""
    return V.difficulty(verdicts(spark, sf_dir)).withColumn("all_hops", F.col("all_hops").cast("int"))


SQL["a16_difficulty"] = f"WITH {_EV}, p AS (SELECT item_id, k_hops, count(*) FILTER (verdict = 'no') AS models_wrong FROM an GROUP BY 1, 2) SELECT models_wrong, k_hops, CAST(grouping(k_hops) AS INT) AS all_hops, count(*) AS items FROM p GROUP BY GROUPING SETS ((models_wrong), (models_wrong, k_hops))"


@query
def a17_universal(spark, sf_dir):
    """Items all models got wrong, all got right, and contested ones."""
    return V.universal(verdicts(spark, sf_dir))


SQL["a17_universal"] = f"WITH {_EV}, p AS (SELECT item_id, bool_and(verdict = 'no') AS w, bool_and(verdict = 'yes') AS r FROM an GROUP BY 1) SELECT count(*) FILTER (w) AS all_wrong, count(*) FILTER (r) AS all_right, count(*) FILTER (NOT w AND NOT r) AS contested FROM p"


@query
def a18_unique_errors(spark, sf_dir):
    """Errors that no other model made."""
    return V.unique_errors(verdicts(spark, sf_dir))


SQL["a18_unique_errors"] = f"WITH {_EV}, n AS (SELECT *, count(*) FILTER (verdict = 'no') OVER (PARTITION BY item_id) AS k FROM an) SELECT model, k_hops, count(*) FILTER (k = 1) AS unique_errors, count(*) AS errors, count(*) FILTER (k = 1) / count(*) AS share FROM n WHERE verdict = 'no' GROUP BY 1, 2"


@query
def a19_agreement(spark, sf_dir):
    """Share of equal verdicts per pair of models."""
    return V.agreement(verdicts(spark, sf_dir))


SQL["a19_agreement"] = f"WITH {_EV} SELECT a, b, count(*) AS items, avg(CAST(wa = wb AS INT)) AS agreement FROM pr GROUP BY 1, 2"


@query
def a20_gains(spark, sf_dir):
    """Gains and regressions between consecutive checkpoints."""
    return V.gains(checkpoints(spark, sf_dir), checkpoint_step(F.col("model"))).withColumn("all_hops", F.col("all_hops").cast("int"))


SQL["a20_gains"] = f"""WITH {_EV}, r AS (SELECT model, dense_rank() OVER (ORDER BY model) AS k FROM (SELECT DISTINCT model FROM ev)), c AS (SELECT an.item_id, an.k_hops, r.k, verdict = 'yes' AS y FROM an JOIN r USING (model))
SELECT CAST(b.k * 100 AS INT) AS step, b.k_hops, CAST(grouping(b.k_hops) AS INT) AS all_hops, count(*) FILTER (NOT a.y AND b.y) AS gains, count(*) FILTER (a.y AND NOT b.y) AS regressions, count(*) FILTER (NOT a.y AND b.y) - count(*) FILTER (a.y AND NOT b.y) AS net FROM c a JOIN c b ON a.item_id = b.item_id AND b.k = a.k + 1 GROUP BY GROUPING SETS ((b.k), (b.k, b.k_hops))"""


@query
def a21_best_and_worst(spark, sf_dir):
    """Best and worst model."""
    return V.best_and_worst(verdicts(spark, sf_dir))


SQL["a21_best_and_worst"] = f"WITH {_EV}, c AS (SELECT model, avg(CAST(verdict = 'yes' AS INT)) AS acc FROM an GROUP BY 1) SELECT (SELECT model FROM c ORDER BY acc DESC, model LIMIT 1) AS best_model, (SELECT model FROM c ORDER BY acc, model LIMIT 1) AS worst_model"


@query
def f14_complete_models(spark, sf_dir):
    """Verdicts of models that answered every item, errors taken as wrong answers."""
    t = verdicts(spark, sf_dir, "%e%").withColumn("verdict", F.when(F.col("verdict") == "error", "no").otherwise(F.col("verdict")))
    return V.complete_models(t)


_EV_SOME = _EV.replace("WHERE (user_id", "WHERE event_type NOT LIKE '%e%' OR (user_id")
SQL["f14_complete_models"] = f"WITH {_EV_SOME}, e AS (SELECT item_id, k_hops, model, CASE WHEN verdict = 'error' THEN 'no' ELSE verdict END AS verdict FROM ev) SELECT * FROM e WHERE model IN (SELECT model FROM e GROUP BY model HAVING count(DISTINCT item_id) = (SELECT count(DISTINCT item_id) FROM e))"


@query
def r10_long_results(spark, sf_dir):
    """Wide results turned into rows."""
    t = verdicts(spark, sf_dir)
    models = [r.model for r in collect_bounded(t.select("model").distinct().orderBy("model"), 1000, "models")]  # columns of a wide table
    wide = t.groupBy("item_id", "k_hops").pivot("model", models).agg(F.first("verdict")).select("item_id", "k_hops", *[F.col(m).alias(f"correctness_{m}") for m in models])
    return V.to_long(wide, "item_id", "k_hops")


SQL["r10_long_results"] = f"WITH {_EV} SELECT i.item_id, i.k_hops, m.model, ev.verdict FROM (SELECT DISTINCT item_id, k_hops FROM ev) i JOIN (SELECT DISTINCT model FROM ev) m ON true LEFT JOIN ev ON ev.item_id = i.item_id AND ev.model = m.model"


@query
def f9_both_judges(spark, sf_dir):
    """Predicted triples that two rule judges accept."""
    p = table(spark, sf_dir, "predictions")
    return V.both_judges(p, F.length("head") % 3 != 0, F.length("tail") % 4 != 0).select("row_no", "head", "relation", "tail")


SQL["f9_both_judges"] = "SELECT row_no, head, relation, tail FROM predictions WHERE length(head) % 3 <> 0 AND length(tail) % 4 <> 0"
