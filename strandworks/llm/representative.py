"""Best representative of each duplicate group.

Two parts share the claims table:

* ``survivors`` takes each field of the surviving record from the best row of its group by a
  stated preference (most recent, most trusted, most complete).
* ``latent_truth`` is the latent two-sided quality model: every source has a sensitivity (the
  share of true values it states) and a specificity (the share of false values it leaves
  out), every claimed value a hidden truth; expectation-maximisation infers both, and a
  multi-valued field keeps every value judged true.

The E and M steps depend on a value only through which sources state it and which cover its
field without stating it. Values are therefore first aggregated by that pattern, and the
iterations run over patterns, not over rows. Patterns that together hold at most ``driver_entries``
sources are read by the driver once and iterated there; more stay where they are, and what reaches
the driver per step is one row per source (bounded by ``max_sources``). The steps are extrapolated
and run until they stand still; if they do not, that is an error. Quality is learnt from all fields that two or more sources
cover; a field covered by one source says nothing of it and is only judged by the result.

Defined results: a value that is null or unusable is no claim; a row without a source counts
as the source ``(none)``; repeated rows claim once; ties of ``survivors`` go to the smallest row number; where
no row of a group has a usable value the row number is 0; an empty table gives an empty
result; further columns are not read. Hot groups are pre-aggregated before any shuffle.
"""

from __future__ import annotations

import logging
import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandworks.runtime import Workspace, collect_bounded

_log = logging.getLogger(__name__)


@dataclass(frozen=True)
class Preference:
    """A field of the survivor: rows are usable where ``usable`` holds; the greatest ``score`` wins."""

    name: str
    usable: Column
    score: Column


def usable_number(c: str) -> Column:
    """Finite and above 0."""
    return F.col(c).isNotNull() & ~F.isnan(F.col(c)) & (F.col(c) > 0) & (F.col(c) < F.lit(float("inf")))


def survivors(df: DataFrame, group: str, row: str, preferences: list[Preference]) -> DataFrame:
    """One row per group of two or more rows; per preference the row number that supplies the value."""
    cols = [F.col(group).alias("_g"), F.col(row).alias("_r")]
    for i, p in enumerate(preferences):
        cols.append(F.when(F.coalesce(p.usable, F.lit(False)), p.score).alias(f"_s{i}"))
    t = df.select(*cols)
    aggs = [F.count(F.lit(1)).alias("_n")]
    for i, p in enumerate(preferences):
        best = F.max(F.when(F.col(f"_s{i}").isNotNull(), F.struct(F.col(f"_s{i}").alias("s"), (-F.col("_r")).alias("r"))))
        aggs.append(F.coalesce(-best["r"], F.lit(0)).cast("bigint").alias(p.name))
    return t.groupBy("_g").agg(*aggs).filter("_n > 1").select(F.col("_g").alias(group), *[p.name for p in preferences])


def claims_of(df: DataFrame, group: str, source: str, fields: dict[str, Column]) -> DataFrame:
    """``(grp, field, source, value)``, repeats included; each field's expression gives an array of strings."""
    parts = [F.struct(F.lit(name).alias("field"), values.alias("values")) for name, values in fields.items()]
    t = df.select(F.col(group).alias("grp"), F.coalesce(F.col(source).cast("string"), F.lit("(none)")).alias("source"), F.explode(F.array(*parts)).alias("f"))
    return t.select("grp", "source", "f.field", F.explode("f.values").alias("value")).filter(F.col("value").isNotNull())


def _logit(x: np.ndarray) -> np.ndarray:
    return np.log(x) - np.log1p(-x)


def _expit(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def fixed_point(step: Callable[[np.ndarray], tuple[np.ndarray, float]], start: np.ndarray, tolerance: float, max_rounds: int) -> tuple[np.ndarray, int]:
    """Where an EM step moves no probability by ``tolerance``, and the steps taken; raises if that is not reached.

    Squared extrapolation (SQUAREM) on the logits: two steps give a direction, a third starts from
    the extrapolated point and is kept if the objective did not fall behind that of the plain steps.
    """
    x, rounds = start, 0

    def move(x: np.ndarray) -> tuple[np.ndarray, float, bool]:
        nonlocal rounds
        if rounds >= max_rounds:
            raise RuntimeError(f"EM moves by more than {tolerance} after {rounds} steps; raise max_rounds")
        rounds += 1
        y, objective = step(x)
        return y, objective, float(np.abs(y - x).max()) < tolerance

    while True:
        x1, _, done = move(x)
        if done:
            return x1, rounds
        x2, plain, done = move(x1)
        if done:
            return x2, rounds
        u = _logit(x1) - _logit(x)
        v = _logit(x2) - _logit(x1) - u
        far = max(1.0, float(np.sqrt((u @ u) / max(v @ v, 1e-300))))
        guess = _expit(np.clip(_logit(x) + 2 * far * u + far * far * v, -30, 30))
        y, objective, done = move(guess)
        if objective < plain:
            x = x2
        elif done:
            return y, rounds
        else:
            x = y


def latent_truth(claims: DataFrame, max_rounds: int = 20_000, tolerance: float = 1e-10, prior: float = 0.5, sensitivity_prior: tuple[float, float] = (5.0, 2.0), specificity_prior: tuple[float, float] = (18.0, 2.0), max_sources: int = 10_000, driver_entries: int = 1_000_000) -> tuple[DataFrame, DataFrame]:
    """Truth and quality: ``(grp, field, value, stating, truth)`` and ``(source, sensitivity, specificity)``; ``stating``: a value's sources.

    The steps run until none moves a probability by ``tolerance``; raises if ``max_rounds`` steps do not suffice.
    """
    spark = claims.sparkSession
    work = Workspace(spark, "truth")
    # sources are bounded by max_sources, so the sets are; repeated claims vanish in them before the shuffle
    values = work.cut(claims.groupBy("grp", "field", "value").agg(F.sort_array(F.collect_set("source")).alias("stating")))
    cover = values.select("grp", "field", F.explode("stating").alias("source")).groupBy("grp", "field").agg(F.sort_array(F.collect_set("source")).alias("covering"))
    facts = work.cut(values.join(cover, ["grp", "field"]).select("grp", "field", "value", "stating", F.array_except("covering", "stating").alias("silent")))
    patterns = facts.groupBy("stating", "silent").agg(F.count(F.lit(1)).alias("n"))
    names = sorted(r.source for r in collect_bounded(values.select(F.explode("stating").alias("source")).distinct(), max_sources, "sources"))
    work.drop(values)
    k = len(names)
    odds = math.log(prior / (1 - prior))

    def weighed(t: DataFrame, x: np.ndarray) -> DataFrame:
        """Adds ``one`` and ``zero``: log likelihoods of a pattern, given that its value is true or not."""
        q = spark.createDataFrame([(s, math.log(a), math.log(1 - b), math.log(1 - a), math.log(b)) for s, a, b in zip(names, x[:k].tolist(), x[k:].tolist())], "source string, s1 double, s0 double, n1 double, n0 double")
        # one row of weights: bounded by max_sources
        w = q.agg(*[F.map_from_entries(F.collect_list(F.struct("source", c))).alias(c) for c in ("s1", "s0", "n1", "n0")])
        sum_of = lambda a, m: F.aggregate(a, F.lit(0.0), lambda x, s: x + F.element_at(F.col(m), s))
        t = t.join(F.broadcast(w)).withColumns({"one": sum_of("stating", "s1") + sum_of("silent", "n1") + odds, "zero": sum_of("stating", "s0") + sum_of("silent", "n0")})
        return t.withColumn("truth", 1 / (1 + F.exp(F.col("zero") - F.col("one")))).drop("s1", "s0", "n1", "n0")

    shared = work.cut(patterns.filter(F.size("stating") + F.size("silent") >= 2))
    size = shared.agg(F.coalesce(F.sum(F.size("stating") + F.size("silent")), F.lit(0)).alias("entries")).first().entries

    def maximised(x: np.ndarray, tp, t, tn, f, likelihood: float) -> tuple[np.ndarray, float]:
        """M step and the objective at ``x``, the likelihood with the sources' priors."""
        a, b = x[:k], x[k:]
        (a1, a0), (b1, b0) = sensitivity_prior, specificity_prior
        penalty = (a1 * np.log(a) + a0 * np.log(1 - a) + b1 * np.log(b) + b0 * np.log(1 - b)).sum()
        return np.concatenate([(tp + a1) / (t + a1 + a0), (tn + b1) / (f + b1 + b0)]), float(likelihood + penalty)

    def spread_step(x: np.ndarray) -> tuple[np.ndarray, float]:
        e = weighed(shared, x)
        top = F.greatest("one", "zero")
        said = lambda c, value: F.transform(c, lambda s: F.struct(s.alias("source"), F.lit(value).alias("said")))
        whole = F.array(F.struct(F.lit(None).cast("string").alias("source"), F.lit(False).alias("said")))  # once a pattern, for the objective
        seen = e.select(F.explode(F.concat(said("stating", True), said("silent", False), whole)).alias("o"), "n", "truth", (F.col("n") * (top + F.log(F.exp(F.col("one") - top) + F.exp(F.col("zero") - top)))).alias("l"))
        m = seen.groupBy("o.source").agg(F.sum(F.when(F.col("o.said"), F.col("n") * F.col("truth")).otherwise(0.0)).alias("tp"), F.sum(F.col("n") * F.col("truth")).alias("t"), F.sum(F.when(~F.col("o.said"), F.col("n") * (1 - F.col("truth"))).otherwise(0.0)).alias("tn"), F.sum(F.col("n") * (1 - F.col("truth"))).alias("f"), F.sum("l").alias("l"))
        sums, likelihood = np.zeros((4, k)), 0.0
        for r in collect_bounded(m, max_sources + 1, "sources"):
            if r.source is None:
                likelihood = r.l
            else:
                sums[:, at[r.source]] = r.tp, r.t, r.tn, r.f
        return maximised(x, *sums, likelihood)

    def driver_step(x: np.ndarray) -> tuple[np.ndarray, float]:
        a, b = x[:k], x[k:]
        one = np.bincount(pattern, np.where(stated, np.log(a)[source], np.log(1 - a)[source]), len(n)) + odds
        zero = np.bincount(pattern, np.where(stated, np.log(1 - b)[source], np.log(b)[source]), len(n))
        true = (n / (1 + np.exp(zero - one)))[pattern]
        false = n[pattern] - true
        sums = [np.bincount(source, w, k) for w in (true * stated, true, false * ~stated, false)]
        return maximised(x, *sums, float((n * np.logaddexp(one, zero)).sum()))

    x = np.repeat([p[0] / sum(p) for p in (sensitivity_prior, specificity_prior)], k)
    at = {s: i for i, s in enumerate(names)}
    if size and size <= driver_entries:
        rows = sorted((r.stating, r.silent, r.n) for r in shared.collect())  # holds at most driver_entries sources
        n = np.array([r[2] for r in rows], dtype=np.float64)
        pattern = np.repeat(np.arange(len(rows)), [len(r[0]) + len(r[1]) for r in rows])
        source = np.array([at[s] for r in rows for s in (*r[0], *r[1])])
        stated = np.array([said for r in rows for said in (*[True] * len(r[0]), *[False] * len(r[1]))])
    if size:
        x, rounds = fixed_point(driver_step if size <= driver_entries else spread_step, x, tolerance, max_rounds)
        _log.info("EM converged after %d steps", rounds)
    truth = weighed(facts, x).select("grp", "field", "value", "stating", "truth")
    quality = spark.createDataFrame([(s, float(x[i]), float(x[k + i])) for i, s in enumerate(names)], "source string, sensitivity double, specificity double")
    return truth, quality


def true_values(truth: DataFrame, multi_valued: list[str], threshold: float = 0.5, trust: DataFrame | None = None) -> DataFrame:
    """``(grp, field, values)``: all values judged true of a multi-valued field, the likeliest of any other.

    Values equally likely (to nine digits) are ranked by their most trusted source, if ``trust`` gives
    ``(source, rank)`` with 1 as the best, then by their number of sources, then the greater number
    wins, and of texts the greater text.
    """
    multi = F.col("field").isin(multi_valued)
    place = F.lit(0)
    if trust is not None:
        ranks = trust.select(F.coalesce(F.col(trust.columns[0]).cast("string"), F.lit("(none)")).alias("s"), F.col(trust.columns[1]).cast("int").alias("r"))
        # one row: bounded by the number of sources
        truth = truth.join(F.broadcast(ranks.agg(F.map_from_entries(F.collect_list(F.struct("s", "r"))).alias("_ranks"))))
        last = F.lit(2**31 - 1)
        place = -F.array_min(F.transform("stating", lambda s: F.coalesce(F.try_element_at("_ranks", s), last)))
    order = F.struct(F.round("truth", 9).alias("t"), place.alias("p"), F.size("stating").alias("n"), F.coalesce(F.expr("try_cast(value AS DOUBLE)"), F.lit(float("-inf"))).alias("x"), F.col("value").alias("v"))
    rank = F.max(F.when(~multi, order)).alias("best")
    kept = F.sort_array(F.collect_set(F.when(multi & (F.col("truth") >= threshold), F.col("value")))).alias("kept")
    return truth.groupBy("grp", "field").agg(rank, kept).select("grp", "field", F.when(multi, F.col("kept")).otherwise(F.array(F.col("best.v"))).alias("values"))
