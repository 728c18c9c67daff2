"""The usual runs with their usual settings: extraction, grounding, curriculum, evaluation.

Every function is a lazy composition of operators; the settings are dataclasses, so a second
configuration is a changed copy.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandworks.functions import tokens as K
from strandworks.operators import evaluation as V
from strandworks.operators import graph as G
from strandworks.operators import grounding as R
from strandworks.operators import merge as M
from strandworks.operators import qa as Q
from strandworks.operators import records as P
from strandworks.operators import sampling as S
from strandworks.sources.tables import chunk_texts


@dataclass(frozen=True)
class Extraction:
    """Chunk sizes in words, entity types kept (none: all), least pairs of a relation, similarity of names."""

    chunk_words: int = 1200
    overlap_words: int = 100
    types: tuple[str, ...] = ()
    least_pairs: int = 80
    threshold: float | None = 0.90


#: Larger chunks, for texts of long arguments.
LONG_CHUNKS = Extraction(chunk_words=2000)


@dataclass(frozen=True)
class Curriculum:
    """Path lengths, share of names that count as hubs, the relation that costs like a hub, draws per target."""

    least_hops: int = 2
    most_hops: int = 3
    hub_share: float = 0.01
    excepted: str = "part_of"
    attempts: int = 5


def text_chunks(texts: DataFrame, key: str, text: str, settings: Extraction = Extraction()) -> DataFrame:
    """Overlapping chunks of words for extraction."""
    return chunk_texts(texts, key, text, settings.chunk_words, settings.overlap_words)


def extract_graph(responses: DataFrame, key: str, response: str, settings: Extraction = Extraction()) -> tuple[DataFrame, DataFrame]:
    """``(nodes, edges)`` parsed from replies and merged across them; nodes of other types are left out if types are given."""
    records = P.parse_records(responses, key, response)
    entities, relations = P.entity_rows(records, key), P.relationship_rows(records, key)
    nodes = P.merge_nodes(entities, relations, key)
    if settings.types:
        nodes = nodes.filter(F.col("type").isin(list(settings.types)))
    return nodes, P.merge_responses(P.merge_edges(relations, key), key)


def merge_runs(new: DataFrame, old: DataFrame | None, ordinal: str, settings: Extraction = Extraction()) -> DataFrame:
    """The merged graph with dense numbers in the order of its triples' places."""
    merged = M.merge_graphs(new, old, ordinal, settings.threshold, settings.least_pairs)
    return M.numbered(merged, ["place"]).drop("place", "_before")


def ground_graph(triples: DataFrame, entities: DataFrame, units: DataFrame, vocabulary: DataFrame, tokenizer: str | None = K.DEFAULT) -> DataFrame:
    """Triples with every unit that mentions both ends, and the tokens before them."""
    return R.ground(triples, R.mentions(entities, units, tokenizer=tokenizer), vocabulary)


def curriculum(triples: DataFrame, starts: DataFrame, settings: Curriculum = Curriculum()) -> DataFrame:
    """One path per start and length, with its signature; paths of the same steps count once."""
    hubs = G.hubs(M.degrees(triples), settings.hub_share).select("title")
    out = None
    for k in range(settings.least_hops, settings.most_hops + 1):
        t = G.sampled_paths(triples, starts, k, settings.excepted, hubs).select("start", F.lit(k).alias("k_hops"), "steps")
        out = t if out is None else out.unionByName(t)
    return M.first_by(out.withColumn("signature", F.md5(Q.path_text(F.col("steps")))), ["signature"], [F.col("start")])


def work_list(paths: DataFrame, key: str, target: int, settings: Curriculum = Curriculum()) -> DataFrame:
    """The draws of a run that stops at ``target`` accepted items or with the last draw."""
    return S.requeued(paths, key, target, settings.attempts)


def evaluate(verdicts: DataFrame, step: Column | None = None) -> dict[str, Callable[[], DataFrame]]:
    """The evaluation tables by name, each built when it is asked for."""
    tables = {"accuracy": lambda: V.accuracy(verdicts), "coverage": lambda: V.coverage(verdicts), "error_overlap": lambda: V.error_overlap(verdicts), "error_overlap_by_hop": lambda: V.error_overlap(verdicts, by_hop=True), "agreement": lambda: V.agreement(verdicts), "difficulty": lambda: V.difficulty(verdicts), "universal": lambda: V.universal(verdicts), "unique_errors": lambda: V.unique_errors(verdicts), "best_and_worst": lambda: V.best_and_worst(verdicts)}
    if step is not None:
        tables["gains"] = lambda: V.gains(verdicts, step)
    return tables
