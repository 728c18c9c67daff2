"""All queries of the core by name; each module of plans contributes QUERIES and SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandworks.plans import array_queries, eval_queries, extra_queries, kg_queries, misc_queries, packed_queries, qa_queries, source_queries, text_queries

MODULES = [packed_queries, kg_queries, eval_queries, qa_queries, text_queries, misc_queries, extra_queries, source_queries, array_queries]


def queries() -> dict:
    return {name: q for m in MODULES for name, q in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kg_queries.a1_collapsed_triples(spark, sf_dir)
