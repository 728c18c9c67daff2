"""Queries over packed fields (problem 6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandworks.operators.packed import split_packed
from strandworks.runtime import table


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every value of text_unit_ids and source_id in final_relationships with its position."""
    rel = table(spark, sf_dir, "final_relationships").select("human_readable_id", "text_unit_ids", "source_id")
    known = table(spark, sf_dir, "mix_targets").select("title").unionByName(table(spark, sf_dir, "text_units").select(F.col("id").alias("title")))
    return split_packed(rel, "human_readable_id", ["text_unit_ids", "source_id"], known)


_P6_ITEMS = r"""
WITH packed AS (
  SELECT human_readable_id, 'text_unit_ids' AS field, text_unit_ids AS p FROM final_relationships
  UNION ALL SELECT human_readable_id, 'source_id', source_id FROM final_relationships),
parts AS (
  SELECT human_readable_id, field, generate_subscripts(a, 1) AS raw_pos, unnest(a) AS raw
  FROM (SELECT *, regexp_extract_all(p, '"(?:[^"\\]|""|\\.)*"|''(?:[^''\\]|''''|\\.)*''|[^\s,;|/\[\](){}"'']+') AS a FROM packed WHERE p IS NOT NULL)),
items AS (
  SELECT human_readable_id, field, raw_pos,
    CASE WHEN raw LIKE '"%' THEN replace(replace(substr(raw, 2, length(raw) - 2), '""', '"'), '\"', '"')
         WHEN raw LIKE '''%' THEN replace(replace(substr(raw, 2, length(raw) - 2), '''''', ''''), '\''', '''')
         ELSE raw END AS item FROM parts)
SELECT human_readable_id, field, CAST(row_number() OVER (PARTITION BY human_readable_id, field ORDER BY raw_pos) AS INT) AS pos, item
FROM items WHERE trim(item) <> ''
"""

QUERIES = {"p6_found": p6_found}
SQL = {"p6_found": _P6_ITEMS}
