"""Entities: type filter, merge by title, degrees, resolution of text unit positions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandworks.runtime import trim_all


def typed_entities(df: DataFrame, types: list[str]) -> DataFrame:
    """Entities whose type, in capitals, is allowed, with non-empty title and description."""
    t = df.withColumn("type", F.upper(trim_all(F.col("type"))))
    return t.filter(F.col("type").isin(types) & (F.col("description") != "") & (F.col("title") != ""))


def merge_entities(df: DataFrame, ordinal: str) -> DataFrame:
    """One entity per title: descriptions in order, distinct unit ids, the first type that is there."""
    texts = F.sort_array(F.collect_list(F.when(F.col("description") != "", F.struct(F.col(ordinal).alias("o"), F.col("description").alias("d")))))
    return df.groupBy("title").agg(
        F.transform(texts, lambda x: x["d"]).alias("descriptions"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.coalesce("text_unit_ids", F.array().cast("array<string>")))))).alias("text_unit_ids"),
        F.min_by("type", F.when(F.col("type").isNotNull(), F.col(ordinal))).alias("type"),
    )


def with_degrees(entities: DataFrame, degrees: DataFrame) -> DataFrame:
    """Entities, one per title, with the degree of their lower-case title in a graph, 0 if it is not there."""
    one = entities.dropDuplicates(["title"]).withColumn("_name", F.lower(trim_all(F.col("title"))))
    return one.join(degrees.select(F.col("title").alias("_name"), "degree"), "_name", "left").drop("_name").withColumn("degree", F.coalesce("degree", F.lit(0)))


def resolve_units(df: DataFrame, key: str, packed: str, units: DataFrame) -> DataFrame:
    """Positions in a comma list replaced by the ids of the text units at these positions."""
    e = df.select(key, F.explode(F.split(packed, ",")).alias("p")).select(key, F.expr("try_cast(CASE WHEN trim(p) RLIKE '^[0-9]{1,18}$' THEN trim(p) END AS BIGINT)").alias("row_no")).filter("row_no is not null")
    found = e.join(units, "row_no").groupBy(key).agg(F.array_join(F.array_sort(F.collect_set("id")), ",").alias("text_unit_ids"))
    return found
