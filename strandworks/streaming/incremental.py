"""Incremental merging: new triples arrive as files, and the merged table is kept up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from strandworks.operators.merge import coerce_triples, fast_collapse, valid_triples


def upsert(spark: SparkSession, target: str, batch: DataFrame, ordinal: str, version: int) -> str:
    """Merges a batch into the last version of the table and writes the next one; old versions stay readable.

    Writing the same version again gives the same result, so a repeated batch does no harm.
    """
    t = coerce_triples(batch, ordinal, version + 1)
    if version > 0:
        t = spark.read.parquet(f"{target}/v{version - 1}").unionByName(t)
    merged = fast_collapse(valid_triples(t)).drop("n_rows", "place")
    path = f"{target}/v{version}"
    merged.write.mode("overwrite").parquet(path)
    return path


def merge_stream(spark: SparkSession, source: str, schema, target: str, checkpoint: str, ordinal: str) -> StreamingQuery:
    """Merges every file that is in the source folder by now, one micro-batch after the other."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    return stream.writeStream.foreachBatch(lambda df, n: upsert(spark, target, df, ordinal, n)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(stream: DataFrame, time: str, late: str = "1 day", size: str = "1 day") -> DataFrame:
    """Rows and distinct relations per window of event time; later rows than the watermark are left out."""
    return stream.withWatermark(time, late).groupBy(F.window(time, size)).agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("relation").alias("relations"))
