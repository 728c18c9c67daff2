"""Round trips through every source and sink: a table is written below the shared folder and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandworks.plans.kg_queries import COERCED, triples
from strandworks.runtime import Workspace, table
from strandworks.sources import tables as S

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def _text_folder(spark: SparkSession, sf_dir: str) -> str:
    """One .txt file per input file of the text units, its texts in their order."""
    folder = f"{Workspace(spark, 'roundtrip').root}/texts"
    t = table(spark, sf_dir, "text_units").filter("text is not null and document_id is not null").select("document_id", "row_no", "text")
    t.repartition("document_id").sortWithinPartitions("document_id", "row_no").select("document_id", "text").write.partitionBy("document_id").text(folder)
    return folder


_FILES = "fs AS (SELECT document_id, string_agg(text, chr(10) ORDER BY row_no) AS t FROM text_units WHERE text IS NOT NULL AND document_id IS NOT NULL GROUP BY 1)"


@query
def s1_text_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text files of a folder, whole."""
    t = S.read_text_files(spark, _text_folder(spark, sf_dir))
    return t.select(F.md5("text").alias("content"), F.length("text").alias("n_chars"))


SQL["s1_text_files"] = f"WITH {_FILES} SELECT md5(t || chr(10)) AS content, length(t) + 1 AS n_chars FROM fs"


@query
def s2_text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of text files with their number in the file."""
    return S.read_text_lines(spark, _text_folder(spark, sf_dir)).select("line_no", F.md5("text").alias("content"))


SQL["s2_text_lines"] = f"WITH {_FILES}, l AS (SELECT unnest(string_split(t, chr(10))) AS x, generate_subscripts(string_split(t, chr(10)), 1) - 1 AS line_no FROM fs) SELECT line_no, md5(x) AS content FROM l"


@query
def s4_csv_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triples through CSV with an explicit schema and unified names; empty texts come back as null."""
    path = f"{Workspace(spark, 'roundtrip').root}/triples"
    t = table(spark, sf_dir, "final_relationships").select(F.col("source").alias("head"), F.col("target").alias("tail"), "relation", "weight", "human_readable_id")
    S.write_csv(t, path)
    return S.read_triples(spark, path, "head string, tail string, relation string, weight double, human_readable_id bigint")


SQL["s4_csv_triples"] = "SELECT nullif(source, '') AS source, nullif(target, '') AS target, nullif(relation, '') AS relation, weight, human_readable_id FROM final_relationships"


@query
def s6_json_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions through one JSON array."""
    path = f"{Workspace(spark, 'roundtrip').root}/array"
    t = table(spark, sf_dir, "predictions")
    S.write_json_array(t, path, ["row_no"])
    return S.read_json_array(spark, path, "row_no bigint, id string, head string, relation string, tail string, query_had_no_tails boolean")


SQL["s6_json_array"] = "SELECT * FROM predictions"


@query
def s7_json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions through JSON lines, appended in two parts."""
    path = f"{Workspace(spark, 'roundtrip').root}/lines"
    t = table(spark, sf_dir, "predictions").select("row_no", "head", "tail")
    for part in (t.filter("row_no % 2 = 0"), t.filter("row_no % 2 <> 0")):
        S.append_json_lines(part, path)
    return spark.read.schema("row_no bigint, head string, tail string").json(path)


SQL["s7_json_lines"] = "SELECT row_no, head, tail FROM predictions"


@query
def s9_chunk_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions through numbered folders of Parquet files."""
    root = Workspace(spark, "roundtrip").root
    t = table(spark, sf_dir, "predictions").select("row_no", "relation")
    for k in range(3):
        t.filter(F.col("row_no") % 3 == k).write.parquet(f"{root}/chunk_{k}")
    return S.read_chunks(spark, root)


SQL["s9_chunk_folders"] = "SELECT row_no, relation, CAST(row_no % 3 AS INT) AS chunk FROM predictions"


@query
def s10_count_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the file of relation counts."""
    path = f"{Workspace(spark, 'roundtrip').root}/counts"
    S.write_counts(triples(spark, sf_dir).groupBy("relation").agg(F.count(F.lit(1)).alias("n")), path)
    return spark.read.text(path)


SQL["s10_count_file"] = f"WITH {COERCED} SELECT relation || chr(9) || count(*) AS value FROM va GROUP BY relation"


@query
def y22_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of a run through their JSON document."""
    path = f"{Workspace(spark, 'roundtrip').root}/statistics"
    t = table(spark, sf_dir, "text_units")
    S.write_statistics(t.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("document_id").alias("files"), F.count("text").alias("texts")), path)
    return spark.read.schema("rows bigint, files bigint, texts bigint").json(path)


SQL["y22_statistics"] = "SELECT count(*) AS rows, count(DISTINCT document_id) AS files, count(text) AS texts FROM text_units"


@query
def x8_resumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run that stopped after the items of at most two hops and was taken up again: every item once."""
    path = f"{Workspace(spark, 'roundtrip').root}/done"
    t = table(spark, sf_dir, "eval_items").select("item_id", "k_hops")
    work = lambda df: df.withColumn("reply", F.concat(F.lit("done "), "item_id"))
    S.resume(t.filter("k_hops <= 2"), path, ["item_id"], work)
    return S.resume(t, path, ["item_id"], work)


SQL["x8_resumed"] = "SELECT item_id, k_hops, 'done ' || item_id AS reply FROM eval_items"
