"""Readers and writers: text directories, triples in any format, JSON records, shards, counted text files.

Readers take explicit schemas where there is one, so no pass over the data infers types.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandworks.operators.merge import numbered

TRIPLE = "source string, target string, relation string, weight double, combined_degree double, text_unit_ids string"
ALIASES = {"head": "source", "tail": "target", "description": "relation"}


def read_text_files(spark: SparkSession, folder: str) -> DataFrame:
    """``(doc_id, text)``: one row per .txt file, at any depth."""
    t = spark.read.option("pathGlobFilter", "*.txt").option("recursiveFileLookup", True).text(folder, wholetext=True)
    return t.select(F.col("_metadata.file_name").alias("doc_id"), F.col("value").alias("text"))


def read_text_lines(spark: SparkSession, folder: str) -> DataFrame:
    """``(file, line_no, text)``: one row per line, numbered from 0 in each file; an error if no file is there.

    Files are split and read line by line, however long they are; lines are numbered by their split's
    place in the file and their order in it, without gathering a file.
    """
    t = spark.read.option("pathGlobFilter", "*.txt").text(folder, lineSep="\n")
    if not t.inputFiles():
        raise ValueError(f"no .txt file in {folder}")
    t = t.select(F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_id"), F.col("value").alias("text"))
    t = numbered(t, ["_path", "_start", "_id"], "_n")
    first = t.groupBy("_path").agg(F.min("_n").alias("_first"))
    return t.join(first, "_path").select("file", (F.col("_n") - F.col("_first")).alias("line_no"), "text")


def chunk_texts(df: DataFrame, key: str, text: str, size: int = 1200, overlap: int = 100) -> DataFrame:
    """``(key, ordinal, n_words, text)``: texts as overlapping windows of words, in order."""
    words = F.filter(F.split(F.col(text), r"\s+"), lambda w: w != "")
    step = size - overlap
    t = df.select(F.col(key), words.alias("_w")).filter(F.size("_w") > 0)
    n = F.greatest(F.lit(1), F.ceil((F.size("_w") - overlap) / F.lit(step)))
    t = t.select(key, "_w", F.explode(F.sequence(F.lit(0), n.cast("int") - 1)).alias("ordinal"))
    piece = F.slice("_w", F.col("ordinal") * step + 1, F.lit(size))
    return t.select(key, "ordinal", F.size(piece).alias("n_words"), F.array_join(piece, " ").alias("text"))


def with_aliases(df: DataFrame, aliases: dict[str, str] | None = None) -> DataFrame:
    """Renames columns to their usual names where these are not taken."""
    for old, new in (aliases or ALIASES).items():
        if old in df.columns and new not in df.columns:
            df = df.withColumnRenamed(old, new)
    return df


def read_triples(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Parquet by suffix, else CSV with a header; column names are unified.

    CSV columns are texts unless the schema of the file's columns, in order, is given (``TRIPLE`` for merged triples).
    """
    if path.rstrip("/").endswith(".parquet"):
        return with_aliases(spark.read.parquet(path))
    r = spark.read.option("header", True).option("escape", '"').option("multiLine", True)
    return with_aliases((r.schema(schema) if schema else r).csv(path))


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; arrays become comma text."""
    flat = [F.array_join(F.col(f.name).cast("array<string>"), ",").alias(f.name) if isinstance(f.dataType, T.ArrayType) else F.col(f.name) for f in df.schema]
    df.select(*flat).write.mode("overwrite").option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def read_json_array(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A JSON array of objects, or one object, per file."""
    r = spark.read.option("multiLine", True)
    return (r.schema(schema) if schema else r).json(path)


def _array_text():
    def run(parts):
        import pandas as pd

        last = None
        begun = False
        for part in parts:
            for j in part["j"].dropna():
                if last is not None:
                    yield pd.DataFrame({"value": [("[" if not begun else "") + last + ","]})
                    begun = True
                last = j
        yield pd.DataFrame({"value": [("[" if not begun else "") + (last or "") + "]"]})

    return run


def write_json_array(df: DataFrame, path: str, order: list[str]) -> None:
    """One file with a JSON array of the rows as objects, in an explicit order; null fields are kept.

    A single file by contract: one task streams it, holding one row at a time.
    """
    objects = df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("j"), *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)])
    end = df.sparkSession.range(1).select(F.lit(None).cast("string").alias("j"), F.lit(True).alias("_end"))  # so that there is a row to close the array
    one = objects.withColumn("_end", F.lit(False)).unionByName(end, allowMissingColumns=True)
    one = one.orderBy("_end", *[f"_o{i}" for i in range(len(order))]).select("j").coalesce(1)
    one.mapInPandas(_array_text(), "value string").write.mode("overwrite").text(path)


def write_statistics(df: DataFrame, path: str) -> None:
    """Statistics of a run, one row, as a JSON document."""
    df.limit(1).coalesce(1).write.mode("overwrite").json(path)


def read_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """All ``chunk_*`` folders of Parquet files as one table, with the chunk's number."""
    t = spark.read.parquet(f"{folder.rstrip('/')}/chunk_*")
    return t.withColumn("chunk", F.regexp_extract(F.col("_metadata.file_path"), r"/chunk_(\d+)/", 1).cast("int"))


def resume(df: DataFrame, path: str, keys: list[str], run) -> DataFrame:
    """Runs ``run`` on the rows that the table at ``path`` does not hold yet, appends what it gives and returns the whole table.

    Each finished task's rows are there once the append is committed; a repeated call does the rest.
    """
    spark = df.sparkSession
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        df = remaining(df, spark.read.parquet(path), keys)
    run(df).write.mode("append").parquet(path)
    return spark.read.parquet(path)


def append_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def read_shards(spark: SparkSession, folder: str, contains: str = "exploded", schema: str | None = None) -> DataFrame:
    """All CSV shards of a folder whose name holds a word, as one table; an error if there is none."""
    r = spark.read.option("header", True).option("escape", '"').option("pathGlobFilter", f"*{contains}*.csv")
    t = (r.schema(schema) if schema else r).csv(folder)
    if not t.inputFiles():
        raise ValueError(f"no shard with {contains} in {folder}")
    return t


def read_responses(spark: SparkSession, folder: str) -> DataFrame:
    """``(row_idx, response)`` of JSON arrays of texts whose file names hold their first row's number."""
    t = spark.read.option("pathGlobFilter", "*.json").text(folder, wholetext=True)
    start = F.regexp_extract(F.col("_metadata.file_name"), r"(\d+)-\d+", 1).cast("bigint")
    return t.select(start.alias("_s"), F.posexplode(F.from_json("value", "array<string>")).alias("_p", "response")).select((F.col("_s") + F.col("_p")).alias("row_idx"), "response")


def write_counts(counts: DataFrame, path: str, name: str = "relation", n: str = "n", order: list[Column] | None = None) -> None:
    """Lines of name, tab and count in falling order of count, then by name, as one text file."""
    t = counts.orderBy(*(order or [F.col(n).desc(), F.col(name)]))
    t.select(F.concat_ws("\t", F.col(name), F.col(n).cast("string")).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def run_tag(paths: Column, digits: int = 10) -> Column:
    """Short md5 tag of sorted paths."""
    return F.left(F.md5(F.array_join(F.array_sort(paths), "\n")), F.lit(digits))


def resolve_inputs(path: str, suffix: str = ".json") -> str:
    """A file or glob as it stands, a folder as a glob of its files."""
    return path if path.endswith(suffix) or any(c in path for c in "*?[{") else f"{path.rstrip('/')}/*{suffix}"


def remaining(df: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that a checkpoint table does not hold yet."""
    return df.join(done.select(*keys).distinct(), keys, "left_anti")
