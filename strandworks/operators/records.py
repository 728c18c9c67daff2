"""Parsing of semi-structured model output: tuple records, JSON lists and objects, relation maps."""

from __future__ import annotations

import ast
import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandworks.runtime import trim_all

#: Separator of the records of a reply.
RECORD = "##"


def clean_text(c: Column) -> Column:
    """Basic entities unescaped, control characters dropped, trimmed."""
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return trim_all(F.regexp_replace(c, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", ""))


def parse_weight(c: Column) -> Column:
    """A plain number, else 1.0; so a last field that still carries the end mark gives 1.0."""
    t = F.trim(c)
    return F.coalesce(F.when(t.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), t.try_cast("double")), F.lit(1.0))


def parse_records(df: DataFrame, key: str, response: str) -> DataFrame:
    """``(key, pos, kind, fields)``: records of a response after its reasoning, brackets taken off."""
    body = F.regexp_extract(F.col(response), r"(?s)</think>(.*)", 1)
    body = F.when(F.contains(F.col(response), F.lit("</think>")), body).otherwise(F.col(response))
    t = df.select(key, F.posexplode(F.split(body, RECORD)).alias("pos", "record"))
    inner = trim_all(F.col("record"))
    inner = F.when(inner.startswith("("), F.substring(inner, F.lit(2), F.length(inner))).otherwise(inner)
    inner = F.when(inner.endswith(")"), F.substring(inner, F.lit(1), F.length(inner) - 1)).otherwise(inner)
    fields = F.transform(F.split(inner, r"<\|>"), lambda x: trim_all(x))
    t = t.select(key, "pos", fields.alias("fields")).withColumn("kind", F.get("fields", F.lit(0)))
    ok = ((F.col("kind") == '"entity"') & (F.size("fields") >= 4)) | ((F.col("kind") == '"relationship"') & (F.size("fields") >= 5))
    return t.filter(ok)


def entity_rows(records: DataFrame, key: str) -> DataFrame:
    f = lambda i: clean_text(F.get("fields", F.lit(i)))
    return records.filter(F.col("kind") == '"entity"').select(key, "pos", F.lower(f(1)).alias("title"), F.upper(f(2)).alias("type"), f(3).alias("description"))


def relationship_rows(records: DataFrame, key: str) -> DataFrame:
    f = lambda i: clean_text(F.get("fields", F.lit(i)))
    return records.filter(F.col("kind") == '"relationship"').select(key, "pos", F.lower(f(1)).alias("source"), F.lower(f(2)).alias("target"), F.lower(f(3)).alias("relation"), parse_weight(F.element_at("fields", F.lit(-1))).alias("weight"))


def merge_edges(rows: DataFrame, key: str) -> DataFrame:
    """Edges of one response: relations in order by line, weights summed, the response named once per record."""
    ordered = F.filter(F.transform(F.sort_array(F.collect_list(F.struct("pos", "relation"))), lambda x: x["relation"]), lambda x: x != "")
    named = F.array_join(F.array_repeat(F.col(key).cast("string"), F.col("_n").cast("int")), ", ")
    g = rows.groupBy(key, "source", "target").agg(F.array_join(ordered, "\n").alias("relations"), F.sum("weight").alias("weight"), F.count(F.lit(1)).alias("_n"))
    return g.withColumn("source_id", named).drop("_n")


def merge_responses(edges: DataFrame, key: str) -> DataFrame:
    """Edges of all responses: relations and responses collected, weights summed."""
    return edges.groupBy("source", "target").agg(F.array_sort(F.collect_set("relations")).alias("relations"), F.array_sort(F.collect_set(F.col(key).cast("string"))).alias("responses"), F.sum("weight").alias("weight"))


def merge_nodes(entities: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """Nodes with all descriptions and responses; the last non-empty type; ends of edges are nodes too."""
    named = entities.select(key, "pos", "title", "type", "description")
    ends = edges.select(key, F.lit(-1).alias("pos"), F.explode(F.array("source", "target")).alias("title"), F.lit("").alias("type"), F.lit("").alias("description"))
    t = named.unionByName(ends)
    last = F.max_by("type", F.when(F.col("type") != "", F.struct(F.col(key), F.col("pos"))))
    return t.groupBy("title").agg(F.coalesce(last, F.lit("")).alias("type"), F.array_sort(F.collect_set(F.when(F.col("description") != "", F.col("description")))).alias("descriptions"), F.array_sort(F.collect_set(F.col(key).cast("string"))).alias("responses"))


def flatten_relations(c: Column) -> Column:
    """A relation cell split at line ends, trimmed, lower case, without empty ones."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), "\n"), lambda x: F.lower(trim_all(x))), lambda x: x != "")


def allowed_relations(c: Column, allowed: list[str]) -> Column:
    """Sorted distinct relations of a cell that are allowed."""
    return F.array_sort(F.array_intersect(F.array_distinct(c), F.array(*[F.lit(a) for a in allowed])))


def relation_map_rows(df: DataFrame, key: str, column: str, allowed: list[str]) -> DataFrame:
    """``(key, head, relations)`` of JSON objects {head: relation or list}.

    Heads are trimmed and lowered; of colliding heads the last one in the text that has an allowed
    relation wins; relations are sorted, distinct and allowed; bad JSON, empty heads and heads
    without a relation give no row.
    """
    t = df.select(key, F.when(F.trim(column).startswith("{"), F.from_json(column, "map<string,string>")).alias("m"))
    e = t.select(key, F.posexplode("m").alias("pos", "head", "value"))  # in the order of the text; lists come as their text
    many = F.from_json("value", "array<string>")
    rels = F.when(F.trim("value").startswith("["), many).otherwise(F.array("value"))
    rels = F.transform(F.filter(rels, lambda x: x.isNotNull()), lambda x: F.lower(trim_all(x)))
    e = e.select(key, "pos", F.lower(trim_all(F.col("head"))).alias("head"), allowed_relations(rels, allowed).alias("relations"))
    return e.filter((F.col("head") != "") & (F.size("relations") > 0)).groupBy(key, "head").agg(F.max_by("relations", "pos").alias("relations"))


def relation_rows(maps: DataFrame, key: str) -> DataFrame:
    """One row per head and relation of ``relation_map_rows``, the first relation of each head marked."""
    t = maps.select(key, "head", F.posexplode("relations").alias("p", "relation"))
    return t.select(key, "head", "relation", (F.col("p") == 0).alias("is_first"))


def has_relations(df: DataFrame, key: str, column: str, allowed: list[str]) -> DataFrame:
    """``(key, has_relations)``: whether any head of the row's JSON object keeps an allowed relation."""
    kept = relation_map_rows(df, key, column, allowed).select(key).distinct().withColumn("_k", F.lit(True))
    return df.select(key).join(kept, key, "left").select(key, F.coalesce("_k", F.lit(False)).alias("has_relations"))


def first_json_object(c: Column) -> Column:
    """The first fenced object if it parses, else from the first to the last brace; null unless that parses."""
    fenced = F.regexp_extract(c, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    greedy = F.regexp_extract(c, r"(?s)(\{.*\})", 1)
    parsed = lambda x: F.when((x != "") & F.try_parse_json(x).isNotNull(), x)
    return F.coalesce(parsed(fenced), parsed(greedy))


def json_list(c: Column) -> Column:
    """First bracketed part that is a JSON list, else all quoted texts; trimmed, lower case, without blank ones."""
    bare = F.regexp_replace(c, r"</?think>", "")
    lists = F.filter(F.transform(F.regexp_extract_all(bare, F.lit(r"(?s)\[.*?\]"), F.lit(0)), lambda x: F.from_json(x, "array<string>")), lambda a: a.isNotNull())
    quoted = F.regexp_extract_all(bare, F.lit(r'"([^"]+)"'), F.lit(1))
    texts = F.coalesce(F.try_element_at(lists, F.lit(1)), quoted)
    return F.filter(F.transform(texts, lambda x: F.lower(trim_all(F.coalesce(x, F.lit("none"))))), lambda x: x != "")


def salvage_object(text: str | None) -> str | None:
    """Rightmost object of a messy reply as JSON text: JSON first, then a Python literal; None without one."""
    if not text:
        return None
    body = "\n".join(x for x in text.splitlines() if not x.strip().startswith("```"))
    close = body.rfind("}")
    if close < 0:
        return None
    tries = []
    opens = [m.start() for m in re.finditer(r"\{", body[:close])]
    if opens:
        tries = [body[opens[-1] : close + 1], body[opens[0] : close + 1]]
    for t in tries:
        for parse in (json.loads, ast.literal_eval):
            try:
                v = parse(t)
            except (ValueError, SyntaxError, RecursionError, MemoryError, TypeError):
                continue
            if isinstance(v, dict):
                try:
                    return json.dumps(v, ensure_ascii=False)
                except TypeError:
                    continue
    return None


def salvaged():
    """Batched form of ``salvage_object`` for columns; Python literals have no SQL form."""

    @F.pandas_udf("string")
    def rightmost_object(s: pd.Series) -> pd.Series:
        return s.map(salvage_object)

    return rightmost_object


def with_tails(df: DataFrame, tail: str = "tail") -> DataFrame:
    """Rows whose tail holds more than blanks."""
    return df.filter(F.length(F.trim(tail)) > 0)


def unpacked_lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, place, line)``: distinct trimmed lines of a text with their place from 1."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    t = df.filter(F.col(text).isNotNull()).select(key, F.posexplode(F.array_distinct(lines)).alias("p", "line"))
    return t.select(key, (F.col("p") + 1).alias("place"), "line")


def explode_tails(df: DataFrame, tails: str) -> DataFrame:
    """One row per tail; rows without any keep one with an empty tail and the flag set."""
    t = df.withColumn("_t", F.explode_outer(tails))
    return t.withColumn("tail", F.coalesce("_t", F.lit(""))).withColumn("query_had_no_tails", F.col("_t").isNull()).drop("_t", tails)


def distinct_ignoring_case(a: Column, most: int = 50) -> Column:
    """First spelling of every text, in order, at most ``most``."""
    start = F.struct(F.array().cast("array<string>").alias("seen"), F.array().cast("array<string>").alias("kept"))

    def step(s, x):
        new = ~F.array_contains(s["seen"], F.lower(x))
        return F.struct(F.when(new, F.array_append(s["seen"], F.lower(x))).otherwise(s["seen"]).alias("seen"), F.when(new, F.array_append(s["kept"], x)).otherwise(s["kept"]).alias("kept"))

    return F.slice(F.aggregate(F.filter(a, lambda x: x.isNotNull()), start, step, lambda s: s["kept"]), 1, most)
