"""Duplicates hidden by formatting differences: Merkle-style hashing of records.

A record is a tree. Leaves are texts, reduced to their letters and digits (canonically
composed, lower case) and hashed; an inner node hashes its children's digests, in order or,
at an unordered node, after sorting them. The root digest thus ignores formatting and the
order of unordered fields. Records are grouped by the root digest first and the canonical
record itself second, so a collision of digests never joins different records.

``canonical_triples`` treats flat triples whose ends may be exchanged; ``nested_records`` any
struct, array or map: fields of structs and entries of maps have no order, arrays have one
unless their path is named as unordered.

Everything runs in the JVM except the composition of accents, for which only rows holding
other than plainly composed characters pass through Python; leaves of nested records are taken
as composed.

Defined results: records in which any leaf has no letter or digit (null, empty, punctuation
only) are left out (nested ones: such in which all leaves have none); exact repeats count as
copies; an empty table gives an empty result; other columns, whatever their names, are not
read. A group that holds a third of all rows is found by counts of digest prefixes, at most
65,536 a task, and joined by broadcast of its one result row; all other rows are shuffled once.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandworks.runtime import HEAVY_SHARE, Workspace

#: Characters that NFC leaves as they are and that take no part in compositions.
_COMPOSED = r"^[\x00-\x{2ff}\x{391}-\x{3c9}\x{400}-\x{482}\x{48a}-\x{52f}\x{1e00}-\x{1e95}\x{2010}-\x{2027}\x{4e00}-\x{9fff}]*$"


def _nfc():
    @F.pandas_udf("string")
    def compose_accents(s: pd.Series) -> pd.Series:
        return s.map(lambda x: unicodedata.normalize("NFC", x), na_action="ignore")

    return compose_accents


def composed(df: DataFrame, columns: list[str]) -> DataFrame:
    """The texts in NFC; rows that are so already stay in the JVM."""
    plain = F.lit(True)
    for c in columns:
        plain = plain & F.coalesce(F.col(c).rlike(_COMPOSED), F.lit(True))
    nfc = _nfc()
    return df.filter(plain).unionByName(df.filter(~plain).withColumns({c: nfc(F.col(c)) for c in columns}))


def leaf(c: Column) -> Column:
    """Letters and digits of a composed text in lower case; marks stay with the letter they stand on."""
    text = F.translate(F.lower(c), "ς", "σ")
    text = F.regexp_replace(text, r"(?<![\p{L}\p{N}\p{M}])\p{M}+|[\x{fe00}-\x{fe0f}\x{180b}-\x{180d}]", "")
    return F.regexp_replace(text, r"[^\p{L}\p{N}\p{M}]+", "")


def leaf_digest(c: Column) -> Column:
    return F.unhex(F.sha2(F.concat(F.lit("L"), c), 256))


def node_digest(children: list[Column], unordered: Column | bool = False) -> Column:
    """Digest of an inner node; ``unordered`` may depend on the row."""
    flag = F.lit(unordered) if isinstance(unordered, bool) else unordered
    ordered = F.array(*children)
    mark = F.when(flag, F.lit("U")).otherwise(F.lit("N"))
    kids = F.when(flag, F.sort_array(ordered)).otherwise(ordered)
    return F.unhex(F.sha2(F.concat(F.encode(mark, "UTF-8"), *[F.element_at(kids, i + 1) for i in range(len(children))]), 256))


def canonical_triples(df: DataFrame, row: str, source: str, relation: str, target: str, undirected: DataFrame | None = None) -> DataFrame:
    """``(row, root, a, rel, b)``: root digest and canonical record of each usable row.

    ``undirected``: one column of relation names whose ends may be exchanged; it is a
    vocabulary and joined by its leaf form (Spark broadcasts it while it is small).
    """
    base = composed(df.select(F.col(row).alias("row"), F.col(source).cast("string").alias("s"), F.col(relation).cast("string").alias("r"), F.col(target).cast("string").alias("t")), ["s", "r", "t"])
    base = base.select("row", leaf(F.col("s")).alias("s"), leaf(F.col("r")).alias("rel"), leaf(F.col("t")).alias("t"))
    has = r"[\p{L}\p{N}]"
    base = base.filter(F.col("s").rlike(has) & F.col("rel").rlike(has) & F.col("t").rlike(has))
    if undirected is None:
        base = base.withColumn("free", F.lit(False))
    else:
        names = composed(undirected.select(F.col(undirected.columns[0]).cast("string").alias("n")), ["n"]).select(leaf(F.col("n")).alias("n")).filter("n <> ''").distinct().withColumn("free", F.lit(True))
        base = base.join(names, base.rel == names.n, "left").drop("n").withColumn("free", F.coalesce("free", F.lit(False)))
    swap = F.col("free") & (F.col("s") > F.col("t"))
    ends = node_digest([leaf_digest(F.col("s")), leaf_digest(F.col("t"))], F.col("free"))
    return base.select("row", node_digest([leaf_digest(F.col("rel")), ends]).alias("root"), F.when(swap, F.col("t")).otherwise(F.col("s")).alias("a"), "rel", F.when(swap, F.col("s")).otherwise(F.col("t")).alias("b"))


def _tree(c: Column, kind: T.DataType, path: str, unordered: frozenset[str]) -> tuple[Column, Column]:
    """Digest and canonical text of a nested value; nulls and texts without letters or digits are empty leaves."""
    if isinstance(kind, T.StructType):
        parts = [_tree(c[f.name], f.dataType, f"{path}.{f.name}".lstrip("."), unordered) for f in sorted(kind.fields, key=lambda f: f.name)]
        names = [F.lit(f.name) for f in sorted(kind.fields, key=lambda f: f.name)]
        return node_digest([leaf_digest(n) if i % 2 == 0 else parts[i // 2][0] for i, n in enumerate(x for n in names for x in (n, n))]), F.concat(F.lit("{"), F.concat_ws(",", *[F.concat(n, F.lit(":"), t) for n, (_, t) in zip(names, parts)]), F.lit("}"))
    if isinstance(kind, (T.ArrayType, T.MapType)):
        if isinstance(kind, T.MapType):
            entry = T.StructType([T.StructField("key", kind.keyType), T.StructField("value", kind.valueType)])
            items, inner, loose = F.map_entries(c), entry, True
        else:
            items, inner, loose = c, kind.elementType, path in unordered

        def child(x):
            digest, text = _tree(x, inner, path, unordered)
            return F.struct(digest.alias("digest"), text.alias("text"))

        kids = F.transform(F.coalesce(items, F.array().cast(T.ArrayType(inner))), child)
        kids = F.array_sort(kids) if loose else kids
        joined = F.concat(F.lit("S" if loose else "A"), F.array_join(F.transform(kids, lambda k: F.hex(k["digest"])), ""))
        return F.unhex(F.sha2(joined, 256)), F.concat(F.lit("["), F.array_join(F.transform(kids, lambda k: k["text"]), ","), F.lit("]"))
    text = F.coalesce(leaf(c.cast("string")), F.lit(""))
    return leaf_digest(text), text


def nested_records(df: DataFrame, row: str, record: str, unordered: tuple[str, ...] = ()) -> DataFrame:
    """``(row, root, record)``: root digest and canonical text of a nested column.

    ``unordered``: paths of arrays whose elements have no order, as ``field.inner``; the column's own
    path is the empty text.
    """
    digest, text = _tree(F.col(record), df.schema[record].dataType, "", frozenset(unordered))
    t = df.filter(F.col(record).isNotNull()).select(F.col(row).alias("row"), digest.alias("root"), text.alias("record"))
    return t.filter(F.regexp_replace("record", r"[\p{L}\p{N}_]+:", "").rlike(r"[\p{L}\p{N}]"))


def _keys(canonical: DataFrame) -> list[str]:
    return ["root", *[c for c in canonical.columns if c not in ("row", "root")]]


def collapse_copies(canonical: DataFrame) -> DataFrame:
    """``(root, ..., first_row, n_copies)``: one record per group with its number of rows."""
    return canonical.groupBy(*_keys(canonical)).agg(F.min("row").alias("first_row"), F.count(F.lit(1)).alias("n_copies"))


def copies_of(canonical: DataFrame) -> DataFrame:
    """``(first_row, copy_row)`` for every row but the first of each group.

    Rows are shuffled once, by root and record, and pass their group's first row on in the order of
    the row numbers, so no group is held in memory. Groups above ``HEAVY_SHARE`` of the rows, at
    most ``1 / HEAVY_SHARE``, are joined by broadcast so that none gathers in one task.
    """
    work = Workspace(canonical.sparkSession, "structural")
    canonical = work.cut(canonical)
    keys = _keys(canonical)
    prefix = F.substring("root", 1, 2)
    counts = canonical.groupBy(prefix.alias("p")).agg(F.count(F.lit(1)).alias("n"))  # at most 65,536 rows a task
    per = {bytes(r.p): r.n for r in counts.collect()}
    least = max(sum(per.values()) * HEAVY_SHARE, 1000)
    full = [p for p, n in per.items() if n > least]
    if not full:
        rest, hot = canonical, None
    else:
        many = canonical.filter(prefix.isin(full)).groupBy(*keys).agg(F.min("row").alias("first_row"), F.count(F.lit(1)).alias("n")).filter(F.col("n") > least)
        hot = work.cut(many.drop("n"))
        marked = canonical.join(F.broadcast(hot), keys, "left")
        rest = marked.filter(F.col("first_row").isNull()).drop("first_row")
    order = Window.partitionBy(*keys).orderBy("row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = rest.select(F.first("row").over(order).alias("first_row"), "row")
    if hot is not None:
        out = out.unionByName(marked.filter(F.col("first_row").isNotNull()).select("first_row", "row"))
    return out.filter("row <> first_row").select("first_row", F.col("row").alias("copy_row"))
