"""Grounding triples in text by co-occurrence, and the fixed-size arrays that training samples use."""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandworks.functions import tokens as K
from strandworks.runtime import HEAVY_SHARE, Workspace, collect_bounded, fits_broadcast, sizes_of, spread, trim_all

ROOTS, LEAVES, TOKENS_PER_LEAF, NODES = 512, 512, 3, 2048
#: Positions are capped at the last slot of a snippet; lengths of heads too.
LAST_POSITION, LONGEST_HEAD = 511, 32
_RUN = re.compile(r"[^ \t\n\x0b\f\r]+")


def _finder(shared, whole_words: bool, tokenizer: str | None):
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automaton = ahocorasick.Automaton()
        for name in shared.value:
            automaton.add_word(name, name)
        if len(automaton):
            automaton.make_automaton()
        for part in parts:
            rows = []
            for snippet, text in zip(part["snippet_id"], part["text"]):
                first: dict[str, int] = {}
                for last, name in automaton.iter(text) if len(automaton) else ():
                    at = last + 1 - len(name)
                    if name not in first and not (whole_words and (text[at - 1 : at].isalnum() or text[last + 1 : last + 2].isalnum())):
                        first[name] = at
                if not first:
                    continue
                if tokenizer:
                    found = [len(e.ids) for e in K.load(tokenizer).encode_batch([text[:at] for at in first.values()], add_special_tokens=False)]
                else:
                    starts = [m.start() for m in _RUN.finditer(text)]
                    found = [bisect.bisect_left(starts, at) for at in first.values()]
                rows += [(snippet, name, at, min(n, LAST_POSITION)) for (name, at), n in zip(first.items(), found)]
            yield pd.DataFrame(rows, columns=["snippet_id", "entity", "pos", "token_pos"])

    return run


def mentions(entities: DataFrame, units: DataFrame, whole_words: bool = False, tokenizer: str | None = None, max_titles: int = 200_000) -> DataFrame:
    """``(snippet_id, entity, pos, token_pos)``: entities whose title stands in a text, ignoring case.

    ``pos`` is the first place in characters; with ``whole_words`` only where no letter or digit adjoins.
    ``token_pos`` is the number of tokens before it, capped: tokens of the tokenizer file, or runs
    between white space without one. A multi-pattern automaton finds titles of any length in one narrow
    pass over the texts; above ``max_titles`` they are split into shards with a pass each.
    """
    names = entities.select(F.lower(trim_all(F.col("title"))).alias("name")).filter("name <> ''").distinct()
    t = spread(units.select(F.col("id").alias("snippet_id"), F.lower("text").alias("text")).filter("text is not null"))
    count = names.count()
    shards = max(1, -(-2 * count // max_titles) if count > max_titles else 1)
    kind = f"snippet_id {t.schema['snippet_id'].dataType.simpleString()}, entity string, pos int, token_pos int"
    out = None
    for k in range(shards):
        some = sorted(r.name for r in collect_bounded(names.filter(F.pmod(F.xxhash64("name"), F.lit(shards)) == k), max_titles, "titles of a shard"))
        hits = t.mapInPandas(_finder(t.sparkSession.sparkContext.broadcast(some), whole_words, tokenizer), kind)
        out = hits if out is None else out.unionByName(hits)
    return out


def first_mentions(found: DataFrame) -> DataFrame:
    """``(entity, token_pos, snippet_id)``: the earliest place of every entity, ties by snippet."""
    return found.groupBy("entity").agg(F.min(F.struct("token_pos", "snippet_id")).alias("m")).select("entity", "m.token_pos", "m.snippet_id")


def ground(triples: DataFrame, found: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """One row per triple and snippet that mentions both its ends; relations outside the vocabulary are skipped."""
    t = triples.join(vocabulary.select("relation", "relation_id"), "relation")
    t = t.withColumns({"_h": F.lower("source"), "_t": F.lower("target")})
    h = found.select(F.col("entity").alias("_h"), "snippet_id", F.col("token_pos").alias("head_pos"))
    x = found.select(F.col("entity").alias("_t"), "snippet_id", F.col("token_pos").alias("tail_pos"))
    return t.join(h, "_h").join(x, ["_t", "snippet_id"]).drop("_h", "_t")


def grounding_counters(triples: DataFrame, found: DataFrame, vocabulary: DataFrame, key: str) -> DataFrame:
    """Triples, such without their head in any snippet, (triple, snippet) pairs without the tail, and grounded pairs."""
    heads = found.select(F.col("entity").alias("_h"), "snippet_id")
    t = triples.select(key, "relation", F.lower("source").alias("_h"), F.lower("target").alias("_t"))
    t = t.join(heads, "_h", "left").join(vocabulary.select("relation", F.lit(True).alias("known")), "relation", "left")
    tails = found.select(F.col("entity").alias("_t"), "snippet_id", F.lit(True).alias("with_tail"))
    t = t.join(tails, ["_t", "snippet_id"], "left")
    no_head = F.col("snippet_id").isNull()
    pair = ~no_head & F.coalesce("known", F.lit(False))
    return t.agg(
        F.countDistinct(key).alias("total"),
        F.countDistinct(F.when(no_head, F.col(key))).alias("no_head_match"),
        F.count_if(pair & F.col("with_tail").isNull()).alias("no_cooccurrence"),
        F.count_if(pair & F.col("with_tail").isNotNull()).alias("grounded"),
    )


def padded(a: Column, size: int, fill: int = 0) -> Column:
    """Cut or filled up to a fixed size."""
    return F.slice(F.concat(a, F.array_repeat(F.lit(fill), size)), 1, size)


def leaf_slots(ids: Column, position: Column, leaves: int = LEAVES, per_leaf: int = TOKENS_PER_LEAF, fill: int = 0) -> Column:
    """At most ``per_leaf`` tail ids scattered to the slots of their head's position, ``fill`` elsewhere."""
    kept = F.slice(ids, 1, per_leaf)
    before = (position * per_leaf).cast("int")
    return F.concat(F.array_repeat(F.lit(fill), before), kept, F.array_repeat(F.lit(fill), F.lit(leaves * per_leaf) - before - F.size(kept)))


def one_hot(position: Column, value: Column, size: int = LEAVES) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.when(i == position, value).otherwise(0))


def attention(ids: Column, pad: int = 0) -> Column:
    return F.transform(ids, lambda x: (x != pad).cast("int"))


def special_mask(ids: Column, special: list[int]) -> Column:
    """1 where an id is a special one."""
    return F.transform(ids, lambda x: x.isin(special).cast("int"))


def training_samples(grounded: DataFrame, units: DataFrame, id_column: str, text: str, source: str, target: str, tokenizer: str = K.DEFAULT, pad: str = "<|endoftext|>", begin: str = "<|startoftext|>") -> DataFrame:
    """Training arrays of grounded triples: one row per triple and snippet.

    Roots are the snippet's first ids, padded; the first ids of the tail fill the slots of the head's
    position; relation and head length stand at that position. Columns: ``input_nodes`` and
    ``attention_mask`` (2,048), ``leaf_relationships``, ``head_lengths`` and ``start_indices`` (512),
    ``special_tokens_mask`` (2,048). Texts and names are tokenised once each, before the joins.
    """
    special = K.special_ids(tokenizer, (pad, begin))
    fill = special[pad]
    ids = K.token_ids(tokenizer)
    work = Workspace(grounded.sparkSession, "samples")
    roots = work.cut(units.filter(F.col(text).isNotNull()).select(F.col(id_column).alias("snippet_id"), F.slice(ids(text), 1, ROOTS).alias("_roots")))
    g = work.cut(grounded.filter(F.col("head_pos") < ROOTS))
    ends = work.cut(g.select(F.explode(F.array(source, target)).alias("_name")).distinct().withColumn("_ids", ids("_name")))
    t = g.join(ends.select(F.col("_name").alias(source), F.size("_ids").alias("_heads")), source)
    t = t.join(ends.select(F.col("_name").alias(target), F.col("_ids").alias("_tails")), target).join(roots, "snippet_id")
    nodes = F.concat(padded(F.col("_roots"), ROOTS, fill), leaf_slots(F.col("_tails"), F.col("head_pos"), fill=fill))
    t = t.withColumn("input_nodes", nodes)
    leaf_mask = F.transform(F.slice("input_nodes", ROOTS + 1, NODES - ROOTS), lambda x: (x == fill).cast("int"))
    return t.select(
        *[c for c in grounded.columns],
        "input_nodes",
        attention(F.col("input_nodes"), fill).alias("attention_mask"),
        one_hot(F.col("head_pos"), F.col("relation_id")).alias("leaf_relationships"),
        one_hot(F.col("head_pos"), F.least(F.col("_heads"), F.lit(LONGEST_HEAD))).alias("head_lengths"),
        F.array_repeat(F.lit(0), ROOTS).alias("start_indices"),
        F.concat(special_mask(F.slice("input_nodes", 1, ROOTS), sorted(special.values())), leaf_mask).alias("special_tokens_mask"),
    )


def token_chunks(df: DataFrame, batch: str, ordinal: str, ids: str, size: int, first: int = 101, last: int = 102, heavy: int = 1_000_000) -> DataFrame:
    """Ids of a batch joined in order and cut into chunks of ``size`` with two marks.

    The rest is dropped once a batch fills a chunk; a shorter batch is one short chunk. Ids are computed
    once, as they are written. A batch of more than ``heavy`` ids and more than 1/500 of all is not
    gathered: its sizes alone are range-partitioned, each row learns how many ids stand before it, and
    sends a slice to every chunk it reaches into. Other batches are shuffled once and cut where they are.
    """
    body = size - 2
    work = Workspace(df.sparkSession, "chunks")
    t = df.select(F.col(batch).alias("_b"), F.col(ordinal).alias("_o"), F.col(ids).alias("_ids"), F.size(ids).alias("_n"), F.monotonically_increasing_id().alias("_id"))
    t = work.cut(t).filter("_n > 0")  # behind the write, as a filter before it computes the ids again
    sums = t.groupBy("_b").agg(F.sum("_n").alias("_s"))
    least = sums.agg(F.greatest(F.sum("_s") * F.lit(HEAVY_SHARE), F.lit(float(heavy))).alias("_least"))
    hot = collect_bounded(sums.join(F.broadcast(least), F.col("_s") > F.col("_least")).select("_b"), int(1 / HEAVY_SHARE), "heavy batches")
    in_order = Window.partitionBy("_b").orderBy("_o", "_id")
    whole = in_order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    placed = lambda x: x.withColumn("_at", F.sum("_n").over(in_order) - F.col("_n")).withColumn("_all", F.sum("_n").over(whole))
    if not hot:
        out = _chunks(placed(t), body)
    else:
        keys = F.broadcast(df.sparkSession.createDataFrame([(r[0],) for r in hot], T.StructType([T.StructField("_hot", t.schema["_b"].dataType)])))
        is_hot = F.col("_b").eqNullSafe(F.col("_hot"))
        heavy_rows = t.join(keys, is_hot, "left_semi")
        at = _places(work, heavy_rows)
        out = _chunks(placed(t.join(keys, is_hot, "left_anti")), body).unionByName(_chunks(heavy_rows.join(F.broadcast(at) if fits_broadcast(at) else at, "_id"), body))
    return out.select(F.col("_b").alias(batch), F.col("chunk").cast("int").alias("chunk"), F.concat(F.array(F.lit(first)), "_body", F.array(F.lit(last))).alias("input_ids"))


def _places(work: Workspace, t: DataFrame) -> DataFrame:
    """``(_id, _at, _all)``: ids of the batch before a row and altogether, without gathering a batch."""
    n = work.cut(t.select("_b", "_o", "_id", "_n").repartitionByRange("_b", "_o", "_id").withColumn("_p", F.spark_partition_id()))
    sizes = n.groupBy("_b", "_p").agg(F.sum("_n").alias("_s"))  # one row per batch and partition it reaches into
    by_batch = Window.partitionBy("_b").orderBy("_p")
    sizes = sizes.select(F.col("_b").alias("_sb"), F.col("_p").alias("_sp"), (F.sum("_s").over(by_batch) - F.col("_s")).alias("_before"), F.sum("_s").over(Window.partitionBy("_b")).alias("_all"))
    inside = F.sum("_n").over(Window.partitionBy("_p", "_b").orderBy("_o", "_id")) - F.col("_n")
    at = n.withColumn("_at", inside).join(sizes, F.col("_b").eqNullSafe(F.col("_sb")) & (F.col("_p") == F.col("_sp"))).select("_id", (F.col("_at") + F.col("_before")).alias("_at"), "_all")
    at = work.cut(at, **sizes_of(at))
    work.drop(n)
    return at


def _chunks(t: DataFrame, body: int) -> DataFrame:
    """``(_b, chunk, _body)`` of rows that know their place in the batch."""
    t = t.withColumn("_used", F.when(F.col("_all") >= body, F.floor(F.col("_all") / body) * body).otherwise(F.col("_all"))).filter("_at < _used")
    end = F.least(F.col("_at") + F.col("_n"), F.col("_used"))
    t = t.select("_b", "_at", "_ids", end.alias("_end"), F.explode(F.sequence(F.floor(F.col("_at") / body), F.floor((end - 1) / body))).alias("chunk"))
    lo, hi = F.greatest(F.col("_at"), F.col("chunk") * body), F.least(F.col("_end"), (F.col("chunk") + 1) * body)
    t = t.select("_b", "chunk", F.struct(lo.alias("lo"), F.slice("_ids", (lo - F.col("_at") + 1).cast("int"), (hi - lo).cast("int")).alias("part")).alias("piece"))
    joined = F.flatten(F.transform(F.sort_array(F.collect_list("piece")), lambda x: x["part"]))
    return t.groupBy("_b", "chunk").agg(joined.alias("_body"))


def masked(ids: Column, key: Column, mask_id: int, vocabulary: int, probability: float = 0.15, seed: int = 7) -> Column:
    """Structs (input, label): of the chosen positions 80 % masked, 10 % replaced, 10 % kept; label -100 elsewhere."""
    h = lambda i, salt: F.pmod(F.xxhash64(key, i, F.lit(seed * 31 + salt)), F.lit(1_000_000)) / 1e6

    def one(x, i):
        chosen, u = h(i, 1) < probability, h(i, 2)
        new = F.when(u < 0.8, F.lit(mask_id)).when(u < 0.9, F.pmod(F.xxhash64(key, i, F.lit(seed * 31 + 3)), F.lit(vocabulary)).cast("int")).otherwise(x)
        return F.struct(F.when(chosen, new).otherwise(x).alias("input"), F.when(chosen, x).otherwise(F.lit(-100)).alias("label"))

    return F.transform(ids, one)


def span_lengths(n: int, p: float = 0.2) -> Column:
    """Truncated geometric distribution over lengths 1 to n, normalised."""
    raw = F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.pow(F.lit(1 - p), i - 1) * p)
    total = F.aggregate(raw, F.lit(0.0), lambda a, x: a + x)
    return F.transform(raw, lambda x: x / total)


def word_starts(tokens: Column) -> Column:
    """True where a token begins a word: no continuation mark, first sign a letter or digit."""
    return F.transform(tokens, lambda t: ~t.startswith("##") & t.rlike(r"^[\p{L}\p{N}]"))


def word_end(tokens: Column, end: Column) -> Column:
    """End index (exclusive, from 0) moved right over continuation pieces."""
    n = F.size(tokens)
    rest = F.filter(F.sequence(F.lit(0), n), lambda i: (i >= end) & ((i == n) | ~F.coalesce(F.get(tokens, i), F.lit("")).startswith("##")))
    return F.try_element_at(rest, F.lit(1))


def leaf_runs(leaves: Column, per_root: int) -> Column:
    """Leaf positions grouped into arrays by the root they belong to."""
    roots = F.array_distinct(F.transform(leaves, lambda p: F.floor(p / per_root)))
    return F.transform(roots, lambda r: F.filter(leaves, lambda p: F.floor(p / per_root) == r))


def spans_overlap(spans: Column) -> Column:
    """True if any two of the (start, stop) spans, stops inclusive, share a position."""
    s = F.array_sort(spans)
    return F.exists(F.sequence(F.lit(1), F.greatest(F.size(s) - 1, F.lit(1))), lambda i: (i < F.size(s)) & (F.get(s, i - 1)["stop"] >= F.get(s, i)["start"]))


def padded_spans(nodes: Column, spans: Column, width: int, fill: int = 0) -> Column:
    """Each (start, length) span of the nodes, cut and filled to a width."""
    return F.transform(spans, lambda s: padded(F.slice(nodes, s["start"] + 1, F.greatest(s["length"], F.lit(0))), width, fill))


def token_pairs(tails: Column, heads: Column) -> Column:
    """All pairs of a triple's tail and head tokens (two bounded arrays of one row)."""
    return F.flatten(F.transform(tails, lambda t: F.transform(heads, lambda h: F.struct(t.alias("tail"), h.alias("head")))))


def flatten_leaves(ids: Column, leaves: Column) -> Column:
    """Roots followed by all their leaves."""
    return F.concat(ids, F.flatten(leaves))


def masked_leaf(leaves: Column, key: Column, mask_id: int, seed: int = 7) -> Column:
    """Struct (slot, inputs, label): one filled leaf, chosen by a seeded hash, is masked."""
    filled = F.filter(F.transform(leaves, lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda s: s["x"] != 0)
    pick = F.get(filled, F.pmod(F.xxhash64(key, F.lit(seed)), F.greatest(F.size(filled), F.lit(1))).cast("int"))
    return F.struct(pick["i"].alias("slot"), F.transform(leaves, lambda x, i: F.when(i == pick["i"], F.lit(mask_id)).otherwise(x)).alias("inputs"), pick["x"].alias("label"))


def boundary_pairs(spans: Column, roots: int) -> Column:
    """Neighbours (start - 1, stop + 1) of spans that lie inside the roots, else (-1, -1)."""
    return F.transform(spans, lambda s: F.when((s["start"] >= 1) & (s["stop"] + 1 < roots), F.struct((s["start"] - 1).alias("left"), (s["stop"] + 1).alias("right"))).otherwise(F.struct(F.lit(-1).alias("left"), F.lit(-1).alias("right"))))


def padded_choices(choices: Column, width: int, fill: int = 0) -> Column:
    return F.transform(choices, lambda c: padded(c, width, fill))


def top_k(df: DataFrame, row: str, score: str, k: int, banned: Column | None = None) -> DataFrame:
    """Per row the k best of its scores with log-softmax over all of them; banned entries never count. One shuffle."""
    t = df if banned is None else df.filter(~banned)
    rest = [c for c in t.columns if c not in (row, score)]
    whole = Window.partitionBy(row)
    t = t.withColumn("rank", F.row_number().over(whole.orderBy(F.col(score).desc(), *rest))).withColumn("_m", F.max(score).over(whole))
    t = t.withColumn("_z", F.sum(F.exp(F.col(score) - F.col("_m"))).over(whole)).filter(F.col("rank") <= k)
    return t.withColumn("log_probability", F.col(score) - F.col("_m") - F.log("_z")).drop("_m", "_z")


def masked_spans(ids: Column, spans: Column, key: Column, mask_id: int, vocabulary: int, seed: int = 7) -> Column:
    """Structs (input, label) of span masking: each (start, stop) span, stop inclusive, is masked whole in 80 %, replaced
    by random ids in 10 % and kept in 10 % of the cases; label -100 outside of spans."""
    h = lambda salt, *c: F.pmod(F.xxhash64(key, *c, F.lit(seed * 37 + salt)), F.lit(1_000_000)) / 1e6

    def one(x, i):
        mine = F.try_element_at(F.filter(spans, lambda s: (s["start"] <= i) & (i <= s["stop"])), F.lit(1))
        u = h(1, mine["start"])
        other = F.pmod(F.xxhash64(key, i, F.lit(seed * 37 + 2)), F.lit(vocabulary)).cast("int")
        new = F.when(u < 0.8, F.lit(mask_id)).when(u < 0.9, other).otherwise(x)
        return F.struct(F.when(mine.isNotNull(), new).otherwise(x).alias("input"), F.when(mine.isNotNull(), x).otherwise(F.lit(-100)).alias("label"))

    return F.transform(ids, one)
