"""Evaluation texts leaking into training texts: spaced-seed hashing.

Fixed masks of ``SPAN`` tokens ignore selected positions. Every window of every evaluation
item is hashed under each mask; the windows of the training texts are hashed likewise and
probed against these hashes, so an altered word at an ignored position still hits. Around a
hit the two texts are compared token by token: ``exact_words`` is the longest run of equal
words, ``overlap_words`` / ``substitutions`` the best overlap that tolerates replaced words.
Since the span equals the least run looked for, every exact run of that length hits. Replaced
words that lie five or more words apart are always tolerated: of any such pattern some window
has its only replaced word where a mask does not look.

A run counts as evidence only if it stands in no other item. How far the words at each place
of an item also stand in another one follows from the order of all items' suffixes; no two
items are compared with each other.

Items are a stated query set of at most ``max_words`` words, worked off in blocks of at most
``block_words`` words; each block is broadcast (36 bytes a word) and all texts pass by it once,
without a shuffle. Texts are read whole.

Words are unbroken runs of letters and digits in lower case; character references are
decoded first, soft hyphens vanish, tags and all other characters separate.

Defined results: null, blank and word-less texts hold nothing; items of fewer words than the
span leak nowhere; items with the same text leak nowhere, as each stands in the other;
repeated texts are reported each under its own key; columns but key and text are not read;
items without key or text are left out, of several under one key the smallest text counts;
a query set beyond ``max_words`` is an error.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandworks.runtime import spread

SPAN = 8
#: Positions that count, per mask.
MASKS = ("11011011", "10110111", "11101101")
_TAG = re.compile(r"<!--.*?-->|</?[A-Za-z][^<>]*>", re.S)
_WORD = re.compile(r"[^\W_]+")
_MULTIPLIERS = [pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) for k in range(SPAN)]
#: A replaced word costs as much as this many equal words earn.
SUBSTITUTION = 2


def words_of(text: str) -> list[str]:
    if "&" in text:
        text = html.unescape(text)
    if "\xad" in text:
        text = text.replace("\xad", "")
    if "<" in text:
        text = _TAG.sub(" ", text)
    if not text.isascii():
        text = unicodedata.normalize("NFC", text)
    return _WORD.findall(text.lower())


def shared_lengths(items: list[np.ndarray]) -> list[np.ndarray]:
    """Per item and place: how many words from there on also stand in another item; 0 if fewer than ``SPAN``.

    Suffixes of all items are sorted by doubling the number of words compared. The longest
    common beginning with another item is that with the nearest suffix of another item in this order.
    """
    if not items:
        return []
    top = max((int(x.max()) for x in items if len(x)), default=0) + 1
    text = np.concatenate([y for i, x in enumerate(items) for y in (x, np.array([top + i]))])  # an end of its own for every item
    owner = np.repeat(np.arange(len(items)), [len(x) + 1 for x in items])
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    levels, width = [rank.astype(np.int32)], 1
    order = np.argsort(rank, kind="stable")
    while rank[order[-1]] < n - 1:
        after = np.zeros(n, dtype=np.int64)
        after[: n - width] = rank[width:] + 1
        key = rank * (n + 1) + after
        order = np.argsort(key, kind="stable")
        rank = np.empty(n, dtype=np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)])
        levels.append(rank.astype(np.int32))
        width *= 2
    common = np.zeros(n, dtype=np.int64)  # with the suffix before in the order
    a, b = order[:-1], order[1:]
    for k in range(len(levels) - 1, -1, -1):
        i, j = a + common[1:], b + common[1:]
        inside = np.maximum(i, j) < n
        same = inside & (levels[k][np.where(inside, i, 0)] == levels[k][np.where(inside, j, 0)])
        common[1:] += same * (1 << k)
    mine = owner[order]
    own = np.concatenate([[False], mine[1:] == mine[:-1]])
    common[common < SPAN] = 0
    up, down = np.where(own, 0, common), np.zeros(n, dtype=np.int64)
    for i in np.flatnonzero(own & (common > 0)):
        up[i] = min(up[i - 1], common[i])
    down[:-1] = np.where(own[1:], 0, common[1:])
    for i in np.flatnonzero(own & (common > 0))[::-1]:
        down[i - 1] = min(down[i], common[i])
    longest = np.zeros(n, dtype=np.int64)
    longest[order] = np.maximum(up, down)
    ends = np.cumsum([len(x) + 1 for x in items])
    return [longest[e - len(x) - 1 : e - 1] for x, e in zip(items, ends)]


def _stock(windows: int, shared: np.ndarray) -> np.ndarray:
    """Windows that need no index, as they lie in a stretch that stands in another item.

    A run that is evidence reaches beyond every such stretch, so one of its windows crosses the
    stretch's edge and hits, unless a neighbouring stretch overlaps that far; stretches with such
    a neighbour stay indexed.
    """
    skip = np.zeros(windows, dtype=bool)
    spans: list[tuple[int, int]] = []
    for a in np.flatnonzero(shared):
        b = int(a + shared[a])
        if not spans or b > spans[-1][1]:
            spans.append((int(a), b))
    for i, (a, b) in enumerate(spans):
        close = (i and spans[i - 1][1] - a >= SPAN - 1) or (i + 1 < len(spans) and b - spans[i + 1][0] >= SPAN - 1)
        if not close:
            skip[a : max(a, b - SPAN + 1)] = True
    return skip


class Block:
    """A block of items, indexed by the spaced hashes of its windows.

    ``shared``: per item the lengths of ``shared_lengths``; windows inside shared wording are left
    out of the index unless ``whole``.
    """

    def __init__(self, keys: list[int], words: list[list[str]], shared: list[np.ndarray], whole: bool = False) -> None:
        self.keys, self.shared = keys, [s.astype(np.int32) for s in shared]
        self.vocabulary: dict[str, int] = {}
        self.items = [np.array([self.vocabulary.setdefault(w, len(self.vocabulary)) for w in ws], dtype=np.int32) for ws in words]
        self.start = np.cumsum([0] + [len(x) for x in self.items])
        hashes, place = [], []
        for k, ids in enumerate(self.items):
            windows = max(len(ids) - SPAN + 1, 0)
            at = np.arange(windows) if whole else np.flatnonzero(~_stock(windows, self.shared[k]))
            for hs in window_hashes(ids):
                hashes.append(hs[at])
                place.append((self.start[k] + at).astype(np.int32))
        self.hashes = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        self.place = np.concatenate(place) if place else np.zeros(0, np.int32)
        order = np.argsort(self.hashes, kind="stable")
        self.hashes, self.place = self.hashes[order], self.place[order]

    def encode(self, text: str) -> np.ndarray:
        get = self.vocabulary.get
        return np.array([get(w, -1) for w in words_of(text)], dtype=np.int32)

    def overlaps(self, texts: list[np.ndarray]) -> Iterator[tuple[int, int, int, np.ndarray, int]]:
        """``(text, item, text start, equality along the diagonal, item start)`` of every diagonal with a hit."""
        if not len(self.hashes) or not texts:
            return
        gap = np.full(SPAN, -1, dtype=np.int32)
        joined = np.concatenate([x for t in texts for x in (t, gap)])
        offsets = np.cumsum([0] + [len(t) + SPAN for t in texts])
        found = []
        for h in window_hashes(joined):
            lo = np.searchsorted(self.hashes, h, "left")
            hit = np.flatnonzero((lo < len(self.hashes)) & (h != 0) & (self.hashes[np.minimum(lo, len(self.hashes) - 1)] == h))
            if not len(hit):
                continue
            lo = lo[hit]
            many = np.searchsorted(self.hashes, h[hit], "right") - lo
            within = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            place = self.place[np.repeat(lo, many) + within].astype(np.int64)
            at = np.repeat(hit, many)
            t = np.searchsorted(offsets, at, "right") - 1
            k = np.searchsorted(self.start, place, "right") - 1
            found.append(np.stack([t, k, at - offsets[t] - (place - self.start[k])], axis=1))
        if not found:
            return
        for t, k, d in np.unique(np.concatenate(found), axis=0).tolist():
            item, text = self.items[k], texts[t]
            start = max(0, d)
            stop = min(len(text), d + len(item))
            yield t, k, start, text[start:stop] == item[start - d : stop - d], start - d


def window_hashes(ids: np.ndarray) -> list[np.ndarray]:
    """Hashes of all windows under each mask; windows with an unknown word (-1) where it counts must not hit."""
    n = len(ids) - SPAN + 1
    out = []
    with np.errstate(over="ignore"):
        for m, mask in enumerate(MASKS):
            h = np.full(max(n, 0), m + 1, dtype=np.uint64)
            if n > 0:
                unknown = np.zeros(n, dtype=bool)
                for k, c in enumerate(mask):
                    if c == "1":
                        part = ids[k : k + n]
                        unknown |= part < 0
                        h += (part.astype(np.uint64) + np.uint64(1)) * np.uint64(_MULTIPLIERS[k])
                h ^= h >> np.uint64(29)
                h[unknown] = 0
            out.append(h)
    return out


def exact_runs(equal: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Maximal runs of equal words as (from, to)."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], equal.view(np.int8), [0]])))
    return [(int(a), int(b)) for a, b in zip(edges[::2], edges[1::2]) if b - a >= least]


def best_overlap(equal: np.ndarray) -> tuple[int, int, int]:
    """``(from, to, equal words)`` of the stretch with most equal words less its replaced ones."""
    score = np.where(equal, 1, -SUBSTITUTION)
    total = np.concatenate([[0], np.cumsum(score)])
    low = np.minimum.accumulate(total)
    end = int(np.argmax(total - low))
    start = int(np.flatnonzero(total[: end + 1] == low[end])[-1])
    return start, end, int(equal[start:end].sum())


def _search(shared, rows: int = 256):
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block = shared.value
        for part in parts:
            for at in range(0, len(part), rows):
                piece = part.iloc[at : at + rows]
                keys = piece["key"].tolist()
                best: dict[tuple[int, int], list] = {}
                for t, k, start, equal, i_start in block.overlaps([block.encode(x) for x in piece["text"]]):
                    runs = exact_runs(equal, 1)
                    own = max((b - a for a, b in runs if b - a >= SPAN and block.shared[k][i_start + a] < b - a), default=0)
                    a, b, same = best_overlap(equal)
                    row = best.setdefault((t, k), [0, 0, 0, 0, 0])
                    row[0] = max(row[0], own)
                    row[1] = max([row[1], *(y - x for x, y in runs)])
                    if same > row[2]:
                        row[2:5] = [same, b - a - same, start + a]
                yield pd.DataFrame([(block.keys[k], keys[t], *v) for (t, k), v in best.items()], columns=["item_id", "key", "own_words", "exact_words", "overlap_words", "substitutions", "at_word"])

    return run


def query_set(items: DataFrame, key: str, text: str, max_words: int) -> tuple[list[int], list[list[str]]]:
    """Keys and words of the items, in the order of their keys; an error beyond ``max_words``."""
    q = items.select(F.col(key).cast("bigint").alias("key"), F.col(text).cast("string").alias("text")).filter("key is not null and text is not null")
    q = q.groupBy("key").agg(F.min("text").alias("text"))
    keys, words, held = [], [], 0
    for r in q.orderBy("key").toLocalIterator():
        keys.append(r.key)
        words.append(words_of(r.text))
        held += len(words[-1])
        if held > max_words:
            raise ValueError(f"evaluation items: more than {max_words} words; raise max_words, the driver needs about 80 bytes a word")
    return keys, words


def find_leaks(docs: DataFrame, key: str, text: str, items: DataFrame, item_key: str, item_text: str, block_words: int = 4_000_000, max_words: int = 20_000_000, altered: bool = False) -> DataFrame:
    """``(item_id, key, own_words, exact_words, overlap_words, substitutions, at_word)`` per text and item with a hit
    outside of wording that stands in several items, or with ``altered`` with any hit.

    ``own_words``: the longest exact run of at least ``SPAN`` words that stands in no other item, else 0; it needs
    no hits inside of such wording, overlaps with replaced words do.
    """
    spark = docs.sparkSession
    keys, words = query_set(items, item_key, item_text, max_words)
    vocabulary: dict[str, int] = {}
    shared = shared_lengths([np.array([vocabulary.setdefault(w, len(vocabulary)) for w in ws], dtype=np.int64) for ws in words])
    cuts, room = [0], block_words
    for i, ws in enumerate(words):
        if len(ws) > room and i > cuts[-1]:
            cuts.append(i)
            room = block_words
        room -= len(ws)
    base = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).filter("text is not null and text <> ''")
    base = spread(base)
    kind = base.schema["key"].dataType.simpleString()
    out = None
    for a, b in zip(cuts, [*cuts[1:], len(keys)]):
        block = spark.sparkContext.broadcast(Block(keys[a:b], words[a:b], shared[a:b], altered))
        hits = base.mapInPandas(_search(block), f"item_id bigint, key {kind}, own_words int, exact_words int, overlap_words int, substitutions int, at_word int")
        out = hits if out is None else out.unionByName(hits)
    return out.withColumnRenamed("key", key)
