"""Splitting oversized texts at natural boundaries by agglomerative merging.

A text above the limit starts as atomic segments, cut at every natural boundary: blank line,
line end, sentence end, clause end, white space; a run without any of these that alone
exceeds the limit is cut between characters that form no unit. A heap holds the adjacent
pairs; the pair at the weakest boundary (the smallest such pair, then the leftmost) is merged
first, as long as the merged body plus the overlap fits the limit. What stays separate is
separated by the strongest boundaries. Every piece but the first then repeats the end of the
piece before, from a natural boundary where one lies within the overlap.

Texts within the limit never leave the JVM. The pass is narrow: no shuffle, unless the input has
fewer partitions than there are cores.

Defined results: null and empty texts give no piece; a text of at most ``limit`` characters,
blank or not, is one piece; lengths count code points; dropping the first ``overlap``
characters of every piece and joining them gives the text back; repeated keys are split each
on its own; other columns of the input are not read.
"""

from __future__ import annotations

import bisect
import heapq
import re
import unicodedata

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandworks.runtime import spread

KINDS = ("character", "word", "clause", "sentence", "line", "paragraph")
_GAP = re.compile(r"[。！？…]+[\"'”’」』）)\]]*\s*|[，；、：]\s*|\s+")
_SENTENCE_END = re.compile(r"[.!?…][\"'”’»)\]]*$")
_CLAUSE_END = re.compile(r"[,;:–—][\"'”’»)\]]*$")
_ABBREVIATION = re.compile(r"(?:^|[\s(])(?:e\.g|i\.e|cf|fig|figs|vol|no|dr|prof|vs|etc|z\.b|d\.h|bzw|p|pp|\w)\.$", re.I)
_RUN = 100


def boundaries(text: str, body: int) -> list[tuple[int, int]]:
    """``(end, strength)`` of every atomic segment, the last one excluded."""
    out: list[tuple[int, int]] = []
    at = 0
    for m in _GAP.finditer(text):
        end = m.end()
        if end == len(text):
            break
        gap = m[0]
        if gap[0] in "。！？…":
            level = 3
        elif gap[0] in "，；、：":
            level = 2
        else:
            level = 1
            before = text[max(0, m.start() - 12) : m.start()]
            if _SENTENCE_END.search(before) and not text[end].islower() and not _ABBREVIATION.search(before):
                level = 3
            elif _CLAUSE_END.search(before):
                level = 2
        breaks = gap.count("\n") + gap.count("\r") - gap.count("\r\n")
        level = 5 if breaks > 1 else max(level, 4) if breaks else level
        _cut_run(text, at, end, body, out)
        out.append((end, level))
        at = end
    _cut_run(text, at, len(text), body, out)
    return out


def _cut_run(text: str, start: int, end: int, body: int, out: list[tuple[int, int]]) -> None:
    """A run longer than a piece's body is cut, but not before combining or joining characters."""
    if end - start <= body:
        return
    step = max(1, min(_RUN, body // 2))
    at = start + step
    while at < end:
        cut = at
        while cut - (at - step) > 1 and (unicodedata.combining(text[cut]) or text[cut] in "‍️­" or text[cut - 1] == "‍"):
            cut -= 1
        out.append((cut, 0))
        at = cut + step


def split_text(text: str, limit: int, overlap: int) -> list[tuple[int, int, int, int]]:
    """``(body start, body end, overlap, strength of the boundary at its end)`` of each piece."""
    if len(text) <= limit:
        return [(0, len(text), 0, 5)] if text else []
    body = limit - overlap
    cuts = boundaries(text, body)
    starts = [0, *[e for e, _ in cuts]]
    ends = [*[e for e, _ in cuts], len(text)]
    strength = [s for _, s in cuts]
    n = len(starts)
    left, right, alive = list(range(-1, n - 1)), list(range(1, n + 1)), [True] * n
    heap = [(strength[i], ends[i + 1] - starts[i], i, i + 1) for i in range(n - 1)]
    heapq.heapify(heap)
    while heap:
        _, size, i, j = heapq.heappop(heap)
        if not alive[i] or right[i] != j or ends[j] - starts[i] != size:
            continue
        if size > (body if i else limit):
            continue
        ends[i], right[i], alive[j] = ends[j], right[j], False
        k = right[i]
        if k < n:
            left[k] = i
            heapq.heappush(heap, (strength[k - 1], ends[k] - starts[i], i, k))
        if (h := left[i]) >= 0:
            heapq.heappush(heap, (strength[i - 1], ends[i] - starts[h], h, i))
    marks = dict(cuts)
    spots = [e for e, _ in cuts]
    pieces, i, before = [], 0, 0
    while i < n:
        lap = 0
        if i:
            low = max(before, starts[i] - overlap)
            inside = spots[bisect.bisect_left(spots, low) : bisect.bisect_left(spots, starts[i])]
            natural = [p for p in inside if marks[p] >= 3] or [p for p in inside if marks[p] >= 1]
            at = natural[0] if natural else low
            while at < starts[i] and not natural and unicodedata.combining(text[at]):
                at += 1
            lap = starts[i] - at
        pieces.append((starts[i], ends[i], lap, marks.get(ends[i], 5)))
        before, i = starts[i], right[i]
    return pieces


def _splitter(limit: int, overlap: int):
    kind = "array<struct<piece_no:int,start:int,stop:int,overlap:int,boundary:string,piece:string>>"

    @F.pandas_udf(kind)
    def split_oversized(texts: pd.Series) -> pd.Series:
        return pd.Series([[{"piece_no": k + 1, "start": a - lap, "stop": b, "overlap": lap, "boundary": KINDS[s], "piece": t[a - lap : b]} for k, (a, b, lap, s) in enumerate(split_text(t, limit, overlap))] for t in texts], dtype=object)

    return split_oversized


def split_texts(df: DataFrame, key: str, text: str, limit: int = 2400, overlap: int = 200) -> DataFrame:
    """``(key, piece_no, start, stop, overlap, boundary, piece)``: pieces of at most ``limit`` characters."""
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be below the limit")
    base = df.select(F.col(key), F.col(text).cast("string").alias("_t")).filter("_t is not null and _t <> ''")
    n = F.char_length("_t")
    whole = base.filter(n <= limit).select(key, F.lit(1).alias("piece_no"), F.lit(0).alias("start"), n.alias("stop"), F.lit(0).alias("overlap"), F.lit(KINDS[5]).alias("boundary"), F.col("_t").alias("piece"))
    cut = spread(base.filter(n > limit)).select(key, F.explode(_splitter(limit, overlap)("_t")).alias("p")).select(key, "p.*")
    return whole.unionByName(cut)
