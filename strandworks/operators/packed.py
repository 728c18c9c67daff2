"""Several values packed in one field: dictionary-guided segmentation.

A multi-pattern automaton finds every known whole value, also where it is written with
doubled or escaped quotes; dynamic programming then picks the cover of the field that
explains most characters by known values, and among these the one of fewest pieces.
Delimiters inside a known value are so never cut. What no known value covers falls back
on the grammar: quoted spans are one value, all else is cut at delimiters.

Only entries that hold a delimiter, quote or bracket themselves need protection, so the
dictionary is reduced to these before it is sent to the workers. Up to ``max_entries`` of
them form one automaton; more are split into shards of bounded size, worked off one after the
other: a shard is collected, broadcast, searched for in a pass of its own whose matches are
written beside the fields, and given up before the next one, so that driver and workers never
hold more than one. The passes' matches meet in one cover.

Defined results: null, empty and delimiter-only fields give no row; unbalanced quotes are
taken as delimiters at the ends of a value; repeated rows give repeated results; columns of
the input other than the key and the fields are not read.
"""

from __future__ import annotations

import bisect
import hashlib
import heapq
import json
import re
from collections.abc import Iterator, Sequence

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandworks.runtime import Workspace, collect_bounded

DELIMITERS = ",;|/"
BRACKETS = "[](){}"
QUOTES = "\"'"
_CLOSE = {"“": "”", "«": "»", "‘": "’"}
_SPECIAL = re.compile(rf"[\s{re.escape(DELIMITERS + BRACKETS + QUOTES)}\\“”«»‘’]")
_SEPARATOR = re.compile(rf"[\s{re.escape(DELIMITERS + BRACKETS)}]+")
_PLAIN = re.compile(rf"[^\s{re.escape(DELIMITERS + BRACKETS)}]+")
_QUOTED = {
    '"': re.compile(r'"((?:[^"\\]|""|\\.)*)"', re.S),
    "'": re.compile(r"'((?:[^'\\]|''|\\.)*)'", re.S),
    "“": re.compile("“([^”]*)”"),
    "«": re.compile("«([^»]*)»"),
    "‘": re.compile("‘([^’]*)’"),
}
_EDGE = "\"'“”«»‘’\\"
#: Same class as ``_SPECIAL`` for the JVM.
SPECIAL_SQL = r"""[\s\x0B\x1C-\x1F\x85\p{Z},;|/\[\](){}"'\\“”«»‘’]"""

_automata: dict = {}


def _spellings(value: str) -> set[str]:
    """The ways a value is written inside a packed field."""
    return {
        value,
        value.replace('"', '""'),
        value.replace("'", "''"),
        value.replace("\\", "\\\\").replace('"', '\\"'),
        value.replace("\\", "\\\\").replace("'", "\\'"),
        json.dumps(value)[1:-1],
        json.dumps(value, ensure_ascii=False)[1:-1],
    }


def build_automaton(values: Sequence[str]):
    """Automaton over all spellings, or None without values."""
    a = ahocorasick.Automaton()
    for v in values:
        for s in _spellings(v):
            if s:
                a.add_word(s, (len(s), v))
    if not len(a):
        return None
    a.make_automaton()
    return a


def whole_matches(text: str, automaton) -> list[tuple[int, int, str]]:
    """Known values that stand whole in the text: at both ends the text or a special character ends them."""
    if automaton is None:
        return []
    found = []
    for last, (n, v) in automaton.iter(text):
        start, end = last + 1 - n, last + 1
        if (start == 0 or _SPECIAL.match(text[start - 1])) and (end == len(text) or _SPECIAL.match(text[end])):
            found.append((start, end, v))
    return found


def _unescape(body: str, quote: str) -> str:
    body = body.replace(quote * 2, quote) if quote in QUOTES else body
    if "\\" not in body:
        return body
    return re.sub(r"\\(u[0-9a-fA-F]{4}|.)", lambda m: chr(int(m[1][1:], 16)) if len(m[1]) == 5 else {"n": "\n", "t": "\t", "r": "\r"}.get(m[1], m[1]), body, flags=re.S)


def _step(text: str, i: int) -> tuple[int, str | None]:
    """The grammar's piece at ``i``: its end and its value, None for a separator."""
    if m := _SEPARATOR.match(text, i):
        return m.end(), None
    c = text[i]
    if c in _QUOTED:
        m = _QUOTED[c].match(text, i)
        if m and (m.end() == len(text) or _SPECIAL.match(text[m.end()])):
            return m.end(), _unescape(m[1], c).strip() or None
    m = _PLAIN.match(text, i)
    return m.end(), m[0].strip(_EDGE) or None


def segment(text: str | None, matches: Sequence[tuple[int, int, str]] = ()) -> list[str]:
    """Values of one packed field in order.

    Without a known value the grammar leaves one cover only. Else the best cover is found from
    the left over the places that pieces can end at: ``best[i]`` is (characters in known values,
    minus pieces) of the text before ``i``.
    """
    if not text:
        return []
    if not matches:
        out, i = [], 0
        while i < len(text):
            i, v = _step(text, i)
            if v is not None:
                out.append(v)
        return out
    known: dict[int, list[tuple[int, str]]] = {}
    for start, end, v in matches:
        known.setdefault(start, []).append((end, v))
        if start and end < len(text):  # with the quotes around it
            q = text[start - 1]
            if text[end] == q and q in QUOTES or _CLOSE.get(q) == text[end]:
                known.setdefault(start - 1, []).append((end + 1, v))
    starts = sorted(known)
    n = len(text)
    best: dict[int, tuple[int, int]] = {0: (0, 0)}
    back: dict[int, tuple[int, str | None]] = {}
    todo = [0]
    while todo:
        i = heapq.heappop(todo)
        if i == n:
            break
        end, v = _step(text, i)
        moves = [(end, v, 0)]
        if v is not None and text[i] not in _QUOTED:
            k = bisect.bisect_right(starts, i)
            if k < len(starts) and starts[k] < end:  # a known value begins inside the run
                moves.append((starts[k], text[i : starts[k]].strip(_EDGE) or None, 0))
        moves += [(e, w, len(w)) for e, w in known.get(i, ())]
        gain, pieces = best[i]
        for e, w, g in moves:
            score = (gain + g, pieces - (w is not None))
            if e not in best:
                heapq.heappush(todo, e)
            elif score < best[e] or score == best[e] and not g:
                continue
            best[e], back[e] = score, (i, w)
    out, i = [], n
    while i:
        i, v = back[i]
        if v is not None:
            out.append(v)
    return out[::-1]


def _automaton_of(key: str, values: Sequence[str]):
    if key not in _automata:
        _automata.clear()  # a worker holds one at a time
        _automata[key] = build_automaton(values)
    return _automata[key]


def _segmenter(shared):
    @F.pandas_udf("array<string>")
    def packed_values(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        key, values = shared.value
        automaton = _automaton_of(key, values)
        for part in parts:
            yield pd.Series([segment(t, whole_matches(t, automaton)) if t else [] for t in part], dtype=object)

    return packed_values


def _finder(shared):
    @F.pandas_udf("array<struct<s:int,e:int,v:string>>")
    def packed_matches(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        key, values = shared.value
        automaton = _automaton_of(key, values)
        for part in parts:
            yield pd.Series([[{"s": s, "e": e, "v": v} for s, e, v in whole_matches(t, automaton)] if t else [] for t in part], dtype=object)

    return packed_matches


def _cover():
    @F.pandas_udf("array<string>")
    def packed_cover(text: pd.Series, matches: pd.Series) -> pd.Series:
        return pd.Series([segment(t, [(m["s"], m["e"], m["v"]) for m in (found if found is not None else ())]) for t, found in zip(text, matches)], dtype=object)

    return packed_cover


def split_packed(df: DataFrame, key: str, fields: Sequence[str], dictionary: DataFrame | None = None, max_entries: int = 100_000) -> DataFrame:
    """One row ``(key, field, pos, item)`` per value of each packed field; ``pos`` counts from 1.

    ``dictionary``: one column of known values. Every pass is narrow: fields are never shuffled.
    """
    spark = df.sparkSession
    rows = df.select(F.col(key), F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("packed")) for f in fields])).alias("_f")).select(key, "_f.field", "_f.packed")
    rows = rows.filter(F.col("packed").rlike(r"[^\s,;|/\[\](){}]"))
    count, parts = 0, 1
    if dictionary is not None:
        protected = dictionary.select(F.col(dictionary.columns[0]).cast("string").alias("v")).filter(F.col("v").rlike(SPECIAL_SQL)).distinct()
        count = protected.count()
        parts = max(1, -(-2 * count // max_entries) if count > max_entries else 1)

    def shard(k: int):
        values = sorted(r.v for r in collect_bounded(protected.filter(F.pmod(F.xxhash64("v"), F.lit(parts)) == k), max_entries, "dictionary shard")) if count else []
        return spark.sparkContext.broadcast((hashlib.sha256("\x1f".join(values).encode("utf-8", "surrogatepass")).hexdigest(), values))

    if parts == 1:
        items = _segmenter(shard(0))("packed")
    else:
        work = Workspace(spark, "packed")
        rows = rows.withColumn("_m", F.array().cast("array<struct<s:int,e:int,v:string>>"))
        for k in range(parts):
            shared = shard(k)
            done = work.cut(rows.withColumn("_m", F.concat("_m", _finder(shared)("packed"))))
            work.drop(rows)
            shared.destroy()
            rows = done
        items = _cover()("packed", "_m")
    return rows.select(key, "field", F.posexplode(items).alias("_p", "item")).select(key, "field", (F.col("_p") + 1).alias("pos"), "item")
