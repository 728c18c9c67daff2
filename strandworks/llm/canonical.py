"""Mapping free-entered values to a canonical list.

BK-trees under the unrestricted Damerau-Levenshtein distance, which is a true metric, hold
the reference: some the names (letters and digits only), some the words and word stems of names
and glosses. Triangle-inequality pruning returns every entry within a threshold.

A value is first looked up by spelling: words that only modify are left out, and the rest,
written together, must lie within ``name_threshold`` of a name, closer than of any other. Which
words only modify is learnt from the values themselves: such a word stands beside the exact
spelling of at least ``MODIFIES`` different entries. Else a value is looked up by meaning: its
words' stems are found in the word trees, also when two words were run together, and the entry
whose name and gloss explain most of the words' weight (inverse document frequency over the
reference) wins, if it explains at least ``COVERAGE``. Entries are reached through the lists of
entries per stem, so only those that share a stem with the value are scored.

Values are reduced to their letters and digits and made distinct before any matching; the answer
is joined back without gathering a frequent value in one task. The reference is broadcast up to
``max_reference`` entries; a larger one is split into shards, each matched in its own pass. Words,
stems and their frequencies are then still those of the whole reference, every shard gives its
nearest names with their distance and its best meanings with their score, and ties are decided
after the shards' winners were merged, so the number of shards changes no answer.

Defined results: null and blank values, and values that stand letter for letter in the
reference, give no row; values that match nothing, also such without letters, get the empty
string; ties between entries give the empty string; repeated values are mapped alike; very long
values are matched by their words; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import bisect
import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandworks.runtime import WHITE, Workspace, collect_bounded, skew_lookup

#: Least share of a value's weight that an entry must explain.
COVERAGE = 0.5
#: Certainty of a word found only by cutting a longer one in two.
CUT_WORD = 0.8
#: Different entries beside whose exact spelling a word that only modifies stands, and the most words beside a name.
MODIFIES, BESIDE = 3, 4
#: Fixed value: English function words; they decide only between entries that are otherwise equal.
GRAMMAR = frozenset("a an the of to in into on onto at by for from with without as is are was be been being it its this that these those and or than then has have had do does did so such one two up down out off over under through along via per not no which who whose their there here s t".split())
#: Weights of function words and of words the reference does not know, against the rarest word.
_GRAMMAR_WEIGHT, _UNKNOWN = 0.02, 0.8
#: English endings.
_SUFFIXES = ("ations", "ation", "itions", "ition", "atory", "ically", "ating", "ates", "ated", "ally", "ings", "ing", "ively", "ive", "ivity", "ity", "ors", "or", "iers", "ier", "ies", "ied", "ers", "er", "ments", "ment", "ions", "ion", "ates", "ate", "als", "al", "ages", "age", "ars", "ar", "ed", "es", "ly", "s", "e", "y")

_ENDINGS = ("s", "es", "ed", "ing", "er", "ers", "ion", "ation", "age", "ive", "al", "ment")


def stem(word: str) -> str:
    for suffix in _SUFFIXES:
        if word.endswith(suffix) and len(word) - len(suffix) >= (3 if len(suffix) < 3 or suffix in ("ing", "ings") else 4):
            word = word[: -len(suffix)]
            break
    if len(word) > 3 and word[-1] == word[-2] and word[-1] not in "aeiousl":
        word = word[:-1]
    return word


def distance(a: str, b: str) -> int:
    """Unrestricted Damerau-Levenshtein distance."""
    if a == b:
        return 0
    la, lb = len(a), len(b)
    if not la or not lb:
        return la + lb
    far = la + lb
    last: dict[str, int] = {}
    d = [[far] * (lb + 2), [far, *range(lb + 1)]]
    for i in range(1, la + 1):
        row = [far, i]
        before, match = d[i], 0
        x = a[i - 1]
        for j in range(1, lb + 1):
            y = b[j - 1]
            k, m = last.get(y, 0), match
            if x == y:
                cost, match = 0, j
            else:
                cost = 1
            v = before[j] + cost
            if row[j] + 1 < v:
                v = row[j] + 1
            if before[j + 1] + 1 < v:
                v = before[j + 1] + 1
            if k and m:
                w = d[k][m] + (i - k - 1) + 1 + (j - m - 1)
                if w < v:
                    v = w
            row.append(v)
        d.append(row)
        last[x] = i
    return d[la + 1][lb + 1]


class BKTree:
    def __init__(self, words) -> None:
        self.root: tuple[str, dict] | None = None
        self.size = 0
        for w in words:
            self.add(w)

    def add(self, word: str) -> None:
        if self.root is None:
            self.root, self.size = (word, {}), 1
            return
        node = self.root
        while True:
            d = distance(word, node[0])
            if d == 0:
                return
            if d not in node[1]:
                node[1][d] = (word, {})
                self.size += 1
                return
            node = node[1][d]

    def within(self, word: str, threshold: int) -> list[tuple[int, str]]:
        """Every entry within the threshold, nearest first."""
        found, todo = [], [self.root] if self.root else []
        while todo:
            entry, children = todo.pop()
            d = distance(word, entry)
            if d <= threshold:
                found.append((d, entry))
            for k, child in children.items():
                if d - threshold <= k <= d + threshold:
                    todo.append(child)
        return sorted(found)


class LengthTrees:
    """One BK-tree per word length: words whose lengths differ by more than the threshold are further apart than it."""

    def __init__(self, words) -> None:
        by: dict[int, list[str]] = {}
        for w in words:
            by.setdefault(len(w), []).append(w)
        self.trees = {n: BKTree(ws) for n, ws in by.items()}

    def within(self, word: str, threshold: int) -> list[tuple[int, str]]:
        return sorted(x for n in range(len(word) - threshold, len(word) + threshold + 1) if n in self.trees for x in self.trees[n].within(word, threshold))


def name_threshold(length: int) -> int:
    return 1 if length <= 6 else 2 if length <= 11 else 3


def word_threshold(length: int) -> int:
    return 0 if length <= 4 else 1 if length <= 8 else 2


def _words(text: str) -> list[str]:
    return [w for w in re.split(r"[\W_]+", text.lower()) if w]


class Lexicon:
    """Words of a whole reference: forms with their stems, and the weight of each stem."""

    def __init__(self, words: set[str], frequency: dict[str, int], entries: int) -> None:
        """``words``: content words of all names and glosses; ``frequency``: entries per stem."""
        forms: dict[str, set[str]] = {}
        for w in words:
            forms.setdefault(w, set()).add(stem(w))
            forms.setdefault(stem(w), set()).add(stem(w))
        for root in {x for known in forms.values() for x in known}:
            for ending in _ENDINGS:  # inflected forms, so that a slip in one of them is found
                if len(root) + len(ending) >= 7 and root + ending not in forms:
                    forms[root + ending] = {root}
        n = max(entries, 2)
        self.idf = {s: math.log(1 + n / f) for s, f in frequency.items()}
        self.most = math.log(1 + n)
        self.forms = forms
        self.sorted = sorted(self.idf)
        self.word_tree = LengthTrees(sorted(forms))
        self._stems: dict[str, dict[str, float]] = {}

    @classmethod
    def of(cls, entries: list[tuple[str, str | None]]) -> Lexicon:
        frequency: dict[str, int] = {}
        words: set[str] = set()
        for name, gloss in entries:
            mine = {w for w in _words(name) + _words(gloss or "") if w not in GRAMMAR}
            words |= mine
            for x in {stem(w) for w in mine}:
                frequency[x] = frequency.get(x, 0) + 1
        return cls(words, frequency, len(entries))

    def stems_near(self, word: str) -> dict[str, float]:
        """Reference stems meant by a word, with their certainty."""
        if word in self._stems:
            return self._stems[word]
        s = stem(word)
        if s in self.idf:
            near = {s: 1.0}
        else:
            near = {}
            for form in {word, s}:
                for d, e in self.word_tree.within(form, word_threshold(max(len(form), 5))):
                    if d <= word_threshold(max(len(form), len(e))):
                        for x in self.forms[e]:
                            near[x] = max(near.get(x, 0), 1 - 0.2 * d)
            if len(s) >= 5:  # a longer or shorter form of the same word
                i = bisect.bisect_left(self.sorted, s)
                longer = []
                while i < len(self.sorted) and self.sorted[i].startswith(s):
                    longer.append(self.sorted[i])
                    i += 1
                for e in longer + [s[:k] for k in range(5, len(s)) if s[:k] in self.idf]:
                    near[e] = max(near.get(e, 0), 0.9)
        if len(self._stems) > 100_000:
            self._stems.clear()
        self._stems[word] = near
        return near

    def pieces(self, word: str) -> list[str]:
        """The word, or two words of the reference that it was run together from."""
        if self.stems_near(word) or len(word) < 7:
            return [word]
        best = None
        for i in range(1, len(word)):
            a, b = word[:i], word[i:]
            if i < 3 and a not in GRAMMAR or len(b) < 3 and b not in GRAMMAR:
                continue
            x, y = self.stems_near(a), self.stems_near(b)
            a_known, b_known = bool(x) or a in GRAMMAR, bool(y) or b in GRAMMAR
            if a_known and b_known and (x or y):
                score = max(x.values(), default=0.0) + max(y.values(), default=0.0)
                if best is None or score > best[0]:
                    best = (score, [a, b])
        return best[1] if best else [word]


class Canon:
    """Matcher over entries ``(name, gloss)``: a whole reference, or a shard of it with the lexicon of the whole."""

    def __init__(self, entries: list[tuple[str, str | None]], modifiers: frozenset[str] = frozenset(), lexicon: Lexicon | None = None) -> None:
        self.modifiers, self.lexicon = modifiers, lexicon or Lexicon.of(entries)
        self.names: dict[str, list[str]] = {}
        self.by_stem: dict[str, set[str]] = {}
        self.by_grammar: dict[str, set[str]] = {}
        for name, gloss in sorted(entries, key=lambda e: e[0]):
            words = _words(name)
            self.names.setdefault("".join(words), []).append(name)
            for w in words + _words(gloss or ""):
                self.by_grammar.setdefault(w, set()).add(name) if w in GRAMMAR else self.by_stem.setdefault(stem(w), set()).add(name)
        self.name_tree = LengthTrees(self.names)
        self.longest = max(map(len, self.names), default=0)

    def by_spelling(self, words: list[str]) -> tuple[int, set[str]]:
        """The least distance and all names at it, over the value with and without its modifiers; no names if none is near."""
        plain = [w for w in words if w not in self.modifiers]
        best: dict[str, int] = {}
        for t in {"".join(words), "".join(plain), "".join(w for w in plain if not w.isdigit())}:
            if not t or len(t) > self.longest + 3:
                continue
            near = [(0, t)] if t in self.names else self.name_tree.within(t, name_threshold(len(t)))
            for d, entry in near:
                if d <= name_threshold(len(entry)):
                    for name in self.names[entry]:
                        best[name] = min(d, best.get(name, 9))
        d = min(best.values(), default=99)
        return d, {n for n, x in best.items() if x == d}

    def by_meaning(self, words: list[str]) -> tuple[float, set[str]]:
        """The greatest share of the value explained and all names that explain it."""
        lexicon, content = self.lexicon, []
        for w in words:
            if w in GRAMMAR:
                content.append((w, 1.0))
            elif w not in self.modifiers and not w.isdigit():
                pieces = lexicon.pieces(w)
                content += [(p, 1.0 if len(pieces) == 1 else CUT_WORD) for p in pieces]
        total, score, grammar = 0.0, {}, {}
        for w, certainty in content:
            if w in GRAMMAR:
                for name in self.by_grammar.get(w, ()):
                    grammar[name] = grammar.get(name, 0.0) + _GRAMMAR_WEIGHT
                continue
            near = lexicon.stems_near(w)
            if not near:
                total += lexicon.most * _UNKNOWN * min(1.0, len(w) / 5)
                continue
            total += max(lexicon.idf[s] * c for s, c in near.items())
            gain: dict[str, float] = {}
            for s, c in near.items():
                for name in self.by_stem.get(s, ()):
                    gain[name] = max(gain.get(name, 0.0), lexicon.idf[s] * c)
            for name, g in gain.items():
                score[name] = score.get(name, 0.0) + g * certainty
        if not total or not score:
            return 0.0, set()
        score = {n: round((x + grammar.get(n, 0.0)) / total, 9) for n, x in score.items()}
        best = max(score.values())
        return (best, {n for n, x in score.items() if x == best}) if best >= COVERAGE else (0.0, set())

    def candidates(self, key: str, whole: bool = True) -> tuple[int, list[str], float, list[str]]:
        """Nearest names with their distance, best meanings with their share; of a whole reference, meanings only where spelling does not decide."""
        words = key.split()
        d, near = self.by_spelling(words)
        share, meant = (0.0, set()) if whole and len(near) == 1 else self.by_meaning(words)
        return d, sorted(near), share, sorted(meant)


def decide(found: list[tuple[int, list[str], float, list[str]]]) -> tuple[str, str]:
    """``(name, way)`` from the candidates of all shards; ties between entries decide nothing."""
    d = min((f[0] for f in found), default=99)
    near = {n for f in found if f[0] == d for n in f[1]}
    if len(near) == 1:
        return near.pop(), "spelling"
    share = max((f[2] for f in found), default=0.0)
    meant = {n for f in found if f[2] == share for n in f[3]} if share else set()
    return (meant.pop(), "meaning") if len(meant) == 1 else ("", "none")


def value_key(c: Column) -> Column:
    """Words of a value in lower case; capitals inside a word begin a word."""
    return F.trim(F.regexp_replace(F.lower(F.regexp_replace(c, r"(\p{Ll})(\p{Lu})", "$1 $2")), r"[^\p{L}\p{N}]+", " "))


def _matcher(shared):
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        canon = Canon(*shared.value)
        for part in parts:
            got = [decide([canon.candidates(k)]) for k in part["k"]]
            yield pd.DataFrame({"k": part["k"], "canonical": [g[0] for g in got], "way": [g[1] for g in got]})

    return run


def _shard_matcher(shared):
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        canon = Canon(*shared.value)
        for part in parts:
            got = [canon.candidates(k, False) for k in part["k"]]
            yield pd.DataFrame({"k": part["k"], "d": [g[0] for g in got], "near": [g[1] for g in got], "share": [g[2] for g in got], "meant": [g[3] for g in got]})

    return run


def _entry_words():
    """Per entry its distinct content words with their stems."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [(n, w, stem(w)) for n, g in zip(part["name"], part["gloss"]) for w in {x for x in _words(n) + _words(g or "") if x not in GRAMMAR}]
            yield pd.DataFrame(rows, columns=["name", "word", "stem"])

    return run


def modifying_words(keys: DataFrame, names: DataFrame, max_words: int = 100_000) -> frozenset[str]:
    """Words that stand beside the exact spelling of at least ``MODIFIES`` different names.

    ``names``: name and the same in letters and digits with single blanks. The runs of words of
    each key meet the names in an equi join. Numbers need not be learnt.
    """
    most = names.agg(F.max(F.size(F.split("form", " ")))).first()[0] or 0
    t = keys.select(F.split("k", " ").alias("w")).filter(F.size("w").between(2, most + BESIDE))
    at = F.explode(F.sequence(F.lit(1), F.size("w"))).alias("at")
    t = t.select("w", at).select("w", "at", F.explode(F.sequence(F.lit(1), F.least(F.lit(most), F.size("w") - F.col("at") + 1))).alias("n"))
    t = t.withColumn("form", F.array_join(F.slice("w", F.col("at"), F.col("n")), "")).withColumn("rest", F.concat(F.slice("w", F.lit(1), F.col("at") - 1), F.slice("w", F.col("at") + F.col("n"), F.size("w"))))
    known = names.select("name", F.replace("form", F.lit(" ")).alias("form")).filter("form <> ''")
    t = t.join(known, "form").select("name", F.explode("rest").alias("word")).filter(~F.col("word").rlike("^[0-9]+$"))
    often = t.groupBy("word").agg(F.countDistinct("name").alias("n")).filter(F.col("n") >= MODIFIES).select("word")
    return frozenset(r.word for r in collect_bounded(often, max_words, "modifying words"))


def match_keys(keys: DataFrame, reference: DataFrame, max_reference: int = 50_000, max_words: int = 500_000) -> DataFrame:
    """``(k, canonical, way)`` of each distinct key. ``reference``: name and gloss; ``max_words``: its distinct words."""
    spark = keys.sparkSession
    name, gloss = reference.columns[:2]
    ref = reference.select(F.col(name).cast("string").alias("name"), F.col(gloss).cast("string").alias("gloss")).filter("name is not null").dropDuplicates(["name"])
    count = ref.count()
    shards = max(1, -(-2 * count // max_reference) if count > max_reference else 1)
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    modifiers = modifying_words(keys, ref.select("name", value_key(F.col("name")).alias("form")))
    keys = keys.repartition(parts, "k")
    collected = lambda s: sorted((r.name, r.gloss) for r in collect_bounded(ref.filter(F.pmod(F.xxhash64("name"), F.lit(shards)) == s), max_reference, "reference shard"))
    if shards == 1:
        return keys.mapInPandas(_matcher(spark.sparkContext.broadcast((collected(0), modifiers))), "k string, canonical string, way string")
    words = ref.mapInPandas(_entry_words(), "name string, word string, stem string")
    per = {r.stem: r.n for r in collect_bounded(words.groupBy("stem").agg(F.countDistinct("name").alias("n")), max_words, "stems of the reference")}
    lexicon = Lexicon({r.word for r in collect_bounded(words.select("word").distinct(), max_words, "words of the reference")}, per, count)
    found = None
    for s in range(shards):
        shared = spark.sparkContext.broadcast((collected(s), modifiers, lexicon))
        one = keys.mapInPandas(_shard_matcher(shared), "k string, d int, near array<string>, share double, meant array<string>")
        found = one if found is None else found.unionByName(one)
    # per key one row a shard
    best = found.groupBy("k").agg(F.min("d").alias("_d"), F.max("share").alias("_share"), F.collect_list(F.struct("d", "near", "share", "meant")).alias("all"))
    union = lambda test, c: F.array_distinct(F.flatten(F.transform(F.filter("all", test), lambda x: x[c])))
    best = best.withColumns({"near": union(lambda x: x["d"] == F.col("_d"), "near"), "meant": union(lambda x: (x["share"] == F.col("_share")) & (x["share"] > 0), "meant")})
    spelled, meant = F.size("near") == 1, F.size("meant") == 1
    return best.select("k", F.when(spelled, F.get("near", F.lit(0))).when(meant, F.get("meant", F.lit(0))).otherwise("").alias("canonical"), F.when(spelled, "spelling").when(meant, "meaning").otherwise("none").alias("way"))


def map_to_canonical(df: DataFrame, key: str, value: str, reference: DataFrame, max_reference: int = 50_000) -> DataFrame:
    """``(key, value, canonical, way)`` for every row whose value is not null, not blank and not in the reference.

    ``way``: spelling, meaning or none.
    """
    work = Workspace(df.sparkSession, "canonical")
    name = reference.columns[0]
    exact = reference.select(F.col(name).cast("string").alias("_name")).filter("_name is not null").distinct()
    t = df.select(F.col(key).alias("_key"), F.col(value).cast("string").alias("_value")).filter(F.col("_value").rlike(f"(?s)(?!{WHITE}).") )
    t = work.cut(t.join(exact, F.col("_value") == F.col("_name"), "left_anti").select("_key", "_value", value_key(F.col("_value")).alias("k")))
    distinct = work.cut(t.select("k").distinct())
    answers = work.cut(match_keys(distinct, reference, max_reference).withColumnRenamed("k", "_k"))
    return skew_lookup(t, "k", answers, "_k", "left").select(F.col("_key").alias(key), F.col("_value").alias(value), "canonical", "way")
