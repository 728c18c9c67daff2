"""Missing or wrong language labels: string-kernel classification of sentences.

A sentence is the set of its character n-grams of lengths 1 to ``NGRAM`` (blended spectrum,
presence only); the kernel of two sentences is the size of the sets' intersection over the
geometric mean of their sizes. Kernel ridge regression, one versus rest, is fitted in the
Nyström approximation on ``landmarks`` sentences per language. As the kernel to the
landmarks is linear in a sentence's n-grams, scoring needs one product of the batch's sparse
presence matrix with the folded matrix (landmark presence x coefficients), done for whole
batches at once.

The classifier is fitted on the driver from a bounded sample of labelled texts: of every
language the ``sample`` texts (of at most ``sample_chars`` characters) with the smallest hash of their
key, plus a few fixed sentences; all sentences of these count. The sample is fetched by a threshold
on the hash that follows from the number of texts per label, so that no more than about twice the
sample is ever moved. Labels are noisy, so a first model drops sentences that contradict their label;
the second one is fitted on the rest. Scoring covers every text whole.

The languages, their notations and the fixed sentences are one parameter (``Languages``). Segments
whose confidence stays below ``least_confidence`` come out as ``und``: with a bound above 0 texts in
none of the languages are rejected instead of given to the nearest one.

Sentences are then labelled jointly: the best path through the sentence scores, weighted by
length, where each change of language costs ``SWITCH``. Names, single terms and abbreviation
fragments so never change the language.

Defined results: null and blank texts give no row; a text without any letter is one segment of
language ``und`` with confidence 0; labels in other notations (codes of two or three letters,
names, with region or script, any case) count as the language named; repeated texts are
labelled each; very long texts are scored sentence by sentence; other columns are not read.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandworks.runtime import spread

NGRAM = 4
SWITCH = 0.15
#: Letters from which on a sentence counts fully.
FULL_LENGTH = 50
SHARPNESS = 6.0
#: Rounds in which sentences that contradict their label are dropped, the ridge of these fits and of the last one.
CLEANING, RIDGE, FINAL_RIDGE = 2, 3e-2, 1e-2
#: Nyström landmarks per language; n-grams that more of them hold than this go through the dense product.
LANDMARKS, COMMON = 80, 16
UNKNOWN = "und"

#: ISO 639 codes and English and own names of the languages.
NOTATIONS = {
    "de": ("de", "deu", "ger", "german", "deutsch", "deutsche"),
    "en": ("en", "eng", "english", "englisch", "anglais", "ingles"),
    "es": ("es", "spa", "spanish", "castilian", "espanol", "español", "castellano"),
    "fr": ("fr", "fra", "fre", "french", "francais", "français"),
    "it": ("it", "ita", "italian", "italiano"),
    "nl": ("nl", "nld", "dut", "dutch", "flemish", "nederlands"),
    "pt": ("pt", "por", "portuguese", "portugues", "português"),
    "ru": ("ru", "rus", "russian", "russkij", "русский"),
    "sv": ("sv", "swe", "swedish", "svenska"),
    "zh": ("zh", "zho", "chi", "cmn", "chinese", "mandarin", "zhongwen", "中文", "汉语"),
}
_SEEDS = {
    "de": ("Wir wissen nicht, ob der Versuch gelungen ist und was daraus folgt.", "Nach dem Schlaf wird die Antwort in den Zellen langsamer."),
    "en": ("We do not know whether the experiment worked and what follows from it.", "After sleep the answer of these cells becomes slower than before."),
    "es": ("No sabemos si el experimento ha funcionado y qué se sigue de ello.", "Después del sueño la respuesta de las células se vuelve más lenta."),
    "fr": ("Nous ne savons pas si l'expérience a réussi et ce qui en résulte.", "Après le sommeil, la réponse des cellules devient plus lente."),
    "it": ("Non sappiamo se l'esperimento sia riuscito e che cosa ne segua.", "Dopo il sonno la risposta delle cellule diventa più lenta."),
    "nl": ("We weten niet of de proef gelukt is en wat eruit volgt.", "Na de slaap wordt het antwoord van de cellen trager."),
    "pt": ("Não sabemos se a experiência funcionou e o que se segue dela.", "Depois do sono a resposta das células torna-se mais lenta."),
    "ru": ("Мы не знаем, удался ли опыт и что из него следует.", "После сна ответ клеток становится медленнее."),
    "sv": ("Vi vet inte om försöket lyckades och vad som följer av det.", "Efter sömnen blir cellernas svar långsammare."),
    "zh": ("我们不知道实验是否成功，也不知道由此得出什么。", "睡眠之后，细胞的反应变得更慢。"),
}


@dataclass(frozen=True)
class Languages:
    """The languages told apart: code to the names it goes by, and a few sentences of each."""

    notations: dict[str, tuple[str, ...]]
    seeds: dict[str, tuple[str, ...]]
    #: Languages whose letters keep their marks in the copies fitted without accents.
    unaccented: tuple[str, ...] = ("ru", "zh")

    @property
    def codes(self) -> tuple[str, ...]:
        return tuple(sorted(self.notations))

    @property
    def named(self) -> dict[str, str]:
        return {n: code for code, names in self.notations.items() for n in names}


DEFAULT = Languages(NOTATIONS, _SEEDS)
LANGUAGES = DEFAULT.codes

#: A boundary begins with the sign before it, so that the search skips all other characters.
_BREAK = re.compile(r"[\n。！？.!?…:;»”\"](?:(?<=\n)\n*|(?<=[。！？])[\"'”’»」』）)\]]*|(?<=[.!?…])[\"'”’»)\]]*\s+(?=\S)|(?<=[:;])\s+(?=[«“\"„])|(?<=[»”\"])\s+(?=[A-ZÀ-ÞА-Я«“\"]))")
_IDEOGRAPH, _CYRILLIC, _LATIN = re.compile("[\u3400-\u9fff]"), re.compile("[\u0400-\u052f]"), re.compile("[a-zà-öø-ɏ]")
_OTHER_SCRIPT = re.compile("[\u0400-\u052f\u3400-\u9fff]")
#: Bits of an n-gram's hash; the rest of a key numbers the sentences of a batch.
_HASH_BITS = 44
_DIGITS = re.compile(r"[\W\d_]+")


def named_language(label: str | None, names: dict[str, str] | None = None) -> str | None:
    """The language a delivered label names, or None."""
    if label is None:
        return None
    names = DEFAULT.named if names is None else names
    words = [w for w in re.split(r"[\W_]+", unicodedata.normalize("NFC", label).lower()) if w]
    if not words:
        return None
    if words[0] in names:
        return names[words[0]]
    named = {names[w] for w in words if w in names and len(w) > 3}
    return named.pop() if len(named) == 1 else None


def sentences_of(text: str) -> list[str]:
    out, at = [], 0
    for m in _BREAK.finditer(text):
        out.append(text[at : m.start() + 1].strip())
        at = m.end()
    out.append(text[at:].strip())
    return [s for s in out if s]


def normalise(sentence: str) -> str:
    """Letters only, lower case. Latin names and terms inside an ideographic or Cyrillic sentence are left out."""
    if sentence.isascii():
        return " " + _DIGITS.sub(" ", sentence.lower()).strip() + " "
    t = unicodedata.normalize("NFC", sentence).lower()
    if _OTHER_SCRIPT.search(t):
        ideographs, cyrillic = len(_IDEOGRAPH.findall(t)), len(_CYRILLIC.findall(t))
        if ideographs or cyrillic:
            latin = len(_LATIN.findall(t))
            if 6 * ideographs >= latin and 3 * ideographs >= cyrillic:
                t = _LATIN.sub(" ", t)
                t = _IDEOGRAPH.sub(r"\g<0> ", t)  # its n-grams are then those of single signs and pairs
            elif 2 * cyrillic >= latin:
                t = _LATIN.sub(" ", t)
    return " " + _DIGITS.sub(" ", t).strip() + " "


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ``(text, n-gram hash)`` of normalised texts, for the whole batch at once, ordered by text."""
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(texts), dtype=np.uint64) << np.uint64(_HASH_BITS), lengths)
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(codes))
    keys = []
    with np.errstate(over="ignore"):
        h = np.zeros(len(codes), dtype=np.uint64)
        for n in range(1, NGRAM + 1):
            if len(codes) < n:
                break
            h = h[: len(codes) - n + 1] * np.uint64(0x100000001B3) + codes[n - 1 :]
            mixed = (h + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
            mixed = ((mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - _HASH_BITS)
            keys.append((owner[: len(h)] | mixed)[left[: len(h)] >= n])
    key = np.sort(np.concatenate(keys)) if keys else np.zeros(0, np.uint64)
    if len(key):
        key = key[np.concatenate([[True], key[1:] != key[:-1]])]
    return (key >> np.uint64(_HASH_BITS)).astype(np.int64), key & np.uint64((1 << _HASH_BITS) - 1)


_SLOT_BITS = 18


class Vocabulary:
    """Sorted n-gram hashes, found through a table on their leading bits instead of by bisection."""

    def __init__(self, hashes: np.ndarray) -> None:
        self.hashes = hashes
        self.shift = np.uint64(_HASH_BITS - _SLOT_BITS)
        edges = np.arange((1 << _SLOT_BITS) + 1, dtype=np.uint64) << self.shift
        self.start = np.searchsorted(hashes, edges).astype(np.int32)
        self.deepest = int(np.diff(self.start).max(initial=0))

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(positions in h, places in the vocabulary)`` of those that are known, in order."""
        slot = (h >> self.shift).astype(np.int32)
        at, stop = self.start[slot], self.start[slot + 1]
        place = np.full(len(h), -1, dtype=np.int32)
        left = np.flatnonzero(at < stop)
        at, stop, wanted = at[left], stop[left], h[left]
        for _ in range(self.deepest):
            same = self.hashes[at] == wanted
            place[left[same]] = at[same]
            more = ~same & (at + 1 < stop)
            left, at, stop, wanted = left[more], at[more] + 1, stop[more], wanted[more]
        where = np.flatnonzero(place >= 0)
        return where, place[where]


def _sums(owner: np.ndarray, at: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Product of the batch's presence matrix, given by its (text, n-gram) places, with ``rows``."""
    out = np.zeros((n, rows.shape[1]), dtype=rows.dtype)
    if len(owner):
        starts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        out[owner[starts]] = np.add.reduceat(rows[at], starts, axis=0)
    return out


class Model:
    """Folded kernel classifier: a row of ``weights`` per known n-gram."""

    def __init__(self, vocabulary: Vocabulary, weights: np.ndarray, codes: tuple[str, ...]) -> None:
        self.vocabulary, self.weights, self.codes = vocabulary, weights, codes

    def scores(self, texts: list[str]) -> np.ndarray:
        """Regression scores (texts x languages) of normalised sentences."""
        owner, h = grams(texts)
        sizes = np.bincount(owner, minlength=len(texts))
        known, at = self.vocabulary.find(h)
        return _sums(owner[known], at, self.weights, len(texts)).astype(np.float64) / np.sqrt(np.maximum(sizes, 1))[:, None]


def _landmarks(y: np.ndarray, languages: int, per_language: int) -> np.ndarray:
    """Sentences spread evenly over each language's sample."""
    out = []
    for c in range(languages):
        mine = np.flatnonzero(y == c)
        out.append(mine[np.unique(np.linspace(0, len(mine) - 1, min(per_language, len(mine))).astype(np.int64))] if len(mine) else mine)
    return np.concatenate(out)


class Nystroem:
    """Feature map of all training sentences: the kernel to the landmarks, whitened; computed once.

    The numbers of common n-grams of sentences and landmarks are a product of two presence
    matrices: n-grams that many landmarks hold go through a dense product, all others through
    the lists of the landmarks that hold them.
    """

    def __init__(self, texts: list[str], y: np.ndarray, codes: tuple[str, ...], per_language: int = LANDMARKS) -> None:
        self.y, self.codes = y, codes
        marks = _landmarks(y, len(codes), per_language)
        owner, h = grams([texts[i] for i in marks])
        self.vocabulary = Vocabulary(np.unique(h))
        at = np.searchsorted(self.vocabulary.hashes, h)
        order = np.argsort(at, kind="stable")
        self.holders, self.spread = owner[order], np.bincount(at, minlength=len(self.vocabulary.hashes))
        self.first = np.concatenate([[0], np.cumsum(self.spread)])
        self.scale = 1 / np.sqrt(np.maximum(np.bincount(owner, minlength=len(marks)), 1))
        self.common = np.flatnonzero(self.spread > COMMON)
        self.column = np.full(len(self.spread), -1)
        self.column[self.common] = np.arange(len(self.common))
        self.dense = np.zeros((len(self.common), len(marks)), dtype=np.float32)
        often = self.column[at] >= 0
        self.dense[self.column[at[often]], owner[often]] = 1
        K = np.concatenate([self._kernel(texts[i : i + 1000]) for i in range(0, len(texts), 1000)])
        values, vectors = np.linalg.eigh(K[marks].astype(np.float64))
        keep = values > 1e-6 * values.max()
        self.whiten = vectors[:, keep] / np.sqrt(values[keep])
        self.phi = np.hstack([K @ self.whiten.astype(np.float32), np.ones((len(texts), 1), dtype=np.float32)])

    def _kernel(self, some: list[str]) -> np.ndarray:
        owner, h = grams(some)
        sizes = np.bincount(owner, minlength=len(some))
        known, at = self.vocabulary.find(h)
        owner, column, n = owner[known], self.column[at], len(self.scale)
        often = column >= 0
        present = np.zeros((len(some), len(self.common)), dtype=np.float32)
        present[owner[often], column[often]] = 1
        owner, at = owner[~often], at[~often]
        many = self.spread[at]
        within = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        rare = np.bincount(np.repeat(owner, many) * n + self.holders[np.repeat(self.first[at], many) + within], minlength=len(some) * n)
        return ((present @ self.dense + rare.reshape(len(some), n)) * self.scale / np.sqrt(np.maximum(sizes, 1))[:, None]).astype(np.float32)

    def solve(self, kept: np.ndarray, ridge: float) -> np.ndarray:
        """Coefficients of the ridge regression on the kept sentences, balanced over the languages."""
        phi, y = self.phi[kept].astype(np.float64), self.y[kept]
        weight = (1 / np.maximum(np.bincount(y, minlength=len(self.codes)), 1))[y]
        weighed = (phi * weight[:, None]).T
        return np.linalg.solve(weighed @ phi + ridge * np.eye(phi.shape[1]), weighed @ np.eye(len(self.codes))[y])

    def model(self, coef: np.ndarray) -> Model:
        per_mark = (self.whiten @ coef[:-1]) * self.scale[:, None]
        weights = np.add.reduceat(per_mark[self.holders], self.first[:-1], axis=0)
        return Model(self.vocabulary, weights.astype(np.float32), self.codes)


def training_sentences(rows: list[tuple[str, str]], languages: Languages = DEFAULT) -> tuple[list[str], np.ndarray]:
    """Normalised sentences of the sample and the fixed ones, also written without accents, with their language's place."""
    texts, y = [], []
    for text, code in [*rows, *[(s, code) for code, seeds in languages.seeds.items() for s in seeds]]:
        c = languages.codes.index(code)
        for s in sentences_of(text):
            t = normalise(s)
            if len(t) < 12:
                continue
            texts.append(t)
            y.append(c)
            if not s.isascii() and code not in languages.unaccented:
                bare = normalise("".join(x for x in unicodedata.normalize("NFD", s) if not unicodedata.combining(x)))
                if bare != t:
                    texts.append(bare)
                    y.append(c)
    return texts, np.array(y, dtype=np.int64)


def train(rows: list[tuple[str, str]], languages: Languages = DEFAULT) -> Model:
    """Fits on all sentences of ``(text, language)``; those that a first model judges otherwise are dropped."""
    texts, y = training_sentences(rows, languages)
    seeds = {normalise(s) for v in languages.seeds.values() for s in v}
    fixed = np.array([t in seeds for t in texts])
    features = Nystroem(texts, y, languages.codes)
    kept = np.ones(len(texts), dtype=bool)
    for _ in range(CLEANING):
        coef = features.solve(kept, RIDGE)
        # without the constant, as the folded model scores
        kept = fixed | ((features.phi[:, :-1] @ coef[:-1]).argmax(axis=1) == y)
    return features.model(features.solve(kept, FINAL_RIDGE))


def best_path(scores: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Language of each sentence; every change costs ``SWITCH``."""
    first = scores.argmax(axis=1)
    if (first == first[0]).all():
        return first  # the best of every sentence without any change
    gain = scores * weights[:, None]
    total = gain[0].copy()
    back = np.zeros(scores.shape, dtype=np.int64)
    for i in range(1, len(scores)):
        best = int(total.argmax())
        stay = total >= total[best] - SWITCH
        back[i] = np.where(stay, np.arange(scores.shape[1]), best)
        total = np.where(stay, total, total[best] - SWITCH) + gain[i]
    path = np.zeros(len(scores), dtype=np.int64)
    path[-1] = total.argmax()
    for i in range(len(scores) - 1, 0, -1):
        path[i - 1] = back[i][path[i]]
    return path


def confidence(scores: np.ndarray, weights: np.ndarray, c: int) -> float:
    """Softmax of a segment's length-weighted mean score."""
    s = (scores * weights[:, None]).sum(axis=0) / weights.sum()
    e = np.exp(SHARPNESS * (s - s.max()))
    return float(e[c] / e.sum())


def segments(model: Model, texts: list[str], least_confidence: float = 0.0) -> list[list[tuple[str, int, float]]]:
    """Per text its runs of sentences in one language: ``(language, sentences, confidence)``."""
    parts = [[n for n in (normalise(s) for s in sentences_of(t)) if len(n) > 2] for t in texts]
    flat = [n for p in parts for n in p]
    out: list[list[tuple[str, int, float]]] = []
    scores = np.concatenate([model.scores(flat[i : i + 4000]) for i in range(0, len(flat), 4000)]) if flat else np.zeros((0, len(model.codes)))
    letters = np.array([min(_letters(n), FULL_LENGTH) for n in flat]) / FULL_LENGTH
    at = 0
    for p in parts:
        if not p:
            out.append([(UNKNOWN, 0, 0.0)])
            continue
        s, w = scores[at : at + len(p)], letters[at : at + len(p)]
        at += len(p)
        path = best_path(s, w)
        cuts = [0, *(np.flatnonzero(np.diff(path)) + 1).tolist(), len(path)]
        runs = [(model.codes[path[a]], b - a, confidence(s[a:b], w[a:b], path[a])) for a, b in zip(cuts, cuts[1:])]
        out.append([(lang if c >= least_confidence else UNKNOWN, n, c) for lang, n, c in runs])
    return out


def _letters(t: str) -> int:
    """Letters, an ideograph counting as five."""
    n = len(t) - t.count(" ")
    return n if t.isascii() else n + 4 * len(_IDEOGRAPH.findall(t))


def training_rows(docs: DataFrame, key: str, text: str, label: str, sample: int = 100, sample_chars: int = 20_000, languages: Languages = DEFAULT) -> list[tuple[str, str]]:
    """Bounded sample: per language the ``sample`` labelled texts with the smallest key hash.

    Labels are counted first; of each language only texts whose hash lies below the share that holds
    about twice the sample are fetched, each hash once. Where blank or long texts leave too few, the
    share is doubled, until the sample is full or all texts were seen.
    """
    spark = docs.sparkSession
    first = F.regexp_extract(F.lower(F.col(label).cast("string")), r"^[^\p{L}]*(\p{L}+)", 1)
    t = docs.select(F.xxhash64(F.col(key).cast("string")).alias("h"), F.col(text).cast("string").alias("t"), first.alias("n"))
    names = spark.createDataFrame(sorted(languages.named.items()), "n string, c string")
    per = {r["c"]: r["count"] for r in t.select("n").join(F.broadcast(names), "n").groupBy("c").count().collect()}  # one row per language
    rows: dict[str, list] = {}
    share = {c: min(1.0, 2 * sample / n) for c, n in per.items()}
    while share:
        least = spark.createDataFrame([(n, c, int(-(2**63) + share[c] * (2**64 - 1)) if share[c] < 1 else 2**63 - 1) for n, c in sorted(languages.named.items()) if c in share], "n string, c string, most bigint")
        some = t.join(F.broadcast(least), "n").filter((F.col("h") <= F.col("most")) & F.col("t").rlike(r"\p{L}") & (F.char_length("t") <= sample_chars))
        got: dict[str, list] = {}
        for r in some.groupBy("c", "h").agg(F.min("t").alias("t")).collect():  # about 2 x sample texts per language
            got.setdefault(r.c, []).append((r.h, r.t))
        for c in list(share):
            rows[c] = sorted(got.get(c, []))[:sample]
            if len(rows[c]) == sample or share[c] == 1:
                del share[c]
            else:
                share[c] = min(1.0, 2 * share[c])
    return [(t, c) for c in sorted(rows) for _, t in rows[c]]


def label_languages(docs: DataFrame, key: str, text: str, label: str, sample: int = 100, sample_chars: int = 20_000, languages: Languages = DEFAULT, least_confidence: float = 0.0) -> DataFrame:
    """One row per segment: ``(key, label_language, segment_no, lang, sentences, confidence, segments, doc_lang, doc_confidence)``."""
    model = docs.sparkSession.sparkContext.broadcast(train(training_rows(docs, key, text, label, sample, sample_chars, languages), languages))
    kind = docs.schema[key].dataType.simpleString()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m, names = model.value, languages.named
        for part in parts:
            for at in range(0, len(part), 64):
                piece = part.iloc[at : at + 64]
                rows = []
                for k, given, runs in zip(piece["k"], piece["l"], segments(m, piece["t"].tolist(), least_confidence)):
                    weight: dict[str, float] = {}
                    for lang, n, c in runs:
                        weight[lang] = weight.get(lang, 0) + max(n, 1) * c
                    whole = sum(max(n, 1) for _, n, _ in runs)
                    main = max(weight, key=lambda x: (weight[x], x))
                    named = named_language(given, names)
                    rows += [(k, named, i + 1, lang, n, c, len(runs), main, weight[main] / whole) for i, (lang, n, c) in enumerate(runs)]
                yield pd.DataFrame(rows, columns=["k", "label_language", "segment_no", "lang", "sentences", "confidence", "segments", "doc_lang", "doc_confidence"])

    base = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"), F.col(label).cast("string").alias("l")).filter(F.col("t").rlike(r"[^\s\p{Z}\x00-\x20]"))
    out = spread(base).mapInPandas(run, f"k {kind}, label_language string, segment_no int, lang string, sentences int, confidence double, segments int, doc_lang string, doc_confidence double")
    return out.withColumnRenamed("k", key)
