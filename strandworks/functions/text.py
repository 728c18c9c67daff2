"""Text expressions: normal forms of names and relations, answers, tags, tokens.

All are built-in column expressions, so they stay inside generated code. Null gives null
unless a function says otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from strandworks.runtime import trim_all

#: Fixed value: words that the rewards do not count.
STOP_WORDS = ("the", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by", "a", "an", "is", "are", "was", "were", "be", "been", "have", "has", "had", "do", "does", "did", "will", "would", "could", "should", "may", "might", "can", "this", "that", "these", "those")
#: Fixed value: spellings of relations that stand for another one, replaced before blanks become underscores.
RELATION_ALIASES = {"projects to": "projects_to", "receives": "receives_input_from", "receives_input": "receives_input_from", "input_from": "receives_input_from", "contains_representation_of": "encodes_representation_of", "encodes": "encodes_representation_of", "leads_to": "results_in", "resulting_from": "results_in"}


def norm_text(c: Column) -> Column:
    """Lower case, words only, single blanks; null gives the empty text."""
    c = F.lower(F.coalesce(c, F.lit("")))
    c = F.regexp_replace(c, "[_-]", " ")
    c = F.regexp_replace(c, r"[^\p{L}\p{N}_\s]+", " ")
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def singular_last(c: Column) -> Column:
    """The last word without its plural s, if it has more than three letters and no double s."""
    last = F.element_at(F.split(c, " "), -1)
    return F.when((F.length(last) > 3) & last.endswith("s") & ~last.endswith("ss"), F.substring(c, F.lit(1), F.length(c) - 1)).otherwise(c)


def entity_key(c: Column) -> Column:
    return singular_last(norm_text(c))


def norm_relation(c: Column) -> Column:
    """Lower case with single underscores; null gives the empty text."""
    return F.regexp_replace(F.regexp_replace(F.lower(trim_all(F.coalesce(c, F.lit("")))), " ", "_"), "_+", "_")


def alias_relation(c: Column, aliases: dict[str, str] | None = None) -> Column:
    pairs = [F.lit(x) for kv in (aliases or RELATION_ALIASES).items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), c), c)


def split_ids(c: Column) -> Column:
    """Comma-separated ids as a sorted array of distinct, non-empty texts."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")))


def words(c: Column) -> Column:
    """Runs between white space; the empty text has none."""
    return F.filter(F.split(trim_all(F.coalesce(c, F.lit(""))), r"\s+"), lambda x: x != "")


def word_count(c: Column) -> Column:
    return F.size(words(c))


def clip_middle(c: Column, limit: int) -> Column:
    """Trimmed; longer texts keep their first and last halves around an ellipsis line; null gives the empty text."""
    half = limit // 2
    c = trim_all(F.coalesce(c, F.lit("")))
    return F.when(F.char_length(c) > limit, F.concat(F.left(c, F.lit(half)), F.lit("\n...\n"), F.right(c, F.lit(half)))).otherwise(c)


def normalize_tail(c: Column) -> Column:
    """White space collapsed, one matching pair of quotes taken off."""
    c = trim_all(F.regexp_replace(c, r"\s+", " "))
    quoted = (F.length(c) >= 2) & (F.left(c, F.lit(1)) == F.right(c, F.lit(1))) & F.left(c, F.lit(1)).isin('"', "'")
    return F.when(quoted, F.trim(F.substring(c, F.lit(2), F.length(c) - 2))).otherwise(c)


def between(c: Column, opening: str, closing: str) -> Column:
    """Text after the first opening mark up to the next closing mark; empty without the opening."""
    tail = F.when(F.instr(c, opening) > 0, F.substring(c, F.instr(c, opening) + len(opening), F.length(c)))
    return F.coalesce(F.substring_index(tail, closing, 1), F.lit(""))


def gold_answer(c: Column) -> Column:
    """First answer letter between answer tags, in any case; null without one."""
    return F.nullif(F.upper(F.regexp_extract(c, r"(?i)<Answer>[:\s]*([A-D])[:\s]*</Answer>", 1)), F.lit(""))


def outside_think(c: Column) -> Column:
    """Closed think blocks are cut out, then an unclosed one with all that follows."""
    return F.regexp_replace(F.regexp_replace(c, r"(?s)<think>.*?</think>", ""), r"(?s)<think>.*$", "")


def model_answer(c: Column) -> Column:
    """Last answer letter outside think blocks; case counts."""
    found = F.regexp_extract_all(outside_think(c), F.lit(r"<Answer>[:\s]*([A-D])[:\s]*</Answer>"), F.lit(1))
    return F.try_element_at(found, F.lit(-1))


def question_only(c: Column) -> Column:
    """Question with options, without tags, brackets and runs of blank lines."""
    part = F.regexp_extract(c, r"(?s)(<Question>.*?</Options>)", 1)
    part = F.when(part == "", c).otherwise(part)
    part = F.regexp_replace(part, r"</?(?:Question|Options)>:?", "")
    part = F.regexp_replace(part, r"[\[\]]", "")
    return trim_all(F.regexp_replace(part, r"\n{3,}", "\n\n"))


def extract_answer(c: Column, unclosed_tag: bool = False) -> Column:
    """Cascade: "Final Answer", answer tags, optionally an unclosed tag, first letter after the last think block."""
    t = F.regexp_replace(c, r"\*+", "")
    rules = [F.regexp_extract(t, r"(?i)Final Answer\s*[:\-]\s*([A-D])", 1), F.regexp_extract(t, r"(?i)<answer>\s*([A-D])\s*</answer>", 1)]
    if unclosed_tag:
        rules.append(F.regexp_extract(t, r"(?i)<answer>\s*([A-D])", 1))
    rules.append(F.when(F.instr(t, "</think>") > 0, F.regexp_extract(F.substring_index(t, "</think>", -1), r"\b([A-D])\b", 1)))
    return F.upper(F.coalesce(*[F.nullif(r, F.lit("")) for r in rules], F.lit("")))


def thinking(c: Column) -> Column:
    """After the last opening think tag, before the next closing one; without tags the whole text."""
    return trim_all(F.substring_index(F.substring_index(c, "<think>", -1), "</think>", 1))


def gold_letter(c: Column) -> Column:
    """The last letter A to D that stands alone in a gold answer, else the empty text."""
    return F.coalesce(F.try_element_at(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"\b([A-D])\b"), F.lit(1)), F.lit(-1)), F.lit(""))


def is_correct(response: Column, answer: Column) -> Column:
    """Whether a response's answer is the gold answer's letter; no answer is never right."""
    given = extract_answer(response)
    return F.coalesce((given == gold_letter(answer)) & (given != ""), F.lit(False))


def format_flags(c: Column) -> dict[str, Column]:
    """Whether each part stands exactly once, nothing trails, and the order is right."""
    low = F.lower(c)
    n = lambda pattern: F.size(F.regexp_extract_all(c, F.lit(pattern), F.lit(0)))
    flags = {
        "think_once": n(r"(?s)<think>.*?</think>") == 1,
        "expl_once": n(r"(?s)<explanation>.*?</explanation>") == 1,
        "answer_once": n(r"(?i)<answer>\s*[A-D]\s*</answer>") == 1,
        "no_trailing": (F.instr(low, "</answer>") > 0) & (trim_all(F.substring_index(low, "</answer>", -1)) == ""),
    }
    answer = F.when(F.instr(c, "<answer>") > 0, F.instr(c, "<answer>")).otherwise(F.instr(low, "<answer>"))
    at = [F.instr(c, "</think>"), F.instr(c, "<explanation>"), F.instr(c, "</explanation>"), answer, F.instr(low, "</answer>")]
    ordered = flags["think_once"] & flags["expl_once"] & flags["answer_once"]
    for a, b in zip(at, at[1:]):
        ordered = ordered & (a < b)
    return flags | {"ordered": ordered}


def reward_tokens(c: Column) -> Column:
    stop = F.array(*[F.lit(w) for w in STOP_WORDS])
    return F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+"), lambda t: (t != "") & ~F.array_contains(stop, t))


def bracket_verdict(c: Column) -> Column:
    """True if the first bracketed verdict is yes."""
    return F.coalesce(F.regexp_extract(F.lower(c), r"\[(yes|no)\]", 1) == "yes", F.lit(False))


def leading_verdict(c: Column) -> Column:
    low = F.lower(trim_all(F.coalesce(c, F.lit(""))))
    return low.startswith("yes") | low.startswith("true")


def correct_verdict(c: Column) -> Column:
    """``Yes``, ``No`` or ``error`` after "Correct:"; null stays null."""
    return F.when(c.isNotNull(), F.coalesce(F.nullif(F.initcap(F.regexp_extract(c, r"(?i)Correct:\s*(Yes|No)", 1)), F.lit("")), F.lit("error")))


def length_penalty(tokens: Column, soft: int = 550, hard: int = 1500, most: float = 1.0) -> Column:
    return F.when(tokens <= soft, 0.0).when(tokens >= hard, most).otherwise((tokens - soft) * F.lit(most) / (hard - soft))


def correctness_reward(response: Column, answer: Column, tokens: Column | None = None, soft: int = 550, hard: int = 1500) -> Column:
    """1 for a right answer, else -1, less the length penalty; without a tokenizer a word counts as two tokens."""
    n = word_count(response) * 2 if tokens is None else tokens
    return F.when(is_correct(response, answer), 1.0).otherwise(-1.0) - length_penalty(n, soft, hard)


def format_reward(response: Column, each: float = 0.04) -> Column:
    """A fixed sum for each format flag that holds."""
    return sum((F.coalesce(f, F.lit(False)).cast("int") for f in format_flags(response).values()), F.lit(0)) * F.lit(each)


def repetition_factor(tokens: Column, threshold: float = 0.35) -> Column:
    """Lowered for a token with a large share and for long runs of one token; 1 for no tokens."""
    n = F.size(tokens)
    # sorted, so that equal tokens stand together and one pass counts them
    runs = F.struct(F.lit("").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("most"))

    def count(s, t):
        run = F.when(s["last"] == t, s["run"] + 1).otherwise(1)
        return F.struct(t.alias("last"), run.alias("run"), F.greatest(s["most"], run).alias("most"))

    top = F.aggregate(F.array_sort(tokens), runs, count, lambda s: s["most"])
    share = F.greatest(F.lit(0.0), 1 - F.greatest(F.lit(0.0), top / n - threshold) * 3)
    most = F.aggregate(tokens, runs, count, lambda s: s["most"])
    return F.when(n == 0, 1.0).otherwise(F.greatest(F.lit(0.0), share * (1 - F.greatest(F.lit(0), most - 3) * 0.05)))


def truncate_words(c: Column, tokens: int = 550) -> Column:
    """The first tokens / 1.3 words when there are more."""
    cap = int(tokens / 1.3)
    w = words(c)
    return F.when(F.size(w) <= cap, c).otherwise(F.array_join(F.slice(w, 1, cap), " "))


def alignment_reward(response: Column, answer: Column, path_text: Column) -> Column:
    """F1 of path and thinking tokens for right answers in a valid format, less repetition, at most 0.8."""
    valid = F.lit(True)
    for f in format_flags(response).values():
        valid = valid & f
    think = thinking(response)
    path = F.array_distinct(reward_tokens(path_text))
    seen = F.array_distinct(reward_tokens(truncate_words(think)))
    hits = F.size(F.array_intersect(path, seen))
    recall, precision = hits / F.greatest(F.lit(1), F.size(path)), hits / F.greatest(F.lit(1), F.size(seen))
    f1 = F.when(recall + precision > 0, 2 * recall * precision / F.when(recall + precision > 0, recall + precision)).otherwise(0.0)
    base = 0.7 * f1 + F.when(hits >= 2, 0.2).otherwise(0.0)
    open_gate = is_correct(response, answer) & valid & path_text.isNotNull() & (F.size(path) > 0) & (F.size(seen) > 0)
    return F.when(F.coalesce(open_gate, F.lit(False)), F.least(base * repetition_factor(reward_tokens(think)), F.lit(0.8))).otherwise(0.0)


def coverage_reward(thinking_text: Column, path_text: Column) -> Column:
    """Older variant: 0.8 x recall + 0.3 for two hits, less repetition; no format gate."""
    path = F.array_distinct(reward_tokens(path_text))
    seen = F.array_distinct(reward_tokens(thinking_text))
    hits = F.size(F.array_intersect(path, seen))
    return F.when((F.size(path) > 0) & (F.size(seen) > 0), (0.8 * hits / F.greatest(F.lit(1), F.size(path)) + F.when(hits >= 2, 0.3).otherwise(0.0)) * repetition_factor(reward_tokens(thinking_text))).otherwise(0.0)
