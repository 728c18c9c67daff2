"""Question-answer records: parsing, structural filters, training messages, prompts, completions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandworks.functions import text as T
from strandworks.runtime import trim_all

#: Tags that a generated question needs; its explanation and answer come from elsewhere.
TAGS = ("Question", "Options")


def fields(qae: Column) -> dict[str, Column]:
    """Trimmed question, options, explanation and answer; the answer needs its tag with a colon."""
    question = F.when(F.instr(qae, "<Question>:") > 0, T.between(qae, "<Question>:", "</Question>")).otherwise(T.between(qae, "<Question>", "</Question>"))
    return {
        "question": trim_all(question),
        "options": trim_all(T.between(qae, "<Options>", "</Options>")),
        "explanation": trim_all(T.between(qae, "<Explanation>", "</Explanation>")),
        "answer": trim_all(T.between(qae, "<Answer>:", "</Answer>")),
    }


def messages(qae: Column, fallback: Column) -> Column:
    """User and assistant turns; records without explanation or answer tag get the fallback text."""
    f = fields(qae)
    whole = (F.instr(qae, "<Explanation>") > 0) & (F.instr(qae, "<Answer>:") > 0)
    user = F.concat(f["question"], F.lit("\nOptions:"), f["options"])
    reply = F.concat(F.lit("<think>\n"), f["explanation"], F.lit("\n</think>\nFinal Answer: "), f["answer"])
    turn = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    return F.when(F.coalesce(whole, F.lit(False)), F.array(turn("user", user), turn("assistant", reply))).otherwise(F.array(turn("user", F.lit("Answer the following question:")), turn("assistant", F.coalesce(fallback, F.lit("")))))


def rl_prompt(qae: Column, thinking: bool) -> Column:
    return F.concat(T.question_only(qae), F.lit(" /think" if thinking else " /no_think"))


def rl_answer(qae: Column) -> Column:
    return F.upper(F.regexp_extract(qae, r"<Answer>\s*:?\s*([A-D])", 1))


def chat(system: str, question: Column, trace: Column, answer: Column) -> Column:
    """One training text with system, user and assistant parts; missing fields are empty."""
    e = lambda c: F.coalesce(c, F.lit(""))
    return F.concat(F.lit(f"<|system|>\n{system}\n<|user|>\n"), e(question), F.lit("\n<|assistant|>\n<think>\n"), e(trace), F.lit("\n</think>\n"), e(answer))


def option_lines(qae: Column) -> Column:
    """The bodies of the lines that begin with a letter A to D and a dot."""
    lines = F.filter(F.split(qae, "\n"), lambda x: F.trim(x).rlike(r"^[A-D]\."))
    return F.transform(lines, lambda x: trim_all(F.substring(F.trim(x), F.lit(3), F.length(x))))


def well_formed(qae: Column, tags: tuple[str, ...] = TAGS) -> Column:
    """All tags there, options A to D named, no option body empty or under three ASCII characters."""
    ok = F.lit(True)
    for t in tags:
        ok = ok & F.contains(qae, F.lit(f"<{t}>")) & F.contains(qae, F.lit(f"</{t}>"))
    for letter in "ABCD":
        ok = ok & F.contains(qae, F.lit(f"{letter}."))
    short = F.exists(option_lines(qae), lambda b: (b == "") | ((F.length(b) < 3) & b.rlike(r"^[\x00-\x7f]*$")))
    return F.coalesce(ok & ~short, F.lit(False))


def trace_in_range(c: Column, least: int = 100, most: int = 350) -> Column:
    return T.word_count(c).between(least, most)


def kept_by_length(qae: Column, least: int = 100, most: int = 350) -> Column:
    """True for explanations within the range and for records without the block."""
    block = F.regexp_extract(qae, r"(?s)<Explanation>(.*?)</Explanation>", 1)
    return ~qae.rlike(r"(?s)<Explanation>.*?</Explanation>") | trace_in_range(block, least, most)


def split_by_length(df: DataFrame, qae: str, least: int = 100, most: int = 350) -> tuple[DataFrame, DataFrame]:
    """Records kept by their length, and one row with the numbers of kept and removed ones."""
    kept = F.coalesce(kept_by_length(F.col(qae), least, most), F.lit(False))
    return df.filter(kept), df.agg(F.count_if(kept).alias("kept"), F.count_if(~kept).alias("removed"))


def distinct_options(df: DataFrame, qae: str, factory, batch: int = 64) -> DataFrame:
    """Well-formed questions whose options a judge does not call near duplicates: only an exact no rejects, no reply too."""
    from strandworks.functions.scoring import score

    prompt = F.concat(F.lit("Are the answer options of this multiple choice question sufficiently distinct? Respond with Yes or No only.\n"), F.col(qae))
    t = score(df.filter(well_formed(F.col(qae))).withColumn("_p", prompt), "_p", "_v", factory, batch)
    return t.filter(F.col("_v").isNotNull() & (F.lower(trim_all(F.col("_v"))) != "no")).drop("_p", "_v")


def fact_prompt(head: Column, relation: Column, tail: Column) -> Column:
    """Prompt that asks for a verdict on a triple."""
    return F.concat(F.lit("Is this true? "), F.concat_ws(" | ", head, relation, tail), F.lit(" Answer Yes or No."))


def tails_prompt(head: Column, relation: Column, text: Column, most_tails: int = 10, most_chars: int = 4000) -> Column:
    """Prompt that asks for the tails of a head and relation in a text, clipped in the middle."""
    return F.concat(F.lit("HEAD: "), head, F.lit("\nRELATION: "), relation, F.lit(f"\nTAILS_MAX: {most_tails}\nTEXT:\n"), T.clip_middle(text, most_chars), F.lit("\n\nReturn ONLY the JSON object."))


def shorter_trace(first: Column, retry: Column, most: int = 350) -> Column:
    """The retry replaces a trace above the limit if it is shorter."""
    return F.when((T.word_count(first) > most) & retry.isNotNull() & (T.word_count(retry) < T.word_count(first)), retry).otherwise(first)


def combine(question: Column, explanation: Column, answer: Column) -> Column:
    return F.concat(question, F.lit("\n<Explanation>"), explanation, F.lit("</Explanation>\n<Answer>: "), answer, F.lit("</Answer>"))


def separated(df: DataFrame, qae: str) -> DataFrame:
    """Records with both answer tags, with the part before them and the answer's letter."""
    c = F.col(qae)
    t = df.filter(F.contains(c, F.lit("<Answer>")) & F.contains(c, F.lit("</Answer>")))
    return t.withColumns({"question_part": trim_all(F.substring_index(c, "<Answer>", 1)), "answer": T.gold_answer(c)})


def distinct_paths(df: DataFrame, paths: str, key: str) -> DataFrame:
    """``(key, n)``: the first row of every distinct path and the number of its rows."""
    return df.groupBy(paths).agg(F.min(key).alias(key), F.count(F.lit(1)).alias("n")).select(key, "n")


def path_text(paths: Column, arrow: bool = True) -> Column:
    """Steps as text: with arrows, or as (start, relation, end) list."""
    if arrow:
        return F.array_join(F.transform(paths, lambda s: F.concat(s["start"], F.lit(" --"), s["relation"], F.lit("--> "), s["end"])), "; ")
    return F.array_join(F.transform(paths, lambda s: F.concat(F.lit("("), s["start"], F.lit(", "), s["relation"], F.lit(", "), s["end"], F.lit(")"))), ", ")


def meaningful(paths: Column, verdict: Column) -> Column:
    """Valid, Invalid or Skip; paths of at most two steps are valid unasked."""
    low = F.lower(trim_all(F.coalesce(verdict, F.lit(""))))
    return F.when(F.size(paths) <= 2, "Valid").when(low.startswith("valid"), "Valid").when(low.startswith("invalid"), "Invalid").otherwise("Skip")


def validation_prompt(df: DataFrame) -> Column:
    """Prompt for a judge; older column names stand in for missing ones."""
    have = set(df.columns)
    pick = lambda *names: F.coalesce(*[F.col(n) for n in names if n in have], F.lit(""))
    return F.concat(F.lit("Path: "), pick("path_string", "context_path"), F.lit("\nQuestion: "), pick("question"), F.lit("\nAnswer: "), pick("answer"), F.lit("\nExplanation: "), pick("explanation", "thinking_trace"))


def long_paths(df: DataFrame, k: int) -> Column:
    """Wide columns head_i, relation_i, tail_i as steps; they stop at the first gap, at most k + 1."""
    have = set(df.columns)
    steps = []
    for i in range(1, k + 2):
        if {f"head_{i}", f"relation_{i}", f"tail_{i}"} <= have:
            steps.append(F.struct(F.col(f"head_{i}").alias("start"), F.col(f"relation_{i}").alias("relation"), F.col(f"tail_{i}").alias("end")))
    if not steps:
        return F.array().cast("array<struct<start:string,relation:string,end:string>>")
    a = F.array(*steps)
    gap = lambda s: s["start"].isNull() | s["relation"].isNull() | s["end"].isNull() | (s["start"] == "")
    holes = F.filter(F.transform(a, lambda s, i: F.when(gap(s), i)), lambda i: i.isNotNull())
    return F.slice(a, F.lit(1), F.coalesce(F.try_element_at(holes, F.lit(1)), F.lit(len(steps))))


def completions(items: DataFrame) -> DataFrame:
    """Completions built of items, with defects by item number modulo six."""
    f = fields(F.col("question_and_explanation"))
    d = F.col("item_id") % 6
    body = F.concat(F.lit("<think>"), f["question"], F.lit(" "), f["explanation"], F.lit("</think>\n<explanation>"), f["explanation"], F.lit("</explanation>\n"))
    good = F.concat(body, F.lit("<answer>"), f["answer"], F.lit("</answer>"))
    c = (
        F.when(d == 0, good)
        .when(d == 1, F.concat(good, F.lit("\nThat is all.")))
        .when(d == 2, F.concat(F.lit("<think>first</think>"), good))
        .when(d == 3, F.concat(body, F.lit("**Final Answer:** "), F.lower(f["answer"])))
        .when(d == 4, F.concat(F.lit("<think>"), f["explanation"], F.lit("</think> The letter "), f["answer"], F.lit(" fits.")))
        .otherwise(F.concat(body, F.lit("<Answer>"), f["answer"], F.lit("</Answer>")))
    )
    return items.select("item_id", c.alias("completion"), f["answer"].alias("answer"), F.col("paths"))
