"""Text, time and naming rules as column expressions; nothing here runs Python per row."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

REPEAT_THRESHOLD = 0.6
WORD = r"[\p{L}\p{N}_]+"
EDGE = r"(?:(?<![\p{L}\p{N}_])(?=[\p{L}\p{N}_])|(?<=[\p{L}\p{N}_])(?![\p{L}\p{N}_]))"
APOSTROPHE = "['’]?"

# How a user turn begins that pushes back, and how a reply begins that declines.  {B} is a word edge, {AP} an optional apostrophe.
CORRECTION = r"^\s*(?!no (?:problem|worries|thanks|need))(?:no[,.!]|not (?:what|that)|wrong{B}|that{AP}s (?:not|wrong)|i said{B}|i meant{B}|incorrect{B}|you didn{AP}t{B}|you did not{B}|try again{B}|不对|不是这|不是我(?:要|说)的|错了|нет[,.\s]|неправильно|не то{B}|не так{B}|я сказал|я просил|incorrecto{B}|no es eso|eso no{B}|mal[,.!\s]|non[,.!\s]|ce n{AP}est pas|c{AP}est faux|faux{B})"
REFUSAL = r"^\s*(?:i{AP}m sorry|i am sorry|sorry,? (?:but )?i{B}|i (?:cannot|can{AP}t|can not) (?:help|assist|provide|do|comply|fulfill|fulfil|generate|create|write|continue|share|give){B}|i{AP}m unable|i am unable|as an ai{B}|i{AP}m not able|i am not able|unfortunately,? i (?:cannot|can{AP}t)|很抱歉|对不起|抱歉|извините|к сожалению,? я не могу)"


def compile_pattern(pattern: str, flags: str = "(?iu)") -> str:
    return flags + pattern.replace("{B}", EDGE).replace("{AP}", APOSTROPHE)


def portable_pattern(pattern: str) -> str:
    """Without look-around, for engines that have none: an edge is the text's end or a character that is no part of a word.

    What a pattern excludes at its start goes; no alternative of these patterns begins so.
    """
    pattern = re.sub(r"\(\?!no \(\?:[^()]*\)\)", "", pattern)
    pattern = re.sub(r"(^|\||\()\{B\}", r"\1(?:^|[^\\p{L}\\p{N}_])", pattern)
    return "(?i)" + pattern.replace("{B}", r"(?:$|[^\p{L}\p{N}_])").replace("{AP}", APOSTROPHE)


def tokens(text: Column) -> Column:
    """The distinct words, lower-cased after they were cut out."""
    return F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(rf"({WORD})"), 1), F.lower))


def jaccard(a: Column, b: Column) -> Column:
    # bound by a lambda, so each text is cut into words once however often its words are named
    words = F.array(F.struct(tokens(a).alias("x"), tokens(b).alias("y")))
    both = F.transform(words, lambda w: F.struct(F.size(w["x"]).alias("m"), F.size(w["y"]).alias("n"), F.size(F.array_intersect(w["x"], w["y"])).alias("both")))
    share = F.transform(both, lambda c: F.when((c["m"] > 0) & (c["n"] > 0), c["both"] / (c["m"] + c["n"] - c["both"])).otherwise(F.lit(0.0)))
    return F.try_element_at(share, F.lit(1))


def is_repeat(previous: Column, current: Column, threshold: float = REPEAT_THRESHOLD) -> Column:
    return previous.isNotNull() & (jaccard(previous, current) >= threshold)


def is_correction(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).rlike(compile_pattern(CORRECTION, "(?iuU)"))


def is_refusal(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).rlike(compile_pattern(REFUSAL, "(?iuU)"))


def is_blank(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).rlike(r"(?U)^\s*$")


def pseudo_user(ip: Column, agent: Column, language: Column) -> Column:
    joined = F.concat_ws("|", *(F.coalesce(c, F.lit("")) for c in (ip, agent, language)))
    return F.left(F.sha2(joined, 256), F.lit(16))


#: Release suffixes at a name's end, as many as there are: a date, a four-digit number or "preview".
RELEASE_SUFFIX = r"(-(\d{4}-\d{2}-\d{2}|\d{4}|preview))+$"


def model_family(model: Column) -> Column:
    """The model's name without its release suffixes."""
    return F.regexp_replace(model, RELEASE_SUFFIX, "")


def monday(ts: Column) -> Column:
    return F.to_date(F.date_trunc("week", ts))


def quarter_of(day: Column) -> Column:
    return F.trunc(day, "quarter")


def first_complete_week(day: Column) -> Column:
    return F.next_day(F.date_sub(day, 1), "MON")


def complete_weeks(first_day: Column, last_day: Column) -> tuple[Column, Column]:
    """Mondays of the first and the last week that lie wholly between two days; nulls if there is none."""
    first = first_complete_week(first_day)
    last = F.date_sub(monday(F.date_add(last_day, 1)), 7)
    there = first <= last
    return F.when(there, first), F.when(there, last)


def depth_bucket(turns: Column) -> Column:
    return F.when(turns == 1, "1").when(turns == 2, "2").when(turns <= 5, "3-5").when(turns <= 10, "6-10").otherwise("11+")


def one_and_done(turns: Column, reply_length: Column, limit: int = 200) -> Column:
    return (turns == 1) & (reply_length < limit)


def rate(flag: Column) -> Column:
    return F.avg(flag.cast("int"))


def rounded_rate(flag: Column) -> Column:
    return F.round(rate(flag) + 0.0, 6)


# Names of the two speaking roles; any other role keeps its own name.
USER_NAMES = ["user", "human", "customer", "client", "prompt", "input"]
ASSISTANT_NAMES = ["assistant", "ai", "bot", "gpt", "model", "agent", "completion", "output", "chatbot"]


def role_name(raw: Column) -> Column:
    low = F.nullif(F.lower(raw), F.lit(""))
    return F.when(low.isin(USER_NAMES), "user").when(low.isin(ASSISTANT_NAMES), "assistant").otherwise(low)


def epoch_timestamp(value: Column) -> Column:
    """Seconds, milliseconds, microseconds or nanoseconds since 1970, told apart by magnitude.

    Over 1e11 are milliseconds, over 1e14 microseconds, over 1e17 nanoseconds, so each unit serves for dates from 1973 to 5138.
    """
    v = value.cast("double")
    millis = F.when(v > 1e17, v / 1e6).when(v > 1e14, v / 1e3).when(v > 1e11, v).otherwise(v * 1000)
    return F.timestamp_millis(millis.cast("long"))


def any_timestamp(value: Column) -> Column:
    """A number since 1970 or a text; null where it is neither."""
    text = value.cast("string")
    return F.when(text.rlike(r"^\d+(\.\d+)?$"), epoch_timestamp(F.try_to_number(text, F.lit("9" * 20 + "D" + "9" * 9)))).otherwise(F.try_to_timestamp(text))


def truthy(text: Column) -> Column:
    return F.coalesce(F.trim(text).isin("1", "true", "True", "yes"), F.lit(False))


def example_text(text: Column, length: int = 140) -> Column:
    return F.substring(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " ")), 1, length)


def register_sql(spark) -> None:
    """The rules as SQL functions, for ad-hoc queries; they expand to built-in expressions."""
    correction = compile_pattern(CORRECTION, "(?iuU)").replace("\\", "\\\\").replace("'", "\\'")
    refusal = compile_pattern(REFUSAL, "(?iuU)").replace("\\", "\\\\").replace("'", "\\'")
    suffix = RELEASE_SUFFIX.replace("\\", "\\\\")
    word = WORD.replace("\\", "\\\\")
    words = lambda t: f"array_distinct(transform(regexp_extract_all(coalesce({t}, ''), '({word})', 1), w -> lower(w)))"
    a, b = words("previous"), words("current")
    for text in (
        f"is_correction(t STRING) RETURNS BOOLEAN RETURN coalesce(t, '') RLIKE '{correction}'",
        f"is_refusal(t STRING) RETURNS BOOLEAN RETURN coalesce(t, '') RLIKE '{refusal}'",
        f"is_repeat(previous STRING, current STRING) RETURNS BOOLEAN RETURN previous IS NOT NULL AND size({a}) > 0 AND size({b}) > 0 AND size(array_intersect({a}, {b})) >= {REPEAT_THRESHOLD} * size(array_union({a}, {b}))",
        f"model_family(m STRING) RETURNS STRING RETURN regexp_replace(m, '{suffix}', '')",
        "monday(ts TIMESTAMP) RETURNS DATE RETURN to_date(date_trunc('week', ts))",
        "pseudo_user(ip STRING, agent STRING, lang STRING) RETURNS STRING RETURN left(sha2(concat_ws('|', coalesce(ip, ''), coalesce(agent, ''), coalesce(lang, '')), 256), 16)",
    ):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {text}")
