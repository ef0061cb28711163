"""Why a conversation failed: ordered rules over the reply and the pushback; the first that matches decides."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rules import compile_pattern, jaccard, portable_pattern

# Fixed values: (id, label, reply patterns, pushback patterns). {B} is a word edge, {AP} an optional apostrophe.
REASONS = [
    ("refused", "Refused or dodged", [r"^\s*(?:i{AP}m sorry|i am sorry|sorry,? (?:but )?i{B}|i (?:cannot|can{AP}t|can not) (?:help|assist|provide|do|comply|fulfill|fulfil|generate|create|write|continue|share|give){B}|i{AP}m unable|i am unable|as an ai{B}|i{AP}m not able|i am not able|unfortunately,? i (?:cannot|can{AP}t)|很抱歉|对不起|抱歉|извините|к сожалению,? я не могу)"], []),
    ("broken", "Didn't work", [], [
        "(?:did ?n{AP}t|does ?n{AP}t|do ?n{AP}t|does not|did not|is ?n{AP}t|not) (?:work|run|compile|help|fix|solve)",
        "(?:still|same) (?:error|issue|problem|crash|bug|not|doesn|broken|fail|wrong)",
        "not working",
        "(?:get|got|getting|gives?|giving|throws?|throwing|shows?|showing|returns?|returning|raises?|raising) (?:me )?(?:an? |the |this |that |same )?(?:error|exception|warning)",
        "{B}(?:traceback|exception:|error:|stack ?trace|null ?pointer|syntax ?error|crash(?:es|ed|ing)?){B}",
        "报错|还是不行|运行不了|无法运行|不能用|没用|错误提示|不起作用|не работает|ошибка:|выдает ошибку|все ещ[её]|no funciona|sigue (?:sin|igual|fallando)",
    ]),
    ("incomplete", "Incomplete or cut off", [], [
        r"^\s*(?:continue|go on|keep going|and\??$|next)",
        "(?:you (?:stopped|cut off|didn{AP}t finish|did not finish|forgot|missed|left out))",
        "{B}(?:incomplete|unfinished|cut off|the rest|rest of (?:it|the)|full (?:code|answer|version|text)|complete (?:code|answer|version)|finish (?:it|the)|missing){B}",
        "继续|没写完|不完整|还没完|写完|продолж|допиши|не закончил|continúa|sigue{B}",
    ]),
    ("ignored", "Ignored instructions", [], [
        "(?:i (?:told|asked) you|as i (?:said|asked)|i already (?:said|told|asked)|i said (?:to|not)|follow (?:the|my) instructions?|you ignored|did ?n{AP}t (?:follow|listen|read)|read (?:it |my message )?again|re-?read)",
        "我说了|我让你|我已经说|按照我的要求|я же сказал|я просил|я же просил|ya te dije",
    ]),
    ("language", "Wrong language", [], [
        "(?:in|into|reply in|answer in|write in|respond in|speak) (?:english|chinese|russian|spanish|french|german|arabic|japanese|korean|portuguese|italian|turkish|hindi)",
        "{B}(?:wrong language|translate (?:it|this|that)){B}",
        "用中文|用英文|中文回答|说中文|翻译成|по-русски|на русском|en español",
    ]),
    ("format", "Wrong length or format", [], [
        r"{B}(?:too (?:long|short|wordy|brief|much|detailed)|shorter|longer|more concise|less (?:words|text)|more (?:words|detail)|in \d+ (?:words|sentences|lines|bullet)|word count|bullet(?: point)?s|as a (?:table|list)|in a table|in (?:the|this|that) format|one (?:sentence|paragraph|line)){B}",
        "太长|太短|简短一点|字数|分点|表格|короче|длиннее|más corto|más largo",
    ]),
    ("misunderstood", "Misunderstood the request", [], [
        r"(?:not what i (?:asked|meant|wanted|need)|that{AP}s not (?:it|what)|i meant{B}|i mean{B}|i (?:was )?asking (?:for|about)|i wanted{B}|i need(?:ed)? (?:you to|a|the)|you misunderstood|misunderstood|did ?n{AP}t understand|not asking|^\s*no,? i)",
        "我是说|我的意思|不是这个意思|不是我要的|不是我说的|я имел в виду|не то{B}|не так{B}|no es eso|eso no{B}|ce n{AP}est pas",
    ]),
    ("wrong", "Factually wrong", [], [
        "{B}(?:wrong|incorrect|not (?:right|correct|true|accurate)|inaccurate|mistake|false|that{AP}s not true|actually)",
        "不对|错了|你错|неправильно|неверно|ты ошиб|incorrecto|{B}mal[,.!]|{B}faux{B}|c{AP}est faux",
    ]),
]

# What is left when no rule matches (id, label, kind of failure, least similarity).
FALLBACKS = [("resent", "Sent the same request again", "repeat", 0.9), ("reworded", "Reworded the request", "repeat", 0.0), ("unclear", "Pushed back, reason unclear", "correction", 0.0)]
LONG_REQUEST = 40


def reason_of(failure: Column, bad_reply: Column, feedback: Column, previous: Column) -> Column:
    """The reason's id.  In a repeat, words that already stood in the (long) request before are no complaint.  White space and
    digits are those of Unicode, as in the rules for turns."""
    matches = lambda text, p: text.rlike(compile_pattern(p, "(?iuU)"))
    bare = lambda text: F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
    reply, said, before = (F.coalesce(c, F.lit("")) for c in (bad_reply, feedback, previous))
    resaid = (failure == "repeat") & (before != "") & (F.length(bare(said)) > LONG_REQUEST)
    found = []
    for name, _, replies, feedbacks in REASONS:
        found += [F.when(matches(reply, p), name) for p in replies]
        if feedbacks:
            hits = [matches(said, p) & ~(resaid & matches(before, p)) for p in feedbacks]
            some = hits[0]
            for h in hits[1:]:
                some = some | h
            found.append(F.when(some, name))
    alike = F.when((failure == "repeat") & previous.isNotNull(), jaccard(previous, feedback)).otherwise(F.lit(0.0))
    rest = [F.when((failure == kind) & (alike >= least), name) for name, _, kind, least in FALLBACKS]
    return F.coalesce(*found, *rest, F.lit(FALLBACKS[-1][0]))


def reason_sql(failure: str, bad_reply: str, feedback: str, previous: str, similarity: str) -> str:
    quote = lambda p: "'" + portable_pattern(p).replace("'", "''") + "'"
    resaid = f"({failure} = 'repeat' AND coalesce({previous}, '') <> '' AND length(trim({feedback})) > {LONG_REQUEST})"
    steps = []
    for name, _, replies, feedbacks in REASONS:
        steps += [f"WHEN regexp_matches(coalesce({bad_reply}, ''), {quote(p)}) THEN '{name}'" for p in replies]
        hits = [f"(regexp_matches(coalesce({feedback}, ''), {quote(p)}) AND NOT ({resaid} AND regexp_matches(coalesce({previous}, ''), {quote(p)})))" for p in feedbacks]
        if hits:
            steps.append(f"WHEN {' OR '.join(hits)} THEN '{name}'")
    for name, _, kind, least in FALLBACKS:
        steps.append(f"WHEN {failure} = '{kind}' AND coalesce({similarity}, 0) >= {least} THEN '{name}'")
    return "CASE " + " ".join(steps) + f" ELSE '{FALLBACKS[-1][0]}' END"

