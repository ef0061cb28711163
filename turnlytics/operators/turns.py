"""Turn sequences: who answers for a turn, what repeats or pushes back, and the roll-up to conversations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnlytics.functions import rules as R
from turnlytics.schema import INTENT_TEXT_CHARS, ONE_AND_DONE_CHARS


def before() -> Window:
    """The earlier turns of the same conversation."""
    return Window.partitionBy("conv_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)


def attribute_turns(messages: DataFrame, default: Column) -> DataFrame:
    """Adds prev_user, attributed_to, last_reply and the turn flags.

    A reply belongs to its own responder (``default`` where that is null or empty), a user turn to the responder of the latest
    reply before it.  A user turn is a repeat of the user turn just before it.  All windows share one exchange on conv_id.
    """
    user, reply = F.col("role") == "user", F.col("role") != "user"
    own = F.when(reply, F.coalesce(F.nullif(F.col("responder"), F.lit("")), default))
    last = lambda c: F.last(c, ignorenulls=True).over(before())
    rows = messages.withColumn("own", own)
    rows = rows.withColumns(
        {
            "prev_user": last(F.when(user, F.coalesce("content", F.lit("")))),
            "last_reply": last(F.when(reply, F.coalesce("content", F.lit("")))),
            "attributed_to": F.when(reply, F.col("own")).otherwise(last(F.col("own"))),
            "users_before": F.count_if(user).over(before()),
        }
    ).drop("own")
    return with_flags(rows)


def with_flags(rows: DataFrame) -> DataFrame:
    """Adds content_len, is_empty and the turn flags to rows that have role, content and prev_user."""
    user, reply = F.col("role") == "user", F.col("role") != "user"
    return rows.withColumns(
        {
            "content_len": F.coalesce(F.length("content"), F.lit(0)),
            "is_empty": R.is_blank(F.col("content")),
            "repeats_prev_user": user & R.is_repeat(F.col("prev_user"), F.col("content")),
            "is_correction": user & R.is_correction(F.col("content")),
            "is_refusal": reply & R.is_refusal(F.col("content")),
        }
    )


def roll_up(turns: DataFrame) -> DataFrame:
    """One row per conversation from turn rows; uses the exchange that ``attribute_turns`` made."""
    user = F.col("role") == "user"
    text = F.when(user & (F.col("users_before") < 2), F.struct("idx", "content"))  # two at most
    rows = turns.groupBy("conv_id").agg(
        F.count_if(user).cast("int").alias("n_turns"),
        F.bool_or(user & F.col("is_empty")).alias("has_empty_user_input"),
        F.coalesce(F.min_by(F.when(user, F.col("content_len")), F.when(user, F.col("idx"))), F.lit(0)).alias("first_user_len"),
        F.coalesce(F.max_by(F.when(~user, F.col("content_len")), F.when(~user, F.col("idx"))), F.lit(0)).alias("last_assistant_len"),
        F.bool_or("repeats_prev_user").alias("repeated_request"),
        F.bool_or("is_correction").alias("correction_followup"),
        F.bool_or("is_refusal").alias("assistant_refusal"),
        F.collect_list(text).alias("texts"),
    )
    first_two = F.transform(F.array_sort("texts"), lambda x: F.coalesce(x["content"], F.lit("")))
    return rows.withColumn("intent_text", F.substring(F.array_join(first_two, "\n"), 1, INTENT_TEXT_CHARS)).withColumn("one_and_done", R.one_and_done(F.col("n_turns"), F.col("last_assistant_len"), ONE_AND_DONE_CHARS)).drop("texts")


def first_failures(turns: DataFrame) -> DataFrame:
    """Each conversation's first repeat or correction that follows a reply; a turn that is both counts as a correction."""
    hit = turns.where((F.col("role") == "user") & (F.col("repeats_prev_user") | F.col("is_correction")) & F.col("last_reply").isNotNull())
    case = F.struct(
        "idx", F.when(F.col("is_correction"), "correction").otherwise("repeat").alias("failure"), F.col("last_reply").alias("bad_reply"), F.col("content").alias("user_feedback"),
        F.col("prev_user").alias("prev_request"), "attributed_to",
    )
    return hit.groupBy("conv_id").agg(F.min_by(case, "idx").alias("c")).select("conv_id", "c.*")


def case_context(messages: DataFrame, failures: DataFrame) -> DataFrame:
    """The messages before the failing reply, in order, for each failure."""
    # a merge: files of repeated texts are small, and Spark would take all messages for a table to broadcast
    rows = messages.join(failures.select("conv_id", F.col("idx").alias("failed_at")).hint("merge"), "conv_id").where("idx < failed_at")
    kept = F.array_sort(F.collect_list(F.struct("idx", "role", "content")))
    reply = F.array_max(F.transform(F.filter("m", lambda x: x["role"] != "user"), lambda x: x["idx"]))
    return rows.groupBy("conv_id").agg(kept.alias("m")).select("conv_id", F.filter("m", lambda x: x["idx"] < reply).alias("context"))


def responder_charges(turns: DataFrame) -> DataFrame:
    """A row per reply, and per user turn that reacts to one, charged to the responder."""
    return turns.where("attributed_to IS NOT NULL").select("conv_id", "idx", F.col("attributed_to").alias("responder"), (F.col("role") != "user").alias("reply"), "repeats_prev_user", "is_correction")


# Nested input: a conversation stays in its row, so no exchange is needed.


def nested_roll_up(raw: DataFrame) -> DataFrame:
    """CONVERSATIONS rows from raw shard rows, by higher-order functions only; rows without messages vanish."""
    m = F.col("conversation")
    element = raw.schema["conversation"].dataType.elementType
    users, replies = F.filter(m, lambda x: x["role"] == "user"), F.filter(m, lambda x: x["role"] != "user")
    text = lambda x: F.coalesce(x["content"], F.lit(""))
    usage = {c: F.lit(None).cast("long") for c in ("prompt_tokens", "completion_tokens")}
    if "usage" in element.fieldNames():
        used = F.transform(F.filter(F.col("replies"), lambda x: x["usage"].isNotNull()), lambda x: x["usage"])
        none = F.lit(0).cast("long")
        for c in usage:  # the field of an array of structs is an array
            usage[c] = F.when(F.size(used) > 0, F.aggregate(used[c], none, lambda a, b: a + F.coalesce(b, none)))
    rows = raw.where(F.size("conversation") > 0).withColumns({"users": users, "replies": replies})
    repeated = F.exists(F.sequence(F.lit(2), F.size("users")), lambda i: R.is_repeat(text(F.try_element_at("users", i - 1)), text(F.try_element_at("users", i))))
    first, last = F.try_element_at("users", F.lit(1)), F.try_element_at("replies", F.lit(-1))
    length = lambda x: F.coalesce(F.length(x["content"]), F.lit(0))
    day = F.to_date("timestamp")
    return rows.select(
        F.try_element_at(m, F.lit(1))["turn_identifier"].alias("conv_id"), "model", F.col("timestamp").alias("ts"), day.alias("date"), R.monday(F.col("timestamp")).alias("week"), "country", "state", "language",
        F.col("turn").cast("int").alias("n_turns"),
        R.pseudo_user(F.col("hashed_ip"), F.col("header.user-agent"), F.col("header.accept-language")).alias("pseudo_user"), "redacted",
        F.exists("users", lambda x: R.is_blank(x["content"])).alias("has_empty_user_input"), *(e.alias(c) for c, e in usage.items()),
        F.when(F.size("users") > 0, length(first)).otherwise(0).alias("first_user_len"), F.when(F.size("replies") > 0, length(last)).otherwise(0).alias("last_assistant_len"),
        F.when(F.size("users") > 1, repeated).otherwise(False).alias("repeated_request"),
        F.exists("users", lambda x: R.is_correction(x["content"])).alias("correction_followup"), F.exists("replies", lambda x: R.is_refusal(x["content"])).alias("assistant_refusal"),
        R.one_and_done(F.col("turn"), F.when(F.size("replies") > 0, length(last)).otherwise(0)).alias("one_and_done"),
        F.substring(F.array_join(F.transform(F.slice("users", 1, 2), text), "\n"), 1, INTENT_TEXT_CHARS).alias("intent_text"), F.col("shard") if "shard" in raw.columns else F.lit(None).cast("string").alias("shard"),
    )


def nested_messages(raw: DataFrame, responder: Column | None = None) -> DataFrame:
    """Message rows of raw shard rows, numbered from 1."""
    rows = raw.select(F.try_element_at("conversation", F.lit(1))["turn_identifier"].alias("conv_id"), "model", "shard", F.posexplode("conversation").alias("pos", "m"))
    return rows.select("conv_id", (F.col("pos") + 1).alias("idx"), F.col("m.role").alias("role"), F.col("m.content").alias("content"), (responder if responder is not None else F.lit(None).cast("string")).alias("responder"), "model", "shard", F.col("m.language").alias("language"), F.col("m.redacted").alias("redacted"))


def nested_turns(raw: DataFrame) -> DataFrame:
    """The turns of raw shard rows with attribution and flags, without an exchange: what a turn looks back at stands in its row.

    A conversation's messages are users' or replies, so of the k messages before a turn those of the other kind are k less its
    own kind's, and the latest of either is found by position.  Replies without responder belong to the model.
    """
    turns = _sides(raw).select("conv_id", "model", "shard", F.explode(F.concat(F.expr(_BY_USER), F.expr(_BY_REPLY))).alias("t")).select("conv_id", "model", "shard", "t.*")
    return with_flags(turns)


def nested_failures(raw: DataFrame) -> DataFrame:
    """``first_failures`` of raw shard rows, without an exchange, and ``opening``: the conversation's first user text."""
    case = lambda x: F.struct(
        x["idx"].alias("idx"), F.when(R.is_correction(x["content"]), "correction").otherwise("repeat").alias("failure"), x["last_reply"].alias("bad_reply"), x["content"].alias("user_feedback"),
        x["prev_user"].alias("prev_request"), x["attributed_to"].alias("attributed_to"),
    )
    rows = _sides(raw).select("conv_id", F.try_element_at("users", F.lit(1))["content"].alias("opening"), F.explode(F.transform(_first_hit(), case)).alias("c"))
    return rows.select("conv_id", "c.*", "opening")


def nested_context(raw: DataFrame) -> DataFrame:
    """``case_context`` of raw shard rows, without an exchange: a conversation's failure and its messages stand in its row."""
    rows = _sides(raw).select("conv_id", "m", "replies", F.explode(F.transform(_first_hit(), lambda x: x["idx"])).alias("failed_at"))
    places = F.transform("replies", lambda x: x["m"]["idx"])
    rows = rows.select("conv_id", "m", F.array_max(F.filter(places, lambda i: i < F.col("failed_at"))).alias("reply"))
    message = lambda x: F.struct(x["idx"].alias("idx"), x["role"].alias("role"), x["content"].alias("content"))
    return rows.select("conv_id", F.transform(F.filter("m", lambda x: x["idx"] < F.col("reply")), message).alias("context"))


def _first_hit() -> Column:
    """The first repeat or correction that follows a reply, as an array of one turn at most, on the columns of ``_sides``."""
    hit = lambda x: x["last_reply"].isNotNull() & (R.is_correction(x["content"]) | R.is_repeat(x["prev_user"], x["content"]))
    return F.slice(F.filter(F.expr(_BY_USER), hit), 1, 1)


def nested_responders(raw: DataFrame) -> DataFrame:
    """conv_id, responder: who replied in each conversation of raw shard rows, without an exchange."""
    named = F.filter(F.transform("replies", lambda x: x["own"]), lambda x: x.isNotNull())
    return _sides(raw).select("conv_id", F.explode(F.array_distinct(named)).alias("responder"))


def _sides(raw: DataFrame) -> DataFrame:
    """Each conversation with its users' messages and its replies, both numbered over the whole and in order."""
    responder = "x.responder" if "responder" in raw.schema["conversation"].dataType.elementType.fieldNames() else "cast(NULL as string)"
    rows = raw.where(F.size("conversation") > 0).select(
        F.try_element_at("conversation", F.lit(1))["turn_identifier"].alias("conv_id"), "model", "shard",
        F.expr(f"transform(conversation, (x, i) -> struct(i + 1 AS idx, x.role AS role, x.content AS content, nullif({responder}, '') AS responder, x.language AS language, x.redacted AS redacted))").alias("m"),
    )
    return rows.withColumns({"users": F.filter("m", lambda x: x["role"] == "user"), "replies": F.expr("transform(filter(m, x -> NOT coalesce(x.role = 'user', false)), x -> named_struct('m', x, 'own', coalesce(x.responder, model)))")})


def _text(x: str) -> str:
    return f"if({x} IS NULL, NULL, coalesce({x}.content, ''))"


def _at(what: str, n: str) -> str:
    return f"try_element_at({what}, nullif(greatest({n}, 0), 0))"  # positions count from 1


# The turns of either side, as expressions on the columns of ``_sides``.
_BY_USER = f"""transform(users, (u, k) -> struct(u.idx AS idx, u.role AS role, u.content AS content, u.language AS language, u.redacted AS redacted, {_text(_at("users", "k"))} AS prev_user, {_text(_at("replies", "u.idx - 1 - k") + ".m")} AS last_reply,
        coalesce({_at("replies", "u.idx - 1 - k")}.own, try_element_at(filter(replies, r -> r.m.idx < u.idx AND r.own IS NOT NULL), -1).own) AS attributed_to, k AS users_before))"""
_BY_REPLY = f"""transform(replies, (r, k) -> struct(r.m.idx AS idx, r.m.role AS role, r.m.content AS content, r.m.language AS language, r.m.redacted AS redacted, {_text(_at("users", "r.m.idx - 1 - k"))} AS prev_user, {_text(_at("replies", "k") + ".m")} AS last_reply,
        r.own AS attributed_to, r.m.idx - 1 - k AS users_before))"""
