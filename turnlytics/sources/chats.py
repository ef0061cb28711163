"""Chat logs of several formats, normalised to: id, user, ts, model, version, messages array<struct<role, content, responder>>."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnlytics.functions import rules as R
from turnlytics.schema import ONE_AND_DONE_CHARS
from turnlytics.sources.order import numbered, placed

# Names under which logs keep the same thing, the first one that is there and not empty counts.
MESSAGE_KEYS = ["conversation", "messages", "turns", "chat", "dialog", "history", "chat_messages"]
ID_KEYS = ["conversation_id", "conv_id", "conversationId", "thread_id", "threadId", "session_id", "sessionId", "id", "conversation_hash", "chat_id"]
USER_KEYS = ["user_id", "userId", "user", "pseudo_user", "customer_id", "account_id", "enduser_id", "visitor_id", "hashed_ip", "distinct_id"]
TIME_KEYS = ["timestamp", "created_at", "createdAt", "time", "date", "ts", "start_time", "started_at"]
MODEL_KEYS = ["model", "model_name", "llm", "engine"]
VERSION_KEYS = ["prompt_version", "app_version", "release", "version", "deployment", "build"]
RESPONDER_KEYS = ["responder", "agent", "agent_name", "assistant_name", "name", "model"]
ROLE_KEYS = ["role", "author", "from", "speaker", "sender", "type"]
CONTENT_KEYS = ["content", "text", "message", "value", "body"]
ORDER_KEYS = ["turn", "idx", "index", "position", "seq", "message_index"]


def _text(value: Column, kind: T.DataType) -> Column:
    """A field as text: parts of a list are joined by line breaks, of objects the text, content or role counts."""
    if isinstance(kind, T.ArrayType):
        return F.array_join(F.transform(value, lambda p: F.coalesce(_text(p, kind.elementType), F.lit(""))), "\n")
    if isinstance(kind, T.StructType):
        found = [_text(value[f.name], f.dataType) for name in ("text", "content", "role") for f in kind.fields if f.name == name]
        return F.coalesce(*found) if found else F.lit(None).cast("string")
    return value.cast("string")


def first_present(names: Sequence[str], fields: T.StructType, of: Column | None = None) -> Column:
    """The first non-empty value among the names that are there, as text."""
    kinds = {f.name: f.dataType for f in fields.fields}
    found = [F.nullif(_text(of[c] if of is not None else F.col(c), kinds[c]), F.lit("")) for c in names if c in kinds]
    return F.coalesce(*found) if found else F.lit(None).cast("string")


def message_struct(x: Column, fields: T.StructType) -> Column:
    return F.struct(R.role_name(first_present(ROLE_KEYS, fields, x)).alias("role"), F.coalesce(first_present(CONTENT_KEYS, fields, x), F.lit("")).alias("content"), first_present(RESPONDER_KEYS, fields, x).alias("responder"))


def keep_spoken(messages: Column) -> Column:
    return F.filter(messages, lambda x: x["role"].isin("user", "assistant"))


def utc(ts: Column) -> Column:
    """A moment as a time without zone, in UTC, whatever the session's zone."""
    return F.convert_timezone(F.current_timezone(), F.lit("UTC"), ts.cast("timestamp_ntz"))


def chat_objects(rows: DataFrame) -> DataFrame:
    """One object per conversation; which names it uses shows from its columns.

    An object without id is a conversation of its own: it is named after its number among all rows, file by file, which is the same
    however the files are packed into tasks; rows are counted only where an object may lack its id.  User and version may stand in the
    first message instead; without a time, the first spoken message that has one gives it; without a model, the
    first reply's responder is the model.
    """
    key = next(k for k in MESSAGE_KEYS if isinstance(getattr(rows.schema[k], "dataType", None) if k in rows.columns else None, T.ArrayType))
    fields = rows.schema[key].dataType.elementType
    first = F.try_element_at(F.col(key), F.lit(1))
    pick = lambda names: first_present(names, rows.schema)
    of_first = lambda names: first_present(names, fields, first)
    known = {f.name for f in rows.schema.fields} & set(ID_KEYS)
    place, number = "__place", "__row"
    if not known or not placed(rows, place).where(pick(ID_KEYS).isNull()).isEmpty():
        rows = numbered(placed(rows, place), number, place)
    else:
        rows = rows.withColumn(number, F.lit(None).cast("long"))
    plain = rows.withColumn("__m", keep_spoken(F.transform(key, lambda x: message_struct(x, fields))))
    timed = F.filter(F.transform(key, lambda x: F.struct(R.role_name(first_present(ROLE_KEYS, fields, x)).alias("role"), R.any_timestamp(first_present(TIME_KEYS, fields, x)).alias("ts"))), lambda x: x["role"].isin("user", "assistant") & x["ts"].isNotNull())
    replier = F.try_element_at(F.filter("__m", lambda x: (x["role"] == "assistant") & x["responder"].isNotNull()), F.lit(1))["responder"]
    return plain.select(
        F.coalesce(pick(ID_KEYS), F.concat(F.lit("row:"), F.col(number))).alias("id"), F.coalesce(pick(USER_KEYS), of_first(USER_KEYS)).alias("user"),
        utc(F.coalesce(R.any_timestamp(pick(TIME_KEYS)), F.try_element_at(timed, F.lit(1))["ts"])).alias("ts"),
        F.coalesce(pick(MODEL_KEYS), replier).alias("model"), F.coalesce(pick(VERSION_KEYS), of_first(VERSION_KEYS)).alias("version"), F.col("__m").alias("messages"),
    )


def read_chat_objects(spark: SparkSession, path: str) -> DataFrame:
    return chat_objects(spark.read.json(path))


def turn_rows(rows: DataFrame, order: Sequence[str] = tuple(ORDER_KEYS), seed: bool = False) -> DataFrame:
    """One row per message.  The first order column with a value puts a conversation's messages in order; messages
    without one, and ties, follow as they arrive: file by file in the order of paths, line by line, whatever tasks read them.

    Only rows that user or assistant spoke count.  User and version are the first that arrive, the model is the first that a reply
    names, time is the earliest.  With ``seed``, the row that arrives first names user, time and model, if it does, whoever spoke it.
    """
    ident, fields = first_present(ID_KEYS, rows.schema), rows.schema
    given = first_present([c for c in order if c in rows.columns], fields)
    arrival = "__arrival"
    rows = placed(rows, arrival)
    number = given.try_cast("double")
    if any(c in rows.columns for c in order) and not rows.where(given.isNotNull() & number.isNull()).isEmpty():
        rows = numbered(rows, "__row", arrival)  # a value that is no number counts as the number of the row
        number = F.coalesce(number, F.col("__row").cast("double"))
    plain = rows.select(
        ident.alias("id"), F.col(arrival).alias("arrival"), F.when(given.isNull(), 0.0).otherwise(number).alias("at"), R.role_name(first_present(ROLE_KEYS, fields)).alias("role"), F.coalesce(first_present(CONTENT_KEYS, fields), F.lit("")).alias("content"),
        first_present(RESPONDER_KEYS, fields).alias("responder"), first_present(USER_KEYS, fields).alias("user"), R.any_timestamp(first_present(TIME_KEYS, fields)).alias("ts"), first_present(MODEL_KEYS, fields).alias("model"), first_present(VERSION_KEYS, fields).alias("version"),
    )
    spoke, replied = F.col("role").isin("user", "assistant"), F.col("role") == "assistant"
    first = lambda c, when: F.min_by(F.when(when, F.col(c)), F.when(when & F.col(c).isNotNull(), F.col("arrival")))
    opening = lambda c: F.min_by(c, "arrival") if seed else F.lit(None)
    spoken = F.when(spoke, F.struct("at", "arrival", "role", "content", "responder"))
    out = plain.where("id IS NOT NULL").groupBy("id").agg(
        F.coalesce(opening("user"), first("user", spoke)).alias("user"), F.least(opening("ts"), F.min(F.when(spoke, F.col("ts")))).alias("ts") if seed else F.min(F.when(spoke, F.col("ts"))).alias("ts"),
        F.coalesce(opening("model"), first("model", replied)).alias("model"), first("version", spoke).alias("version"), F.array_sort(F.collect_list(spoken)).alias("m"),
    )
    messages = F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"), x["responder"].alias("responder")))
    return out.select("id", "user", utc(F.col("ts")).alias("ts"), "model", "version", messages.alias("messages"))


def read_turn_rows(spark: SparkSession, path: str) -> DataFrame:
    return turn_rows(spark.read.csv(path, header=True, multiLine=True, escape='"', quote='"'))


ATTRIBUTE = "struct<key:string,value:struct<stringValue:string,intValue:string,doubleValue:double,boolValue:boolean>>"
TRACES = f"resourceSpans array<struct<resource:struct<attributes:array<{ATTRIBUTE}>>,scopeSpans:array<struct<spans:array<struct<traceId:string,spanId:string,name:string,startTimeUnixNano:string,attributes:array<{ATTRIBUTE}>>>>>>>"


def _attribute_map(column: str) -> Column:
    value = lambda v: F.coalesce(v["stringValue"], v["intValue"], v["doubleValue"].cast("string"), v["boolValue"].cast("string"))
    return F.map_from_entries(F.transform(F.coalesce(F.col(column), F.array()), lambda a: F.struct(a["key"], value(a["value"]))))


def traces(rows: DataFrame) -> DataFrame:
    """GenAI spans: one trace is one conversation; a span brings its input messages' last user text and its reply.

    Calls within one turn repeat the user's text, so a user text equal to the one before it in the trace counts once.
    """
    spans = rows.select(F.explode("resourceSpans").alias("r")).select(_attribute_map("r.resource.attributes").alias("resource"), F.explode("r.scopeSpans").alias("s")).select("resource", F.explode("s.spans").alias("span"))
    spans = spans.select("resource", "span.traceId", "span.spanId", F.col("span.startTimeUnixNano").cast("decimal(20,0)").alias("nanos"), _attribute_map("span.attributes").alias("a"))
    spans = spans.where(F.exists(F.map_keys("a"), lambda k: k.startswith("gen_ai.")))
    message = "array<struct<role:string,content:string>>"
    asked = F.filter(F.from_json(F.col("a")["gen_ai.input.messages"], message), lambda m: m["role"] == "user")
    told = F.from_json(F.col("a")["gen_ai.output.messages"], message)
    spans = spans.select(
        F.col("traceId").alias("id"), F.coalesce(F.col("a")["user.id"], F.col("resource")["user.id"]).alias("user"), "nanos", "spanId", F.col("a")["gen_ai.request.model"].alias("model"), F.col("resource")["service.version"].alias("version"),
        F.try_element_at(asked, F.lit(-1))["content"].alias("asked"), F.try_element_at(told, F.lit(-1))["content"].alias("told"), F.col("a")["gen_ai.agent.name"].alias("responder"),
    )
    line = Window.partitionBy("id").orderBy("nanos", "spanId")
    spans = spans.withColumn("fresh", ~F.coalesce(F.col("asked") == F.lag("asked").over(line), F.lit(False)) & F.col("asked").isNotNull())
    user = F.when(F.col("fresh"), F.struct(F.lit("user").alias("role"), F.col("asked").alias("content"), F.lit(None).cast("string").alias("responder")))
    reply = F.when(F.col("told").isNotNull(), F.struct(F.lit("assistant").alias("role"), F.col("told").alias("content"), F.col("responder")))
    out = spans.groupBy("id").agg(F.max("user").alias("user"), F.min("nanos").alias("nanos"), F.max("model").alias("model"), F.max("version").alias("version"), F.array_sort(F.collect_list(F.struct("nanos", "spanId", user.alias("u"), reply.alias("r")))).alias("m"))
    messages = F.filter(F.flatten(F.transform("m", lambda x: F.array(x["u"], x["r"]))), lambda x: x.isNotNull())
    return out.select("id", "user", utc(F.timestamp_micros((F.col("nanos") / 1000).cast("long"))).alias("ts"), "model", "version", messages.alias("messages"))


def read_traces(spark: SparkSession, path: str) -> DataFrame:
    return traces(spark.read.schema(TRACES).json(path))


NODE = "struct<id:string,parent:string,message:struct<author:struct<role:string>,recipient:string,weight:double,content:struct<content_type:string,parts:array<string>>,metadata:struct<is_visually_hidden_from_conversation:boolean,model_slug:string>>>"
EXPORT = f"conversation_id string, title string, create_time double, current_node string, default_model_slug string, mapping map<string,{NODE}>"


def export_threads(rows: DataFrame) -> DataFrame:
    """Chat exports that keep a tree of messages: the thread that ends in the current node, root first.

    A conversation's tree is in its row, so following parents is a fold within the row: no join per step, no exchange.  A path has
    no more steps than the tree has nodes, so threads of any length come whole and circles end.
    Hidden, tool-directed and non-text nodes are left out.  Branches that the person abandoned are not on the path.
    """
    node = F.col("mapping")
    start = F.struct(F.col("current_node").alias("at"), F.array().cast("array<string>").alias("path"))
    def step(state: Column, _: Column) -> Column:
        here = F.try_element_at(node, state["at"])
        on = state["at"].isNotNull() & here.isNotNull()
        return F.struct(F.when(on, here["parent"]).alias("at"), F.when(on, F.array_append(state["path"], state["at"])).otherwise(state["path"]).alias("path"))

    path = F.reverse(F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(F.map_keys(node)), F.lit(1))), start, step)["path"])
    messages = F.transform(path, lambda k: F.try_element_at(node, k)["message"])
    shown = F.filter(messages, lambda m: m.isNotNull() & ~F.coalesce(m["metadata"]["is_visually_hidden_from_conversation"], F.lit(False)) & (F.coalesce(m["recipient"], F.lit("all")) == "all") & F.coalesce(m["content"]["content_type"] == "text", F.lit(False)))
    plain = F.transform(shown, lambda m: F.struct(R.role_name(m["author"]["role"]).alias("role"), F.array_join(m["content"]["parts"], "\n").alias("content"), m["metadata"]["model_slug"].alias("responder")))
    return rows.select(F.col("conversation_id").alias("id"), F.lit("you").alias("user"), utc(R.epoch_timestamp(F.col("create_time"))).alias("ts"), F.col("default_model_slug").alias("model"), F.lit(None).cast("string").alias("version"), keep_spoken(plain).alias("messages"))


def sender_exports(rows: DataFrame) -> DataFrame:
    """Exports of one person's chats, with senders instead of roles: the user is "you", model and responders are unknown."""
    fields = rows.schema["chat_messages"].dataType.elementType
    plain = F.transform("chat_messages", lambda x: F.struct(R.role_name(x["sender"]).alias("role"), F.coalesce(first_present(CONTENT_KEYS, fields, x), F.lit("")).alias("content"), F.lit(None).cast("string").alias("responder")))
    return rows.select(first_present([*ID_KEYS, "uuid"], rows.schema).alias("id"), F.lit("you").alias("user"), utc(R.any_timestamp(first_present(TIME_KEYS, rows.schema))).alias("ts"), F.lit(None).cast("string").alias("model"), F.lit(None).cast("string").alias("version"), keep_spoken(plain).alias("messages"))


def detect_format(schema: T.StructType) -> str:
    names = set(schema.fieldNames())
    if "resourceSpans" in names:
        return "traces"
    if "mapping" in names:
        return "export"
    if "chat_messages" in names:
        return "senders"
    return "objects" if names & set(MESSAGE_KEYS) else "turns"


def as_messages(chats: DataFrame) -> DataFrame:
    """Message rows, numbered from 1, for the turn operators."""
    rows = chats.select("id", "user", "ts", "model", "version", F.posexplode("messages").alias("pos", "m"))
    return rows.select(F.col("id").alias("conv_id"), "user", "ts", "model", "version", (F.col("pos") + 1).alias("idx"), "m.role", "m.content", "m.responder")


def log_facts(chats: DataFrame, limit: int = ONE_AND_DONE_CHARS) -> DataFrame:
    """A row per conversation: user (each conversation its own person where none is known), turns of the user, what repeats or
    pushes back, and whether it ended after one turn.  All within the row."""
    of = lambda who: F.filter("messages", lambda x: x["role"] == who)
    rows = chats.withColumns({"asked": of("user"), "told": of("assistant")})
    repeated = F.exists(F.sequence(F.lit(2), F.greatest(F.size("asked"), F.lit(2))), lambda i: R.is_repeat(F.try_element_at("asked", i - 1)["content"], F.coalesce(F.try_element_at("asked", i)["content"], F.lit(""))))
    last = F.coalesce(F.length(F.try_element_at("told", F.lit(-1))["content"]), F.lit(0))
    return rows.select(
        "id", F.coalesce(F.nullif("user", F.lit("")), F.concat(F.lit("conv:"), F.col("id"))).alias("user"), "ts", "model", F.nullif("version", F.lit("")).alias("version"), F.size("asked").alias("turns"),
        (repeated & (F.size("asked") > 1)).alias("repeat"), F.exists("asked", lambda x: R.is_correction(x["content"])).alias("correction"), R.one_and_done(F.size("asked"), last, limit).alias("one_turn"),
    )


def coverage(chats: DataFrame, least: float = 0.5) -> DataFrame:
    """One row: shares of conversations with user, time and model, and what cannot be computed below ``least``."""
    share = lambda c: F.avg(F.col(c).isNotNull().cast("int"))
    out = chats.agg(F.count(F.lit(1)).alias("conversations"), share("user").alias("user_coverage"), share("ts").alias("ts_coverage"), share("model").alias("model_coverage"))
    notes = F.concat_ws(",", F.when(F.col("user_coverage") < least, "no_users"), F.when(F.col("ts_coverage") < least, "no_weeks"), F.when(F.col("model_coverage") < least, "no_models"))
    return out.withColumn("notes", notes)


# Writing.


def write_failure_cases(cases: DataFrame, path: str) -> None:
    cases.write.mode("overwrite").json(path)


def write_fix_list(fixes: DataFrame, path: str) -> None:
    """The backlog as CSV: intents by flagged conversations, each with a title."""
    title = F.concat(F.lit("Fewer repeats and corrections in "), "intent", F.lit(" ("), F.round(100 * F.col("rate"), 1).cast("string"), F.lit("% of conversations)"))
    fixes.withColumn("title", title).coalesce(1).sortWithinPartitions("rank").write.mode("overwrite").csv(path, header=True, quoteAll=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)  # a row per intent


def write_backlog(themes: DataFrame, path: str) -> None:
    themes.write.mode("overwrite").csv(path, header=True, quoteAll=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def eval_case_text(cases: DataFrame) -> DataFrame:
    """One evaluation case per failure, as text: the request, what was said against the reply, and a check of the reason."""
    quoted = lambda c: F.to_json(F.struct(F.col(c).alias("x")))
    body = F.concat_ws("\n", F.concat(F.lit("- description: "), F.col("reason")), F.concat(F.lit("  vars: "), quoted("prev_request")), F.concat(F.lit("  not: "), quoted("bad_reply")))
    return cases.select(body.alias("value"))
