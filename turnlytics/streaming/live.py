"""Friction of conversations that are still going on: a stream of messages with state for each conversation.

Whatever a message says by itself (words, push-back, refusal) is worked out by built-in expressions before the state; the state holds, per
conversation, a few numbers and the words of each message, so repeats and attribution cross batches and messages may arrive
in any order.  Conversations are held in buckets, as Spark's cost of a state is far greater than that of a conversation's few messages; each
keeps its own times within its bucket.  Each batch emits the conversations that it changed.  A conversation that has been silent for the horizon leaves the
state; a message that comes for it later is not mixed into a half-known conversation but kept and counted as late.
"""

from __future__ import annotations

import json
import pickle
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from turnlytics.functions import rules as R
from turnlytics.schema import ONE_AND_DONE_CHARS
from turnlytics.sources.chats import utc

STATE = "conversations binary, size bigint"
BUCKETS = 2048
FACTS = (
    "conv_id bigint, kind string, at bigint, n_turns int, has_empty_user_input boolean, repeated_request boolean, correction_followup boolean, assistant_refusal boolean, "
    "one_and_done boolean, responders array<string>, replies array<int>, corrections array<int>, repeats array<int>, late_rows int"
)
CORRECTION, REFUSAL, BLANK = 1, 2, 4
GRACE_MS = 3650 * 86_400_000  # Spark drops what is behind its watermark, so that one stays ten years behind the clock that counts here


def said(messages: DataFrame) -> DataFrame:
    """Of (conv_id, ts, idx, role, content, responder, model): what the state needs, without an exchange."""
    user = F.col("role") == "user"
    bit = lambda when, value: F.when(when, value).otherwise(0)
    flags = bit(user & R.is_correction(F.col("content")), CORRECTION) + bit(~user & R.is_refusal(F.col("content")), REFUSAL) + bit(user & R.is_blank(F.col("content")), BLANK)
    words = F.when(user, F.array_join(R.tokens(F.col("content")), " ")).otherwise("")
    message = F.struct("idx", user.alias("user"), words.alias("words"), flags.alias("flags"), F.coalesce(F.length("content"), F.lit(0)).alias("length"), F.when(~user, F.coalesce(F.nullif("responder", F.lit("")), "model")).alias("responder"))
    return messages.select("conv_id", "ts", F.unix_millis("ts").alias("at"), F.to_json(message, {"ignoreNullFields": "false"}).alias("message"))


def facts(conv_id: int, messages: list[tuple], at: int, threshold: float = R.REPEAT_THRESHOLD, one_turn_chars: int = ONE_AND_DONE_CHARS) -> dict:
    """What a conversation's messages, by place, come to: its flags, and what each responder answers for."""
    turns, last_reply, before, owner = 0, 0, None, None
    out = {"repeated_request": False, "correction_followup": False, "assistant_refusal": False, "has_empty_user_input": False}
    charges: dict[str, list[int]] = {}
    for _, user, words, flags, length, responder in sorted(messages, key=lambda m: m[0]):
        if not user:
            owner, last_reply = (responder if responder is not None else owner), length
            out["assistant_refusal"] |= bool(flags & REFUSAL)
            if responder is not None:
                charges.setdefault(responder, [0, 0, 0])[0] += 1
            continue
        turns += 1
        now = set(words.split())
        repeat = before is not None and bool(now) and bool(before) and len(now & before) / len(now | before) >= threshold
        out["repeated_request"] |= repeat
        out["correction_followup"] |= bool(flags & CORRECTION)
        out["has_empty_user_input"] |= bool(flags & BLANK)
        if owner is not None:
            charge = charges.setdefault(owner, [0, 0, 0])
            charge[1] += bool(flags & CORRECTION)
            charge[2] += repeat
        before = now
    names = sorted(charges)
    return out | {
        "conv_id": conv_id, "kind": "facts", "at": at, "n_turns": turns, "one_and_done": turns == 1 and last_reply < one_turn_chars, "responders": names,
        "replies": [charges[n][0] for n in names], "corrections": [charges[n][1] for n in names], "repeats": [charges[n][2] for n in names], "late_rows": 0,
    }


def packed(held: dict) -> tuple[bytes, int]:
    data = pickle.dumps(held)
    return pa.compress(data, "zstd", asbytes=True), len(data)


def unpacked(data: bytes, size: int) -> dict:
    return pickle.loads(pa.decompress(data, size, "zstd", asbytes=True))


def live_conversations(messages: DataFrame, delay_ms: int = 86_400_000, horizon_ms: int = 7 * 86_400_000, buckets: int = BUCKETS) -> DataFrame:
    """A row per conversation and batch that changed it (kind "facts"), and per conversation whose messages came too late (kind "late").

    The clock is the latest ``ts`` (a timestamp) less ``delay_ms``; it moves between batches.  A conversation leaves the state once the clock is
    ``horizon_ms`` past its last message, and a message that old, of a conversation not in the state, is late.  A message repeated at the same place counts once.
    A task holds one of the ``buckets`` at a time; more of them, once and for all, for more conversations that go on at once.
    """

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        watermark = state.getCurrentWatermarkMs()
        clock = watermark + GRACE_MS if watermark > 0 else 0
        held = unpacked(*state.get) if state.exists else {}
        fresh: dict[int, tuple[list[int], list[str]]] = {}
        for frame in frames:  # new messages of a bucket's conversations
            for conv_id, at, text in zip(frame["conv_id"].tolist(), frame["at"].tolist(), frame["message"].tolist(), strict=True):
                moments, texts = fresh.setdefault(conv_id, ([], []))
                moments.append(at)
                texts.append(text)
        out = []
        for conv_id, (moments, texts) in fresh.items():
            if conv_id not in held and max(moments) + horizon_ms < clock:
                out.append(json.dumps(dict.fromkeys(columns) | {"conv_id": conv_id, "kind": "late", "at": max(moments), "late_rows": len(texts)}))
                continue
            known, first, until = held.get(conv_id, ({}, min(moments), 1))
            for text in texts:
                m = list(json.loads(text).values())
                known.setdefault(m[0], m)
            first = min([*moments, first])
            held[conv_id] = known, first, max(until, max(moments) + horizon_ms - GRACE_MS, watermark + horizon_ms)
            out.append(json.dumps(facts(conv_id, list(known.values()), first)))
        held = {c: v for c, v in held.items() if v[2] >= watermark or c in fresh}
        if held:
            state.update(packed(held))
            state.setTimeoutTimestamp(max(min(until for _, _, until in held.values()), watermark + 1))
        elif state.exists:
            state.remove()
        if out:
            yield pd.DataFrame({"fact": out})

    columns = [c.split()[0] for c in FACTS.split(", ")]
    rows = said(messages).withWatermark("ts", f"{delay_ms + GRACE_MS} milliseconds")
    found = rows.withColumn("bucket", F.pmod(F.xxhash64("conv_id"), F.lit(buckets))).groupBy("bucket").applyInPandasWithState(update, "fact string", STATE, "update", GroupStateTimeout.EventTimeTimeout)
    return found.select(F.from_json("fact", FACTS).alias("fact")).select("fact.*")


def run_live(conversations: DataFrame, path: str, checkpoint: str) -> None:
    """Runs the stream to the end of its source.  A batch writes a folder of its own, which a repeated batch replaces."""

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").partitionBy("kind").parquet(f"{path}/batch={number}")

    conversations.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def latest_conversations(spark, path: str) -> DataFrame:
    """The conversations as the last batch that changed each of them left them."""
    rows = spark.read.schema(f"{FACTS}, batch int").option("basePath", path).parquet(f"{path}/batch=*").where("kind = 'facts'")
    values = [c for c in rows.columns if c not in ("conv_id", "kind", "batch")]
    return rows.groupBy("conv_id").agg(F.max_by(F.struct(*values), "batch").alias("v")).select("conv_id", "v.*").drop("late_rows").withColumn("ts", utc(F.timestamp_millis("at"))).withColumn("week", R.monday(F.col("ts")))


def late_rows(spark, path: str) -> DataFrame:
    """conv_id, rows: messages that came after their conversation had left the state."""
    return spark.read.schema(f"{FACTS}, batch int").option("basePath", path).parquet(f"{path}/batch=*").where("kind = 'late'").groupBy("conv_id").agg(F.sum("late_rows").alias("rows"))
