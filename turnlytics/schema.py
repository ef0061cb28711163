"""Schemas that the stages share, as DDL text, which Spark takes wherever it takes a schema."""

from __future__ import annotations

CONVERSATIONS = (
    "conv_id BIGINT NOT NULL, model STRING, ts TIMESTAMP_NTZ, date DATE, week DATE, country STRING, state STRING, language STRING, n_turns INT, "
    "pseudo_user STRING, redacted BOOLEAN, has_empty_user_input BOOLEAN, prompt_tokens BIGINT, completion_tokens BIGINT, first_user_len INT, last_assistant_len INT, "
    "repeated_request BOOLEAN, correction_followup BOOLEAN, assistant_refusal BOOLEAN, one_and_done BOOLEAN, intent_text STRING, shard STRING"
)
TURNS = (
    "conv_id BIGINT NOT NULL, idx INT, role STRING, attributed_to STRING, language STRING, content_len INT, is_empty BOOLEAN, redacted BOOLEAN, "
    "repeats_prev_user BOOLEAN, is_correction BOOLEAN, is_refusal BOOLEAN, shard STRING"
)
INTENT = ("conv_id BIGINT NOT NULL, intent STRING, proba_max FLOAT, shard STRING")
LABELS = ("conv_id BIGINT, intent STRING, confidence STRING")

_HEADER = "header STRUCT<`accept-language`: STRING, `user-agent`: STRING>"
_USAGE = "usage: STRUCT<prompt_tokens: BIGINT, completion_tokens: BIGINT, total_tokens: BIGINT>"


def raw_shard(with_usage: bool = True) -> str:
    """One row per conversation with nested messages; older shards have no token usage."""
    message = (
        "content: STRING, role: STRING, turn_identifier: BIGINT, hashed_ip: STRING, country: STRING, state: STRING, language: STRING, toxic: BOOLEAN, "
        f"redacted: BOOLEAN, timestamp: TIMESTAMP_NTZ, {_HEADER.replace('header ', 'header: ')}" + (f", {_USAGE}" if with_usage else "")
    )
    return (
        "conversation_hash STRING, model STRING, timestamp TIMESTAMP_NTZ, turn BIGINT, language STRING, toxic BOOLEAN, redacted BOOLEAN, state STRING, "
        f"country STRING, hashed_ip STRING, {_HEADER}, conversation ARRAY<STRUCT<{message}>>"
    )


#: The contract between sources and turn operators: one row per message.
MESSAGES = ("conv_id BIGINT, idx INT, role STRING, content STRING, responder STRING")
ONE_AND_DONE_CHARS = 200
INTENT_TEXT_CHARS = 2000
