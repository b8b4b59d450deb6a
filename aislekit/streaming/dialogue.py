"""Dialogues as streams: every question gets the messages of its conversation so far."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from aislekit.operators.chat import messages_after

#: How late a turn may come, and after what time without turns a conversation is forgotten.
LATE, IDLE_MS = "10 minutes", 24 * 3600 * 1000
_PAST = "array<struct<role: string, content: string>>"
_STATE = "turns array<bigint>, roles array<string>, texts array<string>"


def stream_messages(turns: DataFrame, system_prompt: str, late: str = LATE, idle_ms: int = IDLE_MS) -> DataFrame:
    """(conv_id, turn, query, messages) for every question of a stream of turns.

    Turns have conv_id, turn (their order), role, text, `at` (event time), `asks` (whether the row is a question that
    wants messages) and product_context (text or null). A question's messages are the system prompt, the turns of
    its conversation with a lower number, of users and assistants and with content, that have arrived, and the
    question; see `assemble_messages`, which gives the same from whole tables. Questions are turns too.

    State is keyed by conversation and kept across restarts. A turn that comes after a question with a higher number was
    answered counts for later questions alone. One later than the watermark (`late`) is dropped. A conversation
    without a turn for `idle_ms` of event time is forgotten; what comes after that begins anew. A turn number that
    comes again replaces the turn. A null conv_id is a conversation like others.
    """
    kind = turns.schema["conv_id"].dataType.simpleString()
    rows = turns.withWatermark("at", late).select(
        "conv_id", F.col("turn").cast("bigint").alias("turn"), "role", "text", F.coalesce("asks", F.lit(False)).alias("asks"), "product_context", "at")
    answered = rows.groupBy("conv_id").applyInPandasWithState(
        _continued(idle_ms), f"conv_id {kind}, turn bigint, query string, product_context string, past {_PAST}", _STATE, "append",
        GroupStateTimeout.EventTimeTimeout)
    return answered.select("conv_id", "turn", "query", messages_after(F.col("past"), system_prompt).alias("messages"))


def _continued(idle_ms: int):
    """A conversation's new turns, met by its state; only this one's turns are in memory."""
    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        known = dict(zip(state.get[0], zip(*state.get[1:]))) if state.exists else {}
        new = pd.concat(list(parts)).sort_values("turn", kind="stable")
        out = []
        for row in new.itertuples():
            if row.asks:
                past = [{"role": role, "content": text} for turn, (role, text) in sorted(known.items()) if turn < row.turn]
                context = None if pd.isna(row.product_context) else row.product_context
                out.append((key[0], row.turn, row.text, context, past))
            if row.role in ("user", "assistant") and isinstance(row.text, str) and row.text:
                known[row.turn] = row.role, row.text
        turns = sorted(known)
        state.update((turns, [known[t][0] for t in turns], [known[t][1] for t in turns]))
        latest = int(new["at"].max().timestamp() * 1000)
        state.setTimeoutTimestamp(max(latest, state.getCurrentWatermarkMs()) + idle_ms)
        if out:
            yield pd.DataFrame(out, columns=["conv_id", "turn", "query", "product_context", "past"])

    return run
