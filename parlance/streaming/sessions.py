"""Conversations: stretches of a chat without a long silence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.functions import times as tm
from parlance.model import Profile
from parlance.operators.enrich import spoken
from parlance.operators.ordering import CELL_ROWS, previous_row, running_max


def conversations(enriched: DataFrame, profile: Profile, keys=("chat_id",), cell_rows: int = CELL_ROWS) -> DataFrame:
    """(keys, conversation, start_ts, end_ts, messages, people): a row that comes at least the gap
    after the one before starts a new conversation."""
    keys = list(keys)
    rows = previous_row(spoken(enriched).select(*keys, "seq", "ts", "sender"), ["ts"], keys, cell_rows)
    gap = tm.epoch_seconds(F.col("ts")) - tm.epoch_seconds(F.col("prev.ts"))
    starts = F.col("prev").isNull() | (gap >= profile.conversation_gap_hours * 3600)
    marked = rows.withColumn("_a", F.when(starts, F.col("seq"))).drop("prev")
    held = running_max(marked, "_a", "conversation", keys, cell_rows)
    persons = held.groupBy(*keys, "conversation", "sender").agg(F.count("*").alias("_n"), F.min("ts").alias("_s"), F.max("ts").alias("_e"))
    return persons.groupBy(*keys, "conversation").agg(
        F.min("_s").alias("start_ts"), F.max("_e").alias("end_ts"), F.sum("_n").alias("messages"), F.count("*").alias("people"))


def stream_conversations(messages: DataFrame, profile: Profile, lateness: str = "1 hour", keys=("chat_id",)) -> DataFrame:
    """The same on a stream of messages at minute precision. A session window joins rows whose
    distance equals its gap, so the gap is one second short."""
    seconds = profile.conversation_gap_hours * 3600 - 1
    # Event time has to be an instant; the naive time is read in the session's zone and given back.
    timed = messages.where(~F.col("is_system")).withColumn("at", F.col("ts").cast("timestamp"))
    grouped = timed.withWatermark("at", lateness).groupBy(*keys, F.session_window("at", f"{seconds} seconds"))
    return grouped.agg(F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"), F.count("*").alias("messages")).drop("session_window")
