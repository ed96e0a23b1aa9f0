"""The search table and the explorer queries over it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.functions import text as tx
from parlance.functions import times as tm


def search_messages(enriched: DataFrame, people: DataFrame, keys=("chat_id",)) -> DataFrame:
    """Participants' text, media and deleted rows: epoch seconds, sender index from 0, one-line
    text, flag 0 text, 1 media (caption only), 2 deleted (blank)."""
    keys = list(keys)
    kinds = F.col("is_real_text") | F.col("is_media") | F.col("is_deleted")
    rows = enriched.where(~F.col("is_system") & kinds).join(people.select(*keys, "sender", "rank"), [*keys, "sender"])
    one_line = lambda c: tx.strip(F.replace(c, F.lit("\n"), F.lit(" ")))
    caption = F.when(F.col("is_real_text"), one_line(F.col("analysis_text"))).otherwise("")
    return rows.select(
        *keys, "seq", "ts", "sender", tm.epoch_seconds(F.col("ts")).alias("epoch"), (F.col("rank") - 1).alias("sender_idx"),
        F.when(F.col("is_media"), caption).when(F.col("is_deleted"), "").otherwise(one_line(F.col("text"))).alias("text"),
        F.when(F.col("is_media"), 1).when(F.col("is_deleted"), 2).otherwise(0).alias("flag"),
    )


def term_matches(search: DataFrame, term: str, variants=(), keys=("chat_id",)) -> DataFrame:
    """Per sender: messages that hold the term or a variant as whole words, and all occurrences."""
    pattern = tx.word_list_pattern([term, *variants])
    hits = search.withColumn("occurrences", tx.count_matches(F.col("text"), pattern)).where(F.col("occurrences") > 0)
    return hits.groupBy(*keys, "sender").agg(
        F.count("*").alias("messages"), F.sum("occurrences").alias("occurrences"),
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
    )


def term_span(search: DataFrame, term: str, variants=(), keys=("chat_id",)) -> DataFrame:
    """Per chat: matching messages, first and latest use, with up to 180 characters for show."""
    hits = search.where(F.col("text").rlike(tx.word_list_pattern([term, *variants])))
    shown = F.struct("ts", "sender", F.left("text", F.lit(180)).alias("text"))
    found = hits.groupBy(*keys).agg(
        F.count("*").alias("messages"), F.min_by(shown, "seq").alias("a"), F.max_by(shown, "seq").alias("z"),
    )
    return found.select(
        *keys, "messages", F.col("a.ts").alias("first_ts"), F.col("a.sender").alias("first_by"), F.col("a.text").alias("first_text"),
        F.col("z.ts").alias("last_ts"), F.col("z.sender").alias("last_by"), F.col("z.text").alias("last_text"),
    )


def date_range(search: DataFrame, start, end, keys=("chat_id",)) -> DataFrame:
    """Per sender in a range of whole days: messages, next to the chat's total, active days and
    average per active day."""
    keys = list(keys)
    day = F.to_date("ts")
    inside = search.where((day >= F.lit(start).cast("date")) & (day <= F.lit(end).cast("date")))
    counts = inside.groupBy(*keys, day.alias("date"), "sender").agg(F.count("*").alias("n"))
    whole = counts.groupBy(*keys, "date").agg(F.sum("n").alias("n")).groupBy(*keys).agg(
        F.sum("n").alias("total"), F.count("*").alias("active_days"))
    per_sender = counts.groupBy(*keys, "sender").agg(F.sum("n").alias("messages"))
    return per_sender.join(whole, keys).withColumn("avg_per_active_day", F.col("total") / F.col("active_days"))
