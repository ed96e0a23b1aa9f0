"""Message flags, calendar parts, and the filters that choose message populations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.functions import text as tx
from parlance.functions import times as tm
from parlance.operators.ordering import CELL_ROWS, previous_row


def enrich(messages: DataFrame) -> DataFrame:
    """All flags, texts and calendar parts of a message, in projections only. Filters on them are pushed below the projections
    and copy what they read, so each asks once whether a text is marked, and unmarked ones are judged by their first characters."""
    text, marked = F.col("text"), F.col("_marked")
    rows = messages.where(F.col("ts").isNotNull()).withColumns({
        "is_system": F.coalesce("is_system", F.lit(False)), "text": F.coalesce("text", F.lit("")),
    }).withColumn("_marked", tx.may_be_notice(text))
    typed = tx.without_edited_suffix(text)
    deleted, call = tx.is_deleted(typed), tx.is_call(typed)
    flagged = rows.withColumns({
        "is_edited": F.when(marked, tx.is_edited(text)).otherwise(False),
        "text": F.when(marked, typed).otherwise(text),
        "is_media": F.when(marked, tx.is_media(typed)).otherwise(False),
        "is_deleted": F.when(marked, deleted).otherwise(False),
        "is_call": F.when(marked, call).otherwise(False),
        "analysis_text": tx.analysis_text(text, marked, typed),
        "_said": F.when(marked, ~deleted & ~call & (F.length(tx.analysis_text(typed, F.lit(True))) > 0)).otherwise(~tx.is_blank(text)),
    }).drop("_marked")
    real = ~F.col("is_system") & F.col("_said")
    return flagged.withColumns({
        "is_real_text": real,
        "date": F.to_date("ts"),
        "hour": F.hour("ts"),
        "weekday": tm.weekday_name(F.col("ts")),
        "weekday_num": tm.weekday_number(F.col("ts")),
        "month_period": tm.month_period(F.col("ts")),
        "char_count": F.length("analysis_text").cast("long"),
        "word_count": tx.word_count(F.col("analysis_text")),
    }).drop("_said")


def with_lexical(enriched: DataFrame) -> DataFrame:
    """Lexical text and its word count, where no known names have to come out as a whole
    (operators.mentions.without_mentions does that first)."""
    lexical = enriched.withColumn("lexical_text", tx.lexical_text(F.col("analysis_text")))
    return lexical.withColumn("word_count", tx.word_count(F.col("lexical_text")))


def counted(df: DataFrame) -> DataFrame:
    """The population of overall statistics: text, media, deleted or call, and not system."""
    kinds = F.col("is_real_text") | F.col("is_media") | F.col("is_deleted") | F.col("is_call")
    return df.where(kinds & ~F.col("is_system"))


def spoken(df: DataFrame) -> DataFrame:
    """The population of timing and per-person statistics: everything that is not system."""
    return df.where(~F.col("is_system"))


def worded(df: DataFrame) -> DataFrame:
    """The population of word and phrase statistics."""
    return df.where(~F.col("is_system") & F.col("is_real_text"))


def in_range(df: DataFrame, start=None, end=None, people=None) -> DataFrame:
    """Whole days from `start` to `end`, and only these people; system rows stay in any case."""
    if start is not None:
        df = df.where(F.col("ts") >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        df = df.where(F.col("ts") < F.date_add(F.lit(end).cast("date"), 1).cast("timestamp_ntz"))
    if people:
        df = df.where(F.col("is_system") | F.col("sender").isin(list(people)))
    return df


def last_days(df: DataFrame, days: int, keys=("chat_id",)) -> DataFrame:
    """The last `days` calendar days of each chat, counted from its newest row."""
    keys = list(keys)
    ends = df.groupBy(*keys).agg(F.date_sub(F.to_date(F.max("ts")), days - 1).alias("_from"))
    return df.join(ends, keys).where(F.to_date("ts") >= F.col("_from")).drop("_from")


def participants(df: DataFrame, min_messages: int | Column = 1, keys=("chat_id",)) -> DataFrame:
    """(keys, sender, n, rank): senders by message count, ties by name. A chat's sender list is
    what the rank window sorts, never its messages."""
    keys = list(keys)
    counts = spoken(df).groupBy(*keys, "sender").agg(F.count("*").alias("n"))
    ranked = counts.where(F.col("n") >= min_messages)
    order = Window.partitionBy(*keys).orderBy(F.desc("n"), F.asc("sender"))
    return ranked.withColumn("rank", F.row_number().over(order).cast("long"))


def transcript(messages: DataFrame, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Readable rows in chat order: media rows left out, a flag on the first shown message of a
    day, inline markup as tags. System rows never carry the flag."""
    is_media_row = F.lower("text").rlike("|".join(tx.TRANSCRIPT_MEDIA_PARTS))
    said = previous_row(messages.where(~F.col("is_system") & ~is_media_row), ["ts"], cell_rows=cell_rows)
    new_day = F.col("prev").isNull() | (F.to_date("ts") != F.to_date(F.col("prev.ts")))
    events = messages.where(F.col("is_system")).withColumn("day_start", F.lit(False))
    return (
        said.withColumn("day_start", new_day).drop("prev")
        .unionByName(events)
        .select("chat_id", "seq", "ts", "day_start",
                F.date_format(F.to_date("ts"), "dd MMMM yyyy").alias("day"),
                F.format_string("%02d:%02d", F.hour("ts"), F.minute("ts")).alias("time"),
                "sender", tx.chat_markup(F.col("text")).alias("body"))
    )
