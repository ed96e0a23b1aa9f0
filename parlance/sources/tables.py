"""Other sources: message tables, baseline corpora, stored segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.functions import times as tm
from parlance.model import SEGMENTS
from parlance.operators.ordering import resequence


def from_table(df: DataFrame, ts: str, sender: str, text: str, chat_id: Column | str | None = None,
               order: str | None = None, is_system: Column | None = None) -> DataFrame:
    """Any table with time, sender and text as `messages`. `order` names a unique integer that
    breaks ties within a minute; without it rows of a minute are ordered by a hash of their content,
    in 64 cells a minute."""
    chat = F.lit(0) if chat_id is None else (F.col(chat_id) if isinstance(chat_id, str) else chat_id)
    system = F.col(sender).isNull() if is_system is None else is_system
    rows = df.select(
        chat.cast("long").alias("chat_id"),
        (F.xxhash64(ts, sender, text) if order is None else F.col(order)).cast("long").alias("_order"),
        tm.to_minute(F.col(ts)).alias("ts"),
        F.when(~system, F.col(sender)).alias("sender"), F.col(text).alias("text"), system.alias("is_system"),
    )
    return resequence(rows, "ts", ["_order"], cell=F.shiftright("_order", 58) if order is None else None).select("chat_id", "seq", "ts", "sender", "text", "is_system")


def template_corpus(plain: DataFrame, templates: DataFrame, topics: DataFrame) -> DataFrame:
    """Baseline lines: plain ones, and every template filled with every topic. Both factors are
    hand-written lists."""
    filled = templates.crossJoin(topics).select(F.replace("template", F.lit("{topic}"), F.col("topic")).alias("text"))
    return plain.select("text").unionByName(filled)


# Everyday lines of group chats in neutral words, and the topics that the templates are filled with.
PLAIN_LINES = (
    "good morning everyone", "good night all", "thank you so much", "happy birthday have a great day", "see you tomorrow then",
    "sorry I was asleep", "let me know when you get home", "that is so funny", "I have no idea what happened", "can someone call me please",
    "we are almost there", "what time are we meeting", "I will be a bit late", "did you see the message", "no problem take your time",
)
TEMPLATES = ("what do you all think about {topic}", "I have been busy with {topic} all day", "can we talk about {topic} later",
             "we should plan {topic} for the weekend", "I really like {topic}", "does anyone know something about {topic}")
TOPICS = ("work", "school", "the exam", "dinner", "the trip", "the game", "the movie", "the weather", "the house", "the new phone", "music", "the holidays")


def default_baseline(spark: SparkSession) -> DataFrame:
    """Lines of ordinary talk, the corpus words are held against where the user gives none."""
    lists = [spark.createDataFrame([(x,) for x in xs], f"{name} string") for name, xs in (("text", PLAIN_LINES), ("template", TEMPLATES), ("topic", TOPICS))]
    return template_corpus(*lists)


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """Stored segments, the spikes only."""
    return spark.read.schema(SEGMENTS).json(path).where(F.col("type").isin("arc", "miniarc"))
