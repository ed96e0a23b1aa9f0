"""Per-person statistics, leaderboards and pairwise comparison."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parlance.functions import text as tx
from parlance.functions import times as tm
from parlance.model import Profile
from parlance.operators.enrich import spoken, worded
from parlance.operators.mentions import mention_totals
from parlance.operators.ordering import CELL_ROWS, previous_row, top_k
from parlance.session import materialize

# ---- fixed values: leaderboard -> metric ----
LEADERBOARDS = {
    "most_messages": "total_messages",
    "biggest_vocab": "unique_words",
    "most_swears": "swear_count",
    "most_swears_rate": "swear_rate_per_100",
    "most_laughs": "laugh_count",
    "most_laughs_rate": "laugh_rate_per_100",
    "most_questions": "question_count",
    "most_mentions_given": "mentions_given",
    "most_mentions_received": "mentions_received",
    "most_night_owl": "night_owl_pct",
    "most_early_bird": "early_bird_pct",
    "most_double_texting": "double_text_rate_pct",
    "most_conversation_starts": "conversation_starts",
    "longest_avg_messages": "avg_words_per_message",
    "most_shouting": "shout_count",
    "most_exclamations": "exclamation_count",
    "most_emojis": "total_emojis",
    "most_media": "media_sent",
    "most_deleted": "deleted_sent",
    "most_edited": "edited_sent",
}
COMPARED = (
    "total_messages", "unique_words", "avg_words_per_message", "swear_rate_per_100", "laugh_rate_per_100",
    "question_count", "mentions_given", "mentions_received", "night_owl_pct", "early_bird_pct",
    "double_text_rate_pct", "conversation_starts", "peak_hour",
)


def _sum_if(condition, amount=1):
    return F.sum(F.when(condition, amount).otherwise(0)).cast("long")


def person_counts(lexical: DataFrame, profile: Profile, keys=("chat_id",)) -> DataFrame:
    """Counts that add up message by message."""
    return _counts_and_peak(lexical, profile, keys).drop("peak_hour")


def _counts_and_peak(lexical: DataFrame, profile: Profile, keys=("chat_id",)) -> DataFrame:
    """The counts and the busiest hour, the earliest on ties, from one pass. They are summed up on the map side, so a busy person is
    a row for each task, and only plain (person, day) pairs are shuffled for the days."""
    own = F.col("lexical_text")
    real = F.col("is_real_text")
    night, early = profile.night_owl_hours, profile.early_bird_hours
    laughs = tx.laugh_pattern(profile.laugh_words, profile.laugh_regex_patterns, profile.strict_boundaries)
    per_message = {
        "total_messages": F.lit(1),
        "total_text_messages": F.when(real & ~F.col("is_media"), 1),
        "media_sent": F.when(F.col("is_media"), 1),
        "deleted_sent": F.when(F.col("is_deleted"), 1),
        "edited_sent": F.when(F.col("is_edited"), 1),
        "real_texts": F.when(real, 1),
        "real_words": F.when(real, F.col("word_count")),
        "real_chars": F.when(real, F.col("char_count")),
        "swear_count": F.when(real, tx.count_matches(own, tx.word_list_pattern(profile.swear_words))) if profile.swear_words else F.lit(0),
        "laugh_count": F.when(real, tx.count_matches(own, laughs)),
        "question_count": F.when(real & tx.is_question(own, profile.question_starters), 1),
        "shout_count": F.when(real & tx.is_shout(own), 1),
        "exclamation_count": F.when(real, tx.count_char(own, "!")),
        "total_emojis": F.when(real, F.size(tx.emojis(own))),
        "night_messages": F.when(F.col("hour").between(night[0], night[1] - 1), 1),
        "early_messages": F.when(F.col("hour").between(early[0], early[1] - 1), 1),
    }
    sums = [F.sum(F.coalesce(c, F.lit(0)).cast("long")).alias(n) for n, c in per_message.items()]
    at_hour = [F.count_if(F.col("hour") == h).alias(f"_h{h}") for h in range(24)]
    said = spoken(lexical)
    persons = said.groupBy(*keys, "sender").agg(*sums, *at_hour, F.min("ts").alias("first_message"), F.max("ts").alias("last_message"))
    days = said.select(*keys, "sender", "date").distinct().groupBy(*keys, "sender").agg(F.count("*").alias("active_days"))
    # Rows without a sender are somebody too.
    who = [*keys, "sender"]
    same = reduce(and_, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in who))
    persons = persons.join(days.withColumnsRenamed({c: f"_{c}" for c in who}), same).drop(*(f"_{c}" for c in who))
    most = F.array(*[F.col(f"_h{h}") for h in range(24)])
    peak = (F.array_position(most, F.array_max(most)) - 1).cast("int")
    return persons.withColumn("peak_hour", peak).drop(*(f"_h{h}" for h in range(24)))


def vocabulary(lexical: DataFrame, keys=("chat_id",)) -> DataFrame:
    """Words, distinct words and their ratio per person."""
    terms = worded(lexical).select(*keys, "sender", F.explode(tx.tokens(F.col("lexical_text"))).alias("term"))
    uses = terms.groupBy(*keys, "sender", "term").agg(F.count("*").alias("n"))
    sizes = uses.groupBy(*keys, "sender").agg(F.sum("n").alias("total_words"), F.count("*").alias("unique_words"))
    return sizes.withColumn("vocab_richness_pct", 100 * F.col("unique_words") / F.col("total_words"))


def hourly_profile(enriched: DataFrame, keys=("chat_id",)) -> DataFrame:
    """(keys, sender, hour, n) for hours in use."""
    return spoken(enriched).groupBy(*keys, "sender", "hour").agg(F.count("*").alias("n"))


def peak_hours(enriched: DataFrame, keys=("chat_id",)) -> DataFrame:
    """Each person's busiest hour, the earliest on ties."""
    hours = hourly_profile(enriched, keys)
    return hours.groupBy(*keys, "sender").agg(F.max_by("hour", F.struct(F.col("n"), -F.col("hour"))).alias("peak_hour"))


def top_emojis(lexical: DataFrame, keys=("chat_id",), k: int = 5) -> DataFrame:
    """Each person's k most used emoji characters."""
    used = worded(lexical).select(*keys, "sender", F.explode(tx.emojis(F.col("lexical_text"))).alias("emoji"))
    counts = used.groupBy(*keys, "sender", "emoji").agg(F.count("*").alias("n"))
    return top_k(counts, [*keys, "sender"], [F.desc("n"), F.asc("emoji")], k)


def longest_by_person(lexical: DataFrame, keys=("chat_id",)) -> DataFrame:
    """Each person's longest text by words, the earliest on ties."""
    pick = F.struct(F.left("text", F.lit(300)).alias("text"), F.col("word_count").alias("words"), "ts")
    best = worded(lexical).groupBy(*keys, "sender").agg(F.max_by(pick, F.struct(F.col("word_count"), -F.col("seq"))).alias("m"))
    return best.select(*keys, "sender", F.col("m.text").alias("longest_text"),
                       F.col("m.words").alias("longest_words"), F.col("m.ts").alias("longest_ts"))


def turn_taking(enriched: DataFrame, profile: Profile, keys=("chat_id",), cell_rows: int = CELL_ROWS) -> DataFrame:
    """Double texts (the row before is one's own) and conversation starts (after a long gap)."""
    rows = previous_row(spoken(enriched).select(*keys, "seq", "ts", "sender"), ["ts", "sender"], keys, cell_rows)
    gap = tm.epoch_seconds(F.col("ts")) - tm.epoch_seconds(F.col("prev.ts"))
    return rows.groupBy(*keys, "sender").agg(
        _sum_if(F.col("sender") == F.col("prev.sender")).alias("double_texts"),
        _sum_if(gap >= profile.conversation_gap_hours * 3600).alias("conversation_starts"),
    )


def person_rows(lexical: DataFrame, keys=("chat_id",)) -> DataFrame:
    """The columns that participants, mentions and `person_stats` read, worked out and written once."""
    read = ("seq", "ts", "date", "hour", "is_system", "is_real_text", "is_media", "is_deleted", "is_edited", "word_count", "char_count", "analysis_text", "lexical_text")
    return materialize(lexical.select(*keys, "sender", *read, F.left("text", F.lit(300)).alias("text")), "person-rows")


def person_stats(lexical: DataFrame, people: DataFrame, profile: Profile, mentions: DataFrame | None = None,
                 keys=("chat_id",), cell_rows: int = CELL_ROWS) -> DataFrame:
    """One row per participant with every metric. `mentions` is the (src, dst, cnt) edge table. Several parts read the
    rows, so pass rows that are written (`person_rows` writes what is read)."""
    keys = list(keys)
    who = [*keys, "sender"]
    # The joins below ask for keys; asked of every part alike, the parts still share a shuffle.
    lexical = lexical.where(reduce(and_, (F.col(k).isNotNull() for k in keys)))
    totals = lexical.groupBy(*keys).agg((F.datediff(F.to_date(F.max("ts")), F.to_date(F.min("ts"))) + 1).alias("_days"))
    counted = _counts_and_peak(lexical, profile, keys)
    counted = counted.withColumn("_all", F.sum("total_messages").over(Window.partitionBy(*keys)))
    table = people.select(*who, "rank").join(counted, who)
    parts = [vocabulary(lexical, keys), longest_by_person(lexical, keys),
             turn_taking(lexical, profile, keys, cell_rows)]
    if mentions is not None:
        parts.append(mention_totals(mentions, keys))
    for part in parts:
        table = table.join(part, who, "left")
    if mentions is None:
        table = table.withColumns({"mentions_given": F.lit(0), "mentions_received": F.lit(0)})
    counts = ("total_words", "unique_words", "double_texts", "conversation_starts", "longest_words",
              "mentions_given", "mentions_received")
    table = table.join(totals, keys).withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in counts})
    n = F.col("total_messages")
    return table.withColumns({
        "vocab_richness_pct": F.coalesce("vocab_richness_pct", F.lit(0.0)),
        "pct_of_all_messages": 100 * n / F.col("_all"),
        "avg_messages_per_day_active": n / F.col("active_days"),
        "avg_messages_per_day_overall": n / F.col("_days"),
        "avg_words_per_message": F.coalesce(F.try_divide("real_words", "real_texts"), F.lit(0.0)),
        "avg_chars_per_message": F.coalesce(F.try_divide("real_chars", "real_texts"), F.lit(0.0)),
        "swear_rate_per_100": 100 * F.col("swear_count") / n,
        "laugh_rate_per_100": 100 * F.col("laugh_count") / n,
        "question_rate_per_100": 100 * F.col("question_count") / n,
        "night_owl_pct": 100 * F.col("night_messages") / n,
        "early_bird_pct": 100 * F.col("early_messages") / n,
        "double_text_rate_pct": 100 * F.col("double_texts") / n,
        "peak_hour": F.col("peak_hour").cast("long"),
    }).drop("_all", "_days", "real_texts", "real_words", "real_chars", "night_messages", "early_messages", "double_texts")


def leaderboards(stats: DataFrame, keys=("chat_id",)) -> DataFrame:
    """Twenty rankings, full order, participant order on ties."""
    keys = list(keys)
    boards = [F.struct(F.lit(b).alias("board"), F.col(m).cast("double").alias("value")) for b, m in LEADERBOARDS.items()]
    long = stats.select(*keys, "sender", "rank", F.inline(F.array(*boards)))
    order = Window.partitionBy(*keys, "board").orderBy(F.desc("value"), F.asc("rank"))
    return long.withColumn("place", F.row_number().over(order).cast("long")).drop("rank")


def compare(stats: DataFrame, a: str, b: str, keys=("chat_id",)) -> DataFrame:
    """Two people side by side, one row per metric."""
    keys = list(keys)
    metrics = [F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in COMPARED]
    long = stats.where(F.col("sender").isin(a, b)).select(*keys, "sender", F.inline(F.array(*metrics)))
    both = long.groupBy(*keys, "metric").agg(
        F.max(F.when(F.col("sender") == a, F.col("value"))).alias("a"),
        F.max(F.when(F.col("sender") == b, F.col("value"))).alias("b"),
    )
    return both.where(F.col("a").isNotNull() & F.col("b").isNotNull())
