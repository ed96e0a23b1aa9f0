"""Chat-level statistics: totals, calendars, gaps, streaks, replies.

`daily_counts` is the one pass over messages; what comes after it is calendar-sized. Statistics
on neighbouring rows go through operators.ordering.previous_row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.functions import times as tm
from parlance.operators.enrich import counted, spoken
from parlance.operators.ordering import CELL_ROWS, previous_row, top_k

# ---- fixed values ----
WEEKDAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")


def _sum_if(condition: Column, amount=1) -> Column:
    return F.sum(F.when(condition, amount).otherwise(0)).cast("long")


def daily_counts(enriched: DataFrame, keys=("chat_id",)) -> DataFrame:
    """One row per key and day that has any row: counts by class, words, characters."""
    kinds = F.col("is_real_text") | F.col("is_media") | F.col("is_deleted") | F.col("is_call")
    real = kinds & ~F.col("is_system")
    real_text = real & F.col("is_real_text")
    return enriched.groupBy(*keys, "date").agg(
        _sum_if(real).alias("messages"),
        _sum_if(real_text & ~F.col("is_media")).alias("text_messages"),
        _sum_if(real & F.col("is_media")).alias("media"),
        _sum_if(real & F.col("is_deleted")).alias("deleted"),
        _sum_if(real & F.col("is_call")).alias("calls"),
        _sum_if(real & F.col("is_edited")).alias("edited"),
        _sum_if(F.col("is_system")).alias("system_events"),
        _sum_if(~F.col("is_system")).alias("spoken"),
        _sum_if(real, F.col("word_count")).alias("words"),
        _sum_if(real, F.col("char_count")).alias("chars"),
        _sum_if(real_text).alias("real_texts"),
        _sum_if(real_text, F.col("word_count")).alias("real_text_words"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
    )


def overall(daily: DataFrame, keys=("chat_id",)) -> DataFrame:
    """Totals by class, span, active and silent days, averages. The span takes system rows in."""
    def total(name):
        return F.sum(name).alias(f"total_{name}")

    sums = daily.groupBy(*keys).agg(
        *map(total, ("messages", "text_messages", "media", "deleted", "calls", "edited", "system_events", "words", "chars")),
        F.min("first_ts").alias("first_message_ts"),
        F.max("last_ts").alias("last_message_ts"),
        (F.datediff(F.max("date"), F.min("date")) + 1).cast("long").alias("total_days_spanned"),
        F.count_if(F.col("messages") > 0).alias("active_days"),
        F.sum("real_texts").alias("_texts"),
        F.sum("real_text_words").alias("_text_words"),
    )
    return sums.withColumns({
        "silent_days": F.col("total_days_spanned") - F.col("active_days"),
        "pct_days_active": 100 * F.col("active_days") / F.col("total_days_spanned"),
        "avg_messages_per_day": F.col("total_messages") / F.col("total_days_spanned"),
        "avg_messages_per_active_day": F.try_divide("total_messages", "active_days"),
        "avg_words_per_message": F.try_divide("_text_words", "_texts"),
    }).drop("_texts", "_text_words")


def per_day(daily: DataFrame, keys=("chat_id",)) -> DataFrame:
    """Counted messages per active day."""
    return daily.where(F.col("messages") > 0).select(*keys, "date", F.col("messages").alias("n"))


def extreme_days(daily: DataFrame, keys=("chat_id",), k: int = 3, column: str = "messages", most: bool = True) -> DataFrame:
    """The k busiest (or quietest) active days, the earlier day first on ties."""
    active = daily.where(F.col(column) > 0).select(*keys, "date", F.col(column).alias("n"))
    order = F.desc("n") if most else F.asc("n")
    return top_k(active, keys, [order, F.asc("date")], k)


def media_days(daily: DataFrame, keys=("chat_id",), k: int = 3) -> DataFrame:
    """The k days with the most media."""
    return extreme_days(daily, keys, k, column="media")


def calendar(daily: DataFrame, keys=("chat_id",)) -> DataFrame:
    """Every day from a key's first row to its last."""
    span = daily.groupBy(*keys).agg(F.min("date").alias("_a"), F.max("date").alias("_b"))
    return span.select(*keys, F.explode(F.sequence("_a", "_b")).alias("date"))


def dense_days(daily: DataFrame, keys=("chat_id",), column: str = "messages") -> DataFrame:
    """Counts on every calendar day, zero where nothing was said."""
    filled = calendar(daily, keys).join(daily.select(*keys, "date", F.col(column).alias("n")), [*keys, "date"], "left")
    return filled.withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))


def silent_days(daily: DataFrame, keys=("chat_id",)) -> DataFrame:
    """Calendar days without a counted message."""
    return dense_days(daily, keys).where(F.col("n") == 0).drop("n")


def by_hour(enriched: DataFrame, keys=("chat_id",)) -> DataFrame:
    """Messages per hour of the day, all 24."""
    return _dense(enriched, keys, "hour", F.explode(F.sequence(F.lit(0), F.lit(23))).alias("hour"))


def by_weekday(enriched: DataFrame, keys=("chat_id",)) -> DataFrame:
    """Messages per weekday, Monday first, all seven."""
    rows = _dense(enriched, keys, "weekday_num", F.explode(F.sequence(F.lit(0), F.lit(6))).alias("weekday_num"))
    names = F.array(*map(F.lit, WEEKDAYS))
    return rows.withColumn("weekday", F.get(names, F.col("weekday_num")))


def _dense(enriched: DataFrame, keys, column: str, values: Column) -> DataFrame:
    counts = spoken(enriched).groupBy(*keys, column).agg(F.count("*").alias("n"))
    slots = counts.select(*keys).distinct().select(*keys, values)
    return slots.join(counts, [*keys, column], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def by_month(enriched: DataFrame, keys=("chat_id",)) -> DataFrame:
    return spoken(enriched).groupBy(*keys, "month_period").agg(F.count("*").alias("n"))


def heatmap(enriched: DataFrame, keys=("chat_id",)) -> DataFrame:
    """Weekday by hour, 7 x 24 whatever hours were used; one row per weekday."""
    counts = spoken(enriched).groupBy(*keys, "weekday_num", "hour").agg(F.count("*").alias("n"))
    slots = counts.select(*keys).distinct().select(*keys, F.explode(F.sequence(F.lit(0), F.lit(6))).alias("weekday_num"))
    cells = slots.join(counts, [*keys, "weekday_num"], "left")
    hours = [_sum_if(F.col("hour") == h, F.col("n")).alias(f"h{h:02d}") for h in range(24)]
    return cells.groupBy(*keys, "weekday_num").agg(*hours)


def peaks(enriched: DataFrame, keys=("chat_id",)) -> DataFrame:
    """Peak hour, weekday and month, the first in natural order on ties."""
    def first_max(df, column, order):
        return df.groupBy(*keys).agg(F.max_by(column, F.struct(F.col("n"), -order)).alias(f"peak_{column}"))

    hour = first_max(by_hour(enriched, keys), "hour", F.col("hour"))
    weekday = first_max(by_weekday(enriched, keys), "weekday", F.col("weekday_num"))
    months = by_month(enriched, keys).withColumn("_m", F.replace("month_period", F.lit("-"), F.lit("")).cast("int"))
    month = first_max(months, "month_period", F.col("_m"))
    return hour.join(weekday, list(keys)).join(month, list(keys))


def class_breakdown(overall_df: DataFrame, keys=("chat_id",)) -> DataFrame:
    """Totals by message class, one row each."""
    columns = ["total_text_messages", "total_media", "total_deleted", "total_edited", "total_calls"]
    return overall_df.unpivot(list(keys), columns, "class", "n")


def silences(enriched: DataFrame, keys=("chat_id",), k: int = 3, cell_rows: int = CELL_ROWS) -> DataFrame:
    """The k longest gaps between consecutive rows of any kind, the earlier one first on ties."""
    rows = previous_row(enriched.select(*keys, "seq", "ts"), ["ts"], keys, cell_rows)
    gaps = rows.where(F.col("prev").isNotNull()).select(
        *keys, "seq", F.col("prev.ts").alias("from_ts"), F.col("ts").alias("to_ts"),
        (tm.epoch_seconds(F.col("ts")) - tm.epoch_seconds(F.col("prev.ts"))).alias("seconds"),
    )
    return top_k(gaps, keys, [F.desc("seconds"), F.asc("seq")], k)


def reply_gaps(enriched: DataFrame, keys=("chat_id",), cell_rows: int = CELL_ROWS) -> DataFrame:
    """Gaps above zero between neighbours from different senders."""
    rows = previous_row(counted(enriched).select(*keys, "seq", "ts", "sender"), ["ts", "sender"], keys, cell_rows)
    seconds = tm.epoch_seconds(F.col("ts")) - tm.epoch_seconds(F.col("prev.ts"))
    gaps = rows.select(*keys, "seq", "ts", F.col("prev.sender").alias("from_sender"),
                       F.col("sender").alias("to_sender"), seconds.alias("seconds"))
    return gaps.where((F.col("seconds") > 0) & (F.col("from_sender") != F.col("to_sender")))


def median_reply_gap(gaps: DataFrame, keys=("chat_id",)) -> DataFrame:
    """Exact median reply gap in minutes. Equal gaps are counted first, so that the median sees
    one entry per distinct gap."""
    counts = gaps.groupBy(*keys, "seconds").agg(F.count("*").alias("n"))
    return counts.groupBy(*keys).agg((F.percentile("seconds", F.lit(0.5), F.col("n")) / 60).alias("median_reply_gap_minutes"))


def quickest_replies(gaps: DataFrame, keys=("chat_id",), k: int = 3) -> DataFrame:
    return top_k(gaps, keys, [F.asc("seconds"), F.asc("seq")], k)


def longest_messages(enriched: DataFrame, keys=("chat_id",), k: int = 3) -> DataFrame:
    """The k longest texts by words, cut to 300 characters for show."""
    texts = counted(enriched).where(F.col("is_real_text"))
    cut = texts.select(*keys, "seq", "ts", "sender", F.col("word_count").alias("words"), F.left("text", F.lit(300)).alias("text"))
    return top_k(cut, keys, [F.desc("words"), F.asc("seq")], k)


def streaks(daily: DataFrame, keys=("chat_id",), k: int = 3) -> DataFrame:
    """The k longest runs of consecutive active days, the earlier one first on ties."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("date"))
    islands = per_day(daily, keys).withColumn("_island", F.date_sub("date", place))
    runs = islands.groupBy(*keys, "_island").agg(
        F.count("*").alias("days"), F.min("date").alias("start_day"), F.max("date").alias("end_day"),
    ).drop("_island")
    return top_k(runs, keys, [F.desc("days"), F.asc("start_day")], k)


def trailing_mean(days: DataFrame, keys, width: int = 7, column: str = "n", out: str = "trailing_mean") -> DataFrame:
    """Mean over the row and the width - 1 rows before it, in date order."""
    w = Window.partitionBy(*keys).orderBy("date").rowsBetween(-(width - 1), 0)
    return days.withColumn(out, F.avg(column).over(w))


def active_day_trend(enriched: DataFrame, keys=("chat_id",)) -> DataFrame:
    """Seven-day trailing mean over days with messages only."""
    days = spoken(enriched).groupBy(*keys, "date").agg(F.count("*").alias("n"))
    return trailing_mean(days, keys)


def person_day_trend(enriched: DataFrame, people: DataFrame, keys=("chat_id",)) -> DataFrame:
    """Seven-day trailing mean per person on the chat's whole calendar, zero filled."""
    keys = list(keys)
    span = enriched.groupBy(*keys).agg(F.to_date(F.min("ts")).alias("_a"), F.to_date(F.max("ts")).alias("_b"))
    slots = people.select(*keys, "sender").join(span, keys).select(*keys, "sender", F.explode(F.sequence("_a", "_b")).alias("date"))
    counts = spoken(enriched).groupBy(*keys, "sender", "date").agg(F.count("*").alias("n"))
    filled = slots.join(counts, [*keys, "sender", "date"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return trailing_mean(filled, [*keys, "sender"])
