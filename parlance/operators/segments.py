"""Activity segments: spikes of the smoothed daily curve, and what happened in them.

One aggregation turns messages into daily counts; from there on a chat is as long as its
calendar, which is what the windows and the one fold below run over.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.model import Profile
from parlance.operators.enrich import spoken
from parlance.operators.ordering import top_k
from parlance.session import materialize


def spoken_days(messages: DataFrame, keys=("chat_id",)) -> DataFrame:
    """Messages per calendar day between the first and the last message, zero filled; `idx` counts days."""
    counts = spoken(messages).groupBy(*keys, F.to_date("ts").alias("date")).agg(F.count("*").alias("n"))
    span = counts.groupBy(*keys).agg(F.min("date").alias("_a"), F.max("date").alias("_b"))
    days = span.select(*keys, F.posexplode(F.sequence("_a", "_b")).alias("idx", "date"))
    filled = days.join(counts, [*keys, "date"], "left")
    return filled.select(*keys, "idx", "date", F.coalesce("n", F.lit(0)).alias("n"))


def rolling(days: DataFrame, profile: Profile, keys=("chat_id",)) -> DataFrame:
    """Adds the rolling mean (an even centered window leans back) and the chat's daily mean."""
    w = profile.rolling_window_days
    frame = (-(w // 2), (w - 1) // 2) if profile.rolling_centered else (-(w - 1), 0)
    ordered = Window.partitionBy(*keys).orderBy("idx").rowsBetween(*frame)
    return days.withColumns({"rolling": F.avg("n").over(ordered), "mean": F.avg("n").over(Window.partitionBy(*keys))})


def local_maxima(curve: DataFrame, profile: Profile, keys=("chat_id",)) -> DataFrame:
    """Days that top their neighbourhood and clear the minimum height; plateaus not yet thinned."""
    order = profile.local_max_order_days
    around = Window.partitionBy(*keys).orderBy("idx").rowsBetween(-order, order)
    high = F.col("rolling") >= F.col("mean") * profile.min_peak_multiplier
    return curve.withColumn("_top", F.max("rolling").over(around)).where(high & (F.col("rolling") == F.col("_top"))).drop("_top")


def kept_peaks(maxima: DataFrame, profile: Profile, keys=("chat_id",)) -> DataFrame:
    """Thins plateaus: a peak within the neighbourhood of the last kept one goes. A fold over a
    chat's peak days, of which there are fewer than calendar days."""
    order = profile.local_max_order_days
    found = maxima.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("idx", "rolling"))).alias("_p"))
    none = F.filter("_p", lambda p: F.lit(False))

    def keep(kept, p):
        near = p["idx"] - F.try_element_at(kept, F.lit(-1))["idx"] <= order
        return F.when(near, kept).otherwise(F.concat(kept, F.array(p)))

    kept = F.aggregate("_p", none, keep)
    return found.select(*keys, F.inline(kept)).withColumnRenamed("rolling", "peak_value")


def spike_regions(curve: DataFrame, peaks: DataFrame, profile: Profile, keys=("chat_id",)) -> DataFrame:
    """One region per peak: the stretch around it that stays above the return level."""
    keys = list(keys)
    by_day = Window.partitionBy(*keys).orderBy("idx")
    marked = curve.withColumn("_up", F.col("rolling") > F.col("mean") * profile.return_to_baseline_multiplier)
    place = F.row_number().over(Window.partitionBy(*keys, "_up").orderBy("idx"))
    isle = Window.partitionBy(*keys, "_up", "_isle")
    edged = marked.withColumn("_isle", F.col("idx") - place).withColumns({
        "_from": F.when(F.col("_up"), F.min("idx").over(isle)), "_to": F.when(F.col("_up"), F.max("idx").over(isle)),
    })
    # A peak above the level has its own island; one below it (by settings) reaches into its neighbours'.
    reach = edged.select(
        *keys, "idx", F.coalesce("_from", F.lag("_from").over(by_day), "idx").alias("start_idx"),
        F.coalesce("_to", F.lead("_to").over(by_day), "idx").alias("end_idx"),
    )
    return peaks.join(reach, [*keys, "idx"]).select(*keys, "start_idx", "end_idx", "peak_value")


def merged_regions(regions: DataFrame, profile: Profile, keys=("chat_id",)) -> DataFrame:
    """Overlapping or nearly touching regions as one, with the highest peak."""
    order = Window.partitionBy(*keys).orderBy("start_idx", "end_idx")
    reach = F.max("end_idx").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(F.col("start_idx") - reach <= profile.merge_gap_days, 0).otherwise(1)
    groups = regions.withColumn("_new", fresh).withColumn("_g", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return groups.groupBy(*keys, "_g").agg(
        F.min("start_idx").alias("start_idx"), F.max("end_idx").alias("end_idx"), F.max("peak_value").alias("peak_value"),
    ).drop("_g")


def classified(regions: DataFrame, curve: DataFrame, profile: Profile, keys=("chat_id",)) -> DataFrame:
    """'arc' for high and long regions, 'miniarc' for the others."""
    keys = list(keys)
    means = curve.groupBy(*keys).agg(F.first("mean").alias("mean"))
    is_arc = (F.col("peak_value") >= F.col("mean") * profile.arc_peak_multiplier) & (
        F.col("end_idx") - F.col("start_idx") + 1 >= profile.arc_min_duration_days)
    return regions.join(means, keys).withColumn("type", F.when(is_arc, "arc").otherwise("miniarc")).drop("mean")


def with_fillers(spikes: DataFrame, curve: DataFrame, keys=("chat_id",)) -> DataFrame:
    """Spikes plus 'filler' segments for every stretch of the calendar they leave free."""
    keys = list(keys)
    span = curve.groupBy(*keys).agg(F.max("idx").alias("_last"))
    order = Window.partitionBy(*keys).orderBy("start_idx")
    before = spikes.select(
        *keys, (F.coalesce(F.lag("end_idx").over(order), F.lit(-1)) + 1).alias("start_idx"), (F.col("start_idx") - 1).alias("end_idx"))
    ends = spikes.groupBy(*keys).agg(F.max("end_idx").alias("_end"))
    tail = span.join(ends, keys, "left").select(
        *keys, (F.coalesce("_end", F.lit(-1)) + 1).alias("start_idx"), F.col("_last").alias("end_idx"))
    fillers = before.unionByName(tail).where(F.col("start_idx") <= F.col("end_idx"))
    fillers = fillers.withColumns({"peak_value": F.lit(None).cast("double"), "type": F.lit("filler")})
    return spikes.select(*keys, "start_idx", "end_idx", "peak_value", "type").unionByName(fillers)


def labelled(segments: DataFrame, curve: DataFrame, keys=("chat_id",)) -> DataFrame:
    """Numbers segments within their type and puts real days on them."""
    keys = list(keys)
    start = curve.groupBy(*keys).agg(F.min("date").alias("_day0"))
    number = F.row_number().over(Window.partitionBy(*keys, "type").orderBy("start_idx"))
    seg_no = F.row_number().over(Window.partitionBy(*keys).orderBy("start_idx"))
    title = F.when(F.col("type") == "arc", "Arc").when(F.col("type") == "miniarc", "Mini-arc").otherwise("Filler")
    plain = F.when(F.col("type") == "arc", "arc").when(F.col("type") == "miniarc", "Miniarc")
    return segments.join(start, keys).withColumns({"type_no": number.cast("long"), "seg_no": seg_no.cast("long")}).select(
        *keys, "seg_no", "type", F.concat_ws(" ", title, F.col("type_no").cast("string")).alias("label"),
        F.concat(plain, F.lit("-"), F.col("type_no").cast("string")).alias("default_name"),
        F.date_add("_day0", F.col("start_idx")).alias("start_day"), F.date_add("_day0", F.col("end_idx")).alias("end_day"),
        "peak_value", (F.col("end_idx") - F.col("start_idx") + 1).cast("long").alias("duration_days"),
    )


def detect(messages: DataFrame, profile: Profile, keys=("chat_id",)) -> DataFrame:
    """The whole chain: daily curve, peaks, regions, classes, fillers, labels."""
    curve = materialize(rolling(spoken_days(messages, keys), profile, keys), "curve")
    peaks = kept_peaks(local_maxima(curve, profile, keys), profile, keys)
    regions = merged_regions(spike_regions(curve, peaks, profile, keys), profile, keys)
    return labelled(with_fillers(classified(regions, curve, profile, keys), curve, keys), curve, keys)


def named(segments: DataFrame, names: DataFrame | None = None, keys=("chat_id",)) -> DataFrame:
    """User names and descriptions by label, the default name where there is none."""
    keys = list(keys)
    if names is None:
        own = segments.withColumns({"_n": F.lit(None).cast("string"), "_d": F.lit(None).cast("string")})
    else:
        given = names.select(*keys, "label", F.trim("name").alias("_n"), F.trim("description").alias("_d"))
        own = segments.join(given, [*keys, "label"], "left")
    spike = F.col("type") != "filler"
    return own.withColumns({
        "name": F.when(spike, F.coalesce(F.when(F.col("_n") != "", F.col("_n")), F.col("default_name"))),
        "description": F.when(spike, F.coalesce("_d", F.lit(""))),
    }).drop("_n", "_d", "default_name")


def names_in_order(segments: DataFrame, edited: DataFrame, keys=("chat_id",)) -> DataFrame:
    """Puts the n-th edited (position, name, description) row on the n-th spike of its chat."""
    keys = list(keys)
    spikes = segments.where(F.col("type") != "filler")
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("seg_no")).cast("long")
    return spikes.select(*keys, "label", place.alias("position")).join(edited, [*keys, "position"]).drop("position")


def segment_days(segments: DataFrame, keys=("chat_id",)) -> DataFrame:
    """(keys, date, seg_no): segments tile whole days, so a range join becomes an equi-join."""
    return segments.select(*keys, "seg_no", F.explode(F.sequence("start_day", "end_day")).alias("date"))


def in_segments(messages: DataFrame, segments: DataFrame, keys=("chat_id",)) -> DataFrame:
    """Messages with the number of the segment their day lies in."""
    days = segment_days(segments, keys)
    return messages.withColumn("date", F.to_date("ts")).join(days, [*keys, "date"])


def person_days(messages: DataFrame, keys=("chat_id",)) -> DataFrame:
    """(keys, sender, date, n): what every segment statistic is made of."""
    return spoken(messages).groupBy(*keys, "sender", F.to_date("ts").alias("date")).agg(F.count("*").alias("n"))


def segment_stats(counts: DataFrame, segments: DataFrame, keys=("chat_id",)) -> DataFrame:
    """Messages, average per day and the peak day of each segment, from person-day counts."""
    keys = list(keys)
    daily = _in_segments(counts, segments, keys).groupBy(*keys, "seg_no", "date").agg(F.sum("n").alias("n"))
    stats = daily.groupBy(*keys, "seg_no").agg(
        F.sum("n").alias("n_messages"),
        F.max_by("date", F.struct(F.col("n"), -F.unix_date("date"))).alias("peak_day"),
        F.max("n").alias("peak_day_count"),
    )
    table = segments.join(stats, [*keys, "seg_no"], "left")
    return table.withColumns({
        "n_messages": F.coalesce("n_messages", F.lit(0)),
        "avg_per_day": F.coalesce("n_messages", F.lit(0)) / F.col("duration_days"),
        "peak_day": F.coalesce("peak_day", "start_day"),
        "peak_day_count": F.coalesce("peak_day_count", F.lit(0)),
    })


def _in_segments(counts: DataFrame, segments: DataFrame, keys) -> DataFrame:
    return counts.join(segment_days(segments, keys), [*keys, "date"])


def contributors(counts: DataFrame, segments: DataFrame, profile: Profile, keys=("chat_id",)) -> DataFrame:
    """(keys, seg_no, sender, cnt, place): the most active people of each segment."""
    people = _in_segments(counts, segments, keys).groupBy(*keys, "seg_no", "sender").agg(F.sum("n").alias("cnt"))
    return top_k(people, [*keys, "seg_no"], [F.desc("cnt"), F.asc("sender")], profile.top_n_contributors, "place")


def distinctive_contributors(counts: DataFrame, segments: DataFrame, profile: Profile, keys=("chat_id",)) -> DataFrame:
    """(keys, seg_no, sender, diff, cnt, place): people whose share here most exceeds their share
    in the rest of the chat."""
    keys = list(keys)
    people = _in_segments(counts, segments, keys).groupBy(*keys, "seg_no", "sender").agg(F.sum("n").alias("cnt"))
    here = people.groupBy(*keys, "seg_no").agg(F.sum("cnt").alias("_seg"))
    person = people.groupBy(*keys, "sender").agg(F.sum("cnt").alias("_own"))
    total = people.groupBy(*keys).agg(F.sum("cnt").alias("_all"))
    table = people.join(here, [*keys, "seg_no"]).join(person, [*keys, "sender"]).join(total, keys)
    rest = F.col("_all") - F.col("_seg")
    share_rest = F.when(rest > 0, (F.col("_own") - F.col("cnt")) / rest).otherwise(0.0)
    scored = table.where(F.col("cnt") >= profile.min_messages_for_distinctive).select(
        *keys, "seg_no", "sender", (F.col("cnt") / F.col("_seg") - share_rest).alias("diff"), "cnt")
    return top_k(scored, [*keys, "seg_no"], [F.desc("diff"), F.asc("sender")], profile.top_n_distinctive, "place")


def segment_table(messages: DataFrame, profile: Profile, names: DataFrame | None = None, keys=("chat_id",)) -> DataFrame:
    """Segments end to end, with names, statistics and the two contributor lists."""
    keys = list(keys)
    segments = materialize(named(detect(messages, profile, keys), names, keys), "segments")
    counts = materialize(person_days(messages, keys), "person-days")
    on = [*keys, "seg_no"]

    def listed(people: DataFrame, fields, out: str) -> DataFrame:
        entries = F.array_sort(F.collect_list(F.struct("place", *fields)))
        return people.groupBy(*on).agg(F.transform(entries, lambda e: F.struct(*(e[f].alias(f) for f in fields))).alias(out))

    top = listed(contributors(counts, segments, profile, keys), ["sender", "cnt"], "top_contributors")
    special = listed(distinctive_contributors(counts, segments, profile, keys), ["sender", "diff", "cnt"], "distinctive")
    return segment_stats(counts, segments, keys).join(top, on, "left").join(special, on, "left")


def report_rows(table: DataFrame, keys=("chat_id",)) -> DataFrame:
    """Segments as lines of text."""
    def day(c: str, clock: str) -> Column:
        return F.concat(F.date_format(c, "dd-MMM-yyyy"), F.lit(clock))

    quoted = F.when(F.col("type") != "filler", F.format_string('%s ("%s")', "label", "name")).otherwise(F.col("label"))
    top = F.array_join(F.transform("top_contributors", lambda e: F.format_string("%s (%d)", e["sender"], e["cnt"])), ", ")
    special = F.array_join(F.transform(
        "distinctive", lambda e: F.format_string("%s (+%.1fpp, %d msgs)", e["sender"], e["diff"] * 100, e["cnt"])), ", ")
    return table.select(
        *keys, "seg_no", F.concat(quoted, F.lit(": "), day("start_day", " 00:00"), F.lit(" -> "), day("end_day", " 23:59")).alias("header"),
        F.format_string("%d days", "duration_days").alias("duration"), F.col("n_messages").alias("messages"),
        F.format_string("%.2f", "avg_per_day").alias("avg_per_day"),
        F.format_string("%s (%d messages)", F.date_format("peak_day", "dd-MMM-yyyy"), F.col("peak_day_count")).alias("peak_day"),
        top.alias("top_contributors"), special.alias("distinctive"),
    )
