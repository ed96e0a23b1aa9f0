"""Raw group-chat exports: three message styles and two event styles, parsed in one pass."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.functions import text as tx
from parlance.functions import times as tm
from parlance.sources.lines import put_together, with_entries

# ---- fixed values: line styles ----
DATE = r"[0-9]{1,4}[-/.][0-9]{1,4}[-/.][0-9]{1,4}|[0-9]{1,2}-[A-Za-z]{3,9}-[0-9]{2,4}"
TIME = r"[0-9]{1,2}:[0-9]{2}(?::[0-9]{2})?(?:\s?[APap][Mm])?"
PLAIN = rf"({DATE})\s({TIME})\s"
ANDROID = rf"({DATE}),\s({TIME})\s-\s"
BRACKETED = rf"\[({DATE}),\s({TIME})\]\s"
LINE = rf"(?Us)^(?:{PLAIN}|{ANDROID}|{BRACKETED})(.*)\z"
SENDER_HEAD = r"(?U)^[^:]+:\s"


def classified_lines(lines: DataFrame) -> DataFrame:
    """Lines with their style taken apart: dates, sender, text part, and what kind of line it is."""
    # One match per line: the groups are written out with a separator and split again.
    groups = "\u0001".join(f"${i}" for i in range(1, 8))
    clean = lines.withColumn("value", tx.clean_line(F.col("value")))
    split = clean.withColumn("_out", F.regexp_replace("value", LINE, groups))
    split = split.withColumn("_g", F.when(F.col("_out") != F.col("value"), F.split("_out", "\u0001", 7)))
    g = lambda i: F.get("_g", F.lit(i))
    rest = g(6)
    taken = split.withColumns({
        "is_blank": tx.strip(F.col("value")) == "",
        "style": F.when(g(0) != "", "plain").when(g(2) != "", "android").when(g(4) != "", "bracketed"),
        "date_raw": F.concat(g(0), g(2), g(4)),
        "time_raw": F.concat(g(1), g(3), g(5)),
        "rest": rest,
        "label": F.when(rest.rlike(SENDER_HEAD), F.substring_index(rest, ":", 1)),
    }).drop("_out", "_g")
    is_start = F.col("style").isNotNull() & (F.col("label").isNotNull() | (F.col("style") != "bracketed"))
    speaks = F.col("label").isNotNull() & ~tx.is_system_label(F.col("label"))
    body = F.substr("rest", F.length("label") + 3)
    said = F.when(speaks, body).when(F.col("label").isNotNull(), F.concat_ws(": ", "label", body)).otherwise(F.col("rest"))
    started = taken.withColumn("is_start", F.coalesce(is_start, F.lit(False)))
    return started.withColumns({
        "sender": F.when(F.col("is_start") & speaks, tx.strip(F.col("label"))),
        "part": F.when(F.col("is_start"), tx.strip(said)).when(F.col("is_blank"), "").otherwise(F.col("value")),
        "order_proof": F.when(F.col("is_start"), tm.order_evidence(F.col("date_raw"))),
    })


def parse_export(lines: DataFrame, day_first: bool | None = None) -> DataFrame:
    """(chat_id, file, entry, date, time, dt, sender, msg, unparsed): one row per message or event,
    and one per leading line that is neither, flagged and kept as it is.

    Ambiguous dates are read the way the rest of their file proves; without proof the line
    style decides.
    """
    proof = lambda kind: F.when(F.col("order_proof") == kind, 1).otherwise(0)
    sums = {"day_lines": proof("day"), "month_lines": proof("month"), "open_lines": proof("open")}
    entries = with_entries(classified_lines(lines), sums)
    heads = ["date_raw", "time_raw", "sender", "style", "headless", *sums]
    rows = put_together(entries, heads)
    if day_first is None:
        settled = F.when((F.col("day_lines") > 0) & (F.col("month_lines") == 0), True).when(
            (F.col("month_lines") > 0) & (F.col("day_lines") == 0), False)
        order = F.coalesce(settled, F.col("style") != "plain")
    else:
        order = F.lit(day_first)
    dated = tm.with_clock(tm.with_date(rows, "date_raw", order, "_day"), "time_raw", "_clock")
    return dated.select(
        "chat_id", "file", "entry",
        tm.archive_date(F.col("_day"), F.col("date_raw")).alias("date"),
        tm.archive_time(F.col("_clock"), F.col("time_raw")).alias("time"),
        tm.moment(F.col("_day"), F.col("_clock.h"), F.col("_clock.m")).alias("dt"),
        "sender", F.col("text").alias("msg"), F.col("headless").alias("unparsed"), "n_lines",
    )


def date_order(lines: DataFrame) -> DataFrame:
    """Per file: lines that prove day-first or month-first, open ones, and the verdict (null
    without proof or with contradicting proof)."""
    hits = lambda k: F.count_if(F.col("order_proof") == k)
    counts = classified_lines(lines).groupBy("chat_id", "file").agg(
        hits("day").alias("day_lines"), hits("month").alias("month_lines"), hits("open").alias("open_lines"))
    verdict = F.when((F.col("day_lines") > 0) & (F.col("month_lines") == 0), True).when(
        (F.col("month_lines") > 0) & (F.col("day_lines") == 0), False)
    return counts.withColumn("day_first", verdict)


def quality(parsed: DataFrame) -> DataFrame:
    """Per file: lines, messages, media and unparsed counts, and a warning for a poor match rate."""
    rows = parsed.groupBy("chat_id", "file").agg(
        F.sum("n_lines").alias("filled_lines"), F.count("*").alias("messages"),
        F.count_if(F.col("sender").isNotNull() & tx.is_ingest_media(F.col("msg"))).alias("media"),
        F.count_if("unparsed").alias("unparsed"),
    )
    return rows.withColumn("low_match", F.col("messages") < F.col("filled_lines") * 0.5)
