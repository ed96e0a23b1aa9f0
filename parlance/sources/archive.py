"""Normalized archive text: lines `DD-Mon-YYYY, HH:MM - Sender: text`."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.functions import text as tx
from parlance.functions import times as tm
from parlance.sources.lines import put_together, with_entries

# ---- fixed values: archive line forms ----
BLOCK_LINE = r"(?s)^([0-9]{2}-[A-Za-z]{3}-[0-9]{4}), ([0-9]{2}:[0-9]{2}) - (.*)\z"
DATED_LINE = r"(?s)^[\x{200e}\x{200f}\x{feff}]*([0-9]{1,2}-[A-Za-z]{3}-[0-9]{4}), ([0-9]{1,2}:[0-9]{2}(?::[0-9]{2})?) - (.*)\z"
SYSTEM_TAG = "[SYSTEM]"
UNPARSED_TAG = "[UNPARSED - review this line]"
UNRESOLVED_TAG = "[UNRESOLVED]"
MAX_SENDER = 100


def slot_columns(block_text) -> dict:
    """Date, time and sender of a block's first line, null where it names no sender."""
    head = F.substring_index(block_text, "\n", 1)
    rest = F.regexp_extract(head, BLOCK_LINE, 3)
    fits = rest.rlike(r"(?U)^[^:]+:\s")
    return {
        "slot_date": F.when(fits, F.regexp_extract(head, BLOCK_LINE, 1)),
        "slot_time": F.when(fits, F.regexp_extract(head, BLOCK_LINE, 2)),
        "slot_sender": F.when(fits, tx.strip(F.substring_index(rest, ":", 1))),
    }


def parse_blocks(lines: DataFrame) -> DataFrame:
    """(chat_id, file, seq, dt, block_text, slot_*): blocks verbatim; dt is null for an impossible
    date and for lines before the first dated one."""
    marked = lines.withColumns({
        "is_blank": tx.strip(F.col("value")) == "",
        "is_start": F.col("value").rlike(BLOCK_LINE),
    }).withColumn("part", F.when(F.col("is_blank"), "").otherwise(F.col("value")))
    rows = put_together(with_entries(marked), ["headless"])
    first = F.substring_index("text", "\n", 1)
    dt = tm.archive_moment(F.regexp_extract(first, BLOCK_LINE, 1), F.regexp_extract(first, BLOCK_LINE, 2))
    return rows.select(
        "chat_id", "file", F.col("entry").alias("seq"), F.when(~F.col("headless"), dt).alias("dt"),
        F.col("text").alias("block_text"), *(c.alias(n) for n, c in slot_columns(F.col("text")).items()),
    )


def _spoken(rest):
    """Whether what follows the date is `Sender: text` rather than an event."""
    sender = F.substring_index(rest, ":", 1)
    return (~F.startswith(rest, F.lit(SYSTEM_TAG)) & rest.rlike(r"^[^:]+: ") & (F.length(sender) <= MAX_SENDER))


def parse_messages(lines: DataFrame) -> DataFrame:
    """Archive text as (chat_id, file, seq, ts, sender, text, is_system). Leading junk is dropped,
    blank lines stay in the text, seconds are cut off."""
    marked = lines.withColumns({
        "is_blank": F.col("value") == "",
        "is_start": F.col("value").rlike(DATED_LINE),
    })
    rest = F.regexp_extract("value", DATED_LINE, 3)
    spoken = _spoken(rest)
    fields = marked.withColumns({
        "sender": F.when(F.col("is_start") & spoken, tx.strip(F.substring_index(rest, ":", 1))),
        "is_system": ~spoken,
        "part": F.when(~F.col("is_start"), F.col("value")).when(spoken, F.substr(rest, F.locate(": ", rest) + 2)).otherwise(rest),
        "ts": F.when(F.col("is_start"), tm.archive_moment(F.regexp_extract("value", DATED_LINE, 1), F.regexp_extract("value", DATED_LINE, 2))),
    })
    entries = with_entries(fields).where(~F.col("headless"))
    rows = put_together(entries, ["ts", "sender", "is_system"], drop_trailing_blanks=False)
    return rows.where(F.col("ts").isNotNull()).select(
        "chat_id", "file", F.col("entry").alias("seq"), "ts", "sender", "text", "is_system")


def messages_from_blocks(archive: DataFrame) -> DataFrame:
    """The message table of archive rows, without another pass over text files."""
    first = F.substring_index("block_text", "\n", 1)
    more = F.substr("block_text", F.length(first) + 1)
    rest = F.regexp_extract(first, BLOCK_LINE, 3)
    spoken = _spoken(rest)
    return archive.where(F.col("dt").isNotNull()).select(
        "chat_id", "seq", F.col("dt").alias("ts"),
        F.when(spoken, tx.strip(F.substring_index(rest, ":", 1))).alias("sender"),
        F.concat(F.when(spoken, F.substr(rest, F.locate(": ", rest) + 2)).otherwise(rest), more).alias("text"),
        (~spoken).alias("is_system"),
    )


def without_system(messages: DataFrame) -> DataFrame:
    """Messages as segment detection reads them: no system rows, no blank lines inside."""
    return messages.where(~F.col("is_system")).withColumn("text", F.regexp_replace("text", r"\n\s*(?=\n|$)", ""))


def render_blocks(rows: DataFrame) -> DataFrame:
    """Adds `block_text` to normalized rows (date, time, sender, text, unparsed)."""
    stamp = F.concat(F.col("date"), F.lit(", "), F.col("time"), F.lit(" - "))
    return rows.withColumn(
        "block_text",
        F.when(F.col("unparsed"), F.concat(F.lit(f"{UNPARSED_TAG} "), "text"))
        .when(F.col("sender").isNull(), F.concat(stamp, F.lit(f"{SYSTEM_TAG} "), "text"))
        .otherwise(F.concat(stamp, "sender", F.lit(": "), "text")),
    )
