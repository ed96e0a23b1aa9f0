"""From text lines to messages: which entry a line belongs to, and the entries put together.

Lines come as (chat_id, file, block, pos, value). A block is one split of a file, so that a file
of any size is spread; (block, pos) orders the lines of a file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_lines(spark: SparkSession, paths, chat_id: Column | None = None) -> DataFrame:
    """Text files as ordered lines. `chat_id` is an expression over `file`; 0 if left out."""
    lines = spark.read.text(paths).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("pos"), "value",
    )
    return lines.withColumn("chat_id", (F.lit(0) if chat_id is None else chat_id).cast("long"))


def with_entries(lines: DataFrame, extra_sums: dict | None = None) -> DataFrame:
    """Adds `entry`, the dense number from 1 of the entry a line belongs to within its file, and
    `headless` for lines before the first start; each such line that is not blank is an entry.

    Needs `is_start` and `is_blank`. `extra_sums` (name -> 0/1 column) are totals over the whole
    file that come along on every line. Numbers are counted within blocks and carried over from
    block to block, so that the only window over a whole file has one row per block.
    """
    extra_sums = extra_sums or {}
    where = ["file", "block"]
    cut = lines.repartition(*where)
    so_far = Window.partitionBy(*where).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    one = lambda c: F.when(c, 1).otherwise(0)
    inside = cut.withColumns({
        "_starts": F.sum(one(F.col("is_start"))).over(so_far),
        "_filled": F.sum(one(~F.col("is_blank"))).over(so_far),
    })
    blocks = inside.groupBy(*where).agg(
        F.max("_starts").alias("_s"), F.max(F.when(F.col("_starts") == 0, F.col("_filled"))).alias("_lead"),
        *(F.sum(c).alias(n) for n, c in extra_sums.items()),
    )
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("file")
    carried = (
        blocks.withColumn("_s0", F.coalesce(F.sum("_s").over(before), F.lit(0)))
        .withColumn("_lead", F.when(F.col("_s0") == 0, F.coalesce("_lead", F.lit(0))).otherwise(0))
        .withColumns({"_l0": F.coalesce(F.sum("_lead").over(before), F.lit(0)), "_leads": F.sum("_lead").over(whole),
                      **{n: F.sum(n).over(whole) for n in extra_sums}})
        .drop("_s", "_lead")
    )
    total = F.col("_s0") + F.col("_starts")
    joined = inside.join(carried, where).withColumns({
        "headless": total == 0,
        "entry": F.when(total == 0, F.col("_l0") + F.col("_filled")).otherwise(F.col("_leads") + total),
    })
    return joined.where(~(F.col("headless") & F.col("is_blank"))).drop("_starts", "_filled", "_s0", "_l0", "_leads")


def put_together(entries: DataFrame, head_fields, drop_trailing_blanks: bool = True) -> DataFrame:
    """One row per entry: its first line's `head_fields` and `text`, all lines in order joined by
    line breaks. Lines carry their part in `part`."""
    lines = F.array_sort(F.collect_list(F.struct("block", "pos", "part")))
    heads = F.min_by(F.struct(*head_fields), F.struct("block", "pos"))
    filled = F.count_if(~F.col("is_blank")).alias("n_lines")
    rows = entries.groupBy("chat_id", "file", "entry").agg(lines.alias("_lines"), heads.alias("_head"), filled)
    text = F.array_join(F.transform("_lines", lambda x: x["part"]), "\n")
    if drop_trailing_blanks:
        text = F.regexp_replace(text, r"\n+$", "")
    return rows.select("chat_id", "file", "entry", "_head.*", text.alias("text"), "n_lines")
