"""Merging new exports into the archive: a multiset difference, a placeholder check and a
chronological union.

Archive rows: chat_id, seq, dt (null when undated), block_text, slot_date, slot_time, slot_sender
(null for system rows), src_file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parlance.functions import text as tx
from parlance.operators.ordering import CELL_ROWS, dense_position, resequence


def judged(archive: DataFrame, new: DataFrame, cell_rows: int = CELL_ROWS) -> DataFrame:
    """New rows with a `verdict`: 'duplicate' while an archive copy of the same text is left to
    cancel it, 'placeholder' where the archive already has a row in its slot, else 'new'.

    Both sides are counted in one aggregate per (chat, text, cell of new rows). A text's few rows of counts tell how many
    copies the archive has and how many new ones came in earlier cells; inside a cell a row's own number is added. So many
    copies of one text are many small groups.
    """
    same = ["chat_id", "block_text"]
    cut = new.withColumn("_cell", F.expr(f"seq div {cell_rows}"))
    have, come = F.lit(1).cast("long"), F.lit(0).cast("long")
    both = archive.select(*same, F.lit(None).cast("long").alias("_cell"), have.alias("_have"), come.alias("_come")).unionByName(
        cut.select(*same, "_cell", come.alias("_have"), have.alias("_come")))
    counts = both.groupBy(*same, "_cell").agg(F.sum("_have").alias("_have"), F.sum("_come").alias("_come"))
    text = Window.partitionBy(*same)
    earlier = F.sum("_come").over(text.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select(*same, "_cell", F.sum("_have").over(text).alias("_old"), F.coalesce(earlier, F.lit(0)).alias("_before"))
    sized = cut.join(counts.where(F.col("_cell").isNotNull()), [*same, "_cell"])
    number = F.row_number().over(Window.partitionBy(*same, "_cell").orderBy("seq"))
    marked = sized.withColumn("_fresh", F.col("_before") + number > F.col("_old")).drop("_cell", "_old", "_before")
    # Only fresh placeholders ask for a slot; the key of any other row is one that no slot has.
    late = F.col("_fresh") & tx.is_placeholder(F.col("block_text")) & F.col("slot_sender").isNotNull()
    asks = F.when(late, F.col("slot_sender")).otherwise(F.concat(F.lit("\u0001"), F.col("seq").cast("string")))
    slots = archive.where(F.col("dt").isNotNull() & F.col("slot_sender").isNotNull())
    slots = slots.select("chat_id", "slot_date", "slot_time", F.col("slot_sender").alias("_asks")).distinct().withColumn("_taken", F.lit(True))
    found = marked.withColumn("_asks", asks).join(slots, ["chat_id", "slot_date", "slot_time", "_asks"], "left")
    verdict = F.when(~F.col("_fresh"), "duplicate").when(F.col("_taken"), "placeholder").otherwise("new")
    return found.select(*new.columns, verdict.alias("verdict"))


def merged(archive: DataFrame, judged_rows: DataFrame, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Archive plus the new rows in time order, archive rows first within a minute, undated rows
    last, with fresh dense `seq`."""
    added = judged_rows.where(F.col("verdict") == "new").drop("verdict").withColumn("_src", F.lit(1))
    union = archive.withColumn("_src", F.lit(0)).unionByName(added, allowMissingColumns=True)
    return resequence(union, "dt", ["_src", "seq"], cell_rows=cell_rows).drop("_src")


def verdict_counts(judged_rows: DataFrame, keys=("chat_id",)) -> DataFrame:
    """Rows added, duplicates and placeholders skipped."""
    def hits(v):
        return F.count_if(F.col("verdict") == v)

    return judged_rows.groupBy(*keys).agg(
        hits("new").alias("added"), hits("duplicate").alias("duplicates"), hits("placeholder").alias("placeholders"),
    )


def file_counts(exports: DataFrame, judged_rows: DataFrame) -> DataFrame:
    """(file, added, duplicates, placeholders, undated) of every export file. Copies that another file of the
    same call brought as well were dropped before the archive was asked; they are duplicates too."""
    came = exports.groupBy(F.col("src_file").alias("file")).agg(F.count("*").alias("_came"))
    judged_counts = verdict_counts(judged_rows, ["src_file"]).withColumnRenamed("src_file", "file")
    undated = judged_rows.where((F.col("verdict") == "new") & F.col("dt").isNull()).groupBy(F.col("src_file").alias("file")).agg(F.count("*").alias("undated"))
    rows = came.join(judged_counts, "file", "left").join(undated, "file", "left").fillna(0, ["added", "duplicates", "placeholders", "undated"])
    return rows.select("file", "added", (F.col("_came") - F.col("added") - F.col("placeholders")).alias("duplicates"), "placeholders", "undated")


def combined_exports(exports: DataFrame, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Several exports in one, as if merged one after another: of a text's copies the largest
    per-file number stays. `exports` carries src_file and seq within the file."""
    copies = dense_position(exports, "_copy", ["chat_id", "block_text", "src_file"], cell_rows)
    first = copies.groupBy("chat_id", "block_text", "_copy").agg(F.min_by(F.struct(*exports.columns), F.struct("src_file", "seq")).alias("r"))
    rows = first.select("r.*")
    return resequence(rows, "dt", ["src_file", "seq"], cell_rows=cell_rows)
