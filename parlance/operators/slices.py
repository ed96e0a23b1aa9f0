"""Slices of a chat (all of it, its last days, each spike) as a key column, so that one pass
serves them all."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.model import Profile
from parlance.operators.enrich import participants
from parlance.operators.segments import segment_days


def sliced(messages: DataFrame, profile: Profile, segments: DataFrame | None = None, keys=("chat_id",)) -> DataFrame:
    """Messages once per slice they belong to: 'full', 'last' and 'seg:<seg_no>'."""
    keys = list(keys)
    ends = messages.groupBy(*keys).agg(F.date_sub(F.to_date(F.max("ts")), profile.last_period_days - 1).alias("_from"))
    dated = messages.withColumn("date", F.to_date("ts")).join(ends, keys)
    names = [F.lit("full"), F.when(F.col("date") >= F.col("_from"), "last")]
    if segments is not None:
        days = segment_days(segments.where(F.col("type") != "filler"), keys)
        dated = dated.join(days, [*keys, "date"], "left")
        names.append(F.concat(F.lit("seg:"), F.col("seg_no").cast("string")))
    rows = dated.withColumn("slice", F.explode(F.array_compact(F.array(*names))))
    return rows.drop("_from", "seg_no")


def slice_participants(sliced_messages: DataFrame, min_messages: int = 10, keys=("chat_id",)) -> DataFrame:
    """Participants per slice; the minimum holds for the whole chat, small slices take everyone."""
    floor = F.when(F.col("slice") == "full", F.lit(min_messages)).otherwise(F.lit(1))
    return participants(sliced_messages, floor, [*keys, "slice"])
