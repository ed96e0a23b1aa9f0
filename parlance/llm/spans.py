"""Positions of all matches of a pattern, as column expressions.

Regular expressions of Spark SQL give matches or the text between them, never places; both together do:
the n-th match starts after the first n gaps and the matches between. Places are code points, ends exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EMPTY = "array<struct<start:long,end:long,hit:string>>"


def no_spans() -> Column:
    return F.array().cast(EMPTY)


def find(text: Column, pattern: str) -> Column:
    """array<struct<start, end, hit>> of the leftmost non-overlapping matches, in order."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    start = F.struct(F.lit(0).cast("long").alias("at"), no_spans().alias("found"))

    def step(state, pair):
        low = state["at"] + F.char_length(pair["gap"])
        high = low + F.char_length(pair["hit"])
        span = F.struct(low.cast("long").alias("start"), high.cast("long").alias("end"), pair["hit"].alias("hit"))
        return F.struct(high.cast("long").alias("at"), F.concat(state["found"], F.array(span)).alias("found"))

    pairs = F.zip_with(F.slice(gaps, F.lit(1), F.size(hits)), hits, lambda g, h: F.struct(g.alias("gap"), h.alias("hit")))
    return F.when(F.size(hits) > 0, F.aggregate(pairs, start, step)["found"]).otherwise(no_spans())


def digits(column: Column) -> Column:
    return F.regexp_replace(column, "[^0-9]", "")


def labelled(spans: Column, rank: int) -> Column:
    """(start, rank, end) for sorting spans of several kinds together."""
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end")))


def joined(arrays: list[Column], kinds: list[str]) -> Column:
    """kind:start:end by start, then kind as listed, comma-joined."""
    names = F.array(*[F.lit(k) for k in kinds])
    every = F.array_sort(F.concat(*arrays))
    return F.concat_ws(",", F.transform(every, lambda s: F.concat_ws(":", F.element_at(names, s["rank"] + 1), s["start"].cast("string"), s["end"].cast("string"))))
