"""From export files to a refreshed archive and its tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.model import Profile
from parlance.operators import merge, segments, terms
from parlance.operators.enrich import enrich
from parlance.plans.bundle import bundle
from parlance.session import materialize
from parlance.sources import archive as ar
from parlance.sources import identities as ids
from parlance.sources import sinks
from parlance.sources.lines import read_lines
from parlance.sources.raw_export import parse_export
from parlance.sources.tables import default_baseline


def normalize(lines: DataFrame, claims: DataFrame, day_first: bool | None = None) -> DataFrame:
    """Raw lines as normalized rows: canonical senders, resolved mentions, nothing dropped."""
    parsed = materialize(parse_export(lines, day_first), "parsed")
    resolved = ids.resolve_senders(parsed, ids.sender_labels(parsed, claims))
    texted = ids.resolve_mentions(resolved, claims)
    return ar.render_blocks(texted)


def archive_rows(normalized: DataFrame) -> DataFrame:
    """Normalized rows in the archive's schema, `seq` still counted per file."""
    slot = ar.slot_columns(F.col("block_text"))
    return normalized.select(
        "chat_id", F.col("entry").alias("seq"), F.when(~F.col("unparsed"), F.col("dt")).alias("dt"), "block_text",
        *(c.alias(n) for n, c in slot.items()), F.col("file").alias("src_file"),
    )


def merge_into(spark: SparkSession, root: str, incoming: DataFrame) -> DataFrame:
    """Merges archive rows into the archive under `root` and returns them with their verdicts. Equal blocks are of one
    month, so only the months that come in are read, and only those that gain rows are written."""
    old = sinks.read_parts(spark, root, sinks.in_parts(incoming))
    judged = materialize(merge.judged(old, incoming), "judged")
    sinks.publish_merge(root, old, judged.where("verdict = 'new'"))
    return judged


def merge_lines(spark: SparkSession, paths, root: str, claims: DataFrame, chat_id=None) -> DataFrame:
    """Merges export files into the archive, logs it, and returns the new archive."""
    exports = materialize(archive_rows(normalize(read_lines(spark, paths, chat_id), claims)), "exports")
    incoming = materialize(merge.combined_exports(exports), "incoming")
    judged = merge_into(spark, root, incoming)
    sinks.append_log(sinks.log_rows(merge.file_counts(exports, judged), sinks.file_hashes(spark, paths)), root)
    return sinks.read_archive(spark, root)


def update(spark: SparkSession, paths, root: str, claims: DataFrame, profile: Profile | None = None,
           names: DataFrame | None = None, baseline: DataFrame | None = None, chat_id=None, sections=None,
           identities: DataFrame | None = None) -> dict[str, DataFrame]:
    """Merge, then refresh in order: segments first, since the text statistics slice by them.
    Without files the tables are refreshed from the archive as it stands. `identities` (name, aliases)
    keeps members' names out of the word tables; without `baseline` words are held against the default one."""
    profile = profile or Profile()
    base = terms.baseline_counts(default_baseline(spark)) if baseline is None else baseline
    stopwords = None if identities is None else terms.name_stopwords(identities, base)
    archive = merge_lines(spark, paths, root, claims, chat_id) if paths else sinks.read_archive(spark, root)
    messages = materialize(enrich(ar.messages_from_blocks(archive)), "messages")
    table = materialize(segments.segment_table(messages, profile, names), "segments")
    return {"archive": archive, "messages": messages, "segments": table,
            **bundle(messages, profile, table, ids.unambiguous(claims), base, stopwords, sections=sections)}
