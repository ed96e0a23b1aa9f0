"""A corpus cleaned and encoded in five stages, each one an operator of parlance.llm whose decision takes effect.

A stage takes (spark, docs, sf_dir) and works on everything its predecessor kept; all but the last return the
columns of their input, further ones included. Rows are told apart by their id and text, so rows that share an id, or have
none, get a verdict each; equal rows share theirs.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.llm import byte_bpe, decontamination, jaccard, secrets, spans, toxicity
from parlance.llm.columns import stored, table

MASK = "[SECRET]"


def _rows(docs: DataFrame) -> DataFrame:
    """The whole row in one column, which no name can clash with, beside what tells it apart."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))


def _keyed(rows: DataFrame) -> DataFrame:
    """(doc_id, text) with one id for equal rows and no others."""
    return rows.select(F.xxhash64("doc_id", "text_hash").alias("doc_id"), "text")


def _same(rows: DataFrame, other: DataFrame):
    return rows["doc_id"].eqNullSafe(other["_id"]) & (rows["text_hash"] == other["_hash"])


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score of 0.3 or more go."""
    rows = _rows(docs)
    found = toxicity.toxicity(docs, table(spark, sf_dir, "labels")).where("predicted = 1")
    gone = found.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct()
    return rows.join(gone, _same(rows, gone), "left_anti").select("row.*")


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents alike in their shingles the one with the smallest id stays, once; texts without words all stay.

    Of rows that share that id and text but not their other columns, the one that comes first as JSON stays.
    """
    rows = _rows(docs)
    labels = jaccard.near_duplicates(docs).where("root IS NOT NULL")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "text_hash"))
    kept = labels.groupBy("root").agg(first.alias("f")).select(F.col("f.doc_id").alias("_id"), F.col("f.text_hash").alias("_hash"))
    worded = F.col("text").rlike(r"[^\x20\x09-\x0D]")
    some = rows.where(worded)
    some = some.join(kept, _same(some, kept), "left_semi").groupBy("doc_id", "text_hash").agg(F.min_by("row", F.to_json("row")).alias("row"))
    return some.select("row").unionByName(rows.where(~worded).select("row")).select("row.*")


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold 75 % of a benchmark item go."""
    rows = _rows(docs)
    found = decontamination.contained(_keyed(rows), table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("_key")).distinct()
    return rows.join(found, F.xxhash64(rows["doc_id"], rows["text_hash"]) == F.col("_key"), "left_anti").select("row.*")


def masked(text, found):
    """The text with a mask in place of every stretch that spans cover."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def step(state, s):
        fresh = s["start"] >= state["at"]
        before = F.substring(text, (state["at"] + 1).cast("int"), (s["start"] - state["at"]).cast("int"))
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"), F.when(fresh, F.concat(state["out"], before, F.lit(MASK))).otherwise(state["out"]).alias("out"))

    def end(state):
        return F.concat(state["out"], F.substring(text, (state["at"] + 1).cast("int"), F.char_length(text)))

    return F.aggregate(F.array_sort(found), start, step, end)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret becomes a mask; n_chars, where it is a column, follows the text."""
    rows = _rows(docs)
    every = F.concat(*[spans.labelled(F.col(k), i) for i, k in enumerate(secrets.RULES)])
    found = secrets.secrets(_keyed(rows)).select(F.col("doc_id").alias("_key"), every.alias("_spans")).where(F.size("_spans") > 0).dropDuplicates(["_key"])
    both = rows.join(found, F.xxhash64(rows["doc_id"], rows["text_hash"]) == F.col("_key"), "left")
    clean = both.withColumn("_clean", F.when(F.col("_spans").isNotNull(), masked(F.col("text"), F.col("_spans"))).otherwise(F.col("row.text")))
    new = {"text": F.col("_clean"), "n_chars": F.when(F.col("_spans").isNotNull(), F.char_length("_clean")).otherwise(F.col("row.n_chars")) if "n_chars" in docs.columns else None}
    return clean.select(*[(new[c].cast(kind) if c in new else F.col(f"row.`{c}`")).alias(c) for c, kind in docs.dtypes])


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, ids) of what is left."""
    return byte_bpe.round_trip(docs, public_tokenizers.path(byte_bpe.VOCABULARY), keep_ids=True)


STAGES = [
    ("toxicity", reject_toxic),
    ("ngram_jaccard", one_of_each_group),
    ("decontamination", without_benchmark),
    ("secrets", mask_secrets),
    ("byte_bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; what one returns is written to the shared folder and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs


#: Toxicity is a model fitted on the labels, which SQL doesn't express; tests hold the stages against plain Python.
ORACLE_SQL = None
