"""Identity directories and the joins that use them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.functions import text as tx
from parlance.functions.identity import alias_key
from parlance.model import IDENTITIES
from parlance.sources.archive import UNRESOLVED_TAG

# ---- fixed values ----
NUMBER_SUFFIXES = ("@s.whatsapp.net", "@lid", "@bot", "")
MENTION = "(?U)(?<![\\w@])@(?:⁨[^⁩\n]*⁩|[0-9]{7,20}\\b)"


def read_identities(spark: SparkSession, path: str) -> DataFrame:
    """(position, name, aliases) from an identity directory in JSON."""
    data = spark.read.schema(IDENTITIES).json(path, multiLine=True)
    return data.select(F.posexplode("identities").alias("position", "i")).select("position", "i.name", "i.aliases")


def alias_claims(identities: DataFrame) -> DataFrame:
    """(alias_key, canonical, n_claimants): each key with its first claimant. A name is an alias
    of itself."""
    aliases = F.coalesce("aliases", F.array().cast("array<string>"))
    labels = identities.select("position", F.col("name").alias("canonical"), F.posexplode(F.concat(F.array("name"), aliases)).alias("k", "label"))
    keyed = labels.withColumn("alias_key", alias_key(F.col("label"))).where(F.col("alias_key") != "")
    return keyed.groupBy("alias_key").agg(
        F.min_by("canonical", F.struct("position", "k")).alias("canonical"),
        F.count_distinct("canonical").alias("n_claimants"),
    )


def alias_conflicts(claims: DataFrame) -> DataFrame:
    return claims.where(F.col("n_claimants") > 1)


def unambiguous(claims: DataFrame) -> DataFrame:
    """Aliases of exactly one identity, for analytics that would rather not guess."""
    return claims.where(F.col("n_claimants") == 1)


def sender_labels(parsed: DataFrame, claims: DataFrame) -> DataFrame:
    """(chat_id, file, label, n, first_entry, alias_key, canonical, spelling): every sender label
    once per file. Labels that differ in case, emoji form or prefix share the first spelling."""
    label = tx.strip(tx.strip_isolates(F.col("sender")))
    found = parsed.where(F.col("sender").isNotNull()).groupBy("chat_id", "file", label.alias("label")).agg(
        F.count("*").alias("n"), F.min("entry").alias("first_entry"))
    keyed = found.withColumn("alias_key", alias_key(F.col("label")))
    spelled = keyed.groupBy("chat_id", "file", "alias_key").agg(F.min_by("label", "first_entry").alias("spelling"))
    known = claims.select("alias_key", "canonical")
    return keyed.join(spelled, ["chat_id", "file", "alias_key"]).join(known, "alias_key", "left")


def resolve_senders(parsed: DataFrame, labels: DataFrame) -> DataFrame:
    """Senders as canonical names; unknown ones keep their label with a tag."""
    names = labels.select("chat_id", "file", "label", F.coalesce("canonical", F.concat("spelling", F.lit(f" {UNRESOLVED_TAG}"))).alias("_name"),
                          F.col("canonical").isNull().alias("is_unresolved"))
    keyed = parsed.withColumn("label", tx.strip(tx.strip_isolates(F.col("sender"))))
    joined = keyed.join(names, ["chat_id", "file", "label"], "left")
    return joined.withColumns({"sender": F.col("_name"), "is_unresolved": F.coalesce("is_unresolved", F.lit(False))}).drop("_name", "label")


def unknown_senders(labels: DataFrame) -> DataFrame:
    """(chat_id, alias_key, label, n): labels no identity claims, spellings folded."""
    return labels.where(F.col("canonical").isNull()).groupBy("chat_id", "alias_key").agg(
        F.min_by("label", F.struct("file", "first_entry")).alias("label"), F.sum("n").alias("n"))


def _mention_labels(texts: DataFrame, column: str, keys) -> DataFrame:
    marked = texts.where(F.contains(F.col(column), F.lit("@")))
    raw = marked.select(*keys, F.posexplode(F.regexp_extract_all(column, F.lit(MENTION), F.lit(0))).alias("pos", "raw"))
    return raw.select(*keys, "pos", F.regexp_replace("raw", "^@⁨?|⁩$", "").alias("mention"))


def mention_names(labels: DataFrame, claims: DataFrame) -> DataFrame:
    """(mention, canonical): each distinct mention label with the name it resolves to. A phone
    number also stands for its bare digits under the known suffixes."""
    distinct = labels.select("mention").distinct()
    digits = F.regexp_replace("mention", r"(?U)\D", "")
    phone = (F.length(digits) >= 7) & ~F.col("mention").rlike(r"(?U)[^\d\s+()-]")
    forms = F.when(phone, F.array(*(F.concat(digits, F.lit(s)) for s in NUMBER_SUFFIXES))).otherwise(F.array().cast("array<string>"))
    tried = distinct.select("mention", F.posexplode(F.concat(F.array("mention"), forms)).alias("turn", "form"))
    keyed = tried.withColumn("alias_key", alias_key(F.col("form"))).where(tx.strip(F.col("mention")) != "")
    hits = keyed.join(claims.select("alias_key", "canonical"), "alias_key")
    return hits.groupBy("mention").agg(F.min_by("canonical", "turn").alias("canonical"))


def resolve_mentions(rows: DataFrame, claims: DataFrame, column: str = "msg", keys=("chat_id", "file", "entry")) -> DataFrame:
    """Adds `text`: in-text mentions by canonical name; unknown ones keep their label without the
    invisible marks. Only rows with an @ are taken apart."""
    keys = list(keys)
    labels = _mention_labels(rows, column, keys)
    names = mention_names(labels, claims)
    replaced = labels.join(names, "mention", "left").withColumn("name", F.coalesce("canonical", "mention"))
    lists = replaced.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos", "name"))).alias("_names"))
    joined = rows.join(lists, keys, "left")
    pieces = F.split(F.col(column), MENTION)
    rebuilt = F.concat(F.get(pieces, F.lit(0)), F.array_join(F.transform(
        "_names", lambda m: F.concat(F.lit("@"), m["name"], F.get(pieces, m["pos"] + 1))), ""))
    text = F.when(F.col("_names").isNull(), F.col(column)).otherwise(rebuilt)
    return joined.withColumn("text", tx.strip_isolates(text)).drop("_names")


def unresolved_mentions(rows: DataFrame, claims: DataFrame, column: str = "msg") -> DataFrame:
    """(chat_id, mention, n): mention labels that match no identity."""
    labels = _mention_labels(rows, column, ["chat_id"])
    open_ones = labels.join(mention_names(labels, claims), "mention", "left_anti")
    shown = open_ones.withColumn("mention", tx.strip(F.col("mention"))).where(F.col("mention") != "")
    return shown.groupBy("chat_id", "mention").agg(F.count("*").alias("n"))
