"""Benchmark items inside documents, by size-partitioned MinHash containment search.

A text's set is that of its distinct five-word shingles (words as elsewhere, lower case), the whole sequence if it is
shorter. An item is found in a document that holds at least 75 % of its set. Items are short and documents long,
so a Jaccard sketch of whole documents would miss them. Instead items are partitioned by the size of their sets. In a partition
of size n an item's sketch is its k = n - ceil(0.75 n) + 1 smallest hash values: a document with 75 % of the set holds one of them at
least, however long it is, so none is missed. Documents look their hash values up in all partitions at once; a
bitmap of fixed size, filled from the sketches, keeps values that occur in none of them from being shuffled.
Pairs found so are verified on the exact sets. Everything is a DataFrame or SQL expression.

Defined cases: null and empty texts have no set and match nothing; an item of fewer than five words is found only in
a document that is the same sequence; items that repeat are each reported, with their own item_id; rows of documents
that repeat an id count as one document whose set is the union. Null ids are kept as keys of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm.columns import SPACE, stored, table, texts

WIDTH = 5
PERCENT = 75
#: Seven bits to a byte, so that every byte is an ASCII character.
BITS = 7 << 15


def word_list(text):
    return F.filter(F.split(F.lower(text), SPACE, -1), lambda w: w != "")


def grams(words):
    """Shingles of a list of words as arrays, with repeats; the whole list where it is shorter; none of an empty one.

    `words` must be a column of its own: an expression would be worked out again for every shingle.
    """
    n = F.size(words)
    many = F.transform(F.sequence(F.lit(1), F.greatest(n - WIDTH + 1, F.lit(1))), lambda i: F.slice(words, i, WIDTH))
    return F.when(n > 0, many).otherwise(F.array().cast("array<array<string>>"))


def shingle_texts(words):
    return F.array_distinct(F.transform(grams(words), lambda g: F.concat_ws(" ", g)))


def hashes(words):
    return F.transform(grams(words), lambda g: F.xxhash64(g))


def _bit(h):
    return F.pmod(h, F.lit(BITS))


def sketches(items: DataFrame) -> DataFrame:
    """(h, item, size, least): the smallest hash values of every item, as many as its size partition asks for."""
    size = F.size("set")
    least = F.ceil(size * PERCENT / 100).cast("int")
    return items.where(size > 0).select(
        F.explode(F.slice(F.array_sort("set"), F.lit(1), size - least + 1)).alias("h"), "item", size.alias("size"), least.alias("least"))


def bitmap(sketch: DataFrame) -> bytes:
    """BITS bits, set for every sketch value: the same size for any number of items."""
    bit = _bit(F.col("h"))
    rows = sketch.select((bit / 7).cast("int").alias("at"), (bit % 7).cast("int").alias("bit")).groupBy("at").agg(
        F.bit_or(F.expr("shiftleft(1, bit)")).alias("bits")).collect()
    out = bytearray(BITS // 7)
    for r in rows:
        out[r["at"]] = r["bits"]
    return bytes(out)


def contained(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, n_item, n_shared, containment) for every item found in a document."""
    bench = items.select(F.col("item_id").cast("long").alias("item_id"), word_list(F.coalesce(F.col("text"), F.lit(""))).alias("words"))
    bench = stored(bench.select("item_id", F.monotonically_increasing_id().alias("item"),
                                F.array_distinct(hashes(F.col("words"))).alias("set"),
                                shingle_texts(F.col("words")).alias("shingles")), "bench-sets")
    sketch = sketches(bench)
    return _search(texts(docs), bench, sketch, bitmap(sketch))


def _search(docs: DataFrame, bench: DataFrame, sketch: DataFrame, bits: bytes) -> DataFrame:
    def maybe(h):
        byte = F.substring(F.lit(bits), F.floor(_bit(h) / 7).cast("int") + 1, F.lit(1))
        return F.getbit(F.ascii(byte.cast("string")), (_bit(h) % 7).cast("int")) == 1

    values = docs.select("doc_id", word_list("text").alias("words")).select("doc_id", F.explode(F.array_distinct(F.filter(hashes(F.col("words")), maybe))).alias("h"))
    pairs = values.join(sketch, "h").select("doc_id", "item").distinct()
    pairs = stored(pairs, "bench-pairs")
    # Verification: the shingles of candidate documents only, against the whole set of the item.
    named = pairs.groupBy(F.col("doc_id").alias("key")).agg(F.collect_list("item").alias("found"))
    held = docs.join(named, F.col("doc_id").eqNullSafe(F.col("key"))).select("doc_id", "found", word_list("text").alias("words"))
    held = held.select("doc_id", "found", shingle_texts(F.col("words")).alias("own"))
    shared = held.select("doc_id", "own", F.explode("found").alias("item")).join(bench, "item").select(
        "doc_id", "item", "item_id", F.size("shingles").alias("n_item"), F.explode(F.array_intersect("own", "shingles")).alias("g"))
    return shared.groupBy("doc_id", "item", "item_id", "n_item").agg(F.count_distinct("g").alias("n_shared")).where(
        F.col("n_shared") * 100 >= F.col("n_item") * PERCENT).select(
        "doc_id", "item_id", F.col("n_item").cast("long").alias("n_item"), "n_shared", (F.col("n_shared") / F.col("n_item")).alias("containment"))


def op7_decontamination(spark, sf_dir):
    """Every benchmark item found in a document."""
    return contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL = """WITH grams AS (SELECT 'd' AS side, doc_id AS id, list_filter(string_split_regex(lower(coalesce(text, '')), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w FROM documents
UNION ALL SELECT 'i', item_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') FROM benchmark),
sets AS (SELECT DISTINCT side, id, unnest(CASE WHEN len(w) = 0 THEN [] ELSE list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM grams),
sizes AS (SELECT id AS item_id, count(*) AS n_item FROM sets WHERE side = 'i' GROUP BY id)
SELECT d.id AS doc_id, i.id AS item_id, n_item, count(*) AS n_shared, count(*) / n_item::DOUBLE AS containment
FROM sets d JOIN sets i ON d.g = i.g AND d.side = 'd' AND i.side = 'i' JOIN sizes ON sizes.item_id = i.id
GROUP BY d.id, i.id, n_item HAVING count(*) * 100 >= n_item * 75"""
