"""How far the sources of a language are apart in their words: a recount of kept terms through perfect hashes.

The first pass counts, exactly, in how many documents of its language each term occurs; terms in at least LEAST of them
are kept. They are cut into shards, and a task builds the minimal perfect hash of each, with the bytes of its keys. The second pass
reads the texts again with the shards broadcast: a term's slot is the perfect hash's number once the stored key equals
the term, and each (lang, source) group of a task increments a dense array of slots. At most ROUND bytes of shards are
broadcast at once; a vocabulary beyond that is recounted in as many passes as it needs. A task holds SLOTS slots and hands
its counts on when more would be needed.

Terms are told apart by 64-bit hashes and then compared byte by byte, with their first occurrence and with the stored key, so
no count rests on a hash alone. Shares are whole parts in 10**9, in integers throughout. Distances between sources are sums
over blocks of terms, dense matrices of at most MATRIX cells.

Defined cases: null text, lang and source are ''; texts without terms make groups without terms, whose counts
are all 0; rows that repeat count as often as they come; a language without kept terms has distance 0 everywhere.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parlance.llm import words as W
from parlance.llm.columns import stored, table
from parlance.llm.perfect_hash import PerfectHash
from parlance.llm.vocabulary import Terms, same

LEAST = 30
PRIOR = 5
PARTS = 1_000_000_000
TOP = 50
SHARD = 1 << 16
ROUND = 128 << 20
SLOTS = 1 << 22
MATRIX = 1 << 17
SLICE = 1 << 21
NOT_TERM = np.array([b < 128 and not chr(b).isalpha() for b in range(256)])


def _parts(batches):
    for batch in batches:
        yield from W.slices(batch, most=SLICE)


def _document_counts(batches):
    """(lang, term, h, docs): documents of each language that hold a term, for each slice."""
    for part in _parts(batches):
        terms = Terms(part.column("text"), NOT_TERM)
        if not len(terms):
            continue
        langs = part.column("lang").dictionary_encode()
        row, kind = np.divmod(np.unique(terms.row * len(terms) + terms.kind), len(terms))
        pairs, docs = np.unique(langs.indices.to_numpy()[row].astype(np.int64) * len(terms) + kind, return_counts=True)
        lang, kind = np.divmod(pairs, len(terms))
        yield pa.RecordBatch.from_arrays(
            [langs.dictionary.take(pa.array(lang)), pa.array(terms.bytes(kind), pa.binary()).cast(pa.string()),
             pa.array(terms.hash[kind].view(np.int64)), pa.array(docs)], ["lang", "term", "h", "docs"])


def _build(shard: pa.Table) -> pa.Table:
    """One row for a shard: its terms in the order of their numbers, and the perfect hash that gives the numbers."""
    terms = np.array([t.encode() for t in shard.column("term").to_pylist()], object)
    hashes = shard.column("h").to_numpy().view(np.uint64)
    _, first = np.unique(hashes, return_index=True)
    numbers = PerfectHash(hashes[first])
    order = first[numbers.value]
    others = np.setdiff1d(np.arange(len(terms)), first)  # terms whose hash another one has too
    order = np.concatenate([order, others])
    levels = [(alone, rank.astype(np.int32)) for alone, rank in numbers.levels]
    keys = terms[order].tolist()
    ends = np.cumsum([len(k) for k in keys])
    twins = {k: len(first) + i for i, k in enumerate(keys[len(first):])}
    blob = pickle.dumps((levels, numbers.fingerprint, np.frombuffer(b"".join(keys), np.uint8), ends, twins))
    return pa.table({"lang": shard.column("lang").slice(0, 1), "shards": shard.column("shards").slice(0, 1), "shard": shard.column("shard").slice(0, 1),
                     "terms": pa.array([[k.decode() for k in keys]], pa.list_(pa.string())), "blob": pa.array([blob], pa.binary())})


class Shard:
    def __init__(self, base: int, blob: bytes):
        levels, fingerprint, self.data, self.ends, self.twins = pickle.loads(blob)
        self.base = base
        self.hash = PerfectHash.__new__(PerfectHash)
        self.hash.levels, self.hash.fingerprint, self.hash.value = levels, fingerprint, np.arange(len(fingerprint))

    def slots(self, terms: Terms, kinds: np.ndarray) -> np.ndarray:
        """The slot of each kind of term, -1 where the stored key is not that term."""
        number = self.hash.find(terms.hash[kinds])
        at = np.flatnonzero(number >= 0)
        n, k = number[at], kinds[at]
        starts = np.where(n > 0, self.ends[n - 1], 0)
        fits = self.ends[n] - starts == terms.length[k]
        fits[fits] = same(terms.data, terms.start[k[fits]], self.data, starts[fits], terms.length[k[fits]])
        wrong = at[~fits]
        number[wrong] = [self.twins.get(key, -1) for key in terms.bytes(kinds[wrong])]
        return np.where(number >= 0, number + self.base, -1)


def _recount(shards):
    """Counts of the slots of `shards`, a broadcast list of (lang, shards of the lang, shard, base, size, blob)."""
    def run(batches):
        held: dict[str, dict[int, Shard]] = {}
        span: dict[str, tuple[int, int, int]] = {}
        for lang, total, number, base, size, blob in shards.value:
            held.setdefault(lang, {})[number] = Shard(base, blob)
            low, high, _ = span.get(lang, (base, base, total))
            span[lang] = (min(low, base), max(high, base + size), total)
        counts: dict[tuple[str, str], np.ndarray] = {}

        def flushed():
            for (lang, source), slots in counts.items():
                hit = np.flatnonzero(slots)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(hit), pa.string()), pa.array([source] * len(hit), pa.string()),
                                                  pa.array(hit + span[lang][0]), pa.array(slots[hit])], ["lang", "source", "slot", "n"])
            counts.clear()

        for part in _parts(batches):
            terms = Terms(part.column("text"), NOT_TERM)
            if not len(terms):
                continue
            langs, sources = part.column("lang").dictionary_encode(), part.column("source").dictionary_encode()
            lang_of = langs.indices.to_numpy()[terms.row]
            source_of = sources.indices.to_numpy()[terms.row]
            for code, lang in enumerate(langs.dictionary.to_pylist()):
                if lang not in held:
                    continue
                mine = np.flatnonzero(lang_of == code)
                kinds = np.unique(terms.kind[mine])
                low, high, total = span[lang]
                slot = np.full(len(terms), -1, np.int64)
                shard = np.mod(terms.hash[kinds].view(np.int64), total)
                for number in np.unique(shard).tolist():
                    if number in held[lang]:
                        here = kinds[shard == number]
                        slot[here] = held[lang][number].slots(terms, here)
                found = slot[terms.kind[mine]]
                mine, found = mine[found >= 0], found[found >= 0] - low
                pairs, times = np.unique(source_of[mine].astype(np.int64) * (high - low) + found, return_counts=True)
                group, found = np.divmod(pairs, high - low)
                cuts = np.searchsorted(group, np.arange(len(sources.dictionary) + 1))
                for g, source in enumerate(sources.dictionary.to_pylist()):
                    a, b = cuts[g], cuts[g + 1]
                    if a == b:
                        continue
                    if (lang, source) not in counts:
                        if sum(map(len, counts.values())) + high - low > SLOTS:
                            yield from flushed()
                        counts[lang, source] = np.zeros(high - low, np.int64)
                    counts[lang, source][found[a:b]] += times[a:b]
        yield from flushed()
    return run


def kept_terms(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(lang, term, h) of the terms that at least `least` documents of the language hold."""
    each = docs.mapInArrow(_document_counts, "lang string, term string, h long, docs long")
    return each.groupBy("lang", "term", "h").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= least).select("lang", "term", "h")


def sharded(kept: DataFrame) -> DataFrame:
    """(lang, shards, shard, base, size, terms, blob): perfect hashes of about SHARD terms each; `base` is the shard's first slot."""
    volume = kept.groupBy("lang").agg(F.ceil(F.count("*") / SHARD).alias("shards"))
    cut = kept.join(volume, "lang").withColumn("shard", F.pmod("h", "shards")).repartition("lang", "shard")
    built = cut.groupBy("lang", "shard").applyInArrow(_build, "lang string, shards long, shard long, terms array<string>, blob binary")
    built = stored(built, "shards")
    size = F.size("terms").cast("long")
    before = F.coalesce(F.sum(size).over(Window.partitionBy("lang").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = built.select("lang", "shard", size.alias("size"), before.alias("base"))
    return built.join(bases, ["lang", "shard"])


def recounted(docs: DataFrame, shards: DataFrame) -> DataFrame:
    """(lang, source, slot, n): occurrences of each kept term in each group, where there are any."""
    spark = docs.sparkSession
    sizes = shards.select("lang", "shard", F.length("blob").alias("bytes")).orderBy("lang", "shard").collect()
    rounds, room = [], 0
    for row in sizes:
        if row["bytes"] > room or not rounds:
            rounds.append([])
            room = ROUND
        rounds[-1].append((row["lang"], row["shard"]))
        room -= row["bytes"]
    schema = "lang string, source string, slot long, n long"
    counts = spark.createDataFrame([], schema)
    for chosen in rounds:
        low, high = (F.struct(F.lit(lang).alias("lang"), F.lit(number).cast("long").alias("shard")) for lang, number in (chosen[0], chosen[-1]))
        some = shards.where(F.struct("lang", "shard").between(low, high))
        sent = spark.sparkContext.broadcast([tuple(r) for r in some.select("lang", "shards", "shard", "base", "size", "blob").collect()])
        counts = counts.unionByName(docs.mapInArrow(_recount(sent), schema))
    return counts.groupBy("lang", "source", "slot").agg(F.sum("n").alias("n"))


def _shares(count: np.ndarray, total: np.ndarray, volume: int) -> np.ndarray:
    """1 + floor(PARTS * (count + PRIOR) / (total + PRIOR * volume)), by long division in steps that stay below 2**63."""
    whole = total + PRIOR * volume
    out, left = np.divmod(count + PRIOR, whole)
    for _ in range(3):
        digits, left = np.divmod(left * 1000, whole)
        out = out * 1000 + digits
    return out + 1


def _share(count, total, volume):
    scaled = F.lit(PARTS).cast("decimal(10,0)") * (count + PRIOR).cast("decimal(20,0)")
    return F.call_function("div", scaled, (total + PRIOR * volume).cast("decimal(20,0)")) + 1


def _distances(key, counts: pa.Table, groups: pa.Table) -> pa.Table:
    """(lang, a, b, apart) of every two groups of a language, over one block of its terms."""
    order = np.argsort(groups.column("group").to_numpy())
    total, low, high, volume = (groups.column(n).to_numpy()[order] for n in ("total", "low", "high", "volume"))
    width = int(high[0] - low[0])
    matrix = np.zeros((len(order), width), np.int64)
    matrix[counts.column("g").to_numpy(), counts.column("slot").to_numpy() - low[0]] = counts.column("n").to_numpy()
    a, b, apart = [], [], []
    if width:
        matrix = _shares(matrix, total[:, None], int(volume[0]))
    for g in range(len(order) - 1):
        a.append(np.full(len(order) - 1 - g, g))
        b.append(np.arange(g + 1, len(order)))
        apart.append(np.abs(matrix[g + 1:] - matrix[g]).sum(1))
    joined = [np.concatenate(x) if x else np.empty(0, np.int64) for x in (a, b, apart)]
    return pa.table({"lang": pa.array([key[0].as_py()] * len(joined[0]), pa.string()), **{n: pa.array(x.astype(np.int64)) for n, x in zip(("a", "b", "apart"), joined)}})


def source_divergence(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): distances to the other sources of the language ('pair') and the terms that a
    source has more often than its language ('term')."""
    blank = {n: F.coalesce(F.col(n).cast("string"), F.lit("")).alias(n) for n in ("lang", "source", "text")}
    rows = docs.select(*blank.values())
    shards = stored(sharded(stored(kept_terms(rows, least), "kept-terms")), "sharded")
    terms = shards.select("lang", "base", F.posexplode("terms").alias("at", "term")).select("lang", (F.col("base") + F.col("at")).alias("slot"), "term")
    counts = stored(recounted(rows, shards.select("lang", "shards", "shard", "base", "size", "blob")), "recounted")

    volumes = shards.groupBy("lang").agg(F.sum("size").alias("volume"))
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = docs.select(blank["lang"], blank["source"]).distinct().join(totals, ["lang", "source"], "left").join(volumes, "lang", "left").fillna(0, ["total", "volume"])
    mine = Window.partitionBy("lang")
    groups = stored(groups.withColumns({"g": F.row_number().over(mine.orderBy("source")) - 1, "groups": F.count("*").over(mine)}), "groups")

    # Terms: the language's own counts are sums over its groups.
    whole = counts.groupBy("lang", "slot").agg(F.sum("n").alias("all_n"))
    whole_totals = groups.groupBy("lang").agg(F.sum("total").alias("all_total"))
    told = counts.join(whole, ["lang", "slot"]).join(groups, ["lang", "source"]).join(whole_totals, "lang")
    value = _share(F.col("n"), F.col("total"), F.col("volume")) - _share(F.col("all_n"), F.col("all_total"), F.col("volume"))
    told = told.withColumn("value", value).where(F.col("value") > 0).join(terms, ["lang", "slot"])
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    best = told.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value").withColumn("rank", F.row_number().over(by_value)).where(F.col("rank") <= top)

    # Pairs: every block of terms meets the groups of its language, also those that hold none of its terms.
    width = F.greatest(F.floor(F.lit(MATRIX) / F.col("groups")), F.lit(1))
    blocks = groups.select("lang", "g", "total", "volume", width.alias("width"), F.explode(F.sequence(F.lit(0), F.floor((F.greatest("volume", F.lit(1)) - 1) / width))).alias("block"))
    low = F.col("block") * F.col("width")
    blocks = blocks.select("lang", "block", F.col("g").alias("group"), F.col("total").alias("total"), F.col("volume").alias("volume"), low.alias("low"), F.least(low + F.col("width"), F.col("volume")).alias("high"))
    cells = counts.join(groups.select("lang", "source", "g", "groups"), ["lang", "source"]).select("lang", F.floor(F.col("slot") / width).alias("block"), "g", "slot", "n")
    apart = cells.groupBy("lang", "block").cogroup(blocks.groupBy("lang", "block")).applyInArrow(_distances, "lang string, a long, b long, apart long")
    apart = apart.groupBy("lang", "a", "b").agg(F.sum("apart").alias("value"))
    both = apart.select("lang", "value", F.explode(F.array(F.struct(F.col("a").alias("g"), F.col("b").alias("o")), F.struct(F.col("b").alias("g"), F.col("a").alias("o")))).alias("p"))
    both = both.select("lang", "value", "p.g", "p.o")
    named = both.join(groups.select("lang", "g", "source"), ["lang", "g"]).join(groups.select("lang", F.col("g").alias("o"), F.col("source").alias("item")), ["lang", "o"])
    pairs = named.select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", F.row_number().over(by_value))
    return pairs.unionByName(best).withColumn("rank", F.col("rank").cast("int"))


def op12_source_divergence(spark, sf_dir):
    """Distances between sources and the terms that tell a source apart, for all documents."""
    return source_divergence(table(spark, sf_dir, "documents"))


SQL = f"""WITH d AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM documents),
kept AS (SELECT lang, term FROM (SELECT lang, unnest(list_distinct(w)) AS term FROM d) GROUP BY ALL HAVING count(*) >= {LEAST}),
counts AS (SELECT lang, source, term, count(*) AS n FROM (SELECT lang, source, unnest(w) AS term FROM d) SEMI JOIN kept USING (lang, term) GROUP BY ALL),
groups AS (SELECT g.lang, g.source, coalesce(sum(n), 0)::HUGEINT AS total FROM (SELECT DISTINCT lang, source FROM d) g LEFT JOIN counts c ON g.lang = c.lang AND g.source = c.source GROUP BY ALL),
volumes AS (SELECT lang, count(*) AS volume FROM kept GROUP BY lang),
p AS (SELECT g.lang, g.source, k.term, coalesce(n, 0) AS n, 1 + ({PARTS}::HUGEINT * (coalesce(n, 0) + {PRIOR})) // (total + {PRIOR} * volume) AS p
    FROM groups g JOIN kept k ON g.lang = k.lang JOIN volumes v ON v.lang = g.lang LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
q AS (SELECT lang, term, 1 + ({PARTS}::HUGEINT * (sum(n) + {PRIOR})) // ((SELECT sum(total) FROM groups g WHERE g.lang = counts.lang) + {PRIOR} * (SELECT volume FROM volumes v WHERE v.lang = counts.lang)) AS q
    FROM counts GROUP BY lang, term),
apart AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
    FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN apart x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
terms AS (SELECT p.lang, source, 'term' AS part, term AS item, (p - q)::BIGINT AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT * FROM ranked WHERE part = 'pair' OR rank <= {TOP}"""
