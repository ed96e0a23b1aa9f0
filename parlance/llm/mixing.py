"""A mix of sources at target weights: certain whole copies first, the rest as Pareto order samples of fixed size.

A source's documents are all wanted target / size times. The whole part of that ratio is copies that every document
gets for certain. What is then still owed is a sample without repeats: documents fall into strata (source, octave of
size), a stratum takes a fixed number n of its documents, and each has an inclusion probability p around n / count,
tilted along its size so that the expected words are the ones owed. Pareto order sampling takes the n documents with the
smallest ratio of random odds to inclusion odds, where u comes from a hash of id and text, so reruns agree.

Sizes are worked off in BANDS, long documents first. A band sees what the bands before it really took, so the chance
in which long documents were drawn is made good by short ones, and a source ends within a few words of its target
unless its documents are few and long.

Everything is built-in functions. No stratum is sorted as a whole: ratios fall into cells of about CELL rows, counts of
cells tell which one holds the n-th ratio, and only that one is ordered. The window over sources holds one row a source.

Defined cases: a null text is an empty one and has size 0, as has a text of spaces alone; it is taken 0 words. Null
sources are one source, the last. Rows that repeat are documents of their own. Sources without words have target 0.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parlance.llm.columns import stored, table

WEIGHTS = (1, 2, 3)
MOST = 3
#: Least size of a document in each band; powers of two, so that an octave lies in one band.
BANDS = (4096, 512, 64, 1)
CELL = 1 << 12
_HEX = 13  # digits of the hash in u


def sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, octave, k, key): words of each document, and the hash its luck comes from."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    doc = F.col("doc_id").cast("long")
    rows = docs.select(
        doc.alias("doc_id"), F.col("source").cast("string").alias("source"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("size"),
        F.md5(F.concat(F.coalesce(doc.cast("string"), F.lit("")), F.lit("|"), text)).alias("hex"))
    octave = F.when(F.col("size") > 0, F.length(F.bin("size"))).otherwise(0)
    return rows.select("doc_id", "source", "size", octave.alias("octave"),
                       F.conv(F.substring("hex", 1, _HEX), 16, 10).cast("long").alias("k"), F.unhex("hex").alias("key"))


def targets(totals: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, target, copies, owed) from (source, source_size).

    The sources share all words by weight; one that would pass `most` times its size stops there. Ordered by cap over
    weight, those that stop come first, so the common level is read off running sums.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    rows = totals.withColumn("place", place)
    rows = rows.select("source", "source_size", "place", (F.col("source_size") * most).alias("cap"),
                       F.element_at(F.array(*map(F.lit, weights)), ((F.col("place") - 1) % len(weights) + 1).cast("int")).cast("long").alias("w"))
    order = Window.orderBy((F.col("cap") / F.col("w")).asc(), "place")
    everyone = Window.partitionBy(F.lit(0))
    rows = rows.withColumns({
        "turn": F.row_number().over(order),
        "level": (F.sum("source_size").over(everyone) - F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, 0)) + F.col("cap"))
        / (F.sum("w").over(everyone) - F.sum("w").over(order.rowsBetween(Window.unboundedPreceding, 0)) + F.col("w")),
    })
    free = F.col("cap") > F.col("w") * F.col("level")
    rows = rows.withColumn("level", F.min(F.when(free, F.struct("turn", "level"))).over(everyone)["level"])
    rows = rows.withColumn("target", F.coalesce(F.least(F.col("cap").cast("double"), F.col("w") * F.col("level")), F.lit(0.0)))
    copies = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    return rows.withColumn("copies", copies.cast("long")).select(
        "source", "source_size", "target", "copies", (F.col("target") - F.col("copies") * F.col("source_size")).alias("owed"))


def _odds(p):
    return p / (1 - p)


def _by_stratum(a: DataFrame, b: DataFrame, names=("source", "octave")) -> DataFrame:
    """Left join on columns that may be null."""
    renamed = b.withColumnsRenamed({n: f"{n}_" for n in names})
    same = reduce(lambda x, y: x & y, (F.col(n).eqNullSafe(F.col(f"{n}_")) for n in names))
    return a.join(renamed, same, "left").drop(*(f"{n}_" for n in names))


def plan(strata: DataFrame, owed: DataFrame, least: int) -> DataFrame:
    """(source, octave, n, picks, share, slope, mean, cells) for the octaves of one band: how many documents to pick,
    and their inclusion probability share + slope * (size - mean)."""
    rest = strata.groupBy("source").agg(F.sum("words").alias("rest"))
    rows = _by_stratum(_by_stratum(strata.where(F.col("low") >= least), rest, ["source"]), owed, ["source"])
    part = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("owed") / F.col("rest")))
    rows = rows.withColumns({"part": part, "mean": F.col("words") / F.col("n")})
    rows = rows.withColumn("picks", F.floor(F.col("part") * F.col("n") + 0.5).cast("long"))
    rows = rows.withColumn("share", F.col("picks") / F.col("n"))
    spread = F.col("squares").cast("double") - F.col("words") * F.col("mean")
    slope = (F.col("part") * F.col("words") - F.col("picks") * F.col("mean")) / spread
    steepest = F.least(F.col("share"), 1 - F.col("share")) * 0.9 / F.greatest(F.col("high") - F.col("mean"), F.col("mean") - F.col("low"))
    tilt = F.when((F.col("high") > F.col("low")) & (spread > 0), F.greatest(-steepest, F.least(steepest, slope))).otherwise(0.0)
    return rows.select("source", "octave", "n", "picks", "share", tilt.alias("slope"), "mean",
                       F.ceil(F.col("n") / CELL).alias("cells"))


def pareto_picks(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """`rows` with `picked`: in each stratum of `plan` the rows with the smallest odds ratios, as many as it says."""
    u = (F.col("k") + 0.5) / float(1 << 4 * _HEX)
    chance = F.col("share") + F.col("slope") * (F.col("size") - F.col("mean"))
    ratio = _odds(u) * (_odds(F.col("share")) / _odds(chance))
    # The stratum's own odds cancel the greater part of the inclusion odds: same order, and values spread evenly over (0, 1).
    drawn = (F.col("picks") > 0) & (F.col("picks") < F.col("n"))
    cut = _by_stratum(rows, plan).withColumn("v", F.when(drawn, ratio / (1 + ratio)).otherwise(0.0))
    cut = cut.withColumn("cell", F.least(F.floor(F.col("v") * F.col("cells")), F.col("cells") - 1))
    counts = cut.where(drawn).groupBy("source", "octave", "picks", "cell").agg(F.count("*").alias("in_cell"))
    upto = F.sum("in_cell").over(Window.partitionBy("source", "octave").orderBy("cell"))
    edges = counts.withColumn("upto", upto).where((F.col("upto") >= F.col("picks")) & (F.col("upto") - F.col("in_cell") < F.col("picks")))
    edges = edges.select("source", "octave", F.col("cell").alias("edge"), (F.col("picks") - F.col("upto") + F.col("in_cell")).alias("left"))
    held = _by_stratum(cut, edges)
    at_edge = F.coalesce(F.col("cell") == F.col("edge"), F.lit(False))
    sure = held.where(~at_edge).withColumn("picked", F.when(F.col("edge").isNull(), F.col("picks") > 0).otherwise(F.col("cell") < F.col("edge")))
    turn = F.row_number().over(Window.partitionBy("source", "octave").orderBy("v", "key"))
    ranked = held.where(at_edge).withColumn("turn", turn).withColumn("picked", F.col("turn") <= F.col("left")).drop("turn")
    return sure.unionByName(ranked).select(*rows.columns, "picked")


def mixed(docs: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken) of every document of the mix."""
    rows = stored(sizes(docs), "mix-sizes")
    size = F.col("size")
    strata = stored(rows.groupBy("source", "octave").agg(
        F.count("*").alias("n"), F.sum(size).alias("words"), F.sum((size * size).cast("decimal(38,0)")).alias("squares"),
        F.min(size).alias("low"), F.max(size).alias("high")), "mix-strata")
    shares = stored(targets(strata.groupBy("source").agg(F.sum("words").alias("source_size")), weights, most), "mix-targets")
    drawn = [rows.where(size == 0).withColumn("picked", F.lit(False))]
    for least, above in zip(BANDS, (None, *BANDS)):
        below = strata.where(F.col("low") > 0) if above is None else strata.where((F.col("low") > 0) & (F.col("low") < above))
        band = rows.where(size >= least) if above is None else rows.where((size >= least) & (size < above))
        took = reduce(DataFrame.unionByName, drawn).where("picked").groupBy("source").agg(F.sum(size).alias("took"))
        owed = _by_stratum(shares.select("source", "owed"), took, ["source"]).select("source", (F.col("owed") - F.coalesce("took", F.lit(0))).alias("owed"))
        drawn.append(stored(pareto_picks(band, stored(plan(below, owed, least), "mix-plan")), "mix-picks"))
    mix = _by_stratum(reduce(DataFrame.unionByName, drawn), shares.drop("owed"), ["source"])
    copies = F.col("copies") + F.col("picked").cast("long")
    return mix.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * size).alias("taken"))


def op13_source_mix(spark, sf_dir):
    """What the mix of all documents takes of each."""
    return mixed(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def _sql() -> str:
    """The same draw in SQL, with whole windows in place of cells."""
    parts = [f"""WITH r AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
    md5(coalesce(doc_id::VARCHAR, '') || '|' || coalesce(text, '')) AS key FROM documents),
rows AS (SELECT *, CASE WHEN size > 0 THEN len(ltrim(bin(size), '0')) ELSE 0 END AS octave, (('0x' || key[1:{_HEX}])::BIGINT::DOUBLE + 0.5::DOUBLE) / {1 << 4 * _HEX}::DOUBLE AS u FROM r),
strata AS (SELECT source, octave, count(*) AS n, sum(size)::BIGINT AS words, sum(size::HUGEINT * size)::DOUBLE AS squares, min(size) AS low, max(size) AS high FROM rows GROUP BY ALL),
s0 AS (SELECT source, sum(words)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM strata GROUP BY source),
s1 AS (SELECT *, source_size * {MOST} AS cap, (place - 1) % {len(WEIGHTS)} + 1 AS w FROM s0),
s2 AS (SELECT *, row_number() OVER o AS turn, (sum(source_size) OVER () - sum(cap) OVER o + cap)::DOUBLE / (sum(w) OVER () - sum(w) OVER o + w)::DOUBLE AS level
    FROM s1 WINDOW o AS (ORDER BY cap / w::DOUBLE, place ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
s3 AS (SELECT *, coalesce(least(cap::DOUBLE, w * (SELECT arg_min(level, turn) FROM s2 WHERE cap > w * level)), 0::DOUBLE) AS target FROM s2),
shares AS (SELECT source, source_size, target, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS copies FROM s3),
owed0 AS (SELECT source, target - copies * source_size AS owed FROM shares)"""]
    for b, (least, above) in enumerate(zip(BANDS, (1 << 62, *BANDS))):
        parts.append(f"""below{b} AS (SELECT * FROM strata WHERE low > 0 AND low < {above}),
part{b} AS (SELECT s.*, greatest(0::DOUBLE, least(1::DOUBLE, owed / (SELECT sum(words) FROM below{b} t WHERE t.source IS NOT DISTINCT FROM s.source)::DOUBLE)) AS part,
    words / n::DOUBLE AS mean FROM below{b} s JOIN owed{b} o ON s.source IS NOT DISTINCT FROM o.source WHERE low >= {least}),
picks{b} AS (SELECT *, floor(part * n + 0.5::DOUBLE)::BIGINT AS picks, picks / n::DOUBLE AS share FROM part{b}),
plan{b} AS (SELECT *, least(share, 1 - share) * 0.9::DOUBLE / nullif(greatest(high - mean, mean - low), 0) AS steepest, CASE WHEN high > low AND squares - words * mean > 0
    THEN greatest(-steepest, least(steepest, (part * words - picks * mean) / (squares - words * mean))) ELSE 0::DOUBLE END AS slope FROM picks{b}),
odds{b} AS (SELECT r.*, picks, n, share, share + slope * (size - mean) AS p, CASE WHEN picks > 0 AND picks < n
    THEN (u / (1 - u)) * ((share / (1 - share)) / (p / (1 - p))) ELSE 0::DOUBLE END AS x
    FROM rows r JOIN plan{b} q ON r.source IS NOT DISTINCT FROM q.source AND r.octave = q.octave),
drawn{b} AS (SELECT doc_id, source, size, row_number() OVER (PARTITION BY source, octave ORDER BY x / (1 + x), key) <= picks AS picked FROM odds{b}),
drawn_to{b} AS (SELECT * FROM drawn{b}{f" UNION ALL SELECT * FROM drawn_to{b - 1}" if b else ""}),
owed{b + 1} AS (SELECT o.source, o.owed - coalesce((SELECT sum(size) FROM drawn_to{b} d WHERE picked AND d.source IS NOT DISTINCT FROM o.source), 0)::DOUBLE AS owed FROM owed0 o)""")
    union = " UNION ALL ".join(f"SELECT * FROM drawn{b}" for b in range(len(BANDS)))
    return ",\n".join(parts) + f"""
SELECT doc_id, size, source_size, target, ((copies + picked::BIGINT) * size)::BIGINT AS taken
FROM ({union} UNION ALL SELECT doc_id, source, size, false FROM rows WHERE size = 0) d JOIN shares s ON d.source IS NOT DISTINCT FROM s.source"""


SQL = _sql()
