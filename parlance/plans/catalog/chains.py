"""Repeat chains."""

from __future__ import annotations

from pyspark.sql import functions as F

from parlance.functions import times as tm
from parlance.model import Profile
from parlance.operators import chains as ch
from parlance.operators.enrich import enrich
from parlance.operators.slices import sliced
from parlance.plans import views
from parlance.plans.catalog.registry import query
from parlance.session import materialize

# Event type and a letter for the amount: some thirty texts that are no typos of each other.
_TEXT = "concat(event_type, ' ', repeat(chr(97 + CAST(floor(value) AS INT) % 6), 6))"
RUNS = f"""WITH m AS (SELECT CAST(CASE WHEN user_id % 3 = 0 THEN 0 ELSE user_id % 10 END AS BIGINT) AS chat_id, event_id AS seq, date_trunc('minute', ts) AS ts,
    concat('User ', user_id) AS sender, {_TEXT} AS norm FROM events),
    g AS (SELECT *, CASE WHEN norm = LAG(norm) OVER w THEN 0 ELSE 1 END AS f FROM m WINDOW w AS (PARTITION BY chat_id ORDER BY seq)),
    i AS (SELECT *, SUM(f) OVER (PARTITION BY chat_id ORDER BY seq) AS k FROM g)"""


# Cycles of one or two texts and no interruptions: stretches of equal texts and of period two. The walk skips a stretch of four rows
# whose first row ended the chain before it; of those that overlap the longest stays, then the shorter cycle, then the earlier.
STRICT = RUNS.replace("WITH m AS", "WITH RECURSIVE m AS") + """, n AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY chat_id ORDER BY seq) - 1 AS pos FROM m),
    same AS (SELECT *, LAG(norm) OVER w AS one, LAG(norm, 2) OVER w AS two FROM n WINDOW w AS (PARTITION BY chat_id ORDER BY pos)),
    runs AS (SELECT chat_id, MIN(pos) - 1 AS a, MAX(pos) AS z FROM (SELECT *, pos - ROW_NUMBER() OVER (PARTITION BY chat_id ORDER BY pos) AS k FROM same WHERE norm = one) GROUP BY chat_id, k),
    turns AS (SELECT chat_id, MIN(pos) - 2 AS a, MAX(pos) AS z, BOOL_AND(norm = one) AS dull
        FROM (SELECT *, pos - ROW_NUMBER() OVER (PARTITION BY chat_id ORDER BY pos) AS k FROM same WHERE norm = two) GROUP BY chat_id, k HAVING COUNT(*) >= 2),
    linked AS (SELECT *, CASE WHEN z - a = 3 AND a = LAG(z) OVER w THEN 0 ELSE 1 END AS fresh, ROW_NUMBER() OVER w AS k FROM turns WINDOW w AS (PARTITION BY chat_id ORDER BY a)),
    met AS (SELECT *, MAX(CASE WHEN fresh = 1 THEN k END) OVER (PARTITION BY chat_id ORDER BY k) AS anchor FROM linked),
    spans AS (SELECT chat_id, 1 AS p, a, z FROM runs WHERE z - a >= 2 UNION ALL SELECT chat_id, 2, a, z FROM met WHERE NOT dull AND (k - anchor) % 2 = 0),
    peopled AS (SELECT spans.*, (SELECT COUNT(DISTINCT sender) FROM n WHERE n.chat_id = spans.chat_id AND pos BETWEEN a AND z) AS people FROM spans),
    found AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY chat_id ORDER BY z - a DESC, p, a) AS k FROM peopled WHERE people >= 2 OR p > 1),
    pick AS (SELECT DISTINCT chat_id, CAST(0 AS BIGINT) AS k, CAST([] AS STRUCT(p INT, a BIGINT, z BIGINT)[]) AS taken FROM found
        UNION ALL SELECT f.chat_id, f.k, CASE WHEN len(list_filter(taken, lambda t: t.a <= f.z AND t.z >= f.a)) = 0 THEN list_append(taken, {'p': f.p, 'a': f.a, 'z': f.z}) ELSE taken END
        FROM pick JOIN found f ON f.chat_id = pick.chat_id AND f.k = pick.k + 1),
    chosen AS (SELECT chat_id, unnest(arg_max(taken, k)) AS t FROM pick GROUP BY chat_id),
    c AS (SELECT chat_id, CAST(t.p AS INT) AS cycle_length, t.z - t.a + 1 AS members, t.a AS first_pos, t.z AS last_pos FROM chosen)"""
NO_GAPS = Profile(chain_max_cycle=2, chain_tolerance=0)


def messages(spark, sf):
    columns = {**views.EVENT_COLUMNS, "text": _TEXT, "sender": "concat('User ', CAST(user_id AS STRING))", "is_system": "false"}
    rows = views.table(spark, sf, "events").select(*(F.expr(e).alias(c) for c, e in columns.items()), tm.to_minute(F.col("ts")).alias("ts"))
    return enrich(rows)


def sequence(spark, sf):
    return ch.chain_rows(messages(spark, sf), cell_rows=1024)


@query(RUNS + """ SELECT chat_id, MIN(seq) AS run, norm, COUNT(*) AS length, COUNT(DISTINCT sender) AS people, MIN(ts) AS start_ts, MAX(ts) AS end_ts
    FROM i GROUP BY chat_id, k, norm HAVING COUNT(*) >= 2 AND COUNT(DISTINCT sender) >= 2""")
def exact_runs(spark, sf):
    return ch.exact_runs(ch.chain_texts(messages(spark, sf)), Profile(chain_min_length=2), cell_rows=1024)


@query(STRICT + " SELECT * FROM c")
def strict_chains(spark, sf):
    """Chains of cycles one and two without interruptions, in cells so small that chains cross them."""
    rows = materialize(sequence(spark, sf), "sequence")
    return ch.find_chains(rows, NO_GAPS, cell_rows=1024, scan_rows=16)[0].drop("start")


@query(STRICT + """, r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY chat_id ORDER BY members DESC, cycle_length, first_pos) AS place, COUNT(*) OVER (PARTITION BY chat_id) AS total_found FROM c),
    h AS (SELECT r.*, n.pos, n.ts, n.sender, n.norm FROM r JOIN n ON n.chat_id = r.chat_id AND n.pos BETWEEN first_pos AND last_pos WHERE place <= 10),
    t AS (SELECT chat_id, place, sender, COUNT(*) AS k, MIN(pos) AS f FROM h GROUP BY ALL),
    s AS (SELECT chat_id, place, string_agg(concat(sender, ' ', k), ', ' ORDER BY k DESC, f) AS participants FROM t GROUP BY ALL)
    SELECT chat_id, CAST(place AS INT) AS place, members AS length, cycle_length, members / cycle_length AS repetitions, MIN(ts) AS start_ts, MAX(ts) AS end_ts, ANY_VALUE(participants) AS participants,
        string_agg(norm, ' | ' ORDER BY pos) FILTER (pos < first_pos + cycle_length) AS pattern, CAST(least(members, 40) AS INT) AS shown, COUNT(*) AS span, total_found
    FROM h JOIN s USING (chat_id, place) GROUP BY chat_id, place, members, cycle_length, total_found""")
def strict_chain_report(spark, sf):
    """The report on those chains: who takes part, the pattern, the messages shown."""
    rows = materialize(sequence(spark, sf), "sequence")
    found, runs = ch.find_chains(rows, NO_GAPS, cell_rows=1024)
    report = ch.chain_report(rows, found, runs, NO_GAPS, cell_rows=1024)
    said = F.transform("participants", lambda x: F.concat_ws(" ", x["name"], x["count"].cast("string")))
    return report.select("chat_id", "place", "length", "cycle_length", "repetitions", "start_ts", "end_ts", F.array_join(said, ", ").alias("participants"),
                         F.array_join(F.transform("pattern", lambda x: F.lower(x["text"])), " | ").alias("pattern"),
                         F.size("messages").alias("shown"), "span", "total_found")


# The last two weeks of every chat are a sequence of their own.
SLICED = STRICT.replace(", n AS (SELECT *,", """, x AS (SELECT *, CAST(ts AS DATE) >= CAST(MAX(ts) OVER (PARTITION BY chat_id) AS DATE) - 13 AS late FROM m),
    m2 AS (SELECT chat_id * 2 AS chat_id, seq, ts, sender, norm FROM x UNION ALL SELECT chat_id * 2 + 1, seq, ts, sender, norm FROM x WHERE late), n AS (SELECT *,""").replace("- 1 AS pos FROM m)", "- 1 AS pos FROM m2)")


@query(SLICED + " SELECT chat_id // 2 AS chat_id, CASE chat_id % 2 WHEN 0 THEN 'full' ELSE 'last' END AS slice, cycle_length, members, first_pos, last_pos FROM c")
def sliced_chains(spark, sf):
    """Chains of the whole chat and of its last days, in one run."""
    keys = ["chat_id", "slice"]
    cut = sliced(messages(spark, sf), Profile(last_period_days=14))
    rows = materialize(ch.chain_rows(cut, keys, cell_rows=1024), "sequence")
    return ch.find_chains(rows, NO_GAPS, keys, cell_rows=1024)[0].drop("start")


@query("""WITH m AS (SELECT CAST(CASE lang WHEN 'en' THEN 0 WHEN 'fr' THEN 1 WHEN 'de' THEN 2 ELSE 3 END AS BIGINT) AS chat_id, (doc_id % 2160) * 1000000000000 + doc_id AS seq, source AS sender, text FROM documents)
    SELECT chat_id, ROW_NUMBER() OVER (PARTITION BY chat_id ORDER BY seq) - 1 AS pos, sender,
    trim(regexp_replace(regexp_replace(replace(lower(text), 'ß', 'ss'), '[\\p{P}\\p{Sm}\\p{Sc}\\p{Sk}]', '', 'g'), '\\s+', ' ', 'g')) AS norm FROM m""")
def folded_texts(spark, sf):
    """Texts in four languages as chains compare them."""
    return ch.chain_rows(enrich(views.documents(spark, sf))).select("chat_id", "pos", "sender", "norm")


@query()
def chains(spark, sf):
    rows = materialize(sequence(spark, sf), "sequence")
    return ch.find_chains(rows, Profile(), cell_rows=1024)[0]


@query()
def chain_report(spark, sf):
    rows = materialize(sequence(spark, sf), "sequence")
    found, runs = ch.find_chains(rows, Profile())
    return ch.chain_report(rows, found, runs, Profile())
