"""Per-person statistics, mentions, leaderboards, comparison, search."""

from __future__ import annotations

from pyspark.sql import functions as F

from parlance.model import Profile
from parlance.operators import enrich as en
from parlance.operators import mentions as mn
from parlance.operators import people as pe
from parlance.operators import search as se
from parlance.operators.ordering import top_k
from parlance.plans import views
from parlance.plans.catalog.registry import query
from parlance.streaming.sessions import conversations

E = views.sql_enriched("events")
D = views.sql_enriched("documents")
FIRST = "ROW_NUMBER() OVER (PARTITION BY chat_id ORDER BY"
# Words that the documents hold take the place of the built-in lists.
PROFILE = Profile(swear_words=("the", "und", "les"), laugh_words=("hahaha", "lol", "la", "\U0001F602"),
                  laugh_regex_patterns=(r"\b(?:ha){2,}h?\b", r"\b(?:en){2,}\b"), question_starters=("is", "what now", "the"))
# A run of word characters is what word boundaries stand around.
RUNS = "regexp_extract_all(lower(lexical_text), '[\\p{L}\\p{M}\\p{N}_]+')"


def event_rows(spark, sf):
    return en.with_lexical(en.enrich(views.events(spark, sf)))


def document_rows(spark, sf):
    return en.with_lexical(en.enrich(views.documents(spark, sf)))


COUNTS = """n AS (SELECT chat_id, sender, COUNT(*) AS total_messages, COUNT(*) FILTER (is_real_text AND NOT is_media) AS total_text_messages,
    COUNT(*) FILTER (is_media) AS media_sent, COUNT(*) FILTER (is_deleted) AS deleted_sent, COUNT(*) FILTER (is_edited) AS edited_sent,
    COUNT(*) FILTER (is_real_text) AS real_texts, CAST(COALESCE(SUM(word_count) FILTER (is_real_text), 0) AS BIGINT) AS real_words,
    CAST(COALESCE(SUM(char_count) FILTER (is_real_text), 0) AS BIGINT) AS real_chars,
    CAST(COALESCE(SUM(len(list_filter(runs, lambda x: x IN ('the', 'und', 'les')))) FILTER (is_real_text), 0) AS BIGINT) AS swear_count,
    CAST(COALESCE(SUM(len(list_filter(runs, lambda x: regexp_full_match(x, 'hahaha|lol|la|(ha){2,}h?|(en){2,}')))
        + length(lexical_text) - length(replace(lexical_text, '\U0001F602', ''))) FILTER (is_real_text), 0) AS BIGINT) AS laugh_count,
    COUNT(*) FILTER (is_real_text AND (lexical_text LIKE '%?%' OR runs[1] IN ('is', 'the') AND regexp_matches(lexical_text, '^\\s*(is|the)', 'i')
        OR regexp_matches(lexical_text, '^\\s*what now\\b', 'i'))) AS question_count,
    COUNT(*) FILTER (is_real_text AND length(lexical_text) >= 4 AND lexical_text = upper(lexical_text) AND lexical_text <> lower(lexical_text)) AS shout_count,
    CAST(COALESCE(SUM(length(lexical_text) - length(replace(lexical_text, '!', ''))) FILTER (is_real_text), 0) AS BIGINT) AS exclamation_count,
    CAST(COALESCE(SUM(len(regexp_extract_all(lexical_text, """ + views.EMOJI_SQL + """))) FILTER (is_real_text), 0) AS BIGINT) AS total_emojis,
    COUNT(*) FILTER (hour < 5) AS night_messages, COUNT(*) FILTER (hour BETWEEN 5 AND 9) AS early_messages,
    COUNT(DISTINCT date) AS active_days, MIN(ts) AS first_message, MAX(ts) AS last_message FROM r GROUP BY 1, 2)"""
RR = f", r AS (SELECT *, {RUNS} AS runs FROM e WHERE NOT is_system), "
VOCAB = ("w AS (SELECT chat_id, sender, lower(replace(UNNEST(regexp_extract_all(lexical_text, " + views.WORD_SQL + ")), '’', '''')) AS term "
         "FROM e WHERE NOT is_system AND is_real_text), v AS (SELECT chat_id, sender, COUNT(*) AS total_words, COUNT(DISTINCT term) AS unique_words FROM w GROUP BY 1, 2)")
TURNS = """ta AS (SELECT chat_id, sender, LAG(sender) OVER w AS ps, epoch(ts)::BIGINT - epoch(LAG(ts) OVER w)::BIGINT AS gap FROM e
    WHERE NOT is_system WINDOW w AS (PARTITION BY chat_id ORDER BY seq)),
    t AS (SELECT chat_id, sender, COUNT(*) FILTER (ps = sender) AS double_texts, COUNT(*) FILTER (gap >= 10800) AS conversation_starts FROM ta GROUP BY 1, 2)"""
HOURS = "h0 AS (SELECT chat_id, sender, hour, COUNT(*) AS n FROM e WHERE NOT is_system GROUP BY 1, 2, 3)"
PEAK = HOURS + ", h AS (SELECT chat_id, sender, hour AS peak_hour FROM h0 QUALIFY ROW_NUMBER() OVER (PARTITION BY chat_id, sender ORDER BY n DESC, hour) = 1)"
LONGEST = """l AS (SELECT chat_id, sender, substr(text, 1, 300) AS longest_text, CAST(word_count AS BIGINT) AS longest_words, ts AS longest_ts
    FROM e WHERE NOT is_system AND is_real_text QUALIFY ROW_NUMBER() OVER (PARTITION BY chat_id, sender ORDER BY word_count DESC, seq) = 1)"""
PEOPLE = """p AS (SELECT *, """ + FIRST + """ n DESC, sender) AS rank FROM
    (SELECT chat_id, sender, COUNT(*) AS n FROM e WHERE NOT is_system GROUP BY 1, 2 HAVING COUNT(*) >= 10))"""


@query(E + RR + COUNTS + " SELECT * FROM n")
def person_counts(spark, sf):
    return pe.person_counts(event_rows(spark, sf), PROFILE)


@query(D + RR + COUNTS + " SELECT * FROM n")
def writer_counts(spark, sf):
    return pe.person_counts(document_rows(spark, sf), PROFILE)


@query(D + ", " + VOCAB + " SELECT *, 100 * unique_words / total_words AS vocab_richness_pct FROM v")
def vocabulary(spark, sf):
    return pe.vocabulary(document_rows(spark, sf))


@query(E + ", " + HOURS + " SELECT * FROM h0")
def hourly_profile(spark, sf):
    return pe.hourly_profile(event_rows(spark, sf)).withColumn("hour", F.col("hour").cast("long"))


@query(E + ", " + PEAK + " SELECT * FROM h")
def peak_hour_per_person(spark, sf):
    return pe.peak_hours(event_rows(spark, sf)).withColumn("peak_hour", F.col("peak_hour").cast("long"))


@query(E + ", x AS (SELECT chat_id, sender, UNNEST(regexp_extract_all(lexical_text, " + views.EMOJI_SQL + ")) AS emoji FROM e WHERE NOT is_system AND is_real_text), "
       "c AS (SELECT chat_id, sender, emoji, COUNT(*) AS n FROM x GROUP BY 1, 2, 3) "
       "SELECT *, ROW_NUMBER() OVER (PARTITION BY chat_id, sender ORDER BY n DESC, emoji) AS rank FROM c QUALIFY rank <= 5")
def top_emojis(spark, sf):
    return pe.top_emojis(event_rows(spark, sf))


@query(D + ", " + LONGEST + " SELECT * FROM l")
def longest_message_per_person(spark, sf):
    return pe.longest_by_person(document_rows(spark, sf))


@query(E + ", " + TURNS + " SELECT * FROM t")
def turn_taking(spark, sf):
    return pe.turn_taking(event_rows(spark, sf), Profile(), cell_rows=512)


# Participants are looked up by their whole name; the digits of a mention make it up again. All share the first
# name, which therefore names somebody only in a chat with one participant.
EDGES = """, p AS (SELECT chat_id, sender FROM e WHERE NOT is_system GROUP BY 1, 2 HAVING COUNT(*) >= 10),
    a AS (SELECT chat_id, seq, sender AS src, concat('User ', regexp_extract(analysis_text, '@User (\\d+)', 1)) AS dst FROM e
        WHERE NOT is_system AND analysis_text LIKE '%@User %'),
    o AS (SELECT chat_id, MIN(sender) AS only_one FROM p GROUP BY 1 HAVING COUNT(*) = 1),
    g AS (SELECT a.chat_id, src, COALESCE(p.sender, only_one) AS dst, COUNT(*) AS cnt FROM a LEFT JOIN p ON a.chat_id = p.chat_id AND a.dst = p.sender
        LEFT JOIN o ON a.chat_id = o.chat_id WHERE COALESCE(p.sender, only_one) IS NOT NULL GROUP BY 1, 2, 3) """


def edges(spark, sf):
    rows = event_rows(spark, sf)
    return mn.mention_edges(rows, mn.name_lookup(en.participants(rows, 10)))


@query(E + EDGES + "SELECT * FROM g")
def mention_edges(spark, sf):
    return edges(spark, sf)


@query(E + """, p AS (SELECT chat_id, sender FROM e WHERE NOT is_system GROUP BY 1, 2 HAVING COUNT(*) >= 10),
    a AS (SELECT chat_id, sender AS src, concat('User ', regexp_extract(analysis_text, '@User (\\d+)', 1)) AS dst FROM e WHERE NOT is_system AND analysis_text LIKE '%@User %')
    SELECT a.chat_id, src, dst, COUNT(*) AS cnt FROM a JOIN p ON a.chat_id = p.chat_id AND a.dst = p.sender GROUP BY 1, 2, 3""")
def aliased_mentions(spark, sf):
    """Mentions by a nickname only. Nicknames of people below the minimum name somebody, but count for nobody."""
    rows = event_rows(spark, sf).withColumn("analysis_text", F.replace("analysis_text", F.lit("@User "), F.lit("@Nick Of ")))
    people = rows.where("sender IS NOT NULL").select(F.col("sender").alias("canonical")).distinct()
    aliases = people.select(F.replace("canonical", F.lit("User"), F.lit("Nick of")).alias("alias_key"), "canonical")
    who = en.participants(rows, 10)
    return mn.mention_edges(rows, mn.name_lookup(who, aliases, everyone=en.participants(rows)))


@query(E + EDGES + """, s AS (SELECT chat_id, src AS sender, cnt AS given, 0 AS received FROM g UNION ALL SELECT chat_id, dst, 0, cnt FROM g)
    SELECT chat_id, sender, CAST(SUM(given) AS BIGINT) AS mentions_given, CAST(SUM(received) AS BIGINT) AS mentions_received FROM s GROUP BY 1, 2""")
def mention_totals(spark, sf):
    return mn.mention_totals(edges(spark, sf))


@query(E + EDGES + "SELECT *, " + FIRST + " cnt DESC, src, dst) AS rank FROM g QUALIFY rank <= 15")
def top_tagging_pairs(spark, sf):
    return top_k(edges(spark, sf), ["chat_id"], [F.desc("cnt"), F.asc("src"), F.asc("dst")], 15)


@query(E + EDGES + """, s AS (SELECT chat_id, src AS sender, cnt FROM g UNION ALL SELECT chat_id, dst, cnt FROM g),
    t AS (SELECT chat_id, sender, CAST(SUM(cnt) AS BIGINT) AS mentions FROM s GROUP BY 1, 2)
    SELECT *, """ + FIRST + """ mentions DESC, sender) AS rank FROM t QUALIFY rank <= 15""")
def top_tagged_people(spark, sf):
    totals = mn.mention_totals(edges(spark, sf)).select(
        "chat_id", "sender", (F.col("mentions_given") + F.col("mentions_received")).alias("mentions"))
    return top_k(totals, ["chat_id"], [F.desc("mentions"), F.asc("sender")], 15)


@query(E + """, p AS (SELECT chat_id, sender FROM e WHERE NOT is_system GROUP BY 1, 2 HAVING COUNT(*) >= 10),
    k AS (SELECT e.*, regexp_extract(analysis_text, '@User (\\d+)', 1) AS d, p.sender IS NOT NULL AS known FROM e LEFT JOIN p
        ON e.chat_id = p.chat_id AND p.sender = concat('User ', regexp_extract(analysis_text, '@User (\\d+)', 1))),
    x AS (SELECT chat_id, seq, regexp_replace(CASE WHEN known THEN replace(analysis_text, concat('@User ', d), ' ') ELSE analysis_text END,
        '@\\w+', ' ', 'g') AS lexical_text FROM k)
    SELECT *, len(regexp_extract_all(lexical_text, """ + views.WORD_SQL + """)) AS word_count FROM x""")
def texts_without_mentions(spark, sf):
    rows = en.enrich(views.events(spark, sf))
    lookup = mn.name_lookup(en.participants(rows, 10))
    return mn.without_mentions(rows, lookup).select("chat_id", "seq", "lexical_text", "word_count")


STATS = E + RR + ", ".join([COUNTS, VOCAB, TURNS, PEAK, LONGEST, PEOPLE]) + EDGES.replace(", p AS (SELECT chat_id, sender FROM e WHERE NOT is_system GROUP BY 1, 2 HAVING COUNT(*) >= 10)", "") + """,
    gi AS (SELECT chat_id, src AS sender, CAST(SUM(cnt) AS BIGINT) AS mentions_given FROM g GROUP BY 1, 2),
    re AS (SELECT chat_id, dst AS sender, CAST(SUM(cnt) AS BIGINT) AS mentions_received FROM g GROUP BY 1, 2),
    al AS (SELECT chat_id, COUNT(*) FILTER (NOT is_system) AS c, MAX(date) - MIN(date) + 1 AS d FROM e GROUP BY 1),
    st AS (SELECT p.chat_id, p.sender, p.rank, total_messages, total_text_messages, media_sent, deleted_sent, edited_sent, active_days,
    first_message, last_message, swear_count, laugh_count, question_count, shout_count, exclamation_count, total_emojis,
    COALESCE(total_words, 0) AS total_words, COALESCE(unique_words, 0) AS unique_words,
    COALESCE(100 * unique_words / total_words, 0) AS vocab_richness_pct, peak_hour, longest_text, COALESCE(longest_words, 0) AS longest_words,
    longest_ts, conversation_starts, COALESCE(mentions_given, 0) AS mentions_given, COALESCE(mentions_received, 0) AS mentions_received,
    100 * total_messages / c AS pct_of_all_messages, total_messages / active_days AS avg_messages_per_day_active, total_messages / d AS avg_messages_per_day_overall,
    CASE WHEN real_texts > 0 THEN real_words / real_texts ELSE 0 END AS avg_words_per_message,
    CASE WHEN real_texts > 0 THEN real_chars / real_texts ELSE 0 END AS avg_chars_per_message,
    100 * swear_count / total_messages AS swear_rate_per_100, 100 * laugh_count / total_messages AS laugh_rate_per_100,
    100 * question_count / total_messages AS question_rate_per_100, 100 * night_messages / total_messages AS night_owl_pct,
    100 * early_messages / total_messages AS early_bird_pct, 100 * double_texts / total_messages AS double_text_rate_pct
    FROM p JOIN n USING (chat_id, sender) JOIN al USING (chat_id) LEFT JOIN v USING (chat_id, sender) LEFT JOIN t USING (chat_id, sender)
    LEFT JOIN h USING (chat_id, sender) LEFT JOIN l USING (chat_id, sender) LEFT JOIN gi USING (chat_id, sender) LEFT JOIN re USING (chat_id, sender)) """


def stats(spark, sf):
    rows = pe.person_rows(event_rows(spark, sf))
    who = en.participants(rows, 10)
    return pe.person_stats(rows, who, PROFILE, mn.mention_edges(rows, mn.name_lookup(who)), cell_rows=4096)


@query(STATS + "SELECT * FROM st")
def person_stats(spark, sf):
    return stats(spark, sf)


@query(STATS + ", u AS (" + " UNION ALL ".join(
    f"SELECT chat_id, sender, rank, '{b}' AS board, CAST({m} AS DOUBLE) AS value FROM st" for b, m in pe.LEADERBOARDS.items())
    + ") SELECT chat_id, sender, board, value, ROW_NUMBER() OVER (PARTITION BY chat_id, board ORDER BY value DESC, rank) AS place FROM u")
def leaderboards(spark, sf):
    return pe.leaderboards(stats(spark, sf))


@query(STATS + ", u AS (" + " UNION ALL ".join(
    f"SELECT chat_id, sender, '{m}' AS metric, CAST({m} AS DOUBLE) AS value FROM st" for m in pe.COMPARED)
    + ") SELECT x.chat_id, x.metric, x.value AS a, y.value AS b FROM u x JOIN u y USING (chat_id, metric) WHERE x.sender = 'User 3' AND y.sender = 'User 6'")
def two_people_compared(spark, sf):
    return pe.compare(stats(spark, sf), "User 3", "User 6")


SEARCH = E + ", " + PEOPLE + """, s AS (SELECT e.chat_id, seq, ts, e.sender, CAST(epoch(ts) AS BIGINT) AS epoch, rank - 1 AS sender_idx,
    CASE WHEN is_media THEN CASE WHEN is_real_text THEN analysis_text ELSE '' END WHEN is_deleted THEN '' ELSE trim(replace(text, chr(10), ' ')) END AS text,
    CASE WHEN is_media THEN 1 WHEN is_deleted THEN 2 ELSE 0 END AS flag
    FROM e JOIN p ON e.chat_id = p.chat_id AND e.sender = p.sender WHERE NOT is_system AND (is_real_text OR is_media OR is_deleted)) """


def search(spark, sf):
    rows = event_rows(spark, sf)
    return se.search_messages(rows, en.participants(rows, 10))


@query(SEARCH + "SELECT * FROM s")
def search_table(spark, sf):
    return search(spark, sf)


@query(SEARCH + """, x AS (SELECT *, len(list_filter(regexp_extract_all(lower(text), '[\\p{L}\\p{M}\\p{N}_]+'), lambda x: x IN ('clicked', 'nice'))) AS k FROM s)
    SELECT chat_id, sender, COUNT(*) AS messages, CAST(SUM(k) AS BIGINT) AS occurrences, MIN(ts) AS first_ts, MAX(ts) AS last_ts FROM x WHERE k > 0 GROUP BY 1, 2""")
def term_search(spark, sf):
    return se.term_matches(search(spark, sf), "clicked", ["nice"])


@query(SEARCH + """, x AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY chat_id ORDER BY seq) AS a, ROW_NUMBER() OVER (PARTITION BY chat_id ORDER BY seq DESC) AS z,
    COUNT(*) OVER (PARTITION BY chat_id) AS c FROM s WHERE regexp_matches(text, '\\bbought\\b', 'i'))
    SELECT i.chat_id, i.c AS messages, i.ts AS first_ts, i.sender AS first_by, substr(i.text, 1, 180) AS first_text,
    j.ts AS last_ts, j.sender AS last_by, substr(j.text, 1, 180) AS last_text FROM x i JOIN x j ON i.chat_id = j.chat_id AND i.a = 1 AND j.z = 1""")
def term_first_and_latest(spark, sf):
    return se.term_span(search(spark, sf), "bought")


@query(SEARCH + """, x AS (SELECT *, CAST(ts AS DATE) AS date FROM s WHERE ts >= '2024-01-08' AND ts < '2024-01-15')
    SELECT x.chat_id, sender, COUNT(*) AS messages, t.total, t.active_days, t.total / t.active_days AS avg_per_active_day
    FROM x JOIN (SELECT chat_id, COUNT(*) AS total, COUNT(DISTINCT date) AS active_days FROM x GROUP BY 1) t ON x.chat_id = t.chat_id GROUP BY ALL""")
def date_range_explorer(spark, sf):
    return se.date_range(search(spark, sf), "2024-01-08", "2024-01-14")


@query(E + """, g AS (SELECT chat_id, seq, ts, sender, CASE WHEN epoch(ts) - epoch(LAG(ts) OVER w) >= 3600 OR LAG(ts) OVER w IS NULL THEN 1 ELSE 0 END AS f
    FROM e WHERE NOT is_system WINDOW w AS (PARTITION BY chat_id ORDER BY seq)),
    i AS (SELECT *, SUM(f) OVER (PARTITION BY chat_id ORDER BY seq) AS k FROM g)
    SELECT chat_id, MIN(seq) AS conversation, MIN(ts) AS start_ts, MAX(ts) AS end_ts, COUNT(*) AS messages, COUNT(DISTINCT sender) AS people
    FROM i GROUP BY chat_id, k""")
def conversation_sessions(spark, sf):
    return conversations(event_rows(spark, sf), Profile(conversation_gap_hours=1), cell_rows=512)
