"""Enrichment, slices, totals, calendars, gaps and streaks."""

from __future__ import annotations

from pyspark.sql import functions as F

from parlance.functions import text as tx
from parlance.functions import times as tm
from parlance.model import Profile
from parlance.operators import enrich as en
from parlance.operators import summary as su
from parlance.operators.ordering import previous_row
from parlance.operators.slices import sliced
from parlance.plans import views
from parlance.plans.catalog.registry import query
from parlance.sources.tables import from_table

E = views.sql_enriched("events")
C = views.sql_enriched("conversations")
FIRST = "ROW_NUMBER() OVER (PARTITION BY chat_id ORDER BY"


def enriched(spark, sf):
    """Events with flags and lexical text; a query reads and works out what it uses."""
    return en.with_lexical(en.enrich(views.events(spark, sf)))


def daily(spark, sf):
    return su.daily_counts(enriched(spark, sf))


@query(E + """SELECT chat_id, seq, ts, sender, text, is_system, is_edited, is_media, is_deleted, is_call, analysis_text,
    is_real_text, date, CAST(hour AS INTEGER) AS hour, weekday, CAST(weekday_num AS INTEGER) AS weekday_num, month_period,
    char_count, CAST(len(regexp_extract_all(analysis_text, """ + views.WORD_SQL + """)) AS BIGINT) AS word_count FROM e""")
def enriched_messages(spark, sf):
    return en.enrich(views.events(spark, sf)).select(
        "chat_id", "seq", "ts", "sender", "text", "is_system", "is_edited", "is_media", "is_deleted", "is_call",
        "analysis_text", "is_real_text", "date", "hour", "weekday", "weekday_num", "month_period", "char_count", "word_count")


@query(C + """SELECT chat_id, seq, sender, analysis_text, is_real_text, char_count, lexical_text,
    CAST(word_count AS BIGINT) AS word_count FROM e""")
def conversation_texts(spark, sf):
    return en.with_lexical(en.enrich(views.conversations(spark, sf))).select(
        "chat_id", "seq", "sender", "analysis_text", "is_real_text", "char_count", "lexical_text", "word_count")


@query(E + """SELECT chat_id, lower(text) LIKE '%omitted%' OR lower(text) LIKE '%this message was deleted%'
    OR lower(text) LIKE '%missed voice call%' AS media, lower(text) LIKE '%waiting for this message%' AS placeholder,
    COUNT(*) AS n FROM m GROUP BY ALL""")
def ingest_flags(spark, sf):
    flagged = views.events(spark, sf).select(
        "chat_id", tx.is_ingest_media(F.col("text")).alias("media"), tx.is_placeholder(F.col("text")).alias("placeholder"))
    return flagged.groupBy("chat_id", "media", "placeholder").agg(F.count("*").alias("n"))


@query(E + """, shown AS (SELECT * FROM m WHERE NOT is_system AND NOT regexp_matches(lower(text), '(image|media) omitted')),
    s AS (SELECT chat_id, seq, ts, COALESCE(CAST(ts AS DATE) <> CAST(LAG(ts) OVER (PARTITION BY chat_id ORDER BY seq) AS DATE), true) AS day_start, sender, text
    FROM shown UNION ALL SELECT chat_id, seq, ts, false, sender, text FROM m WHERE is_system)
    SELECT chat_id, seq, ts, day_start, strftime(ts, '%d %B %Y') AS day, strftime(ts, '%H:%M') AS time, sender,
    replace(replace(text, '<', '&lt;'), '>', '&gt;') AS body FROM s""")
def transcript_rows(spark, sf):
    return en.transcript(views.events(spark, sf))


@query(E + """SELECT chat_id, seq, sender FROM m WHERE ts >= '2024-01-05' AND ts < '2024-01-11'
    AND (is_system OR sender IN ('User 3', 'User 5', 'User 12'))""")
def range_and_people(spark, sf):
    return en.in_range(views.events(spark, sf), "2024-01-05", "2024-01-10", ["User 3", "User 5", "User 12"]).select("chat_id", "seq", "sender")


@query(E + """SELECT m.chat_id, m.seq, m.ts FROM m JOIN (SELECT chat_id, MAX(CAST(ts AS DATE)) - 6 AS a FROM m GROUP BY 1) x
    ON m.chat_id = x.chat_id AND CAST(m.ts AS DATE) >= x.a""")
def last_week(spark, sf):
    return en.last_days(views.events(spark, sf), 7).select("chat_id", "seq", "ts")


@query(E + """, p AS (SELECT chat_id, sender, COUNT(*) AS n FROM m WHERE NOT is_system GROUP BY 1, 2 HAVING COUNT(*) >= 10)
    SELECT *, """ + FIRST + """ n DESC, sender) AS rank FROM p""")
def participant_list(spark, sf):
    return en.participants(views.events(spark, sf), 10)


@query(E + """SELECT chat_id, COUNT(*) FILTER (counted) AS counted, COUNT(*) FILTER (NOT is_system) AS spoken,
    COUNT(*) FILTER (is_real_text AND NOT is_system) AS worded FROM e GROUP BY 1""")
def populations(spark, sf):
    rows = enriched(spark, sf)
    parts = [p(rows).groupBy("chat_id").agg(F.count("*").alias(n))
             for p, n in ((en.counted, "counted"), (en.spoken, "spoken"), (en.worded, "worded"))]
    return parts[0].join(parts[1], "chat_id").join(parts[2], "chat_id")


@query(E + """, d AS (SELECT chat_id, date, COUNT(*) FILTER (counted) AS n FROM e GROUP BY 1, 2),
    s AS (SELECT chat_id, COUNT(*) AS days, MAX(date) - MIN(date) + 1 AS span FROM d GROUP BY 1),
    a AS (SELECT chat_id, COUNT(*) AS active_days FROM d WHERE n > 0 GROUP BY 1),
    t AS (SELECT chat_id, COUNT(*) FILTER (counted) AS total_messages,
        COUNT(*) FILTER (counted AND is_real_text AND NOT is_media) AS total_text_messages,
        COUNT(*) FILTER (counted AND is_media) AS total_media, COUNT(*) FILTER (counted AND is_deleted) AS total_deleted,
        COUNT(*) FILTER (counted AND is_call) AS total_calls, COUNT(*) FILTER (counted AND is_edited) AS total_edited,
        COUNT(*) FILTER (is_system) AS total_system_events,
        CAST(SUM(word_count) FILTER (counted) AS BIGINT) AS total_words, CAST(SUM(char_count) FILTER (counted) AS BIGINT) AS total_chars,
        MIN(ts) AS first_message_ts, MAX(ts) AS last_message_ts,
        CAST(SUM(word_count) FILTER (counted AND is_real_text) AS BIGINT) / COUNT(*) FILTER (counted AND is_real_text) AS avg_words_per_message
        FROM e GROUP BY 1)
    SELECT t.*, CAST(span AS BIGINT) AS total_days_spanned, active_days, span - active_days AS silent_days,
        100 * active_days / span AS pct_days_active, total_messages / span AS avg_messages_per_day,
        total_messages / active_days AS avg_messages_per_active_day
    FROM t JOIN s USING (chat_id) JOIN a USING (chat_id)""")
def overall_summary(spark, sf):
    return su.overall(daily(spark, sf))


@query(E + "SELECT chat_id, date, COUNT(*) AS n FROM e WHERE counted GROUP BY 1, 2")
def messages_per_day(spark, sf):
    return su.per_day(daily(spark, sf))


def _extreme(flag: str, direction: str) -> str:
    return E + f""", d AS (SELECT chat_id, date, COUNT(*) AS n FROM e WHERE {flag} GROUP BY 1, 2),
    r AS (SELECT *, {FIRST} n {direction}, date) AS rank FROM d) SELECT * FROM r WHERE rank <= 3"""


@query(_extreme("counted", "DESC"))
def busiest_days(spark, sf):
    return su.extreme_days(daily(spark, sf))


@query(_extreme("counted", "ASC"))
def quietest_active_days(spark, sf):
    return su.extreme_days(daily(spark, sf), most=False)


@query(_extreme("counted AND is_media", "DESC"))
def media_days(spark, sf):
    return su.media_days(daily(spark, sf))


# Every source and chat of documents taken apart has days without a word.
SPARSE = views.sql_enriched("documents") + """, s AS (SELECT concat(sender, '/', CAST(chat_id AS STRING)) AS chat, date FROM e
    GROUP BY 1, 2), b AS (SELECT chat, MIN(date) AS a, MAX(date) AS z FROM s GROUP BY 1),
    c AS (SELECT chat, CAST(UNNEST(generate_series(a, z, INTERVAL 1 DAY)) AS DATE) AS date FROM b) """


def sparse_daily(spark, sf):
    """Each source of each chat by itself: few messages, so there are silent days."""
    rows = en.with_lexical(en.enrich(views.documents(spark, sf)))
    rows = rows.withColumn("chat", F.concat_ws("/", "sender", F.col("chat_id").cast("string")))
    return su.daily_counts(rows, ["chat"])


@query(SPARSE + "SELECT c.chat, c.date FROM c ANTI JOIN s ON c.chat = s.chat AND c.date = s.date")
def silent_days(spark, sf):
    return su.silent_days(sparse_daily(spark, sf), ["chat"])


@query(SPARSE + ", n AS (SELECT concat(sender, '/', CAST(chat_id AS STRING)) AS chat, date, COUNT(*) AS n FROM e WHERE counted GROUP BY 1, 2) "
       "SELECT c.chat, c.date, COALESCE(n, 0) AS n FROM c LEFT JOIN n USING (chat, date)")
def dense_calendar(spark, sf):
    return su.dense_days(sparse_daily(spark, sf), ["chat"])


@query(SPARSE + """, i AS (SELECT chat, date, date - CAST(ROW_NUMBER() OVER (PARTITION BY chat ORDER BY date) AS INTEGER) AS g FROM s),
    u AS (SELECT chat, COUNT(*) AS days, MIN(date) AS start_day, MAX(date) AS end_day FROM i GROUP BY chat, g),
    r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY chat ORDER BY days DESC, start_day) AS rank FROM u)
    SELECT * FROM r WHERE rank <= 3""")
def active_streaks(spark, sf):
    return su.streaks(sparse_daily(spark, sf), ["chat"])


def _dense(column: str, top: int) -> str:
    return E + f""", k AS (SELECT DISTINCT chat_id FROM e WHERE NOT is_system), h AS (SELECT UNNEST(range({top})) AS {column}),
    n AS (SELECT chat_id, {column}, COUNT(*) AS n FROM e WHERE NOT is_system GROUP BY 1, 2),
    f AS (SELECT chat_id, CAST({column} AS INTEGER) AS {column}, COALESCE(n, 0) AS n FROM (k CROSS JOIN h) LEFT JOIN n USING (chat_id, {column})) """


@query(_dense("hour", 24) + "SELECT * FROM f")
def messages_by_hour(spark, sf):
    return su.by_hour(enriched(spark, sf))


@query(_dense("weekday_num", 7) + "SELECT *, ['Monday','Tuesday','Wednesday','Thursday','Friday','Saturday','Sunday'][weekday_num + 1] AS weekday FROM f")
def messages_by_weekday(spark, sf):
    return su.by_weekday(enriched(spark, sf))


@query(E + "SELECT chat_id, month_period, COUNT(*) AS n FROM e WHERE NOT is_system GROUP BY 1, 2")
def messages_by_month(spark, sf):
    return su.by_month(enriched(spark, sf))


@query(E + ", k AS (SELECT DISTINCT chat_id FROM e WHERE NOT is_system), w AS (SELECT UNNEST(range(7)) AS weekday_num) "
       "SELECT k.chat_id, CAST(w.weekday_num AS INTEGER) AS weekday_num, "
       + ", ".join(f"COUNT(*) FILTER (hour = {h}) AS h{h:02d}" for h in range(24))
       + " FROM (k CROSS JOIN w) LEFT JOIN (SELECT * FROM e WHERE NOT is_system) e ON k.chat_id = e.chat_id AND w.weekday_num = e.weekday_num GROUP BY 1, 2")
def weekday_hour_heatmap(spark, sf):
    return su.heatmap(enriched(spark, sf))


def _first_max(column: str, order: str) -> str:
    return (f"(SELECT chat_id, {column} AS peak_{column} FROM (SELECT chat_id, {column}, {FIRST} COUNT(*) DESC, {order}) AS r "
            f"FROM e WHERE NOT is_system GROUP BY chat_id, {column}, {order}) WHERE r = 1)")


@query(E + f"SELECT * FROM {_first_max('hour', 'hour')} JOIN {_first_max('weekday', 'weekday_num')} USING (chat_id) "
       f"JOIN {_first_max('month_period', 'month_period')} USING (chat_id)")
def peak_times(spark, sf):
    return su.peaks(enriched(spark, sf)).withColumn("peak_hour", F.col("peak_hour").cast("long"))


@query(E + ", t AS (SELECT chat_id, COUNT(*) FILTER (counted AND is_real_text AND NOT is_media) AS total_text_messages, "
       "COUNT(*) FILTER (counted AND is_media) AS total_media, COUNT(*) FILTER (counted AND is_deleted) AS total_deleted, "
       "COUNT(*) FILTER (counted AND is_edited) AS total_edited, COUNT(*) FILTER (counted AND is_call) AS total_calls FROM e GROUP BY 1) "
       "UNPIVOT t ON COLUMNS(* EXCLUDE (chat_id)) INTO NAME class VALUE n")
def message_classes(spark, sf):
    return su.class_breakdown(su.overall(daily(spark, sf)))


@query(E + """, g AS (SELECT chat_id, seq, LAG(ts) OVER (PARTITION BY chat_id ORDER BY seq) AS from_ts, ts AS to_ts FROM e),
    s AS (SELECT *, epoch(to_ts)::BIGINT - epoch(from_ts)::BIGINT AS seconds FROM g WHERE from_ts IS NOT NULL),
    r AS (SELECT *, """ + FIRST + """ seconds DESC, seq) AS rank FROM s) SELECT * FROM r WHERE rank <= 3""")
def longest_silences(spark, sf):
    return su.silences(enriched(spark, sf), cell_rows=512)


GAPS = E + """, g AS (SELECT chat_id, seq, ts, LAG(sender) OVER w AS from_sender, sender AS to_sender,
    epoch(ts)::BIGINT - epoch(LAG(ts) OVER w)::BIGINT AS seconds FROM e WHERE counted WINDOW w AS (PARTITION BY chat_id ORDER BY seq)),
    q AS (SELECT * FROM g WHERE seconds > 0 AND from_sender <> to_sender) """


@query(GAPS + "SELECT chat_id, MEDIAN(seconds) / 60 AS median_reply_gap_minutes FROM q GROUP BY 1")
def median_reply_gap(spark, sf):
    return su.median_reply_gap(su.reply_gaps(enriched(spark, sf), cell_rows=512))


@query(GAPS + ", r AS (SELECT *, " + FIRST + " seconds, seq) AS rank FROM q) SELECT * FROM r WHERE rank <= 3")
def quickest_replies(spark, sf):
    return su.quickest_replies(su.reply_gaps(enriched(spark, sf), cell_rows=512))


@query(E + """SELECT chat_id, seq, LAG(ts) OVER w AS prev_ts, LAG(sender) OVER w AS prev_sender FROM e WHERE NOT is_system
    WINDOW w AS (PARTITION BY chat_id ORDER BY seq)""")
def previous_rows(spark, sf):
    rows = en.spoken(views.events(spark, sf)).select("chat_id", "seq", "ts", "sender")
    return previous_row(rows, ["ts", "sender"], cell_rows=256).select(
        "chat_id", "seq", F.col("prev.ts").alias("prev_ts"), F.col("prev.sender").alias("prev_sender"))


@query(C + """, r AS (SELECT chat_id, seq, ts, sender, CAST(word_count AS BIGINT) AS words, substr(text, 1, 300) AS text, """ + FIRST + """ word_count DESC, seq) AS rank
    FROM e WHERE counted AND is_real_text) SELECT * FROM r WHERE rank <= 3""")
def longest_messages(spark, sf):
    rows = en.with_lexical(en.enrich(views.conversations(spark, sf)))
    return su.longest_messages(rows)


@query(E + """, d AS (SELECT chat_id, date, COUNT(*) AS n FROM e WHERE NOT is_system GROUP BY 1, 2)
    SELECT *, AVG(n) OVER (PARTITION BY chat_id ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS trailing_mean FROM d""")
def active_day_trend(spark, sf):
    return su.active_day_trend(enriched(spark, sf))


@query(E + """, b AS (SELECT chat_id, MIN(date) AS a, MAX(date) AS z FROM e GROUP BY 1),
    p AS (SELECT chat_id, sender FROM e WHERE NOT is_system GROUP BY 1, 2 HAVING COUNT(*) >= 10),
    c AS (SELECT chat_id, sender, CAST(UNNEST(generate_series(a, z, INTERVAL 1 DAY)) AS DATE) AS date FROM p JOIN b USING (chat_id)),
    n AS (SELECT chat_id, sender, date, COUNT(*) AS n FROM e WHERE NOT is_system GROUP BY 1, 2, 3),
    f AS (SELECT chat_id, sender, date, COALESCE(n, 0) AS n FROM c LEFT JOIN n USING (chat_id, sender, date))
    SELECT *, AVG(n) OVER (PARTITION BY chat_id, sender ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS trailing_mean FROM f""")
def person_day_trend(spark, sf):
    rows = enriched(spark, sf)
    return su.person_day_trend(rows, en.participants(rows, 10))


@query(E + """, x AS (SELECT chat_id, MAX(date) - 9 AS a FROM e GROUP BY 1), s AS (SELECT 'full' AS slice, * FROM e
    UNION ALL SELECT 'last', e.* FROM e JOIN x USING (chat_id) WHERE date >= a)
    SELECT chat_id, slice, COUNT(*) FILTER (counted) AS total_messages, MIN(ts) AS first_message_ts FROM s GROUP BY 1, 2""")
def sliced_summary(spark, sf):
    rows = sliced(enriched(spark, sf), Profile(last_period_days=10))
    keys = ["chat_id", "slice"]
    return su.overall(su.daily_counts(rows, keys), keys).select(*keys, "total_messages", "first_message_ts")


@query("""SELECT CAST(o_custkey % 5 AS BIGINT) AS chat_id,
    ROW_NUMBER() OVER (PARTITION BY o_custkey % 5 ORDER BY date_trunc('minute', o_orderdate), o_orderkey) - 1 AS seq,
    date_trunc('minute', o_orderdate) AS ts, o_orderstatus AS sender, o_orderpriority AS text, false AS is_system FROM orders""")
def messages_from_orders(spark, sf):
    orders = views.table(spark, sf, "orders")
    return from_table(orders, "o_orderdate", "o_orderstatus", "o_orderpriority", F.col("o_custkey") % 5, "o_orderkey")


@query("""SELECT CAST(o_orderdate AS DATE) AS day, CAST(epoch(o_orderdate) AS BIGINT) AS epoch, isodow(o_orderdate) - 1 AS weekday_num,
    strftime(o_orderdate, '%Y-%m') AS month_period, COUNT(*) AS n,
    CASE WHEN epoch(o_orderdate) - 694224000 >= 86400 THEN concat(CAST((epoch(o_orderdate)::BIGINT - 694224000) // 86400 AS STRING), 'd ',
        CAST((epoch(o_orderdate)::BIGINT - 694224000) % 86400 // 3600 AS STRING), 'h') ELSE '0s' END AS since_1992
    FROM orders GROUP BY ALL""")
def date_parts(spark, sf):
    at = F.col("o_orderdate")
    since = tm.epoch_seconds(at) - 694224000
    return views.table(spark, sf, "orders").groupBy(
        F.to_date(at).alias("day"), tm.epoch_seconds(at).alias("epoch"), tm.weekday_number(at).cast("long").alias("weekday_num"),
        tm.month_period(at).alias("month_period"), tm.duration_text(since).alias("since_1992"),
    ).agg(F.count("*").alias("n"))
