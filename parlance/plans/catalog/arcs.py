"""Activity segments: the daily curve, peaks, regions, classes, statistics."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from parlance.model import Profile
from parlance.operators import segments as sg
from parlance.plans import views
from parlance.plans.catalog.registry import query
from parlance.session import materialize, shared_dir
from parlance.sources.sinks import write_segments
from parlance.sources.tables import read_segments

# Thirty days of even traffic: a short window and low bars make spikes of its waves.
PROFILE = Profile(rolling_window_days=3, local_max_order_days=2, min_peak_multiplier=1.02, return_to_baseline_multiplier=1.0,
                  arc_peak_multiplier=1.06, arc_min_duration_days=3, top_n_contributors=3, min_messages_for_distinctive=2)
M = f"WITH RECURSIVE m AS ({views.sql_messages('events')}) "
CURVE = M + """, c0 AS (SELECT chat_id, CAST(ts AS DATE) AS date, COUNT(*) AS n FROM m WHERE NOT is_system GROUP BY 1, 2),
    b AS (SELECT chat_id, MIN(date) AS a, MAX(date) AS z FROM c0 GROUP BY 1),
    d AS (SELECT chat_id, CAST(UNNEST(generate_series(a, z, INTERVAL 1 DAY)) AS DATE) AS date FROM b),
    days AS (SELECT d.chat_id, d.date, CAST(d.date - b.a AS INTEGER) AS idx, COALESCE(n, 0) AS n FROM d JOIN b USING (chat_id) LEFT JOIN c0 USING (chat_id, date)),
    curve AS (SELECT *, AVG(n) OVER (PARTITION BY chat_id ORDER BY idx ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS rolling, AVG(n) OVER (PARTITION BY chat_id) AS mean FROM days)"""
PEAKS = CURVE + """, mx AS (SELECT * FROM (SELECT *, MAX(rolling) OVER (PARTITION BY chat_id ORDER BY idx ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS top FROM curve)
    WHERE rolling >= mean * 1.02 AND rolling = top),
    kept AS (SELECT chat_id, MIN(idx) AS idx FROM mx GROUP BY 1 UNION ALL
        SELECT k.chat_id, (SELECT MIN(x.idx) FROM mx x WHERE x.chat_id = k.chat_id AND x.idx > k.idx + 2) FROM kept k
        WHERE EXISTS (SELECT 1 FROM mx x WHERE x.chat_id = k.chat_id AND x.idx > k.idx + 2)),
    pk AS (SELECT k.chat_id, k.idx, mx.rolling AS peak_value FROM kept k JOIN mx USING (chat_id, idx))"""
REGIONS = PEAKS + """, up AS (SELECT chat_id, idx, idx - ROW_NUMBER() OVER (PARTITION BY chat_id ORDER BY idx) AS isle FROM curve WHERE rolling > mean * 1.0),
    isles AS (SELECT chat_id, isle, MIN(idx) AS f, MAX(idx) AS t FROM up GROUP BY 1, 2),
    rg AS (SELECT pk.chat_id, f AS start_idx, t AS end_idx, peak_value FROM pk JOIN isles ON pk.chat_id = isles.chat_id AND pk.idx BETWEEN f AND t)"""
MERGED = REGIONS + """, mr0 AS (SELECT *, MAX(end_idx) OVER (PARTITION BY chat_id ORDER BY start_idx, end_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM rg),
    mr1 AS (SELECT *, SUM(CASE WHEN start_idx - reach <= 1 THEN 0 ELSE 1 END) OVER (PARTITION BY chat_id ORDER BY start_idx, end_idx ROWS UNBOUNDED PRECEDING) AS g FROM mr0),
    mr AS (SELECT chat_id, MIN(start_idx) AS start_idx, MAX(end_idx) AS end_idx, MAX(peak_value) AS peak_value FROM mr1 GROUP BY chat_id, g),
    cl AS (SELECT mr.*, CASE WHEN peak_value >= mean * 1.06 AND end_idx - start_idx + 1 >= 3 THEN 'arc' ELSE 'miniarc' END AS type
        FROM mr JOIN (SELECT DISTINCT chat_id, mean FROM curve) USING (chat_id))"""
TABLE = MERGED + """, la AS (SELECT chat_id, MAX(idx) AS last, MIN(date) AS day0 FROM curve GROUP BY 1),
    fl AS (SELECT chat_id, COALESCE(LAG(end_idx) OVER w, -1) + 1 AS start_idx, start_idx - 1 AS end_idx FROM cl WINDOW w AS (PARTITION BY chat_id ORDER BY start_idx)
        UNION ALL SELECT la.chat_id, COALESCE(MAX(end_idx), -1) + 1, ANY_VALUE(last) FROM la LEFT JOIN cl USING (chat_id) GROUP BY 1),
    al AS (SELECT chat_id, start_idx, end_idx, peak_value, type FROM cl UNION ALL SELECT chat_id, start_idx, end_idx, NULL, 'filler' FROM fl WHERE start_idx <= end_idx),
    nu AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY chat_id ORDER BY start_idx) AS seg_no, ROW_NUMBER() OVER (PARTITION BY chat_id, type ORDER BY start_idx) AS k FROM al),
    sg AS (SELECT nu.chat_id, seg_no, type, concat(CASE type WHEN 'arc' THEN 'Arc' WHEN 'miniarc' THEN 'Mini-arc' ELSE 'Filler' END, ' ', k) AS label,
        CASE type WHEN 'arc' THEN concat('arc-', k) WHEN 'miniarc' THEN concat('Miniarc-', k) END AS default_name,
        day0 + CAST(start_idx AS INTEGER) AS start_day, day0 + CAST(end_idx AS INTEGER) AS end_day, peak_value, CAST(end_idx - start_idx + 1 AS BIGINT) AS duration_days
        FROM nu JOIN la USING (chat_id)),
    ms AS (SELECT m.chat_id, seq, sender, CAST(ts AS DATE) AS date, seg_no FROM m JOIN sg ON m.chat_id = sg.chat_id AND CAST(ts AS DATE) BETWEEN start_day AND end_day WHERE NOT is_system),
    pd AS (SELECT chat_id, seg_no, date, COUNT(*) AS n FROM ms GROUP BY 1, 2, 3),
    st AS (SELECT chat_id, seg_no, CAST(SUM(n) AS BIGINT) AS n_messages, MAX(n) AS peak_day_count FROM pd GROUP BY 1, 2),
    pe AS (SELECT chat_id, seg_no, date AS peak_day FROM pd QUALIFY ROW_NUMBER() OVER (PARTITION BY chat_id, seg_no ORDER BY n DESC, date) = 1),
    cn AS (SELECT chat_id, seg_no, sender, COUNT(*) AS cnt FROM ms GROUP BY 1, 2, 3)"""


def messages(spark, sf):
    return views.events(spark, sf)


def curve(spark, sf):
    return sg.rolling(sg.spoken_days(messages(spark, sf)), PROFILE)


def peaks(spark, sf):
    return sg.kept_peaks(sg.local_maxima(curve(spark, sf), PROFILE), PROFILE)


def regions(spark, sf):
    return sg.spike_regions(curve(spark, sf), peaks(spark, sf), PROFILE)


def detected(spark, sf):
    return materialize(sg.named(sg.detect(messages(spark, sf), PROFILE)), "segments")


@query(CURVE + " SELECT * FROM curve")
def rolling_curve(spark, sf):
    return curve(spark, sf)


@query(CURVE.replace("1 PRECEDING AND 1 FOLLOWING", "7 PRECEDING AND 6 FOLLOWING") + " SELECT chat_id, date, rolling FROM curve")
def rolling_fortnight(spark, sf):
    return sg.rolling(sg.spoken_days(messages(spark, sf)), Profile()).select("chat_id", "date", "rolling")


@query(CURVE + " SELECT DISTINCT chat_id, mean FROM curve")
def daily_mean(spark, sf):
    days = sg.spoken_days(messages(spark, sf))
    return days.groupBy("chat_id").agg(F.avg("n").alias("mean"))


@query(PEAKS + " SELECT chat_id, idx, date, n, rolling, mean FROM mx")
def local_maxima(spark, sf):
    return sg.local_maxima(curve(spark, sf), PROFILE)


@query(PEAKS + " SELECT * FROM pk")
def kept_peaks(spark, sf):
    return peaks(spark, sf)


@query(REGIONS + " SELECT * FROM rg")
def spike_regions(spark, sf):
    return regions(spark, sf)


@query(MERGED + " SELECT * FROM cl")
def merged_and_classified(spark, sf):
    return sg.classified(sg.merged_regions(regions(spark, sf), PROFILE), curve(spark, sf), PROFILE)


@query(TABLE + " SELECT chat_id, seg_no, start_day, end_day FROM sg WHERE type = 'filler'")
def filler_segments(spark, sf):
    return sg.detect(messages(spark, sf), PROFILE).where(F.col("type") == "filler").select("chat_id", "seg_no", "start_day", "end_day")


@query(TABLE + """ SELECT sg.chat_id, sg.seg_no, type, label, default_name AS name, CASE WHEN type <> 'filler' THEN '' END AS description,
    start_day, end_day, peak_value, duration_days, COALESCE(n_messages, 0) AS n_messages, COALESCE(n_messages, 0) / duration_days AS avg_per_day,
    COALESCE(peak_day, start_day) AS peak_day, COALESCE(peak_day_count, 0) AS peak_day_count
    FROM sg LEFT JOIN st ON sg.chat_id = st.chat_id AND sg.seg_no = st.seg_no LEFT JOIN pe ON sg.chat_id = pe.chat_id AND sg.seg_no = pe.seg_no""")
def activity_segments(spark, sf):
    return sg.segment_stats(sg.person_days(messages(spark, sf)), detected(spark, sf))


@query(TABLE + " SELECT chat_id, seg_no, type, label FROM sg WHERE type IN ('arc', 'miniarc')")
def stored_spikes(spark, sf):
    """Segments written as JSON and read back, the spikes only."""
    path = f"{shared_dir(spark)}/segments-json-{uuid.uuid4().hex}"
    detected(spark, sf).write.json(path)
    return read_segments(spark, path).select("chat_id", "seg_no", "type", "label")


@query(TABLE + """, tp AS (SELECT chat_id, seg_no, sender, cnt, ROW_NUMBER() OVER (PARTITION BY chat_id, seg_no ORDER BY cnt DESC, sender) AS place FROM cn QUALIFY place <= 3),
    ta AS (SELECT chat_id, seg_no, string_agg(concat(sender, ' ', cnt), ', ' ORDER BY place) AS top_contributors FROM tp GROUP BY 1, 2)
    SELECT sg.chat_id, sg.seg_no, type, label, default_name AS name, start_day, end_day, COALESCE(n_messages, 0) AS n_messages, top_contributors
    FROM sg LEFT JOIN st ON sg.chat_id = st.chat_id AND sg.seg_no = st.seg_no LEFT JOIN ta ON sg.chat_id = ta.chat_id AND sg.seg_no = ta.seg_no""")
def stored_segment_files(spark, sf):
    """The segment table end to end, written as CSV and as JSON, and both read back."""
    folder = f"{shared_dir(spark)}/segments-{uuid.uuid4().hex}"
    write_segments(sg.segment_table(messages(spark, sf), PROFILE), f"{folder}/csv", f"{folder}/json")
    columns = spark.read.option("header", True).csv(f"{folder}/csv")
    flat = columns.select(*(F.col(c).cast(t).alias(c) for c, t in (
        ("chat_id", "long"), ("seg_no", "long"), ("type", "string"), ("label", "string"), ("name", "string"), ("start_day", "date"), ("end_day", "date"), ("n_messages", "long"))))
    nested = spark.read.schema("chat_id long, seg_no long, top_contributors array<struct<sender:string,cnt:long>>").json(f"{folder}/json")
    said = F.transform("top_contributors", lambda e: F.concat_ws(" ", e["sender"], e["cnt"].cast("string")))
    return flat.join(nested.select("chat_id", "seg_no", F.array_join(said, ", ").alias("top_contributors")), ["chat_id", "seg_no"])


@query(TABLE + " SELECT chat_id, seq, seg_no FROM ms")
def messages_in_segments(spark, sf):
    rows = messages(spark, sf).where(~F.col("is_system"))
    return sg.in_segments(rows, detected(spark, sf)).select("chat_id", "seq", "seg_no")


@query(TABLE + " SELECT chat_id, seg_no, sender, cnt, ROW_NUMBER() OVER (PARTITION BY chat_id, seg_no ORDER BY cnt DESC, sender) AS place FROM cn QUALIFY place <= 3")
def segment_contributors(spark, sf):
    return sg.contributors(sg.person_days(messages(spark, sf)), detected(spark, sf), PROFILE)


@query(TABLE + """, sh AS (SELECT chat_id, seg_no, sender, cnt, CAST(SUM(cnt) OVER (PARTITION BY chat_id, seg_no) AS BIGINT) AS seg,
    CAST(SUM(cnt) OVER (PARTITION BY chat_id, sender) AS BIGINT) AS own, CAST(SUM(cnt) OVER (PARTITION BY chat_id) AS BIGINT) AS al FROM cn),
    df AS (SELECT chat_id, seg_no, sender, cnt / seg - CASE WHEN al > seg THEN (own - cnt) / (al - seg) ELSE 0 END AS diff, cnt FROM sh WHERE cnt >= 2)
    SELECT *, ROW_NUMBER() OVER (PARTITION BY chat_id, seg_no ORDER BY diff DESC, sender) AS place FROM df QUALIFY place <= 5""")
def distinctive_contributors(spark, sf):
    return sg.distinctive_contributors(sg.person_days(messages(spark, sf)), detected(spark, sf), PROFILE)


@query(TABLE + """, ed AS (SELECT chat_id, label, concat('Wave ', ROW_NUMBER() OVER (PARTITION BY chat_id ORDER BY seg_no)) AS w,
    ROW_NUMBER() OVER (PARTITION BY chat_id ORDER BY seg_no) AS r FROM sg WHERE type <> 'filler')
    SELECT sg.chat_id, seg_no, sg.label, CASE WHEN r % 2 = 1 THEN w ELSE default_name END AS name,
    CASE WHEN type = 'filler' THEN NULL WHEN r % 2 = 1 THEN 'named by hand' ELSE '' END AS description
    FROM sg LEFT JOIN ed ON sg.chat_id = ed.chat_id AND sg.label = ed.label""")
def segment_names(spark, sf):
    """Every other spike of a chat renamed by its position."""
    found = materialize(sg.detect(messages(spark, sf), PROFILE), "segments")
    spikes = found.where(F.col("type") != "filler").groupBy("chat_id").agg(F.count("*").alias("n"))
    odd = spikes.select("chat_id", F.explode(F.sequence(F.lit(1).cast("long"), "n", F.lit(2).cast("long"))).alias("position"))
    edited = odd.select("chat_id", "position", F.concat(F.lit(" Wave "), F.col("position").cast("string")).alias("name"), F.lit("named by hand").alias("description"))
    return sg.named(found, sg.names_in_order(found, edited)).select("chat_id", "seg_no", "label", "name", "description")


@query()
def segment_report(spark, sf):
    return sg.report_rows(sg.segment_table(messages(spark, sf), PROFILE))
