"""Exports, identities, archive blocks, merging, snapshots and streams.

There are no exports among the given tables, so conversations are written out as export lines in
all three styles and read back.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parlance.functions import times as tm
from parlance.model import Profile
from parlance.operators import enrich as en
from parlance.operators import merge as mg
from parlance.operators import summary as su
from parlance.operators.ordering import resequence
from parlance.plans import views
from parlance.plans.catalog.registry import query
from parlance.plans.update import archive_rows, merge_into, merge_lines, normalize, update
from parlance.session import materialize, shared_dir
from parlance.sources import archive as ar
from parlance.sources import identities as ids
from parlance.sources import sinks
from parlance.sources.raw_export import date_order, parse_export, quality
from parlance.sources.tables import template_corpus
from parlance.streaming.exports import stream_exports
from parlance.streaming.sessions import stream_conversations

FSI, PDI = "⁨", "⁩"
_DAY = "date_add(date'2024-01-01', CAST(conv_id % 2160 AS INT))"


# Files 0-5, one line style and date order each; one conversation a day, one turn a minute.
def export_lines(spark, sf) -> DataFrame:
    """Conversations as raw export lines (chat_id, file, block, pos, value), with mentions, label
    variants, events whose text holds a colon, and a junk line on top of every file."""
    turns = views.table(spark, sf, "conversations").select("conv_id", "turn", "role", "text", F.expr(_DAY).alias("day"), (F.col("conv_id") % 6).alias("f"))
    style, minute = F.col("f") % 3, F.col("turn").cast("int")
    clock = (
        F.when(style == 0, F.concat(F.date_format("day", "yyyy-MM-dd"), F.format_string(" 13:%02d:27 ", minute)))
        .when(style == 1, F.concat(F.date_format("day", "dd/MM/yyyy"), F.format_string(", 1:%02d PM - ", minute)))
        .otherwise(F.concat(F.lit("["), F.date_format("day", "M/d/yy"), F.format_string(", 13:%02d] ", minute)))
    )
    label = F.when(F.col("turn") % 4 == 1, F.upper("role")).when(F.col("turn") % 4 == 3, F.concat(F.lit("~ "), F.initcap("role"))).otherwise(F.col("role"))
    mention = F.when(F.col("turn") % 4 == 2, f"@{FSI}Assistant{PDI} ").when(F.col("turn") % 4 == 0, "@923001234567 and @7654321 ").otherwise("")
    said = F.when(F.col("role") == "system", F.concat(F.lit("someone changed the topic: "), "text")).otherwise(F.concat(label, F.lit(": "), mention, F.col("text")))
    written = turns.select("f", "conv_id", "turn", F.posexplode(F.split(F.concat(clock, said), "\n")).alias("line", "value"))
    lines = written.select("f", F.col("conv_id").alias("block"), (F.col("turn") * 1000000 + F.col("line")).alias("pos"), "value")
    junk = turns.select("f").distinct().select("f", F.lit(-1).cast("long").alias("block"), F.lit(0).cast("long").alias("pos"),
                                               F.concat(F.lit("exported file "), F.col("f").cast("string")).alias("value"))
    return lines.unionByName(junk).select((F.col("f") % 2).alias("chat_id"), F.concat(F.lit("export-"), F.col("f").cast("string")).alias("file"), "block", "pos", "value")


def claims(spark, sf) -> DataFrame:
    """The assistant has a name and two aliases; the user is unknown."""
    roles = views.table(spark, sf, "conversations").select("role").distinct().where(F.col("role") == "assistant")
    people = roles.select(F.lit(0).alias("position"), F.lit("Helper One").alias("name"),
                          F.array(F.col("role"), F.lit("923001234567@lid")).alias("aliases"))
    return ids.alias_claims(people)


# The text as an export holds it: first line trimmed, blank lines empty, none at the end.
_LINES = "list_transform(string_split({}, chr(10)), lambda x: CASE WHEN trim(x, ' ' || chr(9) || chr(13)) = '' THEN '' ELSE x END)"
_KEPT = "regexp_replace(array_to_string(list_concat([trim({0}[1], ' ' || chr(9))], {0}[2:]), chr(10)), '\\n+$', '')"
RAW = f"""WITH c AS (SELECT *, conv_id % 6 AS f, DATE '2024-01-01' + CAST(conv_id % 2160 AS INTEGER) AS day,
    CASE WHEN turn % 4 = 1 THEN upper(role) WHEN turn % 4 = 3 THEN concat('~ ', upper(role[1]), role[2:]) ELSE role END AS label,
    CASE WHEN turn % 4 = 2 THEN '@{FSI}Assistant{PDI} ' WHEN turn % 4 = 0 THEN '@923001234567 and @7654321 ' ELSE '' END AS mention,
    CASE WHEN turn % 4 = 2 THEN '@Helper One ' WHEN turn % 4 = 0 THEN '@Helper One and @7654321 ' ELSE '' END AS resolved FROM conversations),
    l AS (SELECT *, {_LINES.format("CASE WHEN role = 'system' THEN concat('someone changed the topic: ', text) ELSE concat(mention, text) END")} AS x,
        {_LINES.format("CASE WHEN role = 'system' THEN concat('someone changed the topic: ', text) ELSE concat(resolved, text) END")} AS y FROM c),
    k AS (SELECT *, {_KEPT.format('x')} AS msg, {_KEPT.format('y')} AS clean, concat('export-', f) AS file, f % 2 AS chat_id,
        strftime(day, '%d-%b-%Y') AS date, concat('13:', lpad(CAST(turn AS STRING), 2, '0')) AS time, day + to_hours(13) + to_minutes(turn) AS dt FROM l),
    j AS (SELECT DISTINCT f % 2 AS chat_id, concat('export-', f) AS file, concat('exported file ', f) AS msg FROM c),
    who AS (SELECT *, CASE WHEN role = 'assistant' THEN 'Helper One' WHEN role = 'user' THEN
        concat(FIRST_VALUE(CASE WHEN role = 'user' THEN label END IGNORE NULLS) OVER (PARTITION BY file ORDER BY conv_id, turn ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), ' [UNRESOLVED]') END AS name FROM k),
    bl AS (SELECT chat_id, file, dt, concat(date, ', ', time, ' - ', CASE WHEN role = 'system' THEN '[SYSTEM] ' ELSE concat(name, ': ') END, clean) AS block_text,
        role, name, date, time, clean, ROW_NUMBER() OVER (PARTITION BY file ORDER BY conv_id, turn) + 1 AS entry FROM who)"""


@query(RAW + """ SELECT chat_id, file, date, time, dt, CASE WHEN role <> 'system' THEN label END AS sender, msg, false AS unparsed,
    ROW_NUMBER() OVER (PARTITION BY file ORDER BY conv_id, turn) + 1 AS entry FROM k
    UNION ALL SELECT chat_id, file, NULL, NULL, NULL, NULL, msg, true, 1 FROM j""")
def parsed_exports(spark, sf):
    return parse_export(export_lines(spark, sf)).drop("n_lines")


@query(RAW + """ SELECT chat_id, file, COUNT(*) FILTER (f % 3 = 1 AND day(day) > 12) AS day_lines, COUNT(*) FILTER (f % 3 = 2 AND day(day) > 12) AS month_lines,
    COUNT(*) FILTER (f % 3 > 0 AND day(day) <= 12) AS open_lines, CASE f % 3 WHEN 1 THEN true WHEN 2 THEN false END AS day_first FROM k GROUP BY chat_id, file, f""")
def date_order_per_file(spark, sf):
    return date_order(export_lines(spark, sf))


@query(RAW + """, n AS (SELECT chat_id, file, len(list_filter(x, lambda z: z <> '')) AS lines, 1 AS m, 0 AS u FROM k UNION ALL SELECT chat_id, file, 1, 1, 1 FROM j)
    SELECT chat_id, file, CAST(SUM(lines) AS BIGINT) AS filled_lines, COUNT(*) AS messages, 0 AS media, CAST(SUM(u) AS BIGINT) AS unparsed,
    COUNT(*) < SUM(lines) * 0.5 AS low_match FROM n GROUP BY 1, 2""")
def ingest_quality(spark, sf):
    return quality(parse_export(export_lines(spark, sf)))


@query("""SELECT DISTINCT o_orderdate::DATE AS day, s.raw, s.day AS parsed FROM orders, LATERAL (SELECT UNNEST([
    strftime(o_orderdate, '%Y-%m-%d'), strftime(o_orderdate, '%Y.%d.%m'), strftime(o_orderdate, '%-d %b %Y'), strftime(o_orderdate, '%d-%b-%y'),
    strftime(o_orderdate, '%d/%m/%Y'), strftime(o_orderdate, '%m-%d-%Y'), strftime(o_orderdate, '%-d.%-m.%y'), concat('31/', strftime(o_orderdate, '%m/%Y'))]) AS raw,
    UNNEST([o_orderdate::DATE, CASE WHEN day(o_orderdate) > 12 THEN o_orderdate::DATE ELSE make_date(year(o_orderdate), day(o_orderdate), month(o_orderdate)) END,
    o_orderdate::DATE, (o_orderdate + to_years(CASE WHEN year(o_orderdate) < 2000 THEN 100 ELSE 0 END))::DATE, o_orderdate::DATE,
    CASE WHEN day(o_orderdate) > 12 THEN o_orderdate::DATE ELSE make_date(year(o_orderdate), day(o_orderdate), month(o_orderdate)) END,
    TRY_CAST(concat(2000 + year(o_orderdate) % 100, strftime(o_orderdate, '-%m-%d')) AS DATE), TRY_CAST(concat(strftime(o_orderdate, '%Y-%m'), '-31') AS DATE)]) AS day) s""")
def flexible_dates(spark, sf):
    """Order days written in eight ways and read back, day-first where nothing decides."""
    day = F.to_date("o_orderdate")
    forms = ["yyyy-MM-dd", "yyyy.dd.MM", "d MMM yyyy", "dd-MMM-yy", "dd/MM/yyyy", "MM-dd-yyyy", "d.M.yy"]
    days = views.table(spark, sf, "orders").select(day.alias("day")).distinct()
    raw = days.select("day", F.explode(F.array(*(F.date_format("day", f) for f in forms), F.concat(F.lit("31/"), F.date_format("day", "MM/yyyy")))).alias("raw")).distinct()
    return tm.with_date(raw, "raw", F.lit(True), "parsed")


@query("""SELECT raw, want AS time, COUNT(*) AS n FROM (SELECT UNNEST([strftime(ts, '%H:%M:%S'), strftime(ts, '%-H:%M'), strftime(ts, '%-I:%M %p'),
    concat(strftime(ts, '%I:%M'), chr(8239), strftime(ts, '%p')), concat('at ', strftime(ts, '%H'))]) AS raw,
    UNNEST([strftime(ts, '%H:%M'), strftime(ts, '%H:%M'), strftime(ts, '%H:%M'), strftime(ts, '%H:%M'), concat('at ', strftime(ts, '%H'))]) AS want FROM events) GROUP BY ALL""")
def clock_times(spark, sf):
    """Event times written in four ways and one that is none."""
    ts = F.col("ts")
    h12 = (F.hour(ts) + 11) % 12 + 1
    half = F.when(F.hour(ts) < 12, "AM").otherwise("PM")
    raw = F.array(F.format_string("%02d:%02d:%02d", F.hour(ts), F.minute(ts), F.second(ts)), F.format_string("%d:%02d", F.hour(ts), F.minute(ts)),
                  F.format_string("%d:%02d %s", h12, F.minute(ts), half), F.format_string("%02d:%02d %s", h12, F.minute(ts), half),
                  F.format_string("at %02d", F.hour(ts)))
    rows = views.table(spark, sf, "events").select(F.explode(raw).alias("raw"))
    read = tm.with_clock(rows, "raw", "clock").select("raw", tm.archive_time(F.col("clock"), F.col("raw")).alias("time"))
    return read.groupBy("raw", "time").agg(F.count("*").alias("n"))


# Sources as people whose aliases are the languages they write in, which many share.
PEOPLE_SQL = """WITH s AS (SELECT DISTINCT source, lang FROM documents), n AS (SELECT source, source AS label, 0 AS k FROM s UNION SELECT source, lang, 1 FROM s)
    , a AS (SELECT label AS alias_key, MIN(source) AS canonical, COUNT(DISTINCT source) AS n_claimants FROM n GROUP BY 1) """


def source_claims(spark, sf):
    people = views.table(spark, sf, "documents").groupBy(F.col("source").alias("name")).agg(F.collect_set(F.concat(F.lit("~ "), F.upper("lang"))).alias("aliases"))
    return ids.alias_claims(people.withColumn("position", F.col("name")))


@query(PEOPLE_SQL + "SELECT * FROM a")
def alias_map(spark, sf):
    return source_claims(spark, sf)


@query(PEOPLE_SQL + "SELECT * FROM a WHERE n_claimants = 1")
def unambiguous_aliases(spark, sf):
    return ids.unambiguous(source_claims(spark, sf))


@query(RAW + """ SELECT chat_id, file, entry, date, time, CASE WHEN role <> 'system' THEN name END AS sender, clean AS text, role = 'user' AS is_unresolved, block_text FROM bl
    UNION ALL SELECT chat_id, file, 1, NULL, NULL, NULL, msg, false, concat('[UNPARSED - review this line] ', msg) FROM j""")
def normalized_exports(spark, sf):
    return normalize(export_lines(spark, sf), claims(spark, sf)).select(
        "chat_id", "file", "entry", "date", "time", "sender", "text", "is_unresolved", "block_text")


@query(RAW + """, u AS (SELECT chat_id, file, conv_id, turn, label FROM k WHERE role = 'user')
    SELECT chat_id, 'user' AS alias_key, arg_min(label, (file, conv_id, turn)) AS label, COUNT(*) AS n FROM u GROUP BY 1""")
def unknown_senders(spark, sf):
    parsed = parse_export(export_lines(spark, sf))
    return ids.unknown_senders(ids.sender_labels(parsed, claims(spark, sf)))


@query(RAW + """, t AS (SELECT chat_id, '7654321' AS mention FROM k WHERE role <> 'system' AND turn % 4 = 0) SELECT chat_id, mention, COUNT(*) AS n FROM t GROUP BY 1, 2""")
def unresolved_mentions(spark, sf):
    return ids.unresolved_mentions(parse_export(export_lines(spark, sf)), claims(spark, sf))


# ---- archive text ----

def archive_lines(spark, sf) -> DataFrame:
    """Normalized conversations as archive text lines."""
    rows = normalize(export_lines(spark, sf), claims(spark, sf))
    lines = rows.select("chat_id", "file", "entry", F.posexplode(F.split("block_text", "\n")).alias("n", "value"))
    return lines.select("chat_id", "file", F.expr("entry div 64").alias("block"), (F.col("entry") * 1000000 + F.col("n")).alias("pos"), "value")


@query(RAW + """ SELECT chat_id, file, entry AS seq, dt, block_text, CASE WHEN role <> 'system' THEN date WHEN role = 'system' THEN date END AS slot_date,
    time AS slot_time, CASE WHEN role = 'system' THEN '[SYSTEM] someone changed the topic' ELSE name END AS slot_sender FROM bl
    UNION ALL SELECT chat_id, file, 1, NULL, concat('[UNPARSED - review this line] ', msg), NULL, NULL, NULL FROM j""")
def archive_blocks(spark, sf):
    return ar.parse_blocks(archive_lines(spark, sf))


@query(RAW + """ SELECT chat_id, file, entry AS seq, dt AS ts, CASE WHEN role <> 'system' THEN name END AS sender,
    CASE WHEN role = 'system' THEN concat('[SYSTEM] ', clean) ELSE clean END AS text, role = 'system' AS is_system FROM bl""")
def archive_messages(spark, sf):
    return ar.parse_messages(archive_lines(spark, sf))


@query(RAW + """ SELECT chat_id, file, entry AS seq, name AS sender, regexp_replace(clean, '\\n\\s*\\n', chr(10), 'g') AS text FROM bl WHERE role <> 'system'""")
def spoken_archive(spark, sf):
    return ar.without_system(ar.parse_messages(archive_lines(spark, sf))).select("chat_id", "file", "seq", "sender", "text")


@query(RAW + """ SELECT chat_id, entry AS seq, dt AS ts, CASE WHEN role <> 'system' THEN name END AS sender,
    CASE WHEN role = 'system' THEN concat('[SYSTEM] ', clean) ELSE clean END AS text, role = 'system' AS is_system FROM bl""")
def messages_of_blocks(spark, sf):
    return ar.messages_from_blocks(archive_rows(normalize(export_lines(spark, sf), claims(spark, sf))))


# ---- merging: events as blocks of a day, so that one text has many copies ----

BLOCK = "concat(strftime(ts, '%d-%b-%Y'), ', 00:00 - User ', user_id, ': ', {})"
SIDES = f"""WITH ev AS (SELECT CAST(user_id % 4 AS BIGINT) AS chat_id, event_id AS seq, CASE WHEN event_type <> 'signup' THEN CAST(CAST(ts AS DATE) AS TIMESTAMP) END AS dt,
        ts, user_id, event_type, value FROM events),
    ar AS (SELECT chat_id, seq, dt, {BLOCK.format('event_type')} AS block_text, user_id, ts, 'old' AS src_file FROM ev WHERE value < 60),
    nw AS (SELECT chat_id, seq, dt, {BLOCK.format("CASE WHEN event_type = 'error' THEN 'Waiting for this message' ELSE event_type END")} AS block_text, user_id, ts, event_type, 'new' AS src_file FROM ev WHERE value >= 20),
    hv AS (SELECT chat_id, block_text, COUNT(*) AS h FROM ar GROUP BY 1, 2),
    sl AS (SELECT DISTINCT chat_id, dt, user_id FROM ar WHERE dt IS NOT NULL),
    jd AS (SELECT nw.*, CASE WHEN ROW_NUMBER() OVER (PARTITION BY chat_id, block_text ORDER BY seq) <= COALESCE(h, 0) THEN 'duplicate'
        WHEN event_type = 'error' AND EXISTS (SELECT 1 FROM sl WHERE sl.chat_id = nw.chat_id AND sl.dt = CAST(CAST(nw.ts AS DATE) AS TIMESTAMP) AND sl.user_id = nw.user_id)
        THEN 'placeholder' ELSE 'new' END AS verdict FROM nw LEFT JOIN hv USING (chat_id, block_text))"""


def merge_sides(spark, sf):
    """Cheap events as the archive, dear ones as the new export; the middle is in both."""
    ev = views.table(spark, sf, "events")
    day = F.to_date("ts")

    def blocks(rows, text, src):
        block = F.concat(F.date_format(day, "dd-MMM-yyyy"), F.lit(", 00:00 - User "), F.col("user_id").cast("string"), F.lit(": "), text)
        return rows.select(
            (F.col("user_id") % 4).alias("chat_id"), F.col("event_id").alias("seq"),
            F.when(F.col("event_type") != "signup", day.cast("timestamp_ntz")).alias("dt"), block.alias("block_text"),
            *(c.alias(n) for n, c in ar.slot_columns(block).items()), F.lit(src).alias("src_file"))

    late = F.when(F.col("event_type") == "error", "Waiting for this message").otherwise(F.col("event_type"))
    return blocks(ev.where("value < 60"), F.col("event_type"), "old"), blocks(ev.where("value >= 20"), late, "new")


@query(SIDES + " SELECT chat_id, seq, dt, block_text, verdict FROM jd")
def merge_verdicts(spark, sf):
    return mg.judged(*merge_sides(spark, sf), cell_rows=1024).select("chat_id", "seq", "dt", "block_text", "verdict")


@query(SIDES + """ SELECT chat_id, COUNT(*) FILTER (verdict = 'new') AS added, COUNT(*) FILTER (verdict = 'duplicate') AS duplicates,
    COUNT(*) FILTER (verdict = 'placeholder') AS placeholders FROM jd GROUP BY 1""")
def merge_counts(spark, sf):
    return mg.verdict_counts(mg.judged(*merge_sides(spark, sf), cell_rows=1024))


@query(SIDES + """, un AS (SELECT chat_id, seq, dt, block_text, src_file, 0 AS r FROM ar UNION ALL SELECT chat_id, seq, dt, block_text, src_file, 1 FROM jd WHERE verdict = 'new')
    SELECT chat_id, ROW_NUMBER() OVER (PARTITION BY chat_id ORDER BY dt NULLS LAST, r, seq) - 1 AS seq, dt, block_text, src_file FROM un""")
def merged_archive(spark, sf):
    old, new = merge_sides(spark, sf)
    return mg.merged(old, mg.judged(old, new, cell_rows=1024), cell_rows=1024).select("chat_id", "seq", "dt", "block_text", "src_file")


@query(SIDES + """, al AS (SELECT chat_id, seq, dt, block_text, src_file FROM ar UNION ALL SELECT chat_id, seq, dt, block_text, src_file FROM nw),
    cp AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY chat_id, block_text, src_file ORDER BY seq) AS c FROM al),
    ft AS (SELECT * FROM cp QUALIFY ROW_NUMBER() OVER (PARTITION BY chat_id, block_text, c ORDER BY src_file, seq) = 1)
    SELECT chat_id, ROW_NUMBER() OVER (PARTITION BY chat_id ORDER BY dt NULLS LAST, src_file, seq) - 1 AS seq, block_text, src_file FROM ft""")
def several_exports_at_once(spark, sf):
    old, new = merge_sides(spark, sf)
    return mg.combined_exports(old.unionByName(new), cell_rows=1024).select("chat_id", "seq", "block_text", "src_file")


@query("""SELECT CAST(event_type = 'error' AS BIGINT) AS chat_id, event_id, ROW_NUMBER() OVER (PARTITION BY event_type = 'error'
    ORDER BY date_trunc('minute', ts), -event_id) - 1 AS seq FROM events""")
def chronological_order(spark, sf):
    rows = views.table(spark, sf, "events").select(
        F.when(F.col("event_type") == "error", 1).otherwise(0).cast("long").alias("chat_id"), "event_id",
        tm.to_minute(F.col("ts")).alias("ts"), (-F.col("event_id")).alias("back"))
    return resequence(rows, "ts", ["back"], cell_rows=512).select("chat_id", "event_id", "seq")


# Direction marks around a line, and characters inside it that some read as line ends.
@query("""SELECT conv_id % 2 AS chat_id, concat('P', turn) AS sender, concat('a', chr(8232), 'b', chr(133), 'c', chr(8233), ' ', replace(text, chr(10), ' '), '.') AS msg,
    COUNT(*) AS n FROM conversations GROUP BY ALL""")
def separated_lines(spark, sf):
    said = F.concat(F.lit("a\u2028b\u0085c\u2029 "), F.translate("text", "\n", " "), F.lit("."))
    value = F.concat(F.lit("\u200e\u202a2024-01-02 10:00:00 P"), F.col("turn").cast("string"), F.lit(": "), said, F.lit("\u202c"))
    lines = views.table(spark, sf, "conversations").select(
        (F.col("conv_id") % 2).alias("chat_id"), F.lit("separated").alias("file"), F.col("conv_id").alias("block"), F.col("turn").alias("pos"), value.alias("value"))
    return parse_export(lines).groupBy("chat_id", "sender", "msg").agg(F.count("*").alias("n"))


# ---- sinks, update, streams ----

def _folder(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


PUBLISHED = SIDES + """, un AS (SELECT chat_id, seq, dt, block_text, src_file, 0 AS r FROM ar UNION ALL SELECT chat_id, seq, dt, block_text, src_file, 1 FROM jd WHERE verdict = 'new')"""


def _merged_twice(spark, sf) -> str:
    """A new archive, one side merged after the other."""
    root = _folder(spark, "archive")
    for side in merge_sides(spark, sf):
        merge_into(spark, root, side.select(*sinks.ARCHIVE.names))
    return root


@query(PUBLISHED + """ SELECT chat_id, ROW_NUMBER() OVER (PARTITION BY chat_id ORDER BY dt NULLS LAST, r, seq) - 1 AS seq, dt, block_text, src_file FROM un""")
def published_snapshot(spark, sf):
    """Every row of the archive after two merges, in its order."""
    return sinks.read_archive(spark, _merged_twice(spark, sf)).select("chat_id", "seq", "dt", "block_text", "src_file")


@query(PUBLISHED + """, x AS (SELECT chat_id, coalesce(strftime(dt, '%Y-%m'), 'undated') AS month, MAX(r) + 1 AS last_merge, COUNT(*) AS n FROM un GROUP BY ALL)
    SELECT chat_id, month, CAST(last_merge AS BIGINT) AS last_merge, n FROM x""")
def archive_months(spark, sf):
    """Which merge each month of a chat was last written by."""
    root = _merged_twice(spark, sf)
    rows = sinks.in_parts(sinks.read_parts(spark, root))
    return rows.groupBy("chat_id", "month").agg(F.max("merge_no").alias("last_merge"), F.count("*").alias("n"))


@query(RAW + """ SELECT chat_id, file, entry, dt, block_text FROM bl UNION ALL SELECT chat_id, file, 1, NULL, concat('[UNPARSED - review this line] ', msg) FROM j""")
def stored_normalized_export(spark, sf):
    """Every normalized row as it is read back from the files."""
    path = _folder(spark, "normalized")
    sinks.write_normalized(normalize(export_lines(spark, sf), claims(spark, sf)), path)
    return spark.read.parquet(path).select("chat_id", "file", "entry", "dt", "block_text")


@query(RAW + """, x AS (SELECT chat_id, dt, file, entry, block_text FROM bl UNION ALL SELECT chat_id, NULL, file, 1, concat('[UNPARSED - review this line] ', msg) FROM j),
    o AS (SELECT chat_id, dt, file, entry, unnest(string_split(block_text, chr(10))) AS value, generate_subscripts(string_split(block_text, chr(10)), 1) AS k FROM x)
    SELECT ROW_NUMBER() OVER (ORDER BY chat_id, dt NULLS LAST, file, entry, k) - 1 AS line, value FROM o""")
def ordered_archive_text(spark, sf):
    """The lines of the text files with their place in the archive."""
    path = _folder(spark, "text")
    rows = resequence(archive_rows(normalize(export_lines(spark, sf), claims(spark, sf))), "dt", ["src_file", "seq"])
    sinks.write_ordered_text(rows, path)
    # Files are named in order, so (file name, place in it) is the order of lines.
    lines = spark.read.text(path).select("value", F.regexp_extract(F.input_file_name(), r"part-(\d+)", 1).cast("long").alias("part"), F.monotonically_increasing_id().alias("id"))
    lines = materialize(lines, "text-lines")
    place = lines.select("part", "id").withColumn("seq", F.row_number().over(Window.partitionBy("part").orderBy("id")))
    sizes = place.groupBy("part").agg(F.max("seq").alias("size"))
    starts = sizes.select("part", F.coalesce(F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    return lines.join(place, ["part", "id"]).join(starts, "part").select((F.col("start") + F.col("seq") - 1).alias("line"), "value")


@query(SIDES + " SELECT src_file AS file, COUNT(*) FILTER (verdict = 'new') AS added, COUNT(*) FILTER (verdict = 'duplicate') AS duplicates, "
       "COUNT(*) FILTER (verdict = 'placeholder') AS placeholders, "
       "concat(COUNT(*) FILTER (verdict = 'placeholder'), ' placeholder line(s) skipped: the archive has content in their slots') AS note FROM jd GROUP BY 1")
def merge_log(spark, sf):
    root = _folder(spark, "log")
    counts = mg.verdict_counts(mg.judged(*merge_sides(spark, sf)), ["src_file"]).withColumnRenamed("src_file", "file")
    sinks.append_log(sinks.log_rows(counts), root)
    return spark.read.json(f"{root}/merge_log").select("file", "added", "duplicates", "placeholders", "note")


def _export_files(spark, sf) -> str:
    """The export lines as text files, one folder per file name."""
    path = _folder(spark, "exports")
    lines = export_lines(spark, sf).repartition("file").sortWithinPartitions("file", "block", "pos")
    lines.select("value", "file").write.partitionBy("file").text(path)
    return path


def _chat_of_file():
    return F.regexp_extract("file", r"file=export-(\d+)", 1).cast("long") % 2


MERGED_SQL = RAW + """, al AS (SELECT chat_id, dt, block_text FROM bl UNION ALL SELECT chat_id, NULL, concat('[UNPARSED - review this line] ', msg) FROM j)
    SELECT chat_id, COUNT(*) AS n, COUNT(dt) AS dated, MIN(dt) AS first_dt, MAX(dt) AS last_dt, CAST(SUM(length(block_text)) AS BIGINT) AS chars FROM al GROUP BY 1"""


def _summary(archive: DataFrame) -> DataFrame:
    return archive.groupBy("chat_id").agg(
        F.count("*").alias("n"), F.count("dt").alias("dated"), F.min("dt").alias("first_dt"), F.max("dt").alias("last_dt"), F.sum(F.length("block_text")).alias("chars"))


@query(MERGED_SQL)
def full_update(spark, sf):
    """Files to archive, twice: the second merge of the same files adds nothing."""
    files, root = f"{_export_files(spark, sf)}/*/*.txt", _folder(spark, "archive")
    who = claims(spark, sf)
    update(spark, files, root, who, chat_id=_chat_of_file(), sections=["overview"])
    return _summary(merge_lines(spark, files, root, who, _chat_of_file()))


@query(MERGED_SQL)
def streamed_exports(spark, sf):
    """The same by a stream over the folder, a few files at a time."""
    files, root = f"{_export_files(spark, sf)}/*/*.txt", _folder(spark, "archive")
    run = stream_exports(spark, files, root, claims(spark, sf), _folder(spark, "checkpoint"), _chat_of_file(), max_files=3)
    run.awaitTermination()
    return _summary(sinks.read_archive(spark, root))


@query(views.sql_enriched("events") + """, g AS (SELECT chat_id, seq, ts, CASE WHEN epoch(ts) - epoch(LAG(ts) OVER w) >= 3600 OR LAG(ts) OVER w IS NULL THEN 1 ELSE 0 END AS f
    FROM e WHERE NOT is_system WINDOW w AS (PARTITION BY chat_id ORDER BY seq)), i AS (SELECT *, SUM(f) OVER (PARTITION BY chat_id ORDER BY seq) AS k FROM g)
    SELECT chat_id, MIN(ts) AS start_ts, MAX(ts) AS end_ts, COUNT(*) AS messages FROM i GROUP BY chat_id, k""")
def streamed_conversations(spark, sf):
    events = views.table(spark, sf, "events")
    # A row long after the last one closes all sessions but its own, which is never given out.
    closing = _folder(spark, "closing")
    events.agg(F.max(F.struct("ts", "event_id")).alias("e"), F.first("props").alias("props")).select(
        F.col("e.event_id").alias("event_id"), (F.col("e.ts") + F.expr("INTERVAL 30 DAYS")).alias("ts"), F.lit(1).cast("long").alias("user_id"),
        F.lit("click").alias("event_type"), F.lit(0.0).alias("value"), "props").select(events.columns).write.parquet(closing)
    stream = spark.readStream.schema(events.schema)
    source = stream.parquet(f"{sf}/events*.parquet").unionByName(stream.parquet(closing))
    rows = source.selectExpr(*(f"{e} AS {c}" for c, e in views.EVENT_COLUMNS.items()), "ts").withColumn("ts", tm.to_minute(F.col("ts")))
    sessions = stream_conversations(rows, Profile(conversation_gap_hours=1))
    out = _folder(spark, "sessions")
    run = (sessions.writeStream.outputMode("append").option("checkpointLocation", _folder(spark, "checkpoint"))
           .foreachBatch(lambda df, n: df.write.parquet(f"{out}/batch={n}")).trigger(availableNow=True).start())
    run.awaitTermination()
    return spark.read.parquet(out).drop("batch")


@query("""SELECT text FROM benchmark UNION ALL SELECT concat('about ', n_name, ' and ', r_name) FROM nation CROSS JOIN region""")
def template_baseline(spark, sf):
    templates = views.table(spark, sf, "nation").select(F.concat(F.lit("about "), "n_name", F.lit(" and {topic}")).alias("template"))
    topics = views.table(spark, sf, "region").select(F.col("r_name").alias("topic"))
    return template_corpus(views.table(spark, sf, "benchmark"), templates, topics)


@query(RAW + """ SELECT chat_id, COUNT(*) FILTER (role <> 'system') AS total_messages, COUNT(*) FILTER (role = 'system') AS total_system_events FROM bl GROUP BY 1""")
def archive_overview(spark, sf):
    """Exports all the way to the totals of each chat."""
    rows = resequence(archive_rows(normalize(export_lines(spark, sf), claims(spark, sf))), "dt", ["src_file", "seq"])
    messages = en.enrich(ar.messages_from_blocks(rows))
    return su.overall(su.daily_counts(messages)).select("chat_id", "total_messages", "total_system_events")
