"""The given tables seen as chat messages, once for Spark and once as SQL for the comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.functions import text as tx
from parlance.functions import times as tm

# One chat of a third of all users, the others spread over a few more. Every event type becomes
# another kind of message. `event_id` rises with time.
EVENT_COLUMNS = {
    "chat_id": "CAST(CASE WHEN user_id % 3 = 0 THEN 0 ELSE user_id % 10 END AS BIGINT)",
    "seq": "event_id",
    "sender": "CASE WHEN event_type <> 'signup' THEN concat('User ', CAST(user_id AS STRING)) END",
    "text": """CASE event_type
        WHEN 'click' THEN CASE
            WHEN event_id % 7 = 0 THEN 'clicked it <This message was edited>'
            WHEN user_id % 5 = 0 THEN 'WHAT NOW!!'
            ELSE concat('clicked @User ', CAST((user_id * 7) % 15 AS STRING), ' ok?') END
        WHEN 'view' THEN CASE WHEN event_id % 4 = 0 THEN '<Media omitted> nice view' ELSE 'image omitted' END
        WHEN 'error' THEN CASE WHEN event_id % 5 = 0 THEN 'This message was deleted' ELSE concat('error ', CAST(event_id % 12 AS STRING)) END
        WHEN 'purchase' THEN CASE WHEN event_id % 9 = 0 THEN 'Missed voice call'
            ELSE concat('bought ', CAST(CAST(floor(value / 10) AS BIGINT) AS STRING), ' \U0001F602 hahaha') END
        ELSE concat('User ', CAST(user_id AS STRING), ' joined using an invite link') END""",
    "is_system": "event_type = 'signup'",
}
_CONVERSATIONS = {
    "chat_id": "conv_id", "seq": "turn",
    "sender": "CASE WHEN role <> 'system' THEN role END", "text": "text", "is_system": "role = 'system'",
}
# 90 days of hours; `seq` rises with time and is unique.
_DOCUMENTS = {
    "chat_id": "CAST(CASE lang WHEN 'en' THEN 0 WHEN 'fr' THEN 1 WHEN 'de' THEN 2 ELSE 3 END AS BIGINT)",
    "seq": "(doc_id % 2160) * 1000000000000 + doc_id",
    "sender": "source", "text": "text", "is_system": "false",
}
_HOURS = "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, CAST({} % 2160 AS INT), {})"
_SPARK_TIME = {
    "conversations": _HOURS.format("conv_id", "CAST(turn AS INT)"),
    "documents": _HOURS.format("doc_id", "0"),
}
_SQL_TIME = {
    "events": "date_trunc('minute', ts)",
    "conversations": "TIMESTAMP '2024-01-01' + to_hours(conv_id % 2160) + to_minutes(turn)",
    "documents": "TIMESTAMP '2024-01-01' + to_hours(doc_id % 2160)",
}
_COLUMNS = {"events": EVENT_COLUMNS, "conversations": _CONVERSATIONS, "documents": _DOCUMENTS}
ORDER = ["chat_id", "seq", "ts", "sender", "text", "is_system"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _messages(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    source = table(spark, sf_dir, name)
    when = tm.to_minute(F.col("ts")) if name == "events" else F.expr(_SPARK_TIME[name])
    columns = [F.expr(e).alias(c) for c, e in _COLUMNS[name].items()]
    return source.select(*columns, when.alias("ts")).select(*ORDER)


def events(spark, sf_dir) -> DataFrame:
    return _messages(spark, sf_dir, "events")


def conversations(spark, sf_dir) -> DataFrame:
    return _messages(spark, sf_dir, "conversations")


def documents(spark, sf_dir) -> DataFrame:
    return _messages(spark, sf_dir, "documents")


def sql_messages(name: str) -> str:
    """The same view as a SELECT."""
    columns = ", ".join(f"{e} AS {c}" for c, e in _COLUMNS[name].items())
    return f"SELECT {columns}, {_SQL_TIME[name]} AS ts FROM {name}"


def _re(pattern: str) -> str:
    """A pattern without the flags that only the JVM knows, as a quoted SQL string."""
    for flags in ("(?iU)", "(?imUd)", "(?imU)", "(?U)"):
        pattern = pattern.replace(flags, "")
    return "'" + pattern.replace("'", "''") + "'"


WORD_SQL, TAG_SQL, EMOJI_SQL = _re(tx.WORD), _re(tx.TAG), _re(tx.EMOJI_CHAR)


def sql_enriched(name: str) -> str:
    """CTEs `m` (messages) and `e` (enriched, with lexical text)."""
    return f"""WITH m AS ({sql_messages(name)}),
t0 AS (SELECT * EXCLUDE (text), regexp_matches(text, {_re(tx.EDITED_SUFFIX)}, 'i') AS is_edited,
    regexp_replace(text, {_re(tx.EDITED_SUFFIX)}, '', 'i') AS text FROM m),
t1 AS (SELECT *, regexp_matches(text, {_re(tx.MEDIA)}, 'i') AS is_media,
    regexp_matches(text, {_re(tx.DELETED)}, 'i') AS is_deleted,
    regexp_matches(text, {_re(tx.CALL)}, 'i') AS is_call,
    trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text,
        {_re(tx.MEDIA)}, ' ', 'gi'), {_re(tx.FORWARDED)}, ' ', 'gi'), {_re(tx.WAITING)}, ' ', 'gi'), '\\s+', ' ', 'g')) AS analysis_text FROM t0),
t2 AS (SELECT *, regexp_replace(regexp_replace(analysis_text, '\\\\n|\\n', ' ', 'g'), {TAG_SQL}, ' ', 'g') AS lexical_text,
    NOT is_system AND NOT is_deleted AND NOT is_call AND length(analysis_text) > 0 AS is_real_text FROM t1),
e AS (SELECT *, CAST(ts AS DATE) AS date, hour(ts) AS hour, isodow(ts) - 1 AS weekday_num, dayname(ts) AS weekday,
    strftime(ts, '%Y-%m') AS month_period, length(analysis_text) AS char_count,
    len(regexp_extract_all(lexical_text, {WORD_SQL})) AS word_count,
    (is_real_text OR is_media OR is_deleted OR is_call) AND NOT is_system AS counted FROM t2)
"""
