"""Date and time expressions over raw export strings and naive timestamps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---- fixed values ----
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
DATE_FORMAT = "dd-MMM-yyyy"
ODD_SPACES = "\u202f\u00a0"
TIME_SHAPE = r"^([0-9]{1,2}):([0-9]{2})(?::([0-9]{2}))?(\s*)([AaPp][Mm])?$"


def _parts(raw: Column) -> list[Column]:
    """The first three parts of a date string, and a fourth that is null in a whole one."""
    parts = F.split(F.regexp_replace(raw, r"^[-/.\s]+|[-/.\s]+$", ""), r"[-/. ]+")
    return [F.get(parts, F.lit(i)) for i in range(4)]


def _month_number(part: Column) -> Column:
    """1-12 for a month name, 0 otherwise."""
    return F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(F.left(part, F.lit(3))))


def _calendar(year: Column, month: Column, day: Column) -> Column:
    """A DATE, or null where no such day exists."""
    return F.try_to_date(F.format_string("%04d-%02d-%02d", year, month, day), "yyyy-MM-dd")


def _is_day(first: Column, second: Column, day_first: Column) -> Column:
    """Whether the first of two parts is the day: a part above 12 must be, else `day_first` decides."""
    return F.when((first > 12) & (second <= 12), True).when((second > 12) & (first <= 12), False).otherwise(day_first)


def with_date(df: DataFrame, raw: str, day_first: Column, out: str) -> DataFrame:
    """Adds DATE `out` for the date string `raw` in any of the export shapes; null if it names no
    real day.

    A month name decides; then a four-digit part is the year (leading: month before day, unless
    that part is above 12); else a leading part above 31 is a two-digit year, else the last part
    is. Done in steps, so that no step repeats the expressions of the one before.
    """
    *at, fourth = _parts(F.col(raw))
    parts = df.withColumn("_p", F.struct(
        *(x.try_cast("int").alias(f"n{i}") for i, x in enumerate(at)),
        *(F.length(x).alias(f"s{i}") for i, x in enumerate(at)),
        *(_month_number(x).alias(f"m{i}") for i, x in enumerate(at)),
        (at[2].isNotNull() & fourth.isNull()).alias("whole"), day_first.alias("day_first"),
    ))
    n, size, month = ([F.col(f"_p.{k}{i}") for i in range(3)] for k in "nsm")
    name_at = F.when(month[0] > 0, 0).when(month[1] > 0, 1).when(month[2] > 0, 2)
    year_at = F.when(size[0] == 4, 0).when(size[1] == 4, 1).when(size[2] == 4, 2).when(n[0] > 31, 0).otherwise(2)
    placed = parts.withColumns({"_name": name_at, "_year": year_at})

    # The two parts beside the month name, or beside the year, in written order.
    skip = F.coalesce("_name", "_year")
    a = F.when(skip == 0, F.struct(n[1].alias("n"), size[1].alias("s"))).otherwise(F.struct(n[0].alias("n"), size[0].alias("s")))
    b = F.when(skip == 2, F.struct(n[1].alias("n"), size[1].alias("s"))).otherwise(F.struct(n[2].alias("n"), size[2].alias("s")))
    paired = placed.withColumns({
        "_a": a, "_b": b,
        "_full": (size[0] == 4) | (size[1] == 4) | (size[2] == 4),
        "_y": F.when(F.col("_year") == 0, n[0]).when(F.col("_year") == 1, n[1]).otherwise(n[2]),
        "_named": F.when(F.col("_name") == 0, month[0]).when(F.col("_name") == 1, month[1]).otherwise(month[2]),
    })
    a, b, sa, sb = F.col("_a.n"), F.col("_b.n"), F.col("_a.s"), F.col("_b.s")
    a_is_year = (sa == 4) | ((sb != 4) & ((sa > sb) | ((sa == sb) & (a > 31))))
    a_is_day = _is_day(a, b, F.when(size[0] == 4, False).otherwise(F.col("_p.day_first")))
    # Beside a month name `a` is the year or the day; beside the year it is the day or the month.
    chosen = paired.withColumn("_flip", F.when(F.col("_name").isNotNull(), a_is_year).otherwise(a_is_day))
    flip, by_name = F.col("_flip"), F.col("_name").isNotNull()
    read = chosen.withColumns({
        "_yy": F.when(by_name, F.when(flip, a).otherwise(b)).otherwise(F.col("_y")),
        "_mm": F.when(by_name, F.col("_named")).when(flip, b).otherwise(a),
        "_dd": F.when(by_name, F.when(flip, b).otherwise(a)).when(flip, a).otherwise(b),
    })
    short = F.when(by_name, F.col("_yy") < 100).otherwise(~F.col("_full"))
    year = F.when(short, F.col("_yy") + 2000).otherwise(F.col("_yy"))
    known = F.col("_p.whole") & F.col("_yy").isNotNull() & F.col("_mm").isNotNull() & F.col("_dd").isNotNull()
    dated = read.withColumn(out, F.when(known, _calendar(year, F.col("_mm"), F.col("_dd"))))
    return dated.drop("_p", "_name", "_year", "_a", "_b", "_full", "_y", "_named", "_flip", "_yy", "_mm", "_dd")


def order_evidence(raw: Column) -> Column:
    """'day' or 'month' where a numeric date proves which comes first, 'open' where it fits both
    readings, null where the order is no question."""
    *at, fourth = _parts(raw)
    num = [x.try_cast("int") for x in at]
    whole = num[0].isNotNull() & num[1].isNotNull() & num[2].isNotNull() & fourth.isNull()
    middle_year = (F.length(at[1]) == 4) & (F.length(at[0]) != 4)
    no_year_first = (F.length(at[0]) != 4) & (middle_year | (F.length(at[2]) == 4) | (num[0] <= 31))
    second = F.when(middle_year, num[2]).otherwise(num[1])
    proof = (
        F.when((num[0] > 12) & (second <= 12), "day")
        .when((second > 12) & (num[0] <= 12), "month")
        .otherwise("open")
    )
    return F.when(whole & no_year_first, proof)


def archive_date(day: Column, raw: Column) -> Column:
    """The archive's date form, or the string as it came."""
    return F.coalesce(F.date_format(day, DATE_FORMAT), raw)


def with_clock(df: DataFrame, raw: str, out: str) -> DataFrame:
    """Adds STRUCT<h, m> `out` for the time string `raw`, null if it is none."""
    fields = "\u0001".join(f"${i}" for i in range(1, 6))
    spaced = df.withColumn("_t", F.trim(F.translate(F.col(raw), ODD_SPACES, "  ")))
    split = spaced.withColumn("_f", F.when(F.col("_t").rlike(TIME_SHAPE), F.split(F.regexp_replace("_t", TIME_SHAPE, fields), "\u0001")))
    f = [F.get("_f", F.lit(i)) for i in range(5)]
    typed = split.withColumn("_f", F.struct(
        f[0].try_cast("int").alias("h"), f[1].try_cast("int").alias("m"), f[2].alias("s"), f[3].alias("gap"), F.lower(f[4]).alias("half")))
    hour, minute, second, gap, half = (F.col(f"_f.{k}") for k in ("h", "m", "s", "gap", "half"))
    sane = (minute < 60) & ((second == "") | (second.try_cast("int") <= 61))
    plain = (half == "") & (hour < 24)
    halved = (half != "") & hour.between(1, 12) & ((second == "") | (gap != ""))
    h24 = F.when(half == "", hour).otherwise(hour % 12 + F.when(half == "pm", 12).otherwise(0))
    clock = F.when(sane & (plain | halved), F.struct(h24.alias("h"), minute.alias("m")))
    return typed.withColumn(out, clock).drop("_t", "_f")


def archive_time(clock: Column, raw: Column) -> Column:
    """HH:mm, or the string as it came."""
    return F.when(clock.isNotNull(), F.format_string("%02d:%02d", clock["h"], clock["m"])).otherwise(raw)


def moment(day: Column, hour: Column, minute: Column) -> Column:
    """TIMESTAMP_NTZ at minute precision; null where any part is."""
    return day.cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), hour, minute, F.lit(0))


def archive_moment(raw_date: Column, raw_time: Column) -> Column:
    """The moment of an archive line's date and time; null for an impossible date."""
    hour, minute = (F.get(F.split(raw_time, ":"), F.lit(i)).try_cast("int") for i in (0, 1))
    return F.when((hour < 24) & (minute < 60), moment(F.try_to_date(raw_date, "d-MMM-yyyy"), hour, minute))


def to_minute(ts: Column) -> Column:
    """A naive timestamp cut to its minute, whatever the session time zone."""
    return F.to_date(ts).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.hour(ts), F.minute(ts), F.lit(0))


def epoch_seconds(ts: Column) -> Column:
    """Seconds since 1970 of a naive timestamp, read as UTC."""
    return (F.unix_date(F.to_date(ts)).cast("long") * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts))


def weekday_number(ts: Column) -> Column:
    """Monday = 0."""
    return F.weekday(ts)


def month_period(ts: Column) -> Column:
    return F.date_format(F.to_date(ts), "yyyy-MM")


def weekday_name(ts: Column) -> Column:
    return F.date_format(F.to_date(ts), "EEEE")


def duration_text(seconds: Column) -> Column:
    """The two most significant units, e.g. 1h 5m."""
    s = seconds.cast("long")
    days, hours, minutes = F.floor(s / 86400), F.floor(s % 86400 / 3600), F.floor(s % 3600 / 60)
    return (
        F.when(days > 0, F.format_string("%dd %dh", days, hours))
        .when(hours > 0, F.format_string("%dh %dm", hours, minutes))
        .when(minutes > 0, F.format_string("%dm %ds", minutes, s % 60))
        .otherwise(F.format_string("%ds", s % 60))
    )
