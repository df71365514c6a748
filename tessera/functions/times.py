"""Clock arithmetic of notifications: quiet hours, local days, digest periods."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def minutes(hhmm: Column, default: int) -> Column:
    """Minutes of a day from HH:MM; the default where it is none."""
    h, m = F.regexp_extract(hhmm, r"^\s*(\d{1,2}):(\d{2})\s*$", 1), F.regexp_extract(hhmm, r"^\s*(\d{1,2}):(\d{2})\s*$", 2)
    h, m = F.nullif(h, F.lit("")).cast("int"), F.nullif(m, F.lit("")).cast("int")
    return F.coalesce(F.when((h < 24) & (m < 60), h * 60 + m), F.lit(default))


def local(ts: Column, zone: Column) -> Column:
    return F.from_utc_timestamp(ts.cast("timestamp"), zone)


def minute_of_day(ts: Column) -> Column:
    return F.hour(ts) * 60 + F.minute(ts)


def in_quiet_hours(local_ts: Column, start: Column, end: Column) -> Column:
    """Whether a local time is within the quiet hours, which may wrap midnight; equal ends mean never."""
    at = minute_of_day(local_ts)
    return F.when(start == end, False).when(start < end, (at >= start) & (at < end)).otherwise((at >= start) | (at < end))


def next_quiet_end(ts: Column, zone: Column, start: Column, end: Column) -> Column:
    """The UTC time at which the quiet hours that hold ts end."""
    there = local(ts, zone)
    later = (start > end) & (minute_of_day(there) >= start)
    day = F.date_trunc("day", there) + F.when(later, F.expr("INTERVAL 1 DAY")).otherwise(F.expr("INTERVAL 0 DAY"))
    return F.to_utc_timestamp(day + F.make_dt_interval(F.lit(0), F.lit(0), end), zone)


def schedule(ts: Column, zone: Column, start: Column, end: Column) -> Column:
    return F.when(in_quiet_hours(local(ts, zone), start, end), next_quiet_end(ts, zone, start, end)).otherwise(ts.cast("timestamp"))


def digest_period(ts: Column, zone: Column, frequency: Column) -> tuple[Column, Column, Column]:
    """(key, begin, end) of the last period that is over at ts; null for a daily digest before 08:00 local.

    Days end at 08:00 local, weeks at 08:00 on Monday with an ISO week key.
    """
    there = local(ts, zone)
    shifted = there - F.expr("INTERVAL 8 HOURS")
    weekly = frequency == "weekly"
    day = F.when(weekly, F.date_trunc("week", shifted)).when((frequency == "daily") & (F.hour(there) >= 8), F.date_trunc("day", there))
    end = day + F.expr("INTERVAL 8 HOURS")
    begin = F.when(weekly, end - F.expr("INTERVAL 7 DAYS")).otherwise(end - F.expr("INTERVAL 1 DAY"))
    week = F.concat(F.extract(F.lit("YEAROFWEEK"), day).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(day).cast("string"), 2, "0"))
    return F.when(weekly, week).otherwise(F.date_format(day, "yyyy-MM-dd")), F.to_utc_timestamp(begin, zone), F.to_utc_timestamp(end, zone)


def time_phrase(days: Column) -> Column:
    """How long since the last update, in words; empty where unknown."""
    some = lambda n, word: F.concat(F.lit("Time since last update: "), n.cast("string"), F.lit(f" {word} ago"))
    said = F.when(days == 0, "Time since last update: Same day").when(days == 1, "Time since last update: Yesterday").when(days < 7, some(days, "days"))
    return F.when(days.isNull(), "").otherwise(F.coalesce(said, F.when(days < 30, some(F.floor(days / 7), "week(s)")).otherwise(some(F.floor(days / 30), "month(s)"))))
