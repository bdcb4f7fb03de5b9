"""Dates: the editions' zone, delivery times, relative times, day buckets. Every function takes the time it works at."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the zone of editions.
ZONE = "Asia/Kolkata"


def local(utc: Column) -> Column:
    return F.convert_timezone(F.lit("UTC"), F.lit(ZONE), utc.cast("timestamp_ntz"))


def local_date(utc: Column) -> Column:
    return F.to_date(local(utc))


def delivery_minute(text: Column) -> Column:
    """Minutes after midnight of a time like 1:05 PM; null for anything else."""
    h, m, half = (F.regexp_extract(text, r"^\s*(\d{1,2}):(\d{2})\s*([AaPp])[Mm]\s*$", k) for k in (1, 2, 3))
    hour, minute = (F.nullif(x, F.lit("")).cast("int") for x in (h, m))
    return F.when((half != "") & hour.between(1, 12) & (minute < 60), hour % 12 * 60 + minute + F.when(F.upper(half) == "P", 720).otherwise(0))


def next_delivery(text: Column, now_local: Column) -> Column:
    """The next moment of that time of day: today if it is still ahead, else tomorrow."""
    day = F.to_date(now_local).cast("timestamp_ntz")
    at = day + F.make_dt_interval(mins=delivery_minute(text))
    return F.when(at > now_local, at).otherwise(at + F.expr("INTERVAL 1 DAY"))


def bucket(created: Column, now: Column) -> Column:
    """today, yesterday, week, month or earlier, by calendar days."""
    days = F.datediff(F.to_date(now), F.to_date(created))
    return F.when(days <= 0, "today").when(days == 1, "yesterday").when(days < 7, "week").when(days < 30, "month").otherwise("earlier")


def ago(created: Column, now: Column) -> Column:
    s = F.timestamp_diff("SECOND", created, now)
    return F.when(s < 60, "just now").when(s < 3600, F.concat(F.floor(s / 60).cast("string"), F.lit("m ago"))).when(s < 86400, F.concat(F.floor(s / 3600).cast("string"), F.lit("h ago"))).when(s < 7 * 86400, F.concat(F.floor(s / 86400).cast("string"), F.lit("d"))).otherwise(F.date_format(created, "yyyy-MM-dd"))
