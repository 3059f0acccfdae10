"""Durations, ages and policies over ``timestamp_ntz`` columns; "now" is always an argument."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def seconds_between(start: Column, end: Column) -> Column:
    return F.timestamp_diff("SECOND", start, end)


def minutes_seconds(seconds: Column) -> Column:
    return F.concat(F.floor(seconds / 60).cast("string"), F.lit("分"), (seconds % 60).cast("string"), F.lit("秒"))


def elapsed(created: Column, start: Column, end: Column) -> Column:
    """Minutes and seconds from start (from creation, if start is missing or after the end);
    ``--`` where nothing sound is left."""
    own, fallback = seconds_between(start, end), seconds_between(created, end)
    return F.when(own >= 0, minutes_seconds(own)).when(fallback >= 0, minutes_seconds(fallback)).otherwise("--")


def elapsed_started(start: Column, end: Column) -> Column:
    """Minutes and seconds from start to end only."""
    spent = seconds_between(start, end)
    return F.when(spent >= 0, minutes_seconds(spent)).otherwise("--")


def elapsed_tiers(start: Column, end: Column) -> Column:
    """Seconds, minutes and seconds, or hours and minutes."""
    s = seconds_between(start, end)
    hours = F.concat(F.floor(s / 3600).cast("string"), F.lit("小时"), F.floor((s % 3600) / 60).cast("string"), F.lit("分"))
    return F.when(s < 60, F.concat(s.cast("string"), F.lit("秒"))).when(s < 3600, minutes_seconds(s)).otherwise(hours)


def spent_text(seconds: Column) -> Column:
    """Days, hours, minutes and seconds; parts that are zero are left out."""
    parts = (
        (F.floor(seconds / 86400), "天"),
        (F.floor((seconds % 86400) / 3600), "小时"),
        (F.floor((seconds % 3600) / 60), "分钟"),
        (seconds % 60, "秒"),
    )
    return F.concat(F.lit("用时"), *[F.when(n > 0, F.concat(n.cast("string"), F.lit(unit))).otherwise(F.lit("")) for n, unit in parts])


def uptime(started: Column, now: Column) -> Column:
    s = seconds_between(started, now)
    return F.struct(F.floor(s / 86400).alias("days"), F.floor((s % 86400) / 3600).alias("hours"))


def days_left(expires: Column, now: Column) -> Column:
    """Begun days until expiry, from 1 to 7; 0 once it has passed."""
    s = seconds_between(now, expires)
    return F.when(s <= 0, F.lit(0)).otherwise(F.least(F.greatest(F.floor(s / 86400) + 1, F.lit(1)), F.lit(7)).cast("int"))


def is_expired(expires: Column, now: Column) -> Column:
    return F.coalesce(seconds_between(now, expires) <= 0, F.lit(False))


def older_than(created: Column, now: Column, hours: int) -> Column:
    return seconds_between(created, now) > hours * 3600


def to_shanghai(utc: Column) -> Column:
    """ISO text of a UTC time at UTC+8."""
    return F.date_format(F.convert_timezone(F.lit("UTC"), F.lit("Asia/Shanghai"), utc), "yyyy-MM-dd'T'HH:mm:ss")


def date_or_dashes(at: Column, pattern: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    return F.coalesce(F.date_format(at, pattern), F.lit("--"))


def streaming_policy(size_bytes: Column, words: Column) -> Column:
    """struct(streaming, chunk): large or long files are streamed, in smaller chunks the larger they are."""
    mb = F.coalesce(size_bytes, F.lit(0)) / (1024 * 1024)
    streaming = (mb > 5) | F.coalesce(words > 10000, F.lit(False))
    chunk = F.when(~streaming, 10).when(mb > 50, 5).when(mb > 20, 8).otherwise(10)
    return F.struct(streaming.alias("streaming"), chunk.alias("chunk"))


def font_rgb(color: Column) -> Column:
    """A packed colour's channels from 0 to 1."""
    channel = lambda shift: F.shiftright(color, shift).bitwiseAND(F.lit(255)) / 255.0
    return F.struct(channel(16).alias("r"), channel(8).alias("g"), channel(0).alias("b"))
