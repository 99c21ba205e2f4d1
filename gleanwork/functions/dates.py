"""Timestamps; every rule takes its reference time as an argument."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SHOWN = ["yyyy-MM-dd", "yyyy/MM/dd", "d MMM yyyy", "MMM d, yyyy", "MMMM d, yyyy"]


def publication_time(raw: Column) -> Column:
    """ISO 8601, else RFC 2822 with its weekday left out; without zone UTC; null if neither."""
    s = F.trim(raw)
    mail = F.regexp_replace(F.regexp_replace(s, r"^[A-Za-z]{3},\s*", ""), r"\b(?:GMT|UTC)$", "+0000")
    return F.coalesce(F.when(s.rlike(r"^\d{4}-\d{2}-\d{2}"), F.try_to_timestamp(s)), F.try_to_timestamp(mail, F.lit("d MMM yyyy HH:mm:ss Z")))


def compact_time(raw: Column) -> Column:
    return F.try_to_timestamp(raw, F.lit("yyyyMMdd'T'HHmmss'Z'"))


def shown_date(raw: Column) -> Column:
    s = F.trim(raw)
    return F.coalesce(F.when(s.rlike(r"^\d{4}-\d{2}-\d{2}T"), F.try_to_timestamp(s)), *[F.try_to_timestamp(s, F.lit(p)) for p in SHOWN])


def is_current(ts: Column, as_of: Column, max_age_days: int = 30) -> Column:
    return F.coalesce((ts <= as_of + F.expr("interval 1 day")) & (ts >= as_of - F.expr(f"interval {max_age_days} days")), F.lit(False))


def age_minutes(ts: Column, as_of: Column, missing: int = 999) -> Column:
    return F.coalesce(F.floor((F.unix_timestamp(as_of) - F.unix_timestamp(ts)) / 60), F.lit(missing).cast("long"))


def is_stale(started: Column, as_of: Column, minutes: int) -> Column:
    return F.coalesce(started <= as_of - F.expr(f"interval {max(5, minutes)} minutes"), F.lit(False))


def iso_date(raw: Column) -> Column:
    """An ISO date or time as UTC timestamp, null if it is none."""
    s = F.trim(raw)
    return F.when(s.rlike(r"^\d{4}-\d{2}-\d{2}(?:[T ]|$)"), F.try_to_timestamp(s))


def as_utc(raw: Column) -> Column:
    """A timestamp with or without zone as UTC; without one it is taken for UTC (the session's zone)."""
    s = F.trim(raw)
    return F.try_to_timestamp(F.when(s.rlike(r"(?:Z|[+-]\d{2}:?\d{2})$"), s).otherwise(F.concat(s, F.lit("Z"))))


def leading_date(raw: Column) -> Column:
    """The date in the first ten characters, null if there is none."""
    return F.when(F.left(raw, F.lit(10)).rlike(r"^\d{4}-\d{2}-\d{2}$"), F.left(raw, F.lit(10)).try_cast("date"))


def story_date(published: Column, first_seen: Column) -> Column:
    """The latest date of a list of source timestamps and of when the story was seen first."""
    dates = F.array_compact(F.transform(F.array_append(published, first_seen), leading_date))
    return F.array_max(dates)


def within_bucket(ts: Column, as_of: Column, bucket: str) -> Column:
    """Whether a time lies in the last day, week, month or year."""
    days = {"d": 1, "w": 7, "m": 30, "y": 365}[bucket]
    return F.coalesce((ts <= as_of) & (ts >= as_of - F.expr(f"interval {days} days")), F.lit(False))
