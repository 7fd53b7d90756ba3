"""Validity, freshness and labels of times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mobilis.functions.coerce import js_round


def in_effect(start: Column, end: Column, now: Column) -> Column:
    """Closed on both ends; an open end never excludes."""
    return F.coalesce(start <= now, F.lit(True)) & F.coalesce(end >= now, F.lit(True))


def valid_at(start: Column, until: Column, as_of: Column) -> Column:
    """Half open: from ``start`` up to but without ``until``."""
    return (start <= as_of) & (until.isNull() | (until > as_of))


def published(start: Column, end: Column, now: Column, back_days: int = 120, ahead_days: int = 45) -> Column:
    """Not long over and not far ahead; records without a schedule stay."""
    over = F.coalesce(end < now - F.expr(f"INTERVAL {back_days} DAYS"), F.lit(False))
    ahead = F.coalesce(start > now + F.expr(f"INTERVAL {ahead_days} DAYS"), F.lit(False))
    return ~over & ~ahead


def seconds_between(start: Column, end: Column) -> Column:
    """Whole microseconds apart, in seconds; works for times with and without a zone."""
    return F.timestamp_diff("MICROSECOND", start, end) / F.lit(1e6)


def lag_seconds(observed: Column, now: Column) -> Column:
    return F.greatest(F.lit(0), js_round(seconds_between(observed, now)).cast("long"))


def quality_flags(age_seconds: Column, stale_after: Column) -> Column:
    """Late rows are flagged, never dropped."""
    return (
        F.when(age_seconds > 2 * stale_after, F.array(F.lit("stale"), F.lit("outside_freshness_window")))
        .when(age_seconds > stale_after, F.array(F.lit("delayed")))
        .otherwise(F.array().cast("array<string>"))
    )


def lag_label(seconds: Column) -> Column:
    return (
        F.when(seconds < 60, F.concat(seconds.cast("string"), F.lit("s")))
        .when(seconds < 3600, F.concat(js_round(seconds / 60).cast("string"), F.lit("m")))
        .otherwise(F.concat(js_round(seconds / 3600).cast("string"), F.lit("h")))
    )


def minutes_left(until: Column, now: Column) -> Column:
    return F.greatest(F.lit(0), js_round(seconds_between(now, until) / 60).cast("long"))


def cadence_bucket(at: Column, seconds: int) -> Column:
    """The number of the tumbling bucket that a time falls in."""
    epoch = F.lit("1970-01-01").cast("timestamp_ntz")
    return F.floor(F.timestamp_diff("MICROSECOND", epoch, at.cast("timestamp_ntz")) / F.lit(seconds * 1_000_000)).cast("long")


def span_percent(at: Column, start: Column, span_seconds: int) -> Column:
    """Position in a span, clamped to 0 and 100."""
    return F.least(F.lit(100.0), F.greatest(F.lit(0.0), seconds_between(start, at) * 100.0 / F.lit(float(span_seconds))))


def clock(at: Column, seconds: bool = False) -> Column:
    """The time of day in the session's zone: hh:mm, or hh:mm:ss with a literal Z; a dash where unknown."""
    return F.coalesce(F.date_format(at, "HH:mm:ss'Z'" if seconds else "HH:mm"), F.lit("—"))


def remaining_label(minutes: Column) -> Column:
    """Minutes left in words; a dash where unknown."""
    hours, rest = F.floor(minutes / 60).cast("string"), (minutes % 60).cast("string")
    return (
        F.when(minutes.isNull(), "—")
        .when(minutes < 1, "due now")
        .when(minutes < 60, F.concat(minutes.cast("string"), F.lit(" min")))
        .when(minutes % 60 == 0, F.concat(hours, F.lit("h")))
        .otherwise(F.concat(hours, F.lit("h "), rest, F.lit("m")))
    )
