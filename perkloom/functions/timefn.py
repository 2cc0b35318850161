"""Instants, local wall-clock time and validity windows, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from perkloom.functions import fixed_values as V

MS_PER_DAY = 86_400_000.0


def local_time(instant: Column, zone: str = V.LOCAL_ZONE) -> Column:
    """The wall-clock time (TIMESTAMP_NTZ) of an instant in ``zone``."""
    return F.convert_timezone(F.current_timezone(), F.lit(zone), instant.cast("timestamp_ntz"))


def utc_instant(clock: Column) -> Column:
    """A TIMESTAMP_NTZ that means UTC, as an instant, whatever the session zone."""
    return F.convert_timezone(F.lit("UTC"), F.current_timezone(), clock).cast("timestamp")


def utc_text(instant: Column) -> Column:
    """ISO 8601 with milliseconds and ``Z``."""
    clock = F.convert_timezone(F.current_timezone(), F.lit("UTC"), instant.cast("timestamp_ntz"))
    return F.date_format(clock, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def local_weekday(instant: Column, zone: str = V.LOCAL_ZONE) -> Column:
    """1 = Sunday .. 7 = Saturday."""
    return F.dayofweek(local_time(instant, zone))


def local_minutes(instant: Column, zone: str = V.LOCAL_ZONE) -> Column:
    """Minutes since local midnight."""
    at = local_time(instant, zone)
    return F.hour(at) * 60 + F.minute(at)


def minutes_of_day(text: Column) -> Column:
    """'HH:MM' to minutes since midnight."""
    return F.split_part(text, F.lit(":"), F.lit(1)).cast("int") * 60 + F.split_part(
        text, F.lit(":"), F.lit(2)
    ).cast("int")


def within_hours(minutes: Column, start: Column, end: Column) -> Column:
    """Both ends inclusive; wraps past midnight; equal ends mean always."""
    lo, hi = minutes_of_day(start), minutes_of_day(end)
    return (
        F.when(lo == hi, True)
        .when(lo < hi, (minutes >= lo) & (minutes <= hi))
        .otherwise((minutes >= lo) | (minutes <= hi))
    )


def days_between(earlier: Column, later: Column) -> Column:
    """Fractional days; null when either instant is missing or unparseable."""
    return (F.unix_millis(later) - F.unix_millis(earlier)) / F.lit(MS_PER_DAY)


def day_edge(text: Column, edge: str, zone: str = V.LOCAL_ZONE) -> Column:
    """A bare ``YYYY-MM-DD`` as the instant its local day starts or ends.

    The end is one millisecond before the *next* local midnight, so a day with
    a clock change keeps its true length. Anything that is not a bare, real date
    gives null.
    """
    date = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(text, "yyyy-MM-dd"))
    if edge == "start":
        return _local_midnight(date, zone)
    return _local_midnight(F.date_add(date, 1), zone) - F.expr("INTERVAL 1 MILLISECOND")


def _local_midnight(date: Column, zone: str) -> Column:
    return F.convert_timezone(
        F.lit(zone), F.current_timezone(), date.cast("timestamp_ntz")
    ).cast("timestamp")


def to_instant(text: Column, edge: str, zone: str = V.LOCAL_ZONE) -> Column:
    """A stated validity date: a bare date goes to its local edge, a full
    timestamp passes through, anything else is null."""
    return F.coalesce(day_edge(text, edge, zone), F.try_to_timestamp(text))


def verified_label(verified: Column, now: Column) -> Column:
    """today / yesterday / N days ago."""
    days = F.floor(days_between(verified, now))
    return (
        F.when(days <= 0, F.lit(V.VERIFIED_TODAY))
        .when(days == 1, F.lit(V.VERIFIED_YESTERDAY))
        .otherwise(F.format_string(V.VERIFIED_DAYS, days))
    )


def dwell_minutes(entered: Column, now: Column) -> Column:
    """Whole minutes since entering, never negative; null when not inside."""
    return F.greatest(
        F.lit(0), F.floor((F.unix_millis(now) - F.unix_millis(entered)) / F.lit(60_000))
    ) * F.when(entered.isNotNull(), F.lit(1))
