"""Time arithmetic and time texts."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, functions as F, types as T

_MICROS_PER_MINUTE = 60e6
_MICROS_PER_HOUR = 3600e6


def at(as_of: datetime | str | Column) -> Column:
    """A fixed point in time as a column."""
    if isinstance(as_of, Column):
        return as_of
    if isinstance(as_of, datetime):
        as_of = as_of.strftime("%Y-%m-%d %H:%M:%S.%f")
    return F.lit(as_of).cast("timestamp")


def minutes_between(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(_MICROS_PER_MINUTE)


def hours_between(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(_MICROS_PER_HOUR)


def window_start(as_of: datetime | str | Column, minutes: int) -> Column:
    return at(as_of) - F.make_interval(mins=F.lit(minutes))


def time_of_day(value: Column, kind: T.DataType) -> Column:
    """Time of day as 'HH:mm:ss' text; text passes through, of 12-hour clocks too."""
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.date_format(value, "HH:mm:ss")
    text = F.upper(F.trim(value.cast("string")))
    half_day = F.try_to_timestamp(text, F.lit("h:mm[:ss] a"))
    return F.when(text.rlike("[AP]M$"), F.date_format(half_day, "HH:mm:ss")).otherwise(text)


def join_date_and_time(day: Column, time_text: Column) -> Column:
    """Day and time text as one timestamp; null when either is missing or unreadable.

    ``concat`` (not ``concat_ws``) keeps a missing time null instead of midnight, and the plain
    cast avoids a per-row formatter.
    """
    return F.concat(day.cast("date").cast("string"), F.lit(" "), time_text).try_cast("timestamp")


def iso_text(value: Column) -> Column:
    """ISO 8601 text; the fraction appears only when there is one."""
    whole = F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss")
    fraction = F.when(
        F.pmod(F.unix_micros(value), F.lit(1_000_000)) != 0, F.date_format(value, ".SSSSSS")
    )
    return F.concat(whole, F.coalesce(fraction, F.lit("")))


def duration_label(later: Column, earlier: Column) -> Column:
    """'n seconds' below a minute, 'm min s sec' below an hour, then 'h hr m min'."""
    micros = F.unix_micros(later) - F.unix_micros(earlier)
    total = F.floor(micros / F.lit(1e6) + F.lit(0.5))
    hours = F.floor(total / 3600)
    minutes = F.floor(total / 60)
    return (
        F.when(total < 60, F.concat(total.cast("string"), F.lit(" seconds")))
        .when(
            total < 3600,
            F.concat(
                minutes.cast("string"), F.lit(" min "), (total % 60).cast("string"), F.lit(" sec")
            ),
        )
        .otherwise(
            F.concat(
                hours.cast("string"), F.lit(" hr "), (minutes % 60).cast("string"), F.lit(" min")
            )
        )
    )
