"""Casts that turn unreadable values into null instead of failing the job."""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T


#: A decimal number with optional exponent. Spark's own cast also takes Java's suffixes ('12D').
_NUMBER = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"


def number_text(value: Column) -> Column:
    """Text that reads as a number, any other text null."""
    return F.when(value.rlike(_NUMBER), value)


def nan_to_null(value: Column, kind: T.DataType) -> Column:
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(value), value)
    return value


def to_number(value: Column, kind: T.DataType) -> Column:
    """Double, or null for text that is not a number. NaN counts as missing."""
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType, T.BinaryType)):
        return F.lit(None).cast("double")
    text = number_text(value) if isinstance(kind, T.StringType) else value
    return nan_to_null(text.try_cast("double"), T.DoubleType())


#: Layouts of date texts besides ISO, in the order in which they are tried.
_DATE_LAYOUTS = (
    "yyyyMMdd",
    "yyyy/M/d[ H:mm[:ss]]",
    "d-MMM-yyyy[ H:mm[:ss]]",
    "d MMM yyyy[ H:mm[:ss]]",
    "MMM d[,] yyyy[ H:mm[:ss]]",
    "MMM d[,] yyyy h:mm[:ss] a",
)
#: Layouts in which day and month are numbers.
_NUMERIC_DATES = ("{}/{}/yyyy", "{}-{}-yyyy", "{}.{}.yyyy")
_CLOCKS = ("[ H:mm[:ss]]", " h:mm[:ss] a")


def date_layouts(day_first: bool) -> list[str]:
    """All layouts that ``to_time`` tries, in order."""
    order = ("d", "M") if day_first else ("M", "d")
    numeric = [text.format(*order) + clock for text in _NUMERIC_DATES for clock in _CLOCKS]
    return [*_DATE_LAYOUTS, *numeric]


def to_time(value: Column, kind: T.DataType, day_first: bool = False) -> Column:
    """Timestamp, or null for unreadable text.

    ISO text first, then the layouts of ``date_layouts``; ``day_first`` tells whether 1/2/2024 is
    in February. A bare time of day is not a date: Spark would complete it with today's date,
    which would make the result depend on the day of the run.
    """
    if isinstance(kind, T.StringType):
        text = F.trim(value)
        iso = F.when(~text.rlike(r"^(T?\d{1,2}:|\d+$)"), text).try_cast("timestamp")
        others = [F.try_to_timestamp(text, F.lit(layout)) for layout in date_layouts(day_first)]
        return F.coalesce(iso, *others)
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return value.cast("timestamp")
    return F.lit(None).cast("timestamp")


def delivery_key(value: Column, kind: T.DataType, null_as_zero: bool = False) -> Column:
    """Delivery number as text without a fraction: 12.9 gives '12', unreadable text gives null.

    With ``null_as_zero`` a missing number, NaN included, is '0'.
    """
    value = nan_to_null(value, kind)
    if isinstance(kind, T.IntegralType):
        whole = value.cast("bigint")
    elif isinstance(kind, T.StringType):
        # the direct cast keeps long numbers exact, the detour over double reads '12.0'
        text = number_text(value)
        whole = F.coalesce(text.try_cast("bigint"), text.try_cast("double").try_cast("bigint"))
    else:
        whole = value.try_cast("bigint")
    text = whole.cast("string")
    return F.coalesce(text, F.when(value.isNull(), F.lit("0"))) if null_as_zero else text
