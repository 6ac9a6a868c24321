"""Descriptions, percentages and display names."""

from __future__ import annotations

from collections.abc import Mapping
from itertools import chain

from pyspark.sql import Column, functions as F


def describe_status(status: Column, descriptions: Mapping[str, str]) -> Column:
    """Description of a status code; an unknown code gives null."""
    if not descriptions:
        return F.lit(None).cast("string")
    return F.create_map(*[F.lit(x) for x in chain(*descriptions.items())])[status]


def rounded(value: Column, half_even: bool = False) -> Column:
    """Two decimals; halves go up, or to the even neighbour."""
    return F.bround(value, 2) if half_even else F.round(value, 2)


def percent_of(part: Column, total: Column, half_even: bool = False) -> Column:
    """part / total in percent to two decimals; null when the total is zero or missing."""
    return rounded(F.try_divide(part.cast("double"), total) * 100, half_even)


def card_percent(part: Column, total: Column) -> Column:
    """Whole percent for a progress card: halves round up, no total means zero."""
    share = F.floor(F.try_divide(part.cast("double"), total) * 100 + 0.5)
    return F.when(total > 0, share).otherwise(F.lit(0)).cast("long")


def card_band(percent: Column) -> Column:
    return (
        F.when(percent < 25, "danger")
        .when(percent < 50, "warning")
        .when(percent < 75, "info")
        .otherwise("success")
    )


def display_name(name: Column, user: Column) -> Column:
    return F.coalesce(name, F.concat(F.lit("User "), user))
