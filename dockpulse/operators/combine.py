"""Scans joined with deliveries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from dockpulse.functions.open_columns import (
    EXTRA,
    entries_as_maps,
    map_columns,
    maps_as_entries,
    merged_extra,
)
from dockpulse.operators.ranking import top_rows


def combine(scans: DataFrame, deliveries: DataFrame) -> DataFrame:
    """Inner join on the delivery key, many to many.

    A column both sides have keeps its plain name for the scan side unless the delivery side
    also needs it, in which case both get a suffix. The join carries no hint: the size of the
    delivery report decides at run time between broadcast and shuffle, and a delivery that
    holds a large share of the scans is split by the adaptive skew join. Further columns of both
    reports, in ``extra``, become one map with the same rule for names that both have.
    """
    both_open = EXTRA in scans.columns and EXTRA in deliveries.columns
    clash = [c for c in deliveries.columns if c in scans.columns and c != "delivery"]
    left = scans.withColumnsRenamed({c: f"{c}_serial" for c in clash})
    right = deliveries.withColumnsRenamed({c: f"{c}_delivery" for c in clash})
    joined = left.join(right, "delivery", "inner")
    columns = [*left.columns, *[c for c in right.columns if c != "delivery"]]
    if not both_open:
        return joined.select(*columns)
    mine, theirs = f"{EXTRA}_serial", f"{EXTRA}_delivery"
    extra = merged_extra(F.col(mine), F.col(theirs), "_serial", "_delivery").alias(EXTRA)
    return joined.select(*[c for c in columns if c not in (mine, theirs)], extra)


def one_row_per_delivery(deliveries: DataFrame) -> DataFrame:
    """The row of each delivery that the deduplication by serial would pick: fewest packages
    first, then the lowest of the remaining columns. Joining with these rows instead of all gives
    the same serials and never multiplies the scans of a delivery that is listed repeatedly."""
    rest = [c for c in deliveries.columns if c not in ("delivery", "number_of_packages")]
    order = [F.col(c).asc_nulls_last() for c in ["number_of_packages", *rest]]
    maps = map_columns(deliveries)
    # maps are moved as the entries they are ordered by, not as both
    return entries_as_maps(top_rows(maps_as_entries(deliveries, maps), ["delivery"], order), maps)
