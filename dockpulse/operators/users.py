"""User activity within a lookback window."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, functions as F

from dockpulse.functions.labels import display_name, rounded
from dockpulse.functions.timing import at, hours_between, minutes_between, window_start
from dockpulse.schemas import present


def recent_scans(df: DataFrame, as_of: datetime | str, window_minutes: int) -> DataFrame:
    """Scans at or after the start of the window; there is no upper bound."""
    return present(df, "scan_timestamp", "created_by").filter(
        F.col("scan_timestamp") >= window_start(as_of, window_minutes)
    )


def _first_names(df: DataFrame) -> DataFrame:
    """Name on the row of each user with the lowest serial number, null if that row has none."""
    order = F.struct(
        *[
            part
            for name in ("serial_number", "scan_timestamp", "name")
            for part in (F.col(name).isNull().alias(f"no_{name}"), F.col(name))
        ]
    )
    return df.groupBy("created_by").agg(F.min_by("name", order).alias("__name"))


def user_names(df: DataFrame) -> DataFrame:
    """Display name per user: the name on the user's lowest serial, else 'User <id>'."""
    return _first_names(present(df, "created_by")).select(
        F.col("created_by").alias("user_id"),
        display_name(F.col("__name"), F.col("created_by")).alias("name"),
    )


def user_activity(
    df: DataFrame,
    as_of: datetime | str,
    window_minutes: int = 60,
    include_inactive: bool = False,
    half_even: bool = False,
) -> DataFrame:
    """Scan count, first and last scan, deliveries and rate per user within the window.

    When nobody scanned within the window, every user is returned with zeros and nulls;
    ``include_inactive`` adds such rows for inactive users in any case. Whether anybody is recent
    is a value of the plan, the newest scan alone, so nothing runs before the result is asked for.
    The counts read the window only, a filter that reaches the scan of a saved table, and names
    are sought for the users left.
    """
    cutoff = window_start(as_of, window_minutes)
    known = present(df, "created_by", "scan_timestamp")
    first, last = F.col("first_scan"), F.col("last_scan")
    active = (
        # by delivery first: a heavy user shrinks, by hash, before anything is moved
        known.filter(F.col("scan_timestamp") >= cutoff)
        .groupBy("created_by", "delivery")
        .agg(
            F.count(F.lit(1)).alias("scan_count"),
            F.min("scan_timestamp").alias("first_scan"),
            F.max("scan_timestamp").alias("last_scan"),
        )
        .groupBy("created_by")
        .agg(
            F.sum("scan_count").alias("scan_count"),
            F.min(first).alias("first_scan"),
            F.max(last).alias("last_scan"),
            F.count("delivery").alias("unique_deliveries"),
        )
    )
    rate = F.try_divide(F.col("scan_count").cast("double"), hours_between(last, first))
    columns = [
        F.col("created_by").alias("user_id"),
        "scan_count",
        first,
        last,
        "unique_deliveries",
        rounded(rate, half_even).alias("scans_per_hour"),
        rounded(minutes_between(at(as_of), last), half_even).alias("minutes_since_last_scan"),
    ]
    if "name" in df.columns:
        everything = present(df, "created_by").join(active.select("created_by"), "created_by", "left_semi")
        active = active.join(_first_names(everything), "created_by", "left")
        columns.append(display_name(F.col("__name"), F.col("created_by")).alias("name"))
    section = active.select(*columns)
    users = known.select(F.col("created_by").alias("user_id"))
    if include_inactive:
        idle = users.distinct().join(section.select("user_id"), "user_id", "left_anti")
    else:
        anybody = known.agg(F.max("scan_timestamp") >= cutoff).scalar()
        idle = users.filter(~F.coalesce(anybody, F.lit(False))).distinct()
    zeros = {"scan_count": 0, "unique_deliveries": 0, "scans_per_hour": 0.0}
    idle = idle.select(
        *[
            "user_id"
            if f.name == "user_id"
            else F.lit(zeros.get(f.name)).cast(f.dataType).alias(f.name)
            for f in section.schema.fields
        ]
    )
    return section.unionByName(idle)


def active_users(section: DataFrame, as_of: datetime | str, window_minutes: int = 60) -> DataFrame:
    """Users whose last scan lies within the window."""
    return section.filter(F.col("last_scan") >= window_start(as_of, window_minutes))
