"""Scans folded by minute, so that activity within any lookback is merged and not computed anew.

A slice holds the scans of one minute, user and delivery: their number, first and last time, and
the times themselves. Slices merge exactly: numbers add up, first and last times are extremes, and
distinct deliveries are counted over rows that already are one per delivery and minute. Only the
minute that the window begins in is looked into; its times tell which of its scans belong.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, functions as F

from dockpulse.functions.labels import display_name, rounded
from dockpulse.functions.timing import at, hours_between, minutes_between, window_start
from dockpulse.operators.users import _first_names
from dockpulse.schemas import present


def scan_slices(df: DataFrame) -> DataFrame:
    """(day, minute, created_by, delivery, scan_count, first_scan, last_scan, times) of all scans.
    Write them by ``day``: a window then opens the folders of its days only."""
    known = present(df, "created_by", "scan_timestamp")
    # by time first: a second that very many scans share is one row before anything is gathered
    per_time = known.groupBy("created_by", "delivery", "scan_timestamp").agg(
        F.count(F.lit(1)).alias("n")
    )
    minute = F.date_trunc("minute", "scan_timestamp")
    return per_time.groupBy(minute.alias("minute"), "created_by", "delivery").agg(
        F.sum("n").alias("scan_count"),
        F.min("scan_timestamp").alias("first_scan"),
        F.max("scan_timestamp").alias("last_scan"),
        F.sort_array(F.collect_list(F.struct("scan_timestamp", "n"))).alias("times"),
    ).withColumn("day", F.col("minute").cast("date"))


def known_users(df: DataFrame) -> DataFrame:
    """(created_by, name, newest_scan) of all users, what a window cannot tell."""
    newest = present(df, "created_by", "scan_timestamp").groupBy("created_by").agg(
        F.max("scan_timestamp").alias("newest_scan")
    )
    named = _first_names(present(df, "created_by")).withColumnRenamed("__name", "name")
    return named.join(newest, "created_by", "left")


def users_from_slices(
    slices: DataFrame,
    users: DataFrame,
    as_of: datetime | str,
    window_minutes: int = 60,
    include_inactive: bool = False,
    half_even: bool = False,
) -> DataFrame:
    """The users section at any time from saved ``scan_slices`` and ``known_users``; equal to
    ``user_activity`` over the scans that these were made of."""
    cutoff = window_start(as_of, window_minutes)
    begins = F.date_trunc("minute", cutoff)
    late = F.filter("times", lambda t: t.scan_timestamp >= cutoff)
    partly = (F.col("minute") == begins) & (F.col("first_scan") < cutoff)
    within = (
        slices.filter((F.col("day") >= begins.cast("date")) & (F.col("minute") >= begins))
        .filter(F.col("last_scan") >= cutoff)
        .select(
            "created_by",
            "delivery",
            "last_scan",
            F.when(partly, F.aggregate(late, F.lit(0).cast("long"), lambda s, t: s + t.n))
            .otherwise(F.col("scan_count"))
            .alias("scan_count"),
            F.when(partly, late[0].scan_timestamp).otherwise(F.col("first_scan")).alias("first_scan"),
        )
    )
    first, last = F.col("first_scan"), F.col("last_scan")

    def merged(rows: DataFrame, *keys: str, **more) -> DataFrame:
        return rows.groupBy(*keys).agg(
            F.sum("scan_count").alias("scan_count"),
            F.min(first).alias("first_scan"),
            F.max(last).alias("last_scan"),
            *[column.alias(name) for name, column in more.items()],
        )

    active = merged(
        merged(within, "created_by", "delivery"), "created_by", unique_deliveries=F.count("delivery")
    )
    rate = F.try_divide(F.col("scan_count").cast("double"), hours_between(last, first))
    seen = F.col("scan_count").isNotNull()
    section = users.join(active, "created_by", "left").select(
        F.col("created_by").alias("user_id"),
        F.coalesce("scan_count", F.lit(0)).alias("scan_count"),
        first,
        last,
        F.coalesce("unique_deliveries", F.lit(0)).alias("unique_deliveries"),
        F.when(seen, rounded(rate, half_even)).otherwise(F.lit(0.0)).alias("scans_per_hour"),
        rounded(minutes_between(at(as_of), last), half_even).alias("minutes_since_last_scan"),
        F.when(seen, display_name(F.col("name"), F.col("created_by"))).alias("name"),
        "newest_scan",
    )
    if include_inactive:
        wanted = F.col("newest_scan").isNotNull()
    else:
        # nobody recent: everybody who ever scanned appears with zeros
        anybody = users.agg(F.max("newest_scan") >= cutoff).scalar()
        idle = F.col("newest_scan").isNotNull() & ~F.coalesce(anybody, F.lit(False))
        wanted = (F.col("scan_count") > 0) | idle
    return section.filter(wanted).drop("newest_scan")
