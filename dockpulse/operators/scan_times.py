"""Current and previous scan per user."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from dockpulse.functions.labels import rounded
from dockpulse.functions.timing import at, duration_label, minutes_between
from dockpulse.operators.ranking import ranked, top_rows
from dockpulse.schemas import present


def scan_times(df: DataFrame, as_of: datetime | str, half_even: bool = False) -> DataFrame:
    """Latest scan per user, the latest one strictly before it, and the gap between them.

    Two passes, both cut to a row or two per user and map task before anything is moved: the
    first row at the latest time, and the two latest distinct times.
    """
    valid = present(df, "scan_timestamp", "created_by").select(
        "created_by", "scan_timestamp", "serial_number", "status"
    )
    order = [F.desc("scan_timestamp"), F.asc_nulls_last("serial_number"), F.asc_nulls_first("status")]
    first = top_rows(valid, ["created_by"], order)
    times = top_rows(
        valid.select("created_by", "scan_timestamp").distinct(),
        ["created_by"],
        [F.desc("scan_timestamp")],
        2,
    )
    earlier = times.groupBy("created_by").agg(
        F.max("scan_timestamp").alias("__latest"),
        F.min("scan_timestamp").alias("__earliest"),
    )
    newest = first.join(earlier, "created_by").withColumn(
        "previous_scan_time",
        F.when(F.col("__earliest") < F.col("__latest"), F.col("__earliest")),
    )
    current, previous = F.col("scan_timestamp"), F.col("previous_scan_time")
    return newest.select(
        F.col("created_by").alias("user_id"),
        current.alias("current_scan_time"),
        previous,
        minutes_between(current, previous).alias("time_between_scans_minutes"),
        F.coalesce("serial_number", F.lit("")).alias("serial"),
        F.coalesce("status", F.lit("")).alias("status"),
        rounded(minutes_between(at(as_of), current), half_even).alias("minutes_since_last_scan"),
    )


def scan_times_lookup(section: DataFrame, user: str | None = None) -> DataFrame:
    return section.filter(F.col("user_id") == user) if user else section


def scan_gap_labels(section: DataFrame) -> DataFrame:
    """The gap between the two scans of each user as text."""
    return section.select(
        "user_id",
        "current_scan_time",
        "previous_scan_time",
        duration_label(F.col("current_scan_time"), F.col("previous_scan_time")).alias("gap_label"),
    )


def latest_two_scans(df: DataFrame) -> DataFrame:
    """The two most recent scan rows of each user side by side; unlike ``scan_times`` the two
    may have the same time."""
    valid = present(df, "scan_timestamp", "created_by").select(
        "created_by", "scan_timestamp", "serial_number", "status"
    )
    order = [F.desc("scan_timestamp"), F.asc_nulls_last("serial_number"), F.asc_nulls_last("status")]
    two = ranked(valid, ["created_by"], order, "__rank").filter(F.col("__rank") <= 2)

    def pick(rank: int, column: str) -> Column:
        return F.max(F.when(F.col("__rank") == rank, F.col(column)))

    return two.groupBy(F.col("created_by").alias("user_id")).agg(
        pick(1, "scan_timestamp").alias("current_time"),
        pick(1, "serial_number").alias("current_serial"),
        pick(1, "status").alias("current_status"),
        pick(2, "scan_timestamp").alias("previous_time"),
        pick(2, "serial_number").alias("previous_serial"),
        pick(2, "status").alias("previous_status"),
    )
