"""User activity log: an append-only table of (user_id, activity_type, timestamp)."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, functions as F

from dockpulse.functions.timing import at, minutes_between
from dockpulse.operators.ranking import most_rows, top_rows

def _newest_first() -> list:
    return [F.desc("timestamp"), F.asc_nulls_last("activity_type")]


def last_activities(log: DataFrame, keep: int = 100) -> DataFrame:
    """The newest ``keep`` activities of every user."""
    return most_rows(log, ["user_id"], _newest_first(), keep)


def activity_history(
    log: DataFrame, user: str | None = None, limit: int = 20, keep: int = 100
) -> DataFrame:
    """The newest ``limit`` of the kept activities, of one user or of everybody. Sort by
    ``timestamp`` to show them oldest first; a limit of zero returns nothing. Only ``keep``
    activities of a user count as kept, so a larger limit is refused."""
    if limit > keep:
        raise ValueError(f"limit {limit} exceeds the {keep} activities kept per user")
    if user is not None:
        log = log.filter(F.col("user_id") == user)
    return last_activities(log, limit)


def activity_counts(log: DataFrame) -> DataFrame:
    return log.groupBy(
        "user_id", F.coalesce("activity_type", F.lit("unknown")).alias("activity_type")
    ).agg(F.count(F.lit(1)).alias("activity_count"))


def activity_metrics(log: DataFrame, as_of: datetime | str, keep: int = 100) -> DataFrame:
    """Per user over the kept activities: count by type, total, last time, minutes since then.

    The per-type map holds at most ``keep`` entries because the log is cut first.
    """
    per_type = (
        last_activities(log, keep)
        .groupBy("user_id", F.coalesce("activity_type", F.lit("unknown")).alias("activity_type"))
        .agg(F.count(F.lit(1)).alias("n"), F.max("timestamp").alias("newest"))
    )
    last = F.max("newest")
    return per_type.groupBy("user_id").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("activity_type", "n")))).alias(
            "activity_counts"
        ),
        F.sum("n").alias("total_activities"),
        last.alias("last_activity_time"),
        F.round(minutes_between(at(as_of), last), 2).alias("minutes_since_last_activity"),
    )


def with_last_activity(users: DataFrame, log: DataFrame) -> DataFrame:
    """Users with the time and type of their newest activity; of several at that time the first
    type in order, a missing one last."""
    newest = top_rows(log.filter(F.col("timestamp").isNotNull()), ["user_id"], _newest_first()).select(
        "user_id",
        F.col("timestamp").alias("last_activity"),
        F.col("activity_type").alias("last_activity_type"),
    )
    return users.join(newest, "user_id", "left")
