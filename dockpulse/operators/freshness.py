"""Row counts per section and the age of the data."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from dockpulse.functions.timing import at
from dockpulse.schemas import SECTIONS


def section_counts(sections: Mapping[str, DataFrame]) -> DataFrame:
    parts = [
        df.agg(F.count(F.lit(1)).alias("row_count")).select(
            F.lit(name).alias("section"), "row_count"
        )
        for name, df in sections.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def snapshot_freshness(
    refresh_log: DataFrame, as_of: datetime | str, max_age_seconds: float
) -> DataFrame:
    """Age of the newest refresh per section. A section never refreshed is stale; an age equal
    to the limit is still fresh."""
    spark = refresh_log.sparkSession
    known = spark.createDataFrame([(name,) for name in SECTIONS], "section string")
    newest = refresh_log.groupBy("section").agg(
        F.max("updated_at").alias("last_updated"),
        F.max_by("row_count", "snapshot_id").alias("row_count"),
    )
    age = (F.unix_micros(at(as_of)) - F.unix_micros("last_updated")) / F.lit(1e6)
    return known.join(newest, "section", "left").select(
        "section",
        "last_updated",
        age.alias("age_seconds"),
        F.coalesce(age > max_age_seconds, F.lit(True)).alias("is_stale"),
        F.coalesce(F.col("row_count") > 0, F.lit(False)).alias("has_data"),
    )
