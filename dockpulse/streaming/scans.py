"""Scan reports as a stream of clean rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from dockpulse.params import Params
from dockpulse.sources.reports import read_scans


def write_clean_scans(
    raw_stream: DataFrame,
    path: str,
    checkpoint: str,
    params: Params = Params(),
    **trigger: object,
) -> StreamingQuery:
    """Append the cleaned rows of every new scan file to a Parquet table.

    Reading a report is filters and projections only, so the same code serves batch and stream,
    and the stream needs no state. The file sink commits each micro-batch exactly once.
    """
    trigger = trigger or {"processingTime": f"{params.refresh_seconds} seconds"}
    return (
        read_scans(raw_stream, params)
        .writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .start()
    )
