"""Refresh whenever a newer report has landed.

The stream carries arrivals (kind, path, time), never the report rows: a refresh reads the
newest report of each kind in a batch job of its own. Reports that were overtaken before the
batch ran are skipped, as snapshots are cumulative. A workbook that cannot be opened, such as a
half-copied one, is recorded in the store and passed over for the next newest of its kind.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from dockpulse.params import Params
from dockpulse.plans.refresh import refresh
from dockpulse.schemas import ARRIVAL, present
from dockpulse.sources.files import DELIVERY_REPORT, SCAN_REPORT, classify_files
from dockpulse.sources.reports import load_report, unreadable_report
from dockpulse.sources.store import SnapshotStore

_FILES = "path string, modificationTime timestamp, length long, content binary"


def workbook_arrivals(spark: SparkSession, folder: str) -> DataFrame:
    """Arrivals of report workbooks in a folder; only the listing is read."""
    files = spark.readStream.format("binaryFile").schema(_FILES).load(folder)
    listing = files.select("path", F.col("modificationTime").alias("modified_at"))
    return present(classify_files(listing), "report_type").select(*ARRIVAL.fieldNames())


def announced_arrivals(
    spark: SparkSession, folder: str, max_files_per_batch: int | None = None
) -> DataFrame:
    """Arrivals announced as JSON lines, for reports of many files: whoever writes such a report
    announces it once it is complete, so a half-written one is never read."""
    reader = spark.readStream.schema(ARRIVAL)
    if max_files_per_batch:
        reader = reader.option("maxFilesPerTrigger", max_files_per_batch)
    return reader.json(folder)


def _newest_arrivals(store: SnapshotStore, batch: DataFrame, batch_id: int) -> dict[str, Row]:
    """Newest report of each kind up to this batch: path, time and whether it was known before.

    Each batch saves what it knows for the next one, so neither the state nor what comes to the
    driver ever exceeds one row per kind.
    """
    known = store.arrivals(batch_id - 1).withColumn("known", F.lit(True))
    seen = known.unionByName(batch.withColumn("known", F.lit(False)))
    passed_over: list[tuple[str, str]] = []
    while True:
        newest = (
            seen.filter(~F.col("path").isin([path for path, _ in passed_over]))
            .groupBy("report_type")
            .agg(F.max(F.struct("modified_at", "path", "known")).alias("newest"))
            .select("report_type", "newest.*")
            .collect()
        )
        bad = [
            (row.path, error)
            for row in newest
            if not row.known
            for _, error in unreadable_report(store.spark, row.path)
        ]
        if not bad:
            break
        passed_over += bad
    if passed_over:
        store.record_unreadable(passed_over, batch_id)
    rows = [(row.report_type, row.path, row.modified_at) for row in newest]
    store.save_arrivals(store.spark.createDataFrame(rows, ARRIVAL), batch_id)
    return {row.report_type: row for row in newest}


def start_refresh(
    arrivals: DataFrame,
    store: SnapshotStore,
    checkpoint: str,
    params: Params = Params(),
    as_of: Callable[[datetime], datetime | str] = lambda landed: landed,
    **trigger: object,
) -> StreamingQuery:
    """Refresh the store on new arrivals.

    Snapshot id and ``as_of`` follow from the landing time and the batch number, so a batch that
    is repeated after a failure writes the same snapshot again, or finds it saved.
    """

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        newest = _newest_arrivals(store, batch, batch_id)
        if not {SCAN_REPORT, DELIVERY_REPORT} <= newest.keys():
            return
        if all(arrival.known for arrival in newest.values()):
            return
        landed = max(arrival.modified_at for arrival in newest.values())
        refresh(
            store,
            load_report(store.spark, newest[SCAN_REPORT].path),
            load_report(store.spark, newest[DELIVERY_REPORT].path),
            f"{landed:%Y%m%d%H%M%S}-{batch_id:06d}",
            as_of(landed),
            params,
        )

    trigger = trigger or {"processingTime": f"{params.refresh_seconds} seconds"}
    return (
        arrivals.writeStream.foreachBatch(on_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .start()
    )
