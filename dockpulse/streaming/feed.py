"""Follow the change feed of a store, and a table that takes every change exactly once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from dockpulse.params import Params
from dockpulse.schemas import REFRESH_LOG
from dockpulse.sources.manifest import Manifest
from dockpulse.sources.paths import Paths
from dockpulse.sources.store import CHANGE_FEED, SnapshotStore


class CommittedFeed:
    """A table of delivered changes, written in two steps: the rows of a snapshot, then its commit.

    Rows without a commit are never read and are replaced when the delivery is repeated; a snapshot
    that has its commit is not taken again. Whatever fails between two steps, and however often a
    snapshot is delivered, its changes are in the table once.
    """

    def __init__(self, spark: SparkSession, base: str):
        self.spark = spark
        self._rows = f"{base.rstrip('/')}/rows"
        self._paths = Paths(spark)
        self._commits = Manifest(self._paths, f"{base.rstrip('/')}/commits")

    def __call__(self, changes: DataFrame, snapshot_id: str) -> None:
        newest = self._commits.latest()
        if newest is not None and snapshot_id <= newest:  # snapshots come oldest first
            return
        rows = changes.select(*CHANGE_FEED.fieldNames())
        rows.write.mode("overwrite").parquet(f"{self._rows}/snapshot_id={snapshot_id}")
        self._commits.add(snapshot_id)

    def read(self) -> DataFrame:
        """The changes of all committed snapshots with their ``snapshot_id``."""
        schema = T.StructType([*CHANGE_FEED.fields, T.StructField("snapshot_id", T.StringType())])
        newest = self._commits.latest()
        if newest is None:
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema).parquet(self._rows)
        return rows.filter(F.col("snapshot_id") <= newest)


def follow_changes(
    store: SnapshotStore,
    sink: Callable[[DataFrame, str], None],
    checkpoint: str,
    params: Params = Params(),
    **trigger: object,
) -> StreamingQuery:
    """Hand the changes of every saved snapshot to ``sink(changes, snapshot_id)``, oldest first.

    The stream runs on the refresh log, which is written last: changes of an unfinished refresh
    are never delivered, and those of a finished one are delivered once unless the sink itself
    fails, in which case it sees the same snapshot id again. A ``CommittedFeed`` as the sink takes
    each of them exactly once.
    """

    def on_batch(batch: DataFrame, _: int) -> None:
        saved = batch.select("snapshot_id").distinct().orderBy("snapshot_id").collect()
        for row in saved:
            changes = store.load("change_feed", row.snapshot_id)
            sink(changes.withColumn("snapshot_id", F.lit(row.snapshot_id)), row.snapshot_id)

    trigger = trigger or {"processingTime": f"{params.feed_seconds} seconds"}
    return (
        store.spark.readStream.schema(REFRESH_LOG)
        # bounds the snapshots, and with them the driver's work, of one batch
        .option("maxFilesPerTrigger", 100)
        .parquet(f"{store.base}/refresh_log")
        .writeStream.foreachBatch(on_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .start()
    )
