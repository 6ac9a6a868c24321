"""User activity events as a stream, into a log that holds the newest activities of every user.

New events are appended batch by batch. After some batches they are folded into the kept part: the
newest ``keep`` activities of each user, in one table that replaces the one before. What is stored
is thus bounded by users and by the batches since, not by the events that ever arrived.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from dockpulse.operators.activity import last_activities
from dockpulse.params import Params
from dockpulse.schemas import ACTIVITY, conform
from dockpulse.sources.paths import Paths

_TAIL = T.StructType([*ACTIVITY.fields, T.StructField("batch_id", T.LongType())])


class ActivityLog:
    """The log below ``base``; ``every`` so many batches it is folded."""

    def __init__(self, spark: SparkSession, base: str, keep: int = 100, every: int = 16):
        if keep < 1 or every < 1:
            raise ValueError("at least one activity is kept, and one batch makes a fold")
        self.spark, self.base = spark, base.rstrip("/")
        self.keep, self.every = keep, every
        self._paths = Paths(spark)

    def _folded(self) -> dict:
        text = self._paths.read(f"{self.base}/folded")
        return json.loads(text) if text else {"upto": -1, "path": None}

    def _tail(self, after: int) -> DataFrame:
        """Events of the batches after one."""
        if not self._paths.exists(f"{self.base}/tail"):
            return self.spark.createDataFrame([], ACTIVITY)
        tail = self.spark.read.schema(_TAIL).parquet(f"{self.base}/tail")
        return tail.filter(F.col("batch_id") > after).select(*ACTIVITY.fieldNames())

    def _stored(self) -> DataFrame:
        """All that is stored: the kept part and the batches since."""
        state = self._folded()
        tail = self._tail(state["upto"])
        if state["path"] is None:
            return tail
        return self.spark.read.schema(ACTIVITY).parquet(state["path"]).unionByName(tail)

    def append(self, events: DataFrame, batch_id: int) -> None:
        """Take in a batch; one that is repeated replaces itself, one that is folded is known."""
        upto = self._folded()["upto"]
        if batch_id <= upto:
            return
        # a heavy user's events of one batch are cut before they are stored
        newest = last_activities(conform(events, ACTIVITY), self.keep)
        newest.write.mode("overwrite").parquet(f"{self.base}/tail/batch_id={batch_id}")
        if batch_id - upto >= self.every:
            self.fold(batch_id)

    def fold(self, upto: int) -> None:
        """Keep the newest activities of every user up to a batch, and drop what they replace. The
        pointer is replaced as a whole between the two, so a failure loses and doubles nothing."""
        before = self._folded()
        if upto <= before["upto"]:
            return
        path = f"{self.base}/kept/upto={upto}"
        last_activities(self._stored(), self.keep).write.mode("overwrite").parquet(path)
        self._paths.write(f"{self.base}/folded", json.dumps({"upto": upto, "path": path}))
        for batch_id in range(before["upto"] + 1, upto + 1):
            self._paths.delete(f"{self.base}/tail/batch_id={batch_id}")
        if before["path"] is not None:
            self._paths.delete(before["path"])

    def read(self) -> DataFrame:
        """The newest activities of every user."""
        return last_activities(self._stored(), self.keep)


def append_activity(
    events: DataFrame, log: ActivityLog, checkpoint: str, params: Params = Params(), **trigger: object
) -> StreamingQuery:
    """Keep the log up to date with a stream of activity events."""
    trigger = trigger or {"processingTime": f"{params.feed_seconds} seconds"}
    return (
        conform(events, ACTIVITY)
        .writeStream.foreachBatch(log.append)
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .start()
    )
