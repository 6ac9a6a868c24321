"""Saved snapshots: one Parquet folder per table and snapshot.

A snapshot counts as saved only when its rows in the refresh log and its entry in the manifest exist;
these are written last. Every table of a snapshot goes to its own folder and replaces it, so a job
that is run again after a failure leaves the same files behind as one that succeeded at once.

The serials of a snapshot are saved once, in ``current``: a table bucketed by serial number, from
which ``serials`` is read as a projection. Two snapshots of a store have the same buckets and are
joined by serial without moving either of them.

Rows of every table belong to a slot, a hash of their key. Digests of the slots are saved with the
snapshot; comparing two snapshots begins with them and reads the rows of differing slots only.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime
from functools import reduce
from hashlib import sha256

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F, types as T

from dockpulse.functions.open_columns import comparable
from dockpulse.functions.timing import at
from dockpulse.schemas import ARRIVAL, COMBINED, REFRESH_LOG, SECTION_KEYS, SECTIONS, conform
from dockpulse.sources.manifest import Manifest
from dockpulse.sources.paths import Paths

CHANGE_FEED = T.StructType(
    [
        T.StructField(name, T.StringType())
        for name in ("section", "op", "key", "changed_column", "previous_value", "record")
    ]
    + [T.StructField("generated_at", T.TimestampType())]
)

# Deduplicated combined table of the snapshot; all sections are computed from it.
CURRENT = T.StructType(COMBINED.fields + [T.StructField("status_description", T.StringType())])

TABLES = {**SECTIONS, "current": CURRENT, "change_feed": CHANGE_FEED}

UNREADABLE = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("error", T.StringType()),
        T.StructField("batch_id", T.LongType()),
    ]
)

DIGESTS = T.StructType(
    [
        T.StructField("section", T.StringType()),
        T.StructField("slot", T.IntegerType()),
        T.StructField("row_count", T.LongType()),
        T.StructField("one", T.DecimalType(38, 0)),
        T.StructField("two", T.DecimalType(38, 0)),
        T.StructField("ignored", T.StringType()),
    ]
)

_WRITERS = 4
_EMPTY = object()
_SLOT = "__slot"
#: Columns whose hash is a row's slot; equal keys of the change feed are always of one slot.
_SLOT_KEYS = {
    "users": "user_id",
    "scan_times": "user_id",
    "deliveries": "delivery",
    "progress": "delivery",
    "completed_deliveries": "delivery",
    "change_feed": "op",
}
#: Slots that a comparison names in the filter of its scans at most; beyond them, or beyond a
#: quarter of all, it reads all: rows lie next to those of other slots and are read with them.
MAX_NAMED_SLOTS = 1_000


class SnapshotStore:
    """Snapshots below ``base``. ``buckets`` and ``slots`` are fixed when the store is made: about as
    many buckets as tasks should write the serials, and slots of some thousand rows."""

    def __init__(self, spark: SparkSession, base: str, buckets: int = 16, slots: int = 4096):
        self.spark = spark
        self.base = base.rstrip("/")
        self._paths = Paths(spark)
        self._manifest = Manifest(self._paths, f"{self.base}/manifest")
        self._start(buckets, slots)

    def _start(self, buckets: int, slots: int) -> None:
        """The layout, and an empty log, unless there is one, so that it can always be followed."""
        if (layout := self._paths.read(f"{self.base}/layout.json")) is None:
            layout = json.dumps({"buckets": buckets, "slots": slots})
            self._paths.write(f"{self.base}/layout.json", layout)
        self.buckets, self.slots = (json.loads(layout)[k] for k in ("buckets", "slots"))
        if not self._paths.exists(self._folder("refresh_log")):
            empty = self.spark.createDataFrame([], REFRESH_LOG)
            empty.write.mode("ignore").partitionBy("snapshot_id").parquet(self._folder("refresh_log"))
        elif self._manifest.newest() is None:  # a log from before there was a manifest
            for row in self._logged().select("snapshot_id").distinct().orderBy("snapshot_id").collect():
                self._manifest.add(row.snapshot_id)

    def _folder(self, table: str) -> str:
        return f"{self.base}/{table}"

    def _part(self, table: str, snapshot_id: str) -> str:
        return f"{self._folder(table)}/snapshot_id={snapshot_id}"

    def _read(
        self, schema: T.StructType, folder: str, part: str = "", missing: object = _EMPTY
    ) -> DataFrame | None:
        """A folder, or one of its partitions; if there is none, an empty table or ``missing``. Ids
        in the schema stay text: left to inference, Spark would read them as numbers."""
        if not self._paths.exists(f"{folder}/{part}"):
            return self.spark.createDataFrame([], schema) if missing is _EMPTY else missing
        return self.spark.read.schema(schema).option("basePath", folder).parquet(f"{folder}/{part}")

    # -- slots and buckets ---------------------------------------------------------------------

    def _slot(self, table: str) -> Column:
        key = _SLOT_KEYS.get(table, "serial_number")
        return F.pmod(F.xxhash64(key), F.lit(self.slots)).cast("int")

    def _bucketed(self, snapshot_id: str) -> str:
        """Catalog name of a snapshot's serials. The catalog only says how the files are bucketed;
        a session that does not know the table yet is told."""
        digest = sha256(f"{self.base}/{snapshot_id}".encode()).hexdigest()[:24]
        return f"dockpulse_current_{digest}"

    def _write_current(self, df: DataFrame, snapshot_id: str) -> None:
        # one task per bucket, so that each bucket is one file in the order of its slots
        dealt = df.repartition(self.buckets, "serial_number")
        (
            dealt.write.mode("overwrite")
            .format("parquet")
            .option("path", self._part("current", snapshot_id))
            .bucketBy(self.buckets, "serial_number")
            .sortBy(_SLOT)
            .saveAsTable(self._bucketed(snapshot_id))
        )

    def discard_current(self, snapshot_id: str) -> None:
        """Take back the serials of a snapshot that is not saved."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self._bucketed(snapshot_id)}")
        self._paths.delete(self._part("current", snapshot_id))

    def _load_current(self, snapshot_id: str) -> DataFrame | None:
        path, name = self._part("current", snapshot_id), self._bucketed(snapshot_id)
        if not self._paths.exists(path):
            return None
        if not self.spark.catalog.tableExists(name):
            fields = T.StructType([*CURRENT.fields, T.StructField(_SLOT, T.IntegerType())])
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
            self.spark.sql(
                f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet "
                f"CLUSTERED BY (serial_number) SORTED BY ({_SLOT}) INTO {self.buckets} BUCKETS "
                f"LOCATION '{path}'"
            )
        return self.spark.table(name)

    # -- tables --------------------------------------------------------------------------------

    def write(
        self, table: str, df: DataFrame, snapshot_id: str, section: str | None = None
    ) -> int:
        """Save one table of a snapshot and return its row count, counted while writing.

        The change feed is written section by section, each to a folder of its own."""
        rows = Observation()
        counted = conform(df, TABLES[table]).observe(rows, F.count(F.lit(1)).alias("rows"))
        if table == "current":
            self._write_current(counted.withColumn(_SLOT, self._slot(table)), snapshot_id)
            return rows.get["rows"]
        folder = self._part(table, snapshot_id)
        if section is not None:
            counted, folder = counted.drop("section"), f"{folder}/section={section}"
        elif table in SECTION_KEYS:
            # local order only: lets a lookup by key skip most row groups, costs no shuffle
            counted = counted.withColumn(_SLOT, self._slot(table))
            counted = counted.sortWithinPartitions(*SECTION_KEYS[table])
        else:
            counted = counted.withColumn(_SLOT, self._slot(table)).sortWithinPartitions(_SLOT)
        counted.write.mode("overwrite").parquet(folder)
        return rows.get["rows"]

    def side_by_side(self, task: Callable[[str], int], names: Iterable[str]) -> dict[str, int]:
        """Run one independent writing task per name, several at a time, so that small ones fill
        the executors while a large one finishes."""
        with ThreadPoolExecutor(_WRITERS) as pool:
            names = list(names)
            return dict(zip(names, pool.map(inheritable_thread_target(self.spark)(task), names)))

    def load(self, table: str, snapshot_id: str, slots: Sequence[int] | None = None) -> DataFrame:
        """One table of one snapshot, or the rows of some of its slots. A table that was never
        saved is empty but has its columns; one that the snapshot committed and that is gone is an
        error."""
        saved = self._load_current(snapshot_id) if table in ("current", "serials") else None
        if saved is None:
            schema = T.StructType([*TABLES[table].fields, T.StructField(_SLOT, T.IntegerType())])
            part = f"snapshot_id={snapshot_id}"
            saved = self._read(schema, self._folder(table), part, missing=None)
        if saved is None:
            if not self._committed(snapshot_id).filter(F.col("section") == table).isEmpty():
                raise FileNotFoundError(
                    f"snapshot {snapshot_id} was saved, but {self._part(table, snapshot_id)} is gone"
                )
            return self.spark.createDataFrame([], TABLES[table])
        if slots is not None:
            # one text: a literal each would cost the driver more than the scan saves
            named = ", ".join(str(int(slot)) for slot in slots)
            saved = saved.filter(F.expr(f"{_SLOT} IN ({named})") if named else F.lit(False))
        return saved.select(*TABLES[table].fieldNames())

    def latest(self, table: str) -> DataFrame:
        """A table of the newest saved snapshot, the same one for every table."""
        snapshot_id = self.latest_snapshot()
        if snapshot_id is None:
            return self.spark.createDataFrame([], TABLES[table])
        return self.load(table, snapshot_id)

    # -- digests -------------------------------------------------------------------------------

    def save_digests(
        self, snapshot_id: str, sections: Iterable[str] = tuple(SECTIONS), ignore: Sequence[str] = ()
    ) -> None:
        """Digest every slot of the saved sections: two sums of row hashes, whatever the order of
        the rows. Columns in ``ignore`` are left out."""
        parts = []
        for name in sections:
            fields = [f for f in TABLES[name].fields if f.name not in ignore]
            values = [comparable(F.col(f.name), f.dataType) for f in fields]
            one, two = (F.xxhash64(F.lit(seed), *values).cast("decimal(38,0)") for seed in (1, 2))
            rows = self.load(name, snapshot_id).withColumn(_SLOT, self._slot(name))
            parts.append(
                rows.groupBy(F.col(_SLOT).alias("slot"))
                .agg(
                    F.count(F.lit(1)).alias("row_count"),
                    F.sum(one).alias("one"),
                    F.sum(two).alias("two"),
                )
                .withColumn("section", F.lit(name))
            )
        digests = reduce(DataFrame.unionByName, parts).withColumn("ignored", F.lit(",".join(sorted(ignore))))
        conform(digests, DIGESTS).coalesce(1).write.mode("overwrite").parquet(self._part("digests", snapshot_id))

    def differing_slots(self, snapshot_id: str, before: str) -> dict[str, list[int] | None]:
        """Slots in which two snapshots differ, by section; None where too many do, or where the
        digests cannot tell. The roots, one per section, are compared first."""
        sides = [
            self._read(DIGESTS, self._folder("digests"), f"snapshot_id={x}", missing=None)
            for x in (snapshot_id, before)
        ]
        if None in sides:
            return dict.fromkeys(SECTIONS)
        sums = [F.sum(c).alias(c) for c in ("row_count", "one", "two")]
        sums.append(F.max("ignored").alias("ignored"))
        now, then = (side.groupBy("section").agg(*sums).alias(n) for side, n in zip(sides, "ab"))

        def unlike(*columns: str) -> Column:
            return reduce(
                Column.__or__, [~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in columns]
            )

        roots = now.join(then, "section", "full").select(
            "section",
            unlike("row_count", "one", "two", "ignored").alias("differs"),
            (F.col("a.ignored") != F.col("b.ignored")).alias("other_columns"),
        )
        found: dict[str, list[int] | None] = {name: [] for name in SECTIONS}
        named: list[str] = []
        for row in roots.collect():
            if row.other_columns:
                found[row.section] = None
            elif row.differs:
                named.append(row.section)
        if not named:
            return found
        now, then = (
            side.where(F.col("section").isin(named)).alias(n) for side, n in zip(sides, "ab")
        )
        slots = (
            now.join(then, ["section", "slot"], "full")
            .where(unlike("row_count", "one", "two"))
            .groupBy("section")
            .agg(F.count(F.lit(1)).alias("n"), F.collect_list("slot").alias("slots"))
        )
        few = F.col("n") <= min(MAX_NAMED_SLOTS, max(self.slots // 4, 1))
        for row in slots.select("section", F.when(few, F.col("slots")).alias("slots")).collect():
            found[row.section] = None if row.slots is None else sorted(row.slots)
        return found

    # -- the log -------------------------------------------------------------------------------

    def commit(
        self, snapshot_id: str, row_counts: Mapping[str, int], updated_at: datetime | str
    ) -> None:
        log = self.spark.createDataFrame(list(row_counts.items()), "section string, row_count long")
        (
            log.withColumn("updated_at", at(updated_at))
            .coalesce(1)
            .write.mode("overwrite")
            .parquet(self._part("refresh_log", snapshot_id))
        )
        self._manifest.add(snapshot_id)

    def save(
        self, sections: Mapping[str, DataFrame], snapshot_id: str, updated_at: datetime | str
    ) -> dict[str, int]:
        """Save the given sections, empty ones too, and commit the snapshot."""
        counts = self.side_by_side(
            lambda name: self.write(name, sections[name], snapshot_id), sections
        )
        self.commit(snapshot_id, counts, updated_at)
        return counts

    def _logged(self) -> DataFrame:
        log = self._read(REFRESH_LOG, self._folder("refresh_log"))
        return log.select(*REFRESH_LOG.fieldNames())

    def refresh_log(self) -> DataFrame:
        """Rows of all snapshots that are kept: those compacted, then those of each later one."""
        archive = self._archive()
        if archive is None:
            return self._logged()
        old = self.spark.read.schema(REFRESH_LOG).parquet(archive["path"])
        return old.unionByName(self._logged().filter(F.col("snapshot_id") > archive["upto"]))

    def _archive(self) -> dict | None:
        text = self._paths.read(f"{self.base}/log_archive/newest")
        return json.loads(text) if text else None

    def compact_log(self, keep: int = 100) -> None:
        """Put the log rows of all but the newest ``keep`` snapshots into one file.

        Followers of the feed read what is not compacted, so ``keep`` bounds how far one may lag.
        """
        self._compact([e["snapshot_id"] for e in self._manifest.backwards()][keep:], ())

    def _compact(self, old: Sequence[str], gone: Sequence[str]) -> None:
        """Move the log rows of ``old`` snapshots to the archive, and drop those of ``gone``."""
        archive, log = self._archive(), self.refresh_log()
        upto = max([*old, *gone, *([archive["upto"]] if archive else [])], default=None)
        if upto is None:
            return
        path = f"{self.base}/log_archive/{sha256('/'.join([*old, '-', *gone]).encode()).hexdigest()[:16]}"
        kept = log.filter((F.col("snapshot_id") <= upto) & ~F.col("snapshot_id").isin(list(gone)))
        if archive and archive["path"] == path:
            return
        kept.coalesce(1).write.mode("overwrite").parquet(path)
        self._paths.write(f"{self.base}/log_archive/newest", json.dumps({"path": path, "upto": upto}))
        for snapshot_id in {*old, *gone}:
            self._paths.delete(self._part("refresh_log", snapshot_id))
        if archive:
            self._paths.delete(archive["path"])

    def expire(self, keep: int) -> list[str]:
        """Remove all but the newest ``keep`` snapshots with their tables; returns their ids.

        The log and the manifest forget them first, so what a failure leaves behind is never read.
        """
        if keep < 1:
            raise ValueError("the newest snapshot always stays")
        gone = [e["snapshot_id"] for e in self._manifest.backwards()][keep:]
        if gone:
            self._compact((), gone)
            self._manifest.cut(keep)
        for snapshot_id in gone:
            self.spark.sql(f"DROP TABLE IF EXISTS {self._bucketed(snapshot_id)}")
            for table in (*TABLES, "digests"):
                self._paths.delete(self._part(table, snapshot_id))
        return gone

    def latest_snapshot(self, before: str | None = None) -> str | None:
        """Newest saved snapshot, optionally among those before a given one."""
        return self._manifest.latest(before)

    def _committed(self, snapshot_id: str) -> DataFrame:
        """The snapshot's own rows of the refresh log; no other snapshot is listed."""
        own = self._read(REFRESH_LOG, self._folder("refresh_log"), f"snapshot_id={snapshot_id}", None)
        if own is None:
            return self.refresh_log().filter(F.col("snapshot_id") == snapshot_id)
        return own

    def is_saved(self, snapshot_id: str) -> bool:
        """Whether the snapshot is complete. Should only its entry in the manifest be missing, as
        after a failure between the two, it is added."""
        if self._committed(snapshot_id).isEmpty():
            return False
        self._manifest.add(snapshot_id)
        return True

    # -- arrivals ------------------------------------------------------------------------------

    def record_unreadable(self, reports: list[tuple[str, str]], batch_id: int) -> None:
        """Reports of a batch of arrivals that could not be opened, with the error."""
        rows = self.spark.createDataFrame(reports, "path string, error string")
        rows.coalesce(1).write.mode("overwrite").parquet(
            f"{self._folder('unreadable')}/batch_id={batch_id}"
        )

    def unreadable(self) -> DataFrame:
        """(path, error, batch_id) of all reports that were passed over."""
        return self._read(UNREADABLE, self._folder("unreadable"))

    def arrivals(self, batch_id: int) -> DataFrame:
        """Newest report of each kind known after a batch of arrivals."""
        known = self._read(ARRIVAL, self._folder("arrivals"), f"batch_id={batch_id}")
        return known.select(*ARRIVAL.fieldNames())

    def save_arrivals(self, newest: DataFrame, batch_id: int) -> None:
        """What is known after a batch. Only this batch's state and the one before are needed, the
        latter should this batch be repeated."""
        newest.coalesce(1).write.mode("overwrite").parquet(
            f"{self._folder('arrivals')}/batch_id={batch_id}"
        )
        self._paths.delete(f"{self._folder('arrivals')}/batch_id={batch_id - 2}")
