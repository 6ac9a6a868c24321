"""Every registered query: a name and a function of (spark, sf_dir)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from dockpulse.functions.open_columns import map_columns
from dockpulse.operators import activity, cleaning, diff, events, freshness, headers
from dockpulse.operators import progress as packing
from dockpulse.operators import scan_times as scanning
from dockpulse.operators import serials as serial
from dockpulse.operators import slices
from dockpulse.operators import users as people
from dockpulse.plans import canonical as given
from dockpulse.plans.canonical import CURRENT, PARAMS, PREVIOUS, Snapshot
from dockpulse.plans.refresh import refresh
from dockpulse.plans.workbooks import scan_workbooks
from dockpulse.schemas import SECTION_KEYS, SECTIONS
from dockpulse.session import scratch_dir
from dockpulse.sources.export import load_records, section_from_json, sections_to_json
from dockpulse.sources.files import classify_files, latest_file
from dockpulse.sources.reports import read_scans
from dockpulse.sources.store import SnapshotStore
from dockpulse.sources.workbook import workbook_table
from dockpulse.streaming.activity import ActivityLog, append_activity
from dockpulse.streaming.feed import CommittedFeed, follow_changes
from dockpulse.streaming.refresh import announced_arrivals, start_refresh
from dockpulse.streaming.scans import write_clean_scans

Query = Callable[[SparkSession, str], DataFrame]

ACTIVITY_AS_OF = "2024-02-01 00:00:00"
ACTIVITY_KEEP = 50
FRESHNESS_AS_OF = CURRENT.as_of
FRESHNESS_MAX_AGE = 200 * 86400
LOOKUP_USER = "U7"
WINDOW = PARAMS.window_minutes


def _section(name: str, snapshot: Snapshot = CURRENT, previous: Snapshot | None = PREVIOUS) -> Query:
    return lambda spark, sf: given.section(spark, sf, name, snapshot, previous)


def _users(spark: SparkSession, sf: str, snapshot: Snapshot = CURRENT) -> DataFrame:
    return people.user_activity(given.core(spark, sf, snapshot), snapshot.as_of, WINDOW)


def _users_from_slices(spark, sf):
    """The users section merged from slices that were saved by day."""
    home = scratch_dir(spark, "slices")
    core = given.core(spark, sf)
    slices.scan_slices(core).write.partitionBy("day").parquet(f"{home}/slices")
    slices.known_users(core).write.parquet(f"{home}/users")
    saved = spark.read.parquet(f"{home}/slices"), spark.read.parquet(f"{home}/users")
    return slices.users_from_slices(*saved, CURRENT.as_of, WINDOW)


def _pair(spark: SparkSession, sf: str, name: str) -> tuple[DataFrame, DataFrame]:
    """A section in the current and in the previous snapshot."""
    now = given.section(spark, sf, name, CURRENT, PREVIOUS)
    return now, given.section(spark, sf, name, PREVIOUS)


def _diff_added(spark, sf):
    return diff.added_rows(*_pair(spark, sf, "progress"), SECTION_KEYS["progress"])


def _diff_removed(spark, sf):
    return diff.removed_rows(*_pair(spark, sf, "users"), SECTION_KEYS["users"])


def _diff_changed(spark, sf):
    keys = SECTION_KEYS["scan_times"]
    return diff.changed_rows(*_pair(spark, sf, "scan_times"), keys, unique=True)


def _diff_serials(spark, sf):
    return diff.diff_section("serials", *_pair(spark, sf, "serials"), unique=True)


def _diff_first_run(spark, sf):
    return diff.diff_section("users", _users(spark, sf), None, SECTION_KEYS["users"])


def _save(spark: SparkSession, sf: str, store: SnapshotStore, *snapshots: Snapshot) -> None:
    for snapshot in snapshots:
        refresh(
            store,
            given.raw_scans(spark, sf, snapshot),
            given.raw_deliveries(spark, sf),
            snapshot.id,
            snapshot.as_of,
            PARAMS,
        )


def _saved_store(spark: SparkSession, sf: str, *snapshots: Snapshot) -> SnapshotStore:
    store = SnapshotStore(spark, scratch_dir(spark, "store"))
    _save(spark, sf, store, *snapshots)
    return store


def _save_sections(spark, sf):
    store = _saved_store(spark, sf, PREVIOUS, CURRENT)
    return store.refresh_log()


def _load_section(spark, sf):
    return _saved_store(spark, sf, CURRENT).load("serials", CURRENT.id)


def _latest_section(spark, sf):
    return _saved_store(spark, sf, PREVIOUS, CURRENT).latest("progress")


def _change_feed(spark, sf):
    return _saved_store(spark, sf, PREVIOUS, CURRENT).latest("change_feed")


def _dashboard(spark, sf):
    """All sections of the current snapshot as records."""
    store = _saved_store(spark, sf, PREVIOUS, CURRENT)
    return sections_to_json({name: store.latest(name) for name in SECTIONS}, CURRENT.as_of)


def _sections_to_json(spark, sf):
    current = given.current(spark, sf)
    return sections_to_json(
        {
            "progress": packing.progress(current),
            "deliveries": packing.delivery_packages(current),
            "serials": serial.serials_section(current),
        },
        CURRENT.as_of,
    )


def _section_from_json(spark, sf):
    """Sections written as JSON lines, one of them read back with its types."""
    path = scratch_dir(spark, "sections-json")
    _sections_to_json(spark, sf).write.json(path)
    return section_from_json(load_records(spark, path), "serials")


def _section_counts(spark, sf):
    current = given.current(spark, sf)
    return freshness.section_counts(
        {
            "scans": given.scans(spark, sf),
            "report_deliveries": given.deliveries(spark, sf),
            "combined": given.combined(spark, sf),
            "serials": serial.serials_section(current),
            "deliveries": packing.delivery_packages(current),
            "progress": packing.progress(current),
        }
    )


def _xlsx_ingest(spark, sf):
    """Scan report written to workbooks by Spark tasks and read back from them."""
    books = scan_workbooks(given.raw_scans(spark, sf))
    columns = [headers.report_header(c) for c in given.raw_scans(spark, sf).columns]
    return read_scans(workbook_table(books, columns), PARAMS)


def _finish(streaming_query) -> None:
    streaming_query.awaitTermination()


def _stream_scans(spark, sf):
    """Line items arrive as a stream; the orders they belong to are a plain table."""
    home = scratch_dir(spark, "stream-scans")
    orders = given.table(spark, sf, "orders").filter(
        F.col("o_orderdate") <= F.lit(CURRENT.day).cast("timestamp_ntz")
    )
    items = (
        spark.readStream.schema(given.table(spark, sf, "lineitem").schema)
        .option("pathGlobFilter", "lineitem.parquet")
        .parquet(sf)
        .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    )
    raw = items.select(*given.raw_scan_columns(CURRENT))
    _finish(write_clean_scans(raw, f"{home}/scans", f"{home}/checkpoint", PARAMS, availableNow=True))
    return spark.read.parquet(f"{home}/scans")


def _streamed_store(spark: SparkSession, sf: str) -> SnapshotStore:
    """Two report deliveries arrive one after the other and are refreshed by the stream."""
    home = scratch_dir(spark, "stream-refresh")
    given.raw_deliveries(spark, sf).write.parquet(f"{home}/in/deliveries")
    for snapshot in (PREVIOUS, CURRENT):
        path = f"{home}/in/scans-{snapshot.id}"
        given.raw_scans(spark, sf, snapshot).write.parquet(path)
        arrived = [("scans", path, snapshot.as_of), ("deliveries", f"{home}/in/deliveries", snapshot.as_of)]
        spark.createDataFrame(arrived, "report_type string, path string, modified_at string").coalesce(
            1
        ).write.mode("append").json(f"{home}/announced")
    store = SnapshotStore(spark, f"{home}/store")
    arrivals = announced_arrivals(spark, f"{home}/announced", max_files_per_batch=1)
    _finish(start_refresh(arrivals, store, f"{home}/refresh", PARAMS, availableNow=True))
    return store


def _stream_refresh(spark, sf):
    """Sections, times and row counts of the snapshots the stream saved."""
    return _streamed_store(spark, sf).refresh_log().select("section", "updated_at", "row_count")


def _stream_change_feed(spark, sf):
    """Changes delivered to a follower of the streamed store."""
    store = _streamed_store(spark, sf)
    delivered = CommittedFeed(spark, f"{store.base}/followed")
    _finish(follow_changes(store, delivered, f"{store.base}/follow", PARAMS, availableNow=True))
    return delivered.read().drop("snapshot_id")


def _stream_activity(spark, sf):
    home = scratch_dir(spark, "stream-activity")
    arriving = (
        spark.readStream.schema(given.table(spark, sf, "events").schema)
        .option("pathGlobFilter", "events.parquet")
        .parquet(sf)
    )
    log = ActivityLog(spark, f"{home}/log", ACTIVITY_KEEP)
    events = given.activity_columns(arriving)
    _finish(append_activity(events, log, f"{home}/checkpoint", availableNow=True))
    return log.read()


def _activity_metrics(spark, sf):
    """The map of counts as JSON text, so every engine can compare it."""
    metrics = activity.activity_metrics(
        given.activity_log(spark, sf), ACTIVITY_AS_OF, ACTIVITY_KEEP
    )
    return metrics.withColumn("activity_counts", F.to_json("activity_counts"))


def _prepare(spark, sf):
    """Standard columns added beside the report columns."""
    raw = given.raw_scans(spark, sf).select("Serial #", "Created by", "Delivery", "Status")
    return headers.copy_aliases(raw).select("serial_number", "created_by", "delivery", "status")


def _with_text_cells(query: Query) -> Query:
    """The map of further report columns as JSON text, so every engine can compare it."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        df = query(spark, sf)
        names = map_columns(df)
        return df.withColumns({n: F.to_json(n, {"ignoreNullFields": "false"}) for n in names}) if names else df

    return run


_QUERIES: dict[str, Query] = {
    # reading and combining
    "read_scans": lambda spark, sf: given.scans(spark, sf),
    "read_deliveries": lambda spark, sf: given.deliveries(spark, sf),
    "combined": lambda spark, sf: given.combined(spark, sf),
    "xlsx_ingest": _xlsx_ingest,
    "classify_files": lambda spark, sf: classify_files(given.file_listing(spark, sf)),
    "latest_file": lambda spark, sf: latest_file(classify_files(given.file_listing(spark, sf))),
    # names and cells
    "sanitize_headers": lambda spark, sf: headers.sanitize_headers(given.untidy_scans(spark, sf)),
    "standardize_columns": lambda spark, sf: headers.standardize_columns(
        given.untidy_scans(spark, sf)
    ),
    "prepare": _prepare,
    "clean_numeric": lambda spark, sf: cleaning.clean_numeric(
        headers.standardize_columns(given.untidy_scans(spark, sf)), ["qty", "pallet"]
    ),
    "clean_dates": lambda spark, sf: cleaning.clean_dates(
        headers.standardize_columns(given.untidy_scans(spark, sf)), ["created_on"]
    ),
    "sanitize_scans": lambda spark, sf: cleaning.sanitize_scans(given.untidy_scans(spark, sf)),
    "sanitize_deliveries": lambda spark, sf: cleaning.sanitize_deliveries(
        given.untidy_deliveries(spark, sf)
    ),
    "normalize_delivery": lambda spark, sf: cleaning.normalize_delivery(
        headers.standardize_columns(given.untidy_scans(spark, sf))
    ),
    "scan_timestamp": lambda spark, sf: cleaning.with_scan_timestamp(given.timed_scans(spark, sf)),
    "drop_blank_rows": lambda spark, sf: cleaning.drop_blank_rows(
        given.scattered_blanks(spark, sf)
    ),
    "filter_warehouse": lambda spark, sf: cleaning.filter_warehouse(
        given.plain_scans(spark, sf), PARAMS.warehouse
    ),
    "filter_pallet": lambda spark, sf: cleaning.filter_pallet(given.plain_scans(spark, sf)),
    # serials
    "dedup_serials": lambda spark, sf: serial.dedup_serials(given.combined(spark, sf)),
    "status_description": lambda spark, sf: serial.with_status_description(
        given.scans(spark, sf)
    ).select("serial_number", "scan_timestamp", "status", "status_description"),
    "serials": _section("serials"),
    "status_distribution": lambda spark, sf: serial.status_distribution(given.core(spark, sf)),
    # packing progress
    "deliveries": _section("deliveries"),
    "progress": _section("progress"),
    "progress_lookup": lambda spark, sf: packing.progress_lookup(
        packing.progress(given.core(spark, sf)), user=LOOKUP_USER
    ),
    "progress_band": lambda spark, sf: packing.progress_cards(
        packing.progress(given.core(spark, sf))
    ),
    "delivery_status": lambda spark, sf: packing.delivery_status(given.core(spark, sf)),
    # scan times
    "scan_times": _section("scan_times"),
    "scan_times_lookup": lambda spark, sf: scanning.scan_times_lookup(
        scanning.scan_times(given.core(spark, sf), CURRENT.as_of), LOOKUP_USER
    ),
    "scan_gap_label": lambda spark, sf: scanning.scan_gap_labels(
        scanning.scan_times(given.core(spark, sf), CURRENT.as_of)
    ),
    "latest_two_scans": lambda spark, sf: scanning.latest_two_scans(given.core(spark, sf)),
    # users
    "users": _section("users"),
    "users_from_slices": _users_from_slices,
    "users_idle_fallback": lambda spark, sf: people.user_activity(
        given.core(spark, sf), "2005-01-01 00:00:00"
    ),
    "recent_scans": lambda spark, sf: people.recent_scans(
        given.current(spark, sf), CURRENT.as_of, WINDOW
    ),
    "active_users": lambda spark, sf: people.active_users(
        _users(spark, sf), CURRENT.as_of, WINDOW // 3
    ),
    "user_names": lambda spark, sf: people.user_names(given.core(spark, sf)),
    # changes since the previous snapshot
    "new_serials": _section("new_serials"),
    "new_serials_first_run": _section("new_serials", previous=None),
    "status_changes": _section("status_changes"),
    "completed_deliveries": _section("completed_deliveries"),
    "common_serials": lambda spark, sf: events.common_serials(
        given.current(spark, sf), given.core(spark, sf, PREVIOUS), unique_previous=True
    ),
    "diff_added": _diff_added,
    "diff_removed": _diff_removed,
    "diff_changed": _diff_changed,
    "diff_serials": _diff_serials,
    "diff_first_run": _diff_first_run,
    # activity log
    "activity_last_n": lambda spark, sf: activity.last_activities(
        given.activity_log(spark, sf), ACTIVITY_KEEP
    ),
    "activity_history": lambda spark, sf: activity.activity_history(given.activity_log(spark, sf)),
    "activity_counts": lambda spark, sf: activity.activity_counts(given.activity_log(spark, sf)),
    "activity_metrics": _activity_metrics,
    "users_last_activity": lambda spark, sf: activity.with_last_activity(
        _users(spark, sf), given.activity_log(spark, sf)
    ),
    # saved snapshots
    "save_sections": _save_sections,
    "load_section": _load_section,
    "latest_section": _latest_section,
    "change_feed": _change_feed,
    "dashboard": _dashboard,
    "sections_to_json": _sections_to_json,
    "section_from_json": _section_from_json,
    "section_counts": _section_counts,
    "snapshot_freshness": lambda spark, sf: freshness.snapshot_freshness(
        given.refresh_history(spark, sf), FRESHNESS_AS_OF, FRESHNESS_MAX_AGE
    ),
    # streams
    "stream_scans": _stream_scans,
    "stream_refresh": _stream_refresh,
    "stream_change_feed": _stream_change_feed,
    "stream_activity": _stream_activity,
}

QUERIES = {name: _with_text_cells(query) for name, query in _QUERIES.items()}
