import os
from datetime import datetime

import pytest
from helpers import at, rows
from test_store import FIRST, HEADERS, SECOND, reports

from dockpulse.plans.refresh import refresh
from dockpulse.plans.workbooks import workbook_bytes
from dockpulse.schemas import ACTIVITY
from dockpulse.sources.store import SnapshotStore
from dockpulse.streaming.activity import ActivityLog, append_activity
from dockpulse.streaming.feed import CommittedFeed, follow_changes
from dockpulse.streaming.refresh import announced_arrivals, start_refresh, workbook_arrivals
from dockpulse.streaming.scans import write_clean_scans


def finish(query):
    query.awaitTermination()


def drop_workbook(folder, name, columns, data, stamp):
    path = folder / name
    path.write_bytes(workbook_bytes(columns, data))
    os.utime(path, (stamp, stamp))


def scan_rows(scans):
    return [(s, u, datetime(2024, 3, 1), t, float(d), x, "E01", 1) for s, u, t, d, x in scans]


def test_workbooks_landing_in_a_folder(spark, tmp_path):
    inbox = tmp_path / "inbox"
    inbox.mkdir()
    store = SnapshotStore(spark, str(tmp_path / "store"))
    stamp = int(datetime(2024, 3, 1, 11).timestamp())

    def run():
        arrivals = workbook_arrivals(spark, str(inbox))
        finish(start_refresh(arrivals, store, str(tmp_path / "check"), availableNow=True))

    drop_workbook(inbox, "ZMDESNR_1.xlsx", HEADERS, scan_rows(FIRST), stamp)
    run()
    assert store.latest_snapshot() is None, "one report alone is not enough"

    drop_workbook(inbox, "vl06o.xlsx", ["Delivery", "Number of packages"], [(7, 4), (8, 2)], stamp + 60)
    drop_workbook(inbox, "notes.xlsx", ["a"], [(1,)], stamp + 90)
    run()
    first = store.latest_snapshot()
    assert first.startswith("20240301110100")
    assert rows(store.latest("serials"), "serial_number") == [("S1",), ("S2",)]

    # two newer scan reports at once: only the newest counts; an older one changes nothing
    drop_workbook(inbox, "ZMDESNR_2.xlsx", HEADERS, scan_rows(FIRST[:1]), stamp + 120)
    drop_workbook(inbox, "ZMDESNR_3.xlsx", HEADERS, scan_rows(SECOND), stamp + 180)
    run()
    assert store.latest("serials").count() == 3
    assert store.refresh_log().select("snapshot_id").distinct().count() == 2
    drop_workbook(inbox, "ZMDESNR_0.xlsx", HEADERS, scan_rows(FIRST[:1]), stamp - 60)
    run()
    run()
    assert store.latest("serials").count() == 3
    assert store.refresh_log().select("snapshot_id").distinct().count() == 2


def test_a_truncated_workbook_is_passed_over(spark, tmp_path):
    inbox = tmp_path / "inbox"
    inbox.mkdir()
    store = SnapshotStore(spark, str(tmp_path / "store"))
    stamp = int(datetime(2024, 3, 1, 11).timestamp())

    def run():
        arrivals = workbook_arrivals(spark, str(inbox))
        finish(start_refresh(arrivals, store, str(tmp_path / "check"), availableNow=True))

    drop_workbook(inbox, "vl06o.xlsx", ["Delivery", "Number of packages"], [(7, 4), (8, 2)], stamp)
    good = workbook_bytes(HEADERS, scan_rows(FIRST))
    bad = inbox / "ZMDESNR_1.xlsx"
    bad.write_bytes(good[: len(good) // 2])
    os.utime(bad, (stamp + 60, stamp + 60))
    run()
    assert store.latest_snapshot() is None
    drop_workbook(inbox, "ZMDESNR_2.xlsx", HEADERS, scan_rows(FIRST), stamp + 120)
    worse = inbox / "ZMDESNR_3.xlsx"
    worse.write_bytes(b"PK")
    os.utime(worse, (stamp + 180, stamp + 180))
    run()
    assert rows(store.latest("serials"), "serial_number") == [("S1",), ("S2",)]
    names = [r.path.rsplit("/", 1)[-1] for r in store.unreadable().orderBy("path").collect()]
    assert names == ["ZMDESNR_1.xlsx", "ZMDESNR_3.xlsx"]


def announce(spark, folder, kind, path, clock):
    row = [(kind, path, f"2024-03-01 {clock}")]
    df = spark.createDataFrame(row, "report_type string, path string, modified_at string")
    df.coalesce(1).write.mode("append").json(folder)


def test_announced_reports_and_their_change_feed(spark, tmp_path):
    base = str(tmp_path)
    store = SnapshotStore(spark, f"{base}/store")
    announced = f"{base}/announced"
    _, packages = reports(spark, *FIRST)
    packages.write.parquet(f"{base}/packages")
    announce(spark, announced, "deliveries", f"{base}/packages", "09:00:00")
    for number, scans in enumerate((FIRST, SECOND)):
        reports(spark, *scans)[0].write.parquet(f"{base}/scans{number}")
        announce(spark, announced, "scans", f"{base}/scans{number}", f"1{number}:00:00")
        arrivals = announced_arrivals(spark, announced)
        finish(start_refresh(arrivals, store, f"{base}/refresh", availableNow=True))

    seen = []

    def sink(changes, snapshot_id):
        seen.append((snapshot_id, changes.count()))

    for _ in range(2):
        finish(follow_changes(store, sink, f"{base}/follow", availableNow=True))
    ids = sorted(r.snapshot_id for r in store.refresh_log().select("snapshot_id").distinct().collect())
    assert [s for s, _ in seen] == ids, "each snapshot once, oldest first"
    assert seen[0][1] == 0
    assert seen[1][1] == store.latest("change_feed").count() > 0


def test_changes_are_delivered_once_whatever_fails(spark, tmp_path):
    store = SnapshotStore(spark, f"{tmp_path}/store")
    for name, scans in (("1", FIRST), ("2", SECOND), ("3", FIRST)):
        refresh(store, *reports(spark, *scans), name, at("11:00"))
    feed = CommittedFeed(spark, f"{tmp_path}/feed")
    assert feed.read().count() == 0
    broken = CommittedFeed(spark, f"{tmp_path}/feed")
    add, calls = broken._commits.add, []

    def fails_once(snapshot_id):
        calls.append(snapshot_id)
        if calls.count("2") == 1 and snapshot_id == "2":
            raise OSError("lost before its commit")
        add(snapshot_id)

    broken._commits.add = fails_once
    with pytest.raises(Exception, match="lost before its commit"):
        finish(follow_changes(store, broken, f"{tmp_path}/check", availableNow=True))
    assert feed.read().filter("snapshot_id = '2'").count() == 0, "rows without a commit are not seen"
    for checkpoint in ("check", "check", "another"):
        finish(follow_changes(store, broken, f"{tmp_path}/{checkpoint}", availableNow=True))
    expected = [(n, *r) for n in "123" for r in rows(store.load("change_feed", n), "section", "op", "record")]
    assert rows(feed.read(), "snapshot_id", "section", "op", "record") == sorted(expected, key=repr)
    assert calls.count("2") == 2 and calls.count("3") == 1


def test_restart_repeats_no_refresh(spark, tmp_path):
    """A new checkpoint replays all arrivals; the batch finds its snapshot saved."""
    base = str(tmp_path)
    store = SnapshotStore(spark, f"{base}/store")
    raw, packages = reports(spark, *FIRST)
    raw.write.parquet(f"{base}/scans")
    packages.write.parquet(f"{base}/packages")
    announce(spark, f"{base}/announced", "deliveries", f"{base}/packages", "09:00:00")
    announce(spark, f"{base}/announced", "scans", f"{base}/scans", "10:00:00")
    for checkpoint in ("one", "two"):
        arrivals = announced_arrivals(spark, f"{base}/announced")
        finish(start_refresh(arrivals, store, f"{base}/{checkpoint}", availableNow=True))
    assert store.refresh_log().count() == 8


def test_clean_scans_are_appended_once(spark, tmp_path):
    base = str(tmp_path)
    raw, _ = reports(spark, *FIRST)
    raw.write.parquet(f"{base}/in")

    def run():
        stream = spark.readStream.schema(raw.schema).parquet(f"{base}/in")
        finish(write_clean_scans(stream, f"{base}/out", f"{base}/check", availableNow=True))
        return rows(spark.read.parquet(f"{base}/out"), "serial_number", "scan_timestamp")

    assert run() == [("S1", at("10:00")), ("S2", at("10:30"))]
    assert len(run()) == 2
    reports(spark, *SECOND[2:])[0].write.mode("append").parquet(f"{base}/in")
    assert len(run()) == 3


def test_activity_is_appended_once(spark, tmp_path):
    base = str(tmp_path)
    events = spark.createDataFrame([("U1", "scan", at("10:00")), ("U1", "view", at("10:01"))], ACTIVITY)
    events.write.parquet(f"{base}/in")
    for _ in range(2):
        stream = spark.readStream.schema(ACTIVITY).parquet(f"{base}/in")
        log = ActivityLog(spark, f"{base}/log")
        finish(append_activity(stream, log, f"{base}/check", availableNow=True))
        assert log.read().count() == 2


def test_the_stored_activity_stays_bounded(spark, tmp_path):
    """Many batches, a restart amid them, repeated batches: never more than some per user."""
    base = str(tmp_path / "log")
    expected: dict[str, list] = {}
    log = ActivityLog(spark, base, keep=3, every=4)
    for batch in range(11):
        events = [(f"U{n % 2}", f"a{batch}", at(f"{batch + 8}:{n:02d}")) for n in range(10)]
        for user, kind, stamp in events:
            expected[user] = sorted([*expected.get(user, []), (stamp, kind)])[-3:]
        df = spark.createDataFrame(events, ACTIVITY)
        if batch == 6:  # a new session goes on where the old one was
            log = ActivityLog(spark, base, keep=3, every=4)
            log.append(spark.createDataFrame([("U9", "late", at("08:00"))], ACTIVITY), 2)
        for _ in range(2):
            log.append(df, batch)
        assert log._stored().count() <= 2 * 3 * 5
    assert rows(log.read(), "user_id", "timestamp", "activity_type") == sorted(
        [(user, *kept) for user, all_kept in expected.items() for kept in all_kept], key=repr
    )
    tails = [p.name for p in (tmp_path / "log" / "tail").glob("batch_id=*")]
    assert sorted(tails) == ["batch_id=10", "batch_id=8", "batch_id=9"]
    assert len(list((tmp_path / "log" / "kept").glob("upto=*"))) == 1


def test_a_fold_that_fails_loses_nothing(spark, tmp_path):
    log = ActivityLog(spark, str(tmp_path), keep=2, every=100)
    for batch in range(3):
        log.append(spark.createDataFrame([("U1", f"a{batch}", at(f"{batch + 8}:00"))], ACTIVITY), batch)
    before = rows(log.read())

    def lost(*_):
        raise OSError("lost")

    write, log._paths.write = log._paths.write, lost
    with pytest.raises(OSError):
        log.fold(2)
    assert rows(log.read()) == before
    log._paths.write, log._paths.delete = write, lost
    with pytest.raises(OSError):
        log.fold(2)
    assert rows(log.read()) == before and len(before) == 2


def test_default_trigger_is_the_refresh_interval(spark, tmp_path):
    raw, _ = reports(spark, *FIRST)
    raw.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(raw.schema).parquet(f"{tmp_path}/in")
    query = write_clean_scans(stream, f"{tmp_path}/out", f"{tmp_path}/check")
    try:
        query.processAllAvailable()
        assert query.isActive
    finally:
        query.stop()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 2


@pytest.mark.parametrize("missing", ["Status", "Delivery"])
def test_stream_of_a_report_without_a_required_column(spark, tmp_path, missing):
    raw, _ = reports(spark, *FIRST)
    raw.drop(missing).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(raw.drop(missing).schema).parquet(f"{tmp_path}/in")
    with pytest.raises(ValueError, match=missing.lower()):
        write_clean_scans(stream, f"{tmp_path}/out", f"{tmp_path}/check", availableNow=True)
