import json
from datetime import datetime

import pytest
from helpers import at, combined, rows

from dockpulse.params import Params
from dockpulse.plans.dashboard import build_section, build_sections, current_serials
from dockpulse.plans.refresh import refresh
from dockpulse.schemas import SECTIONS, conform
from dockpulse.session import scratch_dir
from dockpulse.sources.export import broken_records, load_records, section_from_json, sections_to_json
from dockpulse.sources.store import SnapshotStore

HEADERS = ["Serial #", "Created by", "Created on", "Time", "Delivery", "Status", "Warehouse Number", "Pallet"]


def reports(spark, *scans):
    full = [(s, u, "2024-03-01", t, d, x, "E01", "1") for s, u, t, d, x in scans]
    raw = spark.createDataFrame(full, ", ".join(f"`{h}` string" for h in HEADERS))
    packages = spark.createDataFrame([("7", "4"), ("8", "2")], ["Delivery", "Number of packages"])
    return raw, packages


FIRST = [("S1", "U1", "10:00:00", "7", "ASH"), ("S2", "U2", "10:30:00", "8", "ASH")]
SECOND = [
    ("S1", "U1", "10:00:00", "7", "SHP"),
    ("S2", "U2", "10:30:00", "8", "ASH"),
    ("S3", "U1", "11:00:00", "8", "ASH"),
]


@pytest.fixture()
def store(spark, tmp_path):
    return SnapshotStore(spark, str(tmp_path / "store"))


def test_empty_store(store):
    assert store.latest_snapshot() is None
    assert store.latest("users").schema == SECTIONS["users"]
    assert store.load("users", "1").count() == 0
    assert not store.is_saved("1")


def test_two_refreshes(spark, store):
    assert refresh(store, *reports(spark, *FIRST), "20240301110000", at("11:00"))["serials"] == 2
    assert store.latest("new_serials").count() == 2
    assert store.latest("change_feed").count() == 0

    counts = refresh(store, *reports(spark, *SECOND), "20240301120000", at("12:00"))
    assert counts == {
        "users": 1,
        "deliveries": 2,
        "progress": 3,
        "scan_times": 2,
        "serials": 3,
        "status_changes": 1,
        "new_serials": 1,
        "completed_deliveries": 1,
    }
    assert store.latest_snapshot() == "20240301120000"
    assert store.latest_snapshot(before="20240301120000") == "20240301110000"
    assert rows(store.latest("status_changes"), "serial_number", "previous_status") == [("S1", "ASH")]
    assert rows(store.latest("completed_deliveries"), "delivery") == [("7",)]
    assert store.load("serials", "20240301110000").count() == 2
    feed = store.latest("change_feed")
    assert rows(feed.filter("section = 'serials'"), "op") == [("added",), ("added",), ("removed",)]
    assert rows(feed.filter("section = 'progress'"), "op", "key") == [
        ("added", '{"delivery":"8","created_by":"U1"}')
    ]


def test_saved_snapshot_is_not_computed_again(spark, store):
    refresh(store, *reports(spark, *FIRST), "1", at("11:00"))
    assert refresh(store, *reports(spark, *SECOND), "1", at("11:00")) is None
    assert store.latest("serials").count() == 2


def test_refresh_after_a_failure_replaces_what_was_left(spark, store):
    raw, packages = reports(spark, *FIRST)
    half = build_section("serials", combined(spark, {}, {}, {}), None, at("11:00"))
    store.write("serials", conform(half, SECTIONS["serials"]), "1")
    assert store.latest("serials").count() == 0
    refresh(store, raw, packages, "1", at("11:00"))
    assert rows(store.latest("serials"), "serial_number") == [("S1",), ("S2",)]
    refresh(store, raw, packages, "2", at("11:00"))
    # the same reports again: only the serials that were new are not new any more
    assert rows(store.latest("change_feed"), "section", "op") == [("new_serials", "removed")] * 2


def test_report_without_usable_rows(spark, store):
    raw, packages = reports(spark, *FIRST)
    assert refresh(store, raw, packages, "1", at("11:00"), Params(warehouse="E99")) is None
    assert refresh(store, raw, packages.limit(0), "1", at("11:00")) is None
    assert store.latest_snapshot() is None


def test_snapshot_without_matching_deliveries(spark, store):
    raw, _ = reports(spark, *FIRST)
    other = spark.createDataFrame([("99", "4")], ["Delivery", "Number of packages"])
    assert set(refresh(store, raw, other, "1", at("11:00")).values()) == {0}
    refresh(store, *reports(spark, *FIRST), "2", at("11:00"))
    # an empty previous snapshot counts as a first run
    assert store.latest("new_serials").count() == 2


def test_save_sections(spark, store):
    current = current_serials(combined(spark, {}, {"status": "SHP"}))
    store.save(build_sections(current, None, at("12:00")), "20240301", at("12:00"))
    assert store.latest("status_changes").columns == SECTIONS["status_changes"].fieldNames()
    assert rows(store.refresh_log(), "section", "snapshot_id") == sorted(
        (name, "20240301") for name in SECTIONS
    )


def test_unknown_section(spark):
    with pytest.raises(ValueError, match="nonsense"):
        build_section("nonsense", combined(spark, {}), None, at("12:00"))


def test_a_lost_table_of_a_committed_snapshot_is_an_error(spark, store):
    refresh(store, *reports(spark, *FIRST), "1", at("11:00"))
    lost = SnapshotStore(spark, store.base)
    lost._folder = lambda table: f"{store.base}/{'elsewhere' if table == 'current' else table}"
    assert lost.load("serials", "2").count() == 0
    with pytest.raises(FileNotFoundError, match="snapshot 1"):
        lost.load("serials", "1")


def test_settings_of_a_refresh(spark, store):
    params = Params(include_inactive=True, ignore_columns=("minutes_since_last_scan",))
    refresh(store, *reports(spark, *FIRST), "1", at("10:45"), params)
    refresh(store, *reports(spark, *FIRST), "2", at("10:50"), params)
    assert store.latest("users").count() == 2
    assert store.latest("change_feed").filter("section in ('users', 'scan_times')").count() == 0


def test_json_records(spark):
    df = spark.createDataFrame(
        [("U1", datetime(2024, 3, 1, 10, 0, 0, 500), float("nan"), None)],
        "user_id string, last_scan timestamp, rate double, n long",
    )
    row = sections_to_json({"users": df}, at("12:00")).first()
    assert json.loads(row.record) == {
        "user_id": "U1",
        "last_scan": "2024-03-01T10:00:00.000500",
        "rate": None,
        "n": None,
    }
    assert (row.section, row.generated_at) == ("users", at("12:00"))


def test_scratch_dirs_differ_and_follow_the_setting(spark):
    one, two = scratch_dir(spark, "x"), scratch_dir(spark, "x")
    assert one != two
    assert one.startswith(spark.conf.get("spark.checkpoint.dir"))


def test_records_are_read_back_with_their_types(spark, tmp_path):
    current = current_serials(combined(spark, {"extra": {"batch": "B1", "note": None}}, {"status": "SHP", "scan_timestamp": None}))
    sections = build_sections(current, current.filter("status = 'ASH'"), at("12:00"))
    sections_to_json(sections, at("12:00")).write.json(f"{tmp_path}/json")
    records = load_records(spark, f"{tmp_path}/json")
    for name, df in sections.items():
        back = section_from_json(records, name)
        assert back.drop("rescued").schema.simpleString() == conform(df, SECTIONS[name]).schema.simpleString()
        assert rows(back.drop("rescued")) == rows(conform(df, SECTIONS[name]))
        assert back.filter("rescued is not null").count() == 0
    assert broken_records(records).count() == 0


def test_records_that_do_not_fit_are_kept_apart(spark):
    good = '{"delivery":"7","created_by":"U1","scanned_count":2,"number_of_packages":4.0,"progress_percentage":50.0}'
    further = good[:-1] + ',"lane":"L3","stops":[1,2]}'
    texts = [good, further, good.replace("2,", '"two",'), good[:-9], "[1, 2]", "7", "", None]
    data = [("progress", t, at("12:00")) for t in texts] + [("elsewhere", good, None), (None, good, None)]
    records = spark.createDataFrame(data, "section string, record string, generated_at timestamp")
    found = section_from_json(records, "progress")
    assert rows(found, "delivery", "scanned_count", "rescued") == [
        ("7", 2, '{"lane":"L3","stops":"[1,2]"}'),
        ("7", 2, None),
    ]
    assert broken_records(records).count() == 8
    assert not store._paths.exists(f"{store.base}/current/snapshot_id=1")


def test_reports_with_rows_are_not_read_for_being_empty(spark, store, monkeypatch):
    raw, packages = reports(spark, *FIRST)
    plain, asked = type(raw).isEmpty, []
    monkeypatch.setattr(type(raw), "isEmpty", lambda df: asked.append(df.columns) or plain(df))
    assert refresh(store, raw, packages, "1", at("11:00"))["serials"] == 2
    assert not [columns for columns in asked if "delivery" in columns]
