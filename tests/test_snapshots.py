"""Manifest, digests, buckets and expiry of saved snapshots."""

import re

import pytest
from helpers import at, plan, rows
from pyspark.sql import functions as F
from test_store import FIRST, SECOND, reports

from dockpulse.operators.events import common_serials, newly_picked, shipped
from dockpulse.params import Params
from dockpulse.plans.refresh import refresh
from dockpulse.schemas import SECTIONS
from dockpulse.sources.manifest import Manifest
from dockpulse.sources.paths import Paths
from dockpulse.sources.store import SnapshotStore


@pytest.fixture()
def store(spark, tmp_path):
    return SnapshotStore(spark, str(tmp_path / "store"), buckets=4, slots=512)


@pytest.fixture()
def no_broadcast(spark):
    settings = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    for key in settings:
        spark.conf.set(key, "-1")
    yield
    for key in settings:
        spark.conf.unset(key)


def many(spark, n, shipped_from=None):
    """A scan report of ``n`` serials, those from a number on shipped."""
    serial = F.col("id")
    raw = spark.range(n).select(
        F.concat(F.lit("S"), serial).alias("Serial #"),
        F.concat(F.lit("U"), serial % 5).alias("Created by"),
        F.lit("2024-03-01").alias("Created on"),
        F.lit("10:00:00").alias("Time"),
        F.when(serial % 2 == 0, "7").otherwise("8").alias("Delivery"),
        F.when(serial >= (n if shipped_from is None else shipped_from), "SHP").otherwise("ASH").alias("Status"),
        F.lit("E01").alias("Warehouse Number"),
        F.lit("1").alias("Pallet"),
    )
    return raw, reports(spark, *FIRST)[1]


# -- manifest --------------------------------------------------------------------------------


class Counted(Paths):
    reads = 0

    def read(self, path):
        Counted.reads += 1
        return super().read(path)


def test_the_newest_snapshot_is_found_in_two_files(spark, tmp_path):
    manifest = Manifest(Counted(spark), str(tmp_path / "manifest"))
    for n in range(1000):
        manifest.add(f"{n:04d}")
    Counted.reads = 0
    assert manifest.latest() == "0999"
    assert Counted.reads == 1
    assert manifest.latest(before="0999") == "0998"
    assert Counted.reads <= 3


def test_entries_in_any_order_and_twice(spark, tmp_path):
    manifest = Manifest(Paths(spark), str(tmp_path / "manifest"))
    assert manifest.latest() is None
    for name in ("5", "3", "9", "7", "3", "1"):
        manifest.add(name)
    assert [e["snapshot_id"] for e in manifest.backwards()] == ["9", "7", "5", "3", "1"]
    assert manifest.latest(before="7") == "5" and manifest.latest(before="1") is None
    assert manifest.cut(2) == ["5", "3", "1"]
    assert [e["snapshot_id"] for e in manifest.backwards()] == ["9", "7"]
    assert manifest.cut(2) == []
    manifest.add("8")
    assert [e["snapshot_id"] for e in manifest.backwards()] == ["9", "8", "7"]
    assert manifest.cut(1) == ["8", "7"] and manifest.latest() == "9"


def test_a_refresh_that_failed_before_its_entry_is_completed(spark, store):
    refresh(store, *reports(spark, *FIRST), "1", at("11:00"))
    again = SnapshotStore(spark, store.base)
    again._manifest.add = lambda snapshot_id: (_ for _ in ()).throw(OSError("lost"))
    with pytest.raises(OSError):
        refresh(again, *reports(spark, *SECOND), "2", at("12:00"))
    assert store.latest_snapshot() == "1"
    assert refresh(store, *reports(spark, *SECOND), "2", at("12:00")) is None
    assert store.latest_snapshot() == "2"


def test_a_store_from_before_the_manifest_is_taken_over(spark, store):
    for n in "12":
        refresh(store, *reports(spark, *FIRST), n, at("11:00"))
    Paths(spark).delete(f"{store.base}/manifest")
    assert SnapshotStore(spark, store.base).latest_snapshot() == "2"


def test_expiry_and_a_compact_log(spark, store):
    for n in "1234":
        refresh(store, *reports(spark, *(FIRST if n < "3" else SECOND)), n, at("11:00"))
    before = rows(store.refresh_log())
    store.compact_log(keep=1)
    store.compact_log(keep=1)
    assert rows(store.refresh_log()) == before
    assert store._logged().select("snapshot_id").distinct().count() == 1
    assert store.is_saved("1") and not store.is_saved("9")

    assert store.expire(2) == ["2", "1"]
    assert rows(store.refresh_log().select("snapshot_id").distinct()) == [("3",), ("4",)]
    assert store.load("serials", "1").count() == 0 and not store.is_saved("1")
    assert not Paths(spark).exists(store._part("progress", "2"))
    assert store.load("serials", "3").count() == 3
    assert SnapshotStore(spark, store.base).latest_snapshot() == "4"
    with pytest.raises(ValueError):
        store.expire(0)

    refresh(store, *reports(spark, *SECOND), "5", at("11:00"), Params(keep_snapshots=1))
    assert rows(store.refresh_log().select("snapshot_id").distinct()) == [("5",)]
    assert store.latest("serials").count() == 3


# -- buckets ---------------------------------------------------------------------------------


def test_the_saved_side_is_not_moved(spark, store, no_broadcast):
    refresh(store, *many(spark, 40), "1", at("11:00"))
    refresh(store, *many(spark, 60, shipped_from=30), "2", at("12:00"))
    other = SnapshotStore(spark, store.base)
    spark.sql(f"DROP TABLE {store._bucketed('1')}")  # as in a session that did not write it
    for side in (store, other):
        now, before = side.load("current", "2"), side.load("serials", "1")
        for found in (newly_picked(now, before, True), shipped(now, before, True), common_serials(now, before, True)):
            text = plan(found)
            # the subquery for the one row without a serial moves a single flag
            moved = [e for e in re.findall(r"Exchange [^\n]*", text) if "SinglePartition" not in e]
            assert not moved, text
            assert "Bucketed: true" in text
    assert newly_picked(now, before, True).count() == 0
    assert shipped(now, before, True).count() == 10
    assert common_serials(now, before, True).count() == 40


def test_serials_without_a_number_within_buckets(spark, store):
    def saved(name, *serials):
        raw, packages = reports(spark, *[(s, "U1", "10:00:00", "7", x) for s, x in serials])
        refresh(store, raw, packages, name, at("11:00"))
        return store.load("current", name)

    one, two, three = saved("1", (None, "ASH"), ("S1", "ASH")), saved("2", (None, "SHP"), ("S2", "ASH")), saved("3", ("S2", "SHP"))
    assert rows(newly_picked(two, one, True), "serial_number") == [("S2",)]
    assert rows(shipped(two, one, True), "serial_number", "previous_status") == [(None, "ASH")]
    assert rows(common_serials(two, three, True), "serial_number") == [("S2",)]
    assert {r.serial_number for r in newly_picked(one, three, True).collect()} == {None, "S1"}


# -- digests ---------------------------------------------------------------------------------


def test_slots_that_differ(spark, store):
    refresh(store, *many(spark, 1000), "1", at("11:00"))
    refresh(store, *many(spark, 1000, shipped_from=990), "2", at("11:00"))
    slots = store.differing_slots("2", "1")
    changed = store.load("serials", "2").filter("status = 'SHP'")
    expected = {r[0] for r in changed.select(store._slot("serials")).collect()}
    assert set(slots["serials"]) == expected and len(expected) <= 10
    assert slots["users"] == [] and slots["scan_times"] == [] and slots["progress"] == []
    # ten changed rows of a thousand: the scans ask for these slots only, and little else comes back
    part = store.load("serials", "2", slots["serials"])
    assert re.search(r"PushedFilters: \[[^\]]*In\(__slot", plan(part)) or "EqualTo(__slot" in plan(part)
    assert part.count() <= 40
    feed = store.latest("change_feed").filter("section = 'serials'")
    assert rows(feed.groupBy("op").count()) == [("added", 10), ("removed", 10)]


def test_equal_snapshots_read_no_rows(spark, store, monkeypatch):
    refresh(store, *reports(spark, *SECOND), "1", at("11:00"))
    refresh(store, *reports(spark, *SECOND), "2", at("11:00"))
    refresh(store, *reports(spark, *SECOND), "3", at("11:00"))
    assert store.differing_slots("3", "2") == {name: [] for name in SECTIONS}
    assert store.latest("change_feed").count() == 0
    assert store.differing_slots("2", "1")["new_serials"] != []


def test_digests_that_cannot_tell(spark, store):
    refresh(store, *reports(spark, *FIRST), "1", at("11:00"))
    refresh(store, *reports(spark, *FIRST), "2", at("11:01"), Params(ignore_columns=("minutes_since_last_scan",)))
    unlike = store.differing_slots("2", "1")
    assert unlike["users"] is None and unlike["serials"] is None, "other columns were digested"
    refresh(store, *reports(spark, *FIRST), "3", at("11:02"), Params(ignore_columns=("minutes_since_last_scan",)))
    assert store.differing_slots("3", "2")["users"] == []
    Paths(spark).delete(store._part("digests", "2"))
    assert set(store.differing_slots("3", "2").values()) == {None}


def test_the_order_of_rows_does_not_matter_but_their_number_does(spark, store):
    schema = SECTIONS["deliveries"]
    for name, data in {"1": [("7", 1.0), ("8", None)], "2": [("8", None), ("7", 1.0)], "3": [("7", 1.0), ("7", 1.0), ("8", None)]}.items():
        store.write("deliveries", spark.createDataFrame(data, schema), name)
        store.save_digests(name, ["deliveries"])
    assert store.differing_slots("2", "1")["deliveries"] == []
    assert len(store.differing_slots("3", "1")["deliveries"]) == 1


def test_slots_are_not_named_when_most_differ(spark, store):
    refresh(store, *many(spark, 1000), "1", at("11:00"))
    refresh(store, *many(spark, 1000, shipped_from=0), "2", at("12:00"))
    slots = store.differing_slots("2", "1")
    assert slots["serials"] is None and slots["users"] != []
    feed = store.load("change_feed", "2").filter("section = 'serials'")
    assert rows(feed.groupBy("op").count(), "op", "count") == [("added", 1000), ("removed", 1000)]
    assert store.load("serials", "2", []).count() == 0
