import json
import random

import pytest
from helpers import at, combined, rows

from dockpulse.operators.diff import added_rows, change_feed, changed_rows, diff_section, removed_rows
from dockpulse.operators.events import (
    common_serials,
    completed_deliveries,
    newly_picked,
    shipped,
)
from dockpulse.operators.serials import serials_section, with_status_description

AS_OF = at("12:00")


def snapshot(spark, **statuses):
    return combined(spark, *[{"serial_number": s, "status": x} for s, x in statuses.items()])


def test_events(spark):
    before = snapshot(spark, S1="ASH", S2="ASH", S3="SHP", S6="ASH")
    now = snapshot(spark, S1="SHP", S2="ASH", S3="ASH", S4="ASH", S5="SHP")
    assert rows(newly_picked(now, before), "serial_number", "event") == [("S4", "newly_picked")]
    assert rows(shipped(now, before), "serial_number", "previous_status", "event") == [
        ("S1", "ASH", "shipped")
    ]
    assert rows(shipped(now, before, unique_previous=True)) == rows(shipped(now, before))
    assert rows(common_serials(now, before), "serial_number") == [("S1",), ("S2",), ("S3",)]
    union = common_serials(now, before).select("serial_number").union(
        now.join(before.select("serial_number"), "serial_number", "left_anti").select("serial_number")
    )
    assert rows(union) == rows(now, "serial_number")


@pytest.mark.parametrize("empty", [True, False])
def test_first_run(spark, empty):
    now = snapshot(spark, S1="SHP", S2="ASH")
    before = now.limit(0) if empty else None
    assert rows(newly_picked(now, before), "serial_number") == [("S2",)]
    assert shipped(now, before).count() == 0
    assert shipped(now, before).columns == shipped(now, now).columns
    assert completed_deliveries(now.filter("status = 'SHP'"), before).count() == 0


def test_completed_is_a_state(spark):
    now = combined(
        spark,
        {"delivery": "D1", "status": "SHP"},
        {"delivery": "D1", "status": "SHP"},
        {"delivery": "D2", "status": "SHP"},
        {"delivery": "D2", "status": "ASH"},
        {"delivery": None, "status": "SHP"},
    )
    assert rows(completed_deliveries(now, now)) == [("D1", 2, 2, "completed")]


def test_missing_serial_is_known_from_before(spark):
    now = combined(spark, {"serial_number": None}, {"serial_number": "S2"})
    assert rows(newly_picked(now, now), "serial_number") == []


def test_latest_duplicate_gives_the_previous_status(spark):
    before = combined(
        spark,
        {"serial_number": "S1", "status": "SHP", "scan_timestamp": at("09:00")},
        {"serial_number": "S1", "status": "ASH", "scan_timestamp": at("10:00")},
    )
    assert rows(shipped(snapshot(spark, S1="SHP"), before), "serial_number") == [("S1",)]


def table(spark, *data):
    return spark.createDataFrame(list(data), "k string, a int, b string")


def test_first_differing_column(spark):
    before = table(spark, ("x", 1, "p"), ("y", None, "p"), ("z", 1, "p"), (None, 1, "p"), ("n", None, None))
    now = table(spark, ("x", 2, "q"), ("y", 3, "p"), ("z", 1, None), (None, 1, "q"), ("n", None, None))
    expected = [
        ("x", 2, "q", "a", "1"),
        ("y", 3, "p", "a", None),
        ("z", 1, None, "b", "p"),
        (None, 1, "q", "b", "p"),
    ]
    assert rows(changed_rows(now, before, ["k"])) == expected
    assert added_rows(now, before, ["k"]).count() == removed_rows(now, before, ["k"]).count() == 0
    for unique in (False, True):
        feed = diff_section("t", now, before, ["k"], unique=unique)
        assert rows(feed, "op", "changed_column", "previous_value") == [
            ("changed", "a", "1"),
            ("changed", "a", None),
            ("changed", "b", "p"),
            ("changed", "b", "p"),
        ]
        records = [json.loads(r.record) for r in feed.collect()]
        assert {"k": None, "a": 1, "b": "q"} in records


def test_ignored_column(spark):
    before, now = table(spark, ("x", 1, "p")), table(spark, ("x", 2, "q"))
    assert rows(changed_rows(now, before, ["k"], ignore=["a"]), "changed_column") == [("b",)]
    assert diff_section("t", now, before, ["k"], ignore=["a", "b"]).count() == 0
    assert diff_section("t", now, before, ["k"], ignore=["a", "b"], unique=True).count() == 0


def test_duplicates_of_added_and_removed_keys_are_kept(spark):
    before = table(spark, ("r", 1, "p"), ("r", 2, "p"), ("c", 4, "p"))
    now = table(spark, ("a", 1, "p"), ("a", 1, "p"), ("c", 4, "p"), ("c", 5, "p"))
    feed = diff_section("t", now, before, ["k"])
    assert rows(feed, "op") == [("added",), ("added",), ("removed",), ("removed",)]
    assert rows(diff_section("t", now, before), "op") == [
        ("added",), ("added",), ("added",), ("removed",), ("removed",)
    ]


@pytest.mark.parametrize("seed", range(2))
def test_unique_plan_gives_the_same_feed(spark, seed):
    rng = random.Random(seed)

    def some():
        keys = rng.sample([None, *"abcdefgh"], 6)
        return table(spark, *[(k, rng.choice([None, 1, 2]), rng.choice([None, "p", "q"])) for k in keys])

    now, before = some(), some()
    for keys in (["k"], None):
        general = diff_section("t", now, before, keys)
        assert rows(diff_section("t", now, before, keys, unique=True)) == rows(general)
        assert diff_section("t", now, now, keys).count() == 0
        assert diff_section("t", now, now, keys, unique=True).count() == 0


@pytest.mark.parametrize("unique", [False, True])
def test_one_side_empty(spark, unique):
    df = table(spark, ("x", 1, "p"), ("y", None, None))
    for keys in (["k"], None):
        assert rows(diff_section("t", df, df.limit(0), keys, unique=unique), "op") == [("added",)] * 2
        assert rows(diff_section("t", df.limit(0), df, keys, unique=unique), "op") == [("removed",)] * 2
        assert rows(diff_section("t", df, None, keys), "op") == [("added",)] * 2


def test_change_feed_over_sections(spark):
    now = serials_section(with_status_description(snapshot(spark, S1="SHP", S2="ASH")))
    before = serials_section(with_status_description(snapshot(spark, S1="ASH")))
    users = spark.createDataFrame([("U1", 1)], "user_id string, scan_count long")
    feed = change_feed({"serials": now, "users": users}, {"serials": before}, AS_OF, unique=True)
    assert rows(feed, "section", "op") == [
        ("serials", "added"),
        ("serials", "added"),
        ("serials", "removed"),
        ("users", "added"),
    ]
    assert feed.filter("section = 'users'").first().key == '{"user_id":"U1"}'
    assert feed.first().generated_at == AS_OF
