from datetime import timedelta

import pytest
from helpers import DAY, at, plan, rows

from dockpulse.operators.activity import (
    activity_counts,
    activity_history,
    activity_metrics,
    last_activities,
    with_last_activity,
)
from dockpulse.operators.freshness import snapshot_freshness
from dockpulse.schemas import ACTIVITY, REFRESH_LOG


def log(spark, n=101, user="U1"):
    data = [(user, "scan" if i % 3 else "view", DAY + timedelta(minutes=i)) for i in range(n)]
    return spark.createDataFrame(data, ACTIVITY)


def test_cap_keeps_the_newest(spark):
    kept = last_activities(log(spark), 100)
    assert kept.count() == 100
    assert kept.agg({"timestamp": "min"}).first()[0] == DAY + timedelta(minutes=1)


def test_cap_beyond_what_the_map_side_can_cut(spark):
    both = log(spark, 1200).union(log(spark, 5, "U2")).repartition(7)
    kept = last_activities(both, 1100)
    assert "__split" in plan(kept)
    assert kept.count() == 1105
    assert kept.agg({"timestamp": "min"}).first()[0] == DAY
    assert kept.filter("user_id = 'U1'").agg({"timestamp": "min"}).first()[0] == DAY + timedelta(minutes=100)


def test_history(spark):
    both = log(spark).union(log(spark, 3, "U2"))
    assert activity_history(both, "U1").count() == 20
    assert activity_history(both, "U2").count() == 3
    assert activity_history(both, limit=2).count() == 4
    assert activity_history(both, "U1", limit=0).count() == 0
    assert activity_history(both, "U1", limit=100).count() == 100
    with pytest.raises(ValueError):
        activity_history(both, "U1", limit=500)
    newest = activity_history(both, "U1", limit=1).first()
    assert newest.timestamp == DAY + timedelta(minutes=100)


def test_metrics(spark):
    data = [
        ("U1", "scan", at("10:00")),
        ("U1", "scan", at("11:00")),
        ("U1", None, at("11:30")),
        ("U2", "view", at("09:00")),
    ]
    df = spark.createDataFrame(data, ACTIVITY)
    metrics = {r.user_id: r for r in activity_metrics(df, at("12:00")).collect()}
    assert metrics["U1"].activity_counts == {"scan": 2, "unknown": 1}
    assert metrics["U1"].total_activities == 3
    assert metrics["U1"].minutes_since_last_activity == 30.0
    assert metrics["U2"].last_activity_time == at("09:00")
    assert rows(activity_counts(df)) == [("U1", "scan", 2), ("U1", "unknown", 1), ("U2", "view", 1)]
    cut = {r.user_id: r for r in activity_metrics(df, at("12:00"), keep=1).collect()}
    assert cut["U1"].activity_counts == {"unknown": 1}


def test_last_activity_of_users(spark):
    users = spark.createDataFrame([("U1",), ("U9",)], "user_id string")
    df = with_last_activity(users, log(spark, 3))
    assert rows(df) == [("U1", DAY + timedelta(minutes=2), "scan"), ("U9", None, None)]


def test_freshness(spark):
    entries = [
        ("users", "1", at("10:00"), 5),
        ("users", "2", at("11:00"), 0),
        ("serials", "2", at("11:00"), 7),
    ]
    fresh = snapshot_freshness(spark.createDataFrame(entries, REFRESH_LOG), at("12:00"), 3600)
    by_section = {r.section: r for r in fresh.collect()}
    assert len(by_section) == 8
    assert (by_section["serials"].is_stale, by_section["serials"].has_data) == (False, True)
    assert (by_section["users"].age_seconds, by_section["users"].has_data) == (3600.0, False)
    assert (by_section["progress"].is_stale, by_section["progress"].last_updated) == (True, None)
    old = snapshot_freshness(spark.createDataFrame(entries, REFRESH_LOG), at("12:00"), 3599)
    assert {r.section: r.is_stale for r in old.collect()}["serials"]


def test_last_activity_does_not_depend_on_the_order_of_rows(spark):
    log = [("U1", "view", at("10:00")), ("U1", "scan", at("10:00")), ("U1", None, at("10:00"))]
    users = spark.createDataFrame([("U1",)], "user_id string")
    for order in (log, log[::-1]):
        for parts in (1, 3):
            frame = spark.createDataFrame(order, "user_id string, activity_type string, timestamp timestamp")
            found = with_last_activity(users, frame.repartition(parts)).first()
            assert (found.last_activity, found.last_activity_type) == (at("10:00"), "scan")
