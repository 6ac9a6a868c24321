from datetime import timedelta

import pytest
from helpers import DAY, at, combined, random_scans, rows
from pyspark.sql import functions as F

from dockpulse.functions.labels import card_band, card_percent, rounded
from dockpulse.functions.timing import duration_label, iso_text
from dockpulse.operators.combine import combine, one_row_per_delivery
from dockpulse.operators.progress import (
    delivery_packages,
    delivery_status,
    progress,
    progress_cards,
    progress_lookup,
)
from dockpulse.operators.scan_times import latest_two_scans, scan_times, scan_times_lookup
from dockpulse.operators.serials import (
    CORE_COLUMNS,
    dedup_serials,
    serials_section,
    status_distribution,
    with_status_description,
)
from dockpulse.operators.users import active_users, recent_scans, user_activity, user_names
from dockpulse.schemas import DELIVERIES
from pyspark.sql import functions as F

AS_OF = at("12:00")


def test_shipped_row_wins(spark):
    df = combined(
        spark,
        {"serial_number": "S1", "status": "ASH", "scan_timestamp": at("10:00")},
        {"serial_number": "S1", "status": "SHP", "scan_timestamp": at("09:00")},
        {"serial_number": "S2", "delivery": "D1"},
        {"serial_number": "S2", "delivery": "D2"},
    )
    assert rows(dedup_serials(df), "serial_number", "status", "delivery") == [
        ("S1", "SHP", "D1"),
        ("S2", "ASH", "D1"),
    ]


@pytest.mark.parametrize("seed", range(3))
def test_dedup_properties(spark, seed):
    data = random_scans(seed, 60)
    df = combined(spark, *data).repartition(5)
    once = dedup_serials(df).cache()
    serials = [r.serial_number for r in once.collect()]
    assert sorted(map(str, serials)) == sorted({str(d["serial_number"]) for d in data})
    shipped = {d["serial_number"] for d in data if d["status"] == "SHP"}
    assert {r.serial_number for r in once.filter("status = 'SHP'").collect()} == shipped
    assert rows(dedup_serials(once)) == rows(once)
    assert rows(dedup_serials(df.repartition(2))) == rows(once)
    core = dedup_serials(df, CORE_COLUMNS)
    assert rows(core) == rows(once, *CORE_COLUMNS)
    counted = once.filter("delivery is not null and created_by is not null").count()
    per_user = progress(once).groupBy("delivery", "created_by").agg(F.first("scanned_count").alias("n"))
    assert (per_user.agg(F.sum("n")).first()[0] or 0) == counted


def test_serials_of_a_delivery_agree_on_its_packages(spark):
    scans = [{"serial_number": f"S{i}", "delivery": f"D{i % 3}"} for i in range(9)]
    df = combined(spark, *[{**s, "number_of_packages": p} for s in scans for p in (5.0, 4.0, None)])
    assert rows(delivery_packages(dedup_serials(df))) == [("D0", 4.0), ("D1", 4.0), ("D2", 4.0)]


@pytest.mark.parametrize("seed", range(3))
def test_one_row_per_delivery_gives_the_same_serials(spark, seed):
    df = combined(spark, *random_scans(seed, 60))
    packages = [
        (f"D{i % 3 + 1}", p, s, {"note": s})
        for i, (p, s) in enumerate([(4.0, "b"), (None, "a"), (5.0, None), (4.0, "a"), (5.0, "x"), (0.0, None)])
    ]
    deliveries = spark.createDataFrame(packages, DELIVERIES)
    scans = df.drop("number_of_packages", "shipping_point")
    single = one_row_per_delivery(deliveries)
    assert single.count() == 3
    assert rows(dedup_serials(combine(scans, single))) == rows(dedup_serials(combine(scans, deliveries)))


def test_status_description_and_section(spark):
    df = with_status_description(combined(spark, {"status": "SHP"}, {"status": "ASH"}, {"status": "ZZ"}))
    section = serials_section(df.drop("time"))
    assert "time" not in section.columns
    assert rows(section, "status", "status_description") == [
        ("ASH", "picked"),
        ("SHP", "shipped / closed"),
        ("ZZ", None),
    ]
    assert rows(status_distribution(df)) == [("ASH", 1), ("SHP", 1), ("ZZ", 1)]


def test_progress(spark):
    df = combined(
        spark,
        {"delivery": "D1"},
        {"delivery": "D1"},
        {"delivery": "D1", "created_by": "U2", "number_of_packages": 5.0},
        {"delivery": "D2", "number_of_packages": 0.0},
        {"delivery": "D3", "number_of_packages": None},
        {"delivery": None},
        {"created_by": None},
    )
    result = progress(df)
    assert rows(result) == [
        ("D1", "U1", 2, 4.0, 50.0),
        ("D1", "U1", 2, 5.0, 40.0),
        ("D1", "U2", 1, 4.0, 25.0),
        ("D1", "U2", 1, 5.0, 20.0),
        ("D2", "U1", 1, 0.0, None),
        ("D3", "U1", 1, None, None),
    ]
    assert progress_lookup(result, delivery="D1", user="U2").count() == 2
    assert progress_lookup(result).count() == 6
    assert rows(progress_cards(result)) == [
        ("D1", 3, 4.0, 75, "success"),
        ("D1", 3, 5.0, 60, "info"),
        ("D2", 1, 0.0, 0, "danger"),
        ("D3", 1, 0.0, 0, "danger"),
    ]


def test_delivery_status(spark):
    df = combined(spark, {"status": "SHP"}, {"status": "ASH"}, {"serial_number": None, "status": "SHP"})
    assert rows(delivery_status(df)) == [("D1", 2, 2)]


def test_card_bands(spark):
    df = spark.range(101).select("id", card_band(F.col("id")).alias("band"))
    bands = dict(df.collect())
    assert [bands[i] for i in (24, 25, 49, 50, 74, 75)] == [
        "danger",
        "warning",
        "warning",
        "info",
        "info",
        "success",
    ]
    half = spark.range(1).select(card_percent(F.lit(1), F.lit(8.0)), card_percent(F.lit(1), F.lit(0.0)))
    assert tuple(half.first()) == (13, 0)


def test_scan_times_ties(spark):
    df = combined(
        spark,
        {"serial_number": "S2", "scan_timestamp": at("10:00")},
        {"serial_number": "S1", "scan_timestamp": at("10:00"), "status": "SHP"},
        {"serial_number": "S0", "scan_timestamp": at("09:00")},
        {"created_by": "U2", "scan_timestamp": at("10:00")},
        {"created_by": "U2", "scan_timestamp": at("10:00")},
        {"created_by": "U3", "scan_timestamp": None},
        {"created_by": None},
        {"created_by": "U4", "scan_timestamp": at("12:30"), "serial_number": None},
    )
    assert rows(scan_times(df, AS_OF)) == [
        ("U1", at("10:00"), at("09:00"), 60.0, "S1", "SHP", 120.0),
        ("U2", at("10:00"), None, None, "S4", "ASH", 120.0),
        ("U4", at("12:30"), None, None, "", "ASH", -30.0),
    ]
    assert scan_times_lookup(scan_times(df, AS_OF), "U2").count() == 1


@pytest.mark.parametrize("seed", range(3))
def test_scan_times_against_brute_force(spark, seed):
    data = [d for d in random_scans(seed, 80) if d["serial_number"] and d["status"]]
    result = scan_times(combined(spark, *data).repartition(6), AS_OF)
    expected = []
    for user in sorted({d["created_by"] for d in data if d["created_by"]}):
        own = [d for d in data if d["created_by"] == user and d["scan_timestamp"]]
        now = max(d["scan_timestamp"] for d in own)
        before = max((d["scan_timestamp"] for d in own if d["scan_timestamp"] < now), default=None)
        row = min((d["serial_number"], d["status"]) for d in own if d["scan_timestamp"] == now)
        expected.append((user, now, before, *row))
    assert rows(result, "user_id", "current_scan_time", "previous_scan_time", "serial", "status") == expected


def test_latest_two_scans_may_tie(spark):
    df = combined(spark, {}, {}, {"scan_timestamp": at("09:00")})
    assert rows(latest_two_scans(df)) == [
        ("U1", at("10:00"), "S1", "ASH", at("10:00"), "S2", "ASH")
    ]


def test_window_edge_and_future_scan(spark):
    df = combined(
        spark,
        {"scan_timestamp": at("11:00")},
        {"scan_timestamp": at("10:59:59"), "created_by": "U2"},
        {"scan_timestamp": at("12:15"), "created_by": "U3"},
    )
    assert recent_scans(df, AS_OF, 60).count() == 2
    result = user_activity(df, AS_OF, 60)
    assert rows(result, "user_id", "scan_count", "minutes_since_last_scan") == [
        ("U1", 1, 60.0),
        ("U3", 1, -15.0),
    ]


def test_user_activity(spark):
    df = combined(
        spark,
        {"scan_timestamp": at("11:10"), "name": None},
        {"scan_timestamp": at("11:40"), "name": "Ann", "delivery": "D2"},
        {"scan_timestamp": at("11:30"), "delivery": None},
        {"scan_timestamp": at("11:50"), "created_by": "U2", "name": "Bo"},
        {"scan_timestamp": at("08:00"), "created_by": "U2", "name": "Cy"},
    )
    assert rows(user_activity(df, AS_OF, 60)) == [
        ("U1", 3, at("11:10"), at("11:40"), 2, 6.0, 20.0, "User U1"),
        ("U2", 1, at("11:50"), at("11:50"), 1, None, 10.0, "Bo"),
    ]
    assert rows(user_names(df)) == [("U1", "User U1"), ("U2", "Bo")]
    assert "name" not in user_activity(df.drop("name"), AS_OF).columns


def test_nobody_recent(spark):
    df = combined(spark, {}, {"created_by": "U2"}, {"created_by": "U3", "scan_timestamp": None})
    late = AS_OF + timedelta(days=9)
    assert rows(user_activity(df, late, 60)) == [
        ("U1", 0, None, None, 0, 0.0, None, None),
        ("U2", 0, None, None, 0, 0.0, None, None),
    ]
    assert user_activity(df.limit(0), late, 60).count() == 0


def test_inactive_users_on_request(spark):
    df = combined(spark, {"scan_timestamp": at("11:30")}, {"created_by": "U2"})
    assert rows(user_activity(df, AS_OF, 60), "user_id") == [("U1",)]
    everybody = user_activity(df, AS_OF, 60, include_inactive=True)
    assert rows(everybody, "user_id", "scan_count") == [("U1", 1), ("U2", 0)]
    assert active_users(everybody, AS_OF, 60).count() == 1


def test_duration_labels(spark):
    texts = [
        spark.range(1)
        .select(duration_label(F.lit(DAY + timedelta(seconds=s)), F.lit(DAY)))
        .first()[0]
        for s in (59, 60, 3599, 3600, 59.4, 59.5)
    ]
    assert texts == [
        "59 seconds",
        "1 min 0 sec",
        "59 min 59 sec",
        "1 hr 0 min",
        "59 seconds",
        "1 min 0 sec",
    ]
    assert spark.range(1).select(duration_label(F.lit(DAY), F.lit(None).cast("timestamp"))).first()[0] is None


def test_iso_text(spark):
    moments = [DAY, DAY + timedelta(microseconds=1500), None]
    df = spark.createDataFrame([(m,) for m in moments], "t timestamp")
    assert [r[0] for r in df.select(iso_text(F.col("t"))).collect()] == [
        m and m.isoformat() for m in moments
    ]


def test_halves_go_up_or_to_the_even_neighbour(spark):
    df = spark.createDataFrame([(0.125,), (0.375,), (None,)], "x double")
    found = df.select(rounded(F.col("x")).alias("up"), rounded(F.col("x"), True).alias("even")).collect()
    assert [tuple(r) for r in found] == [(0.13, 0.12), (0.38, 0.38), (None, None)]
