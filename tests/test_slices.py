"""The users section from slices equals the one over all scans, at any time."""

import re

import pytest
from helpers import at, combined, plan, random_scans, rows
from pyspark.sql import functions as F

from dockpulse.operators.slices import known_users, scan_slices, users_from_slices
from dockpulse.operators.users import user_activity


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("inactive", [False, True])
def test_users_from_slices(spark, seed, inactive):
    df = combined(spark, *random_scans(seed, 80))
    seconds = F.make_interval(secs=F.abs(F.xxhash64("serial_number", "name")) % 90)
    df = df.withColumn(
        "scan_timestamp", F.col("scan_timestamp") + seconds
    )
    slices, users = scan_slices(df), known_users(df)
    for as_of, window in (("09:30", 60), ("09:31", 31), ("10:00:17", 60), ("09:01:30", 1), ("08:00", 600), ("23:00", 5)):
        expected = user_activity(df, at(as_of), window, inactive)
        assert rows(users_from_slices(slices, users, at(as_of), window, inactive)) == rows(expected), (as_of, window)


def test_a_window_opens_its_own_days_only(spark, tmp_path):
    scans = [{"scan_timestamp": at("10:00").replace(day=d), "serial_number": f"S{d}"} for d in range(1, 29)]
    df = combined(spark, *scans)
    scan_slices(df).write.partitionBy("day").parquet(f"{tmp_path}/slices")
    saved = spark.read.parquet(f"{tmp_path}/slices")
    section = users_from_slices(saved, known_users(df), at("10:30").replace(day=20), 24 * 60)
    assert section.first().scan_count == 9, "there is no upper bound"
    text = plan(section)
    assert re.search(r"PartitionFilters: \[[^\]]*day", text)
    assert re.search(r"PushedFilters: \[[^\]]*GreaterThanOrEqual\(minute", text)


def test_slices_of_nothing(spark):
    df = combined(spark, {"scan_timestamp": None}).filter("false")
    assert users_from_slices(scan_slices(df), known_users(df), at("10:00")).count() == 0
