"""Report columns that no table declares, from the file to the events."""

from datetime import datetime

import pytest
from helpers import at, plan, rows
from pyspark.sql import functions as F

from dockpulse.operators.combine import combine, one_row_per_delivery
from dockpulse.operators.diff import added_rows, changed_rows, diff_section
from dockpulse.operators.serials import dedup_serials
from dockpulse.params import Params
from dockpulse.plans import canonical
from dockpulse.plans.refresh import refresh
from dockpulse.plans.workbooks import workbook_bytes
from dockpulse.sources.reports import load_report, read_deliveries, read_scans
from dockpulse.sources.store import SnapshotStore

COLUMNS = ["Serial #", "Created by", "Created on", "Time", "Delivery", "Status", "Warehouse Number", "Pallet"]
SF = "/root/testdata/sf0.001"


def scan(serial, status, *further):
    return (serial, "U1", datetime(2024, 3, 1), "10:00:00", 7.0, status, "E01", 1, *further)


FIRST = [scan("S1", "ASH", "B1", 5, "x"), scan("S2", "ASH", None, 6, None)]
SECOND = [scan("S1", "SHP", "B1", 5, "x"), scan("S2", "ASH", None, 6, None), scan("S3", "ASH", "B3", None, "z")]
FURTHER = ["Batch", "Bin no.`x`", "Remark"]
PACKAGES = [(7.0, 4, "fast", "C9")]


def report(spark, tmp_path, kind, name, columns, data):
    if kind == "xlsx":
        path = tmp_path / f"{name}.xlsx"
        path.write_bytes(workbook_bytes(columns, data))
        return load_report(spark, str(path))
    path = f"{tmp_path}/{name}"
    spark.createDataFrame(data, columns).write.parquet(path)
    return spark.read.parquet(path)


@pytest.mark.parametrize("kind", ["parquet", "xlsx"])
def test_a_further_column_reaches_the_events(spark, tmp_path, kind):
    store = SnapshotStore(spark, str(tmp_path / "store"))
    for number, scans in enumerate((FIRST, SECOND)):
        refresh(
            store,
            report(spark, tmp_path, kind, f"scans{number}", COLUMNS + FURTHER, scans),
            report(spark, tmp_path, kind, f"packages{number}", ["Delivery", "Number of packages", "Remark", "Ship-to"], PACKAGES),
            str(number),
            at("12:00"),
        )
    new = {r.serial_number: r.extra for r in store.latest("new_serials").collect()}
    assert new == {
        "S3": {"batch": "B3", "bin_no.`x`": None, "remark_serial": "z", "remark_delivery": "fast", "ship-to": "C9"}
    }
    shipped = {r.serial_number: r.extra for r in store.latest("status_changes").collect()}
    five = shipped["S1"].pop("bin_no.`x`")
    assert float(five) == 5
    assert shipped == {"S1": {"batch": "B1", "remark_serial": "x", "remark_delivery": "fast", "ship-to": "C9"}}
    feed = store.latest("change_feed").filter("section = 'new_serials' and op = 'added'")
    assert '"batch":"B3"' in feed.first().record
    assert store.latest("serials").columns.count("extra") == 0


def test_reports_without_further_columns_have_an_empty_map(spark):
    df = spark.createDataFrame([scan("S1", "ASH")], COLUMNS)
    assert read_scans(df).first().extra == {}
    again = read_scans(read_scans(spark.createDataFrame([scan("S1", "ASH", "B1")], COLUMNS + ["Batch"])))
    assert again.first().extra == {"batch": "B1"}, "a table that was read before keeps its map"


def test_a_report_column_called_extra(spark):
    df = spark.createDataFrame([scan("S1", "ASH", "yes")], COLUMNS + ["Extra"])
    assert read_scans(df).first().extra == {"extra": "yes"}


def test_clashing_names_keep_both_values(spark):
    scans = read_scans(spark.createDataFrame([scan("S1", "ASH", "a", "b")], COLUMNS + ["Note", "Note_serial"]))
    packages = read_deliveries(
        spark.createDataFrame([(7.0, 4, "c")], ["Delivery", "Number of packages", "Note"])
    )
    assert combine(scans, packages).first().extra == {"note": "a", "note_serial": "b", "note_delivery": "c"}


def test_ties_are_decided_by_the_map_too(spark):
    packages = read_deliveries(
        spark.createDataFrame([(7.0, 4, "c"), (7.0, 4, "a"), (7.0, 4, None)], ["Delivery", "Number of packages", "Note"])
    )
    assert one_row_per_delivery(packages).first().extra == {"note": None}
    scans = read_scans(spark.createDataFrame([scan("S1", "ASH", x) for x in ("q", "p")], COLUMNS + ["Batch"]))
    one = dedup_serials(combine(scans, packages.filter("extra['note'] = 'a'")))
    assert [r.extra for r in one.collect()] == [{"batch": "p", "note": "a"}]


def test_maps_in_differences(spark):
    def table(*data):
        return spark.createDataFrame(list(data), "k string, extra map<string,string>")

    before, now = table(("x", {"a": "1", "b": "2"}), ("y", {"a": "1"})), table(("x", {"b": "2", "a": "1"}), ("y", {"a": None}))
    assert added_rows(now, before, ["k", "extra"]).collect()[0].extra == {"a": None}
    changed = changed_rows(now, before, ["k"]).collect()
    assert [(r.k, r.extra, r.changed_column) for r in changed] == [("y", {"a": None}, "extra")]
    for unique in (True, False):
        feed = diff_section("s", now, before, unique=unique)
        assert rows(feed, "op", "record") == [
            ("added", '{"k":"y","extra":{"a":null}}'),
            ("removed", '{"k":"y","extra":{"a":"1"}}'),
        ]
        keyed = diff_section("s", now, before, ["k"], unique=unique)
        assert rows(keyed, "op", "changed_column") == [("changed", "extra")]


def test_metrics_neither_read_nor_move_further_columns(spark, tmp_path):
    canonical.raw_scans(spark, SF).write.parquet(f"{tmp_path}/scans")
    canonical.raw_deliveries(spark, SF).write.parquet(f"{tmp_path}/deliveries")
    both = combine(
        read_scans(spark.read.parquet(f"{tmp_path}/scans"), canonical.PARAMS),
        read_deliveries(spark.read.parquet(f"{tmp_path}/deliveries")),
    )
    text = plan(both.groupBy("delivery").agg(F.count("serial_number")))
    assert "Batch#" not in text and "Ship-to" not in text and "map(" not in text
    assert "Batch#" in plan(both.select("extra"))


@pytest.mark.parametrize("day_first", [False, True])
def test_day_first_reaches_every_cast(spark, day_first):
    df = spark.createDataFrame(
        [("S1", "U1", "02/01/2024", "10:00:00", "7", "ASH", "E01", "1"), ("S2", "U1", "13/02/2024", "10:00:00", "7", "ASH", "E01", "1")],
        COLUMNS,
    )
    found = read_scans(df, Params(day_first=day_first))
    expected = {
        False: [("S1", datetime(2024, 2, 1), datetime(2024, 2, 1, 10)), ("S2", None, None)],
        True: [("S1", datetime(2024, 1, 2), datetime(2024, 1, 2, 10)), ("S2", datetime(2024, 2, 13), datetime(2024, 2, 13, 10))],
    }
    assert rows(found, "serial_number", "created_on", "scan_timestamp") == expected[day_first]


def test_maps_are_moved_once_by_the_deduplication(spark):
    df = spark.createDataFrame(
        [("S1", "ASH", {"b": "2", "a": None}), ("S1", "ASH", {"a": "1", "b": "2"}), (None, "SHP", None)],
        "serial_number string, status string, extra map<string,string>",
    )
    found = dedup_serials(df)
    assert "array_sort" not in plan(found) and plan(found).count("map_entries") == 1
    assert rows(found, "serial_number", "extra") == [("S1", {"a": None, "b": "2"}), (None, None)]
    packages = df.selectExpr("serial_number AS delivery", "1 AS number_of_packages", "extra")
    assert plan(one_row_per_delivery(packages)).count("map_entries") == 1
