from datetime import datetime

import pytest
from helpers import rows

from dockpulse.operators.cleaning import (
    clean_dates,
    clean_numeric,
    drop_blank_rows,
    filter_pallet,
    filter_warehouse,
    normalize_delivery,
    sanitize_scans,
    with_scan_timestamp,
)
from dockpulse.operators.combine import combine
from dockpulse.operators.headers import (
    copy_aliases,
    rename_existing,
    sanitize_headers,
    standard_name,
    standardize_columns,
)
from dockpulse.params import Params
from dockpulse.schemas import SCANS, conform
from dockpulse.sources.reports import read_combined, read_deliveries, read_scans


def test_header_rule(spark):
    df = spark.createDataFrame([(1, 2, 3)], ["Serial #", "Shipping Point/Receiving Pt", "Created by"])
    assert sanitize_headers(df).columns == [
        "serial_number",
        "shipping_point_receiving_pt",
        "created_by",
    ]


@pytest.mark.parametrize(
    ("header", "name"),
    [
        ("User ID", "created_by"),
        ("Packages", "number_of_packages"),
        ("SerialNo", "serial_number"),
        ("Shipping Point/Receiving Pt", "shipping_point"),
        ("Weight (kg)", "weight_kg"),
    ],
)
def test_standard_names(header, name):
    assert standard_name(header) == name


def test_two_headers_with_one_standard_name(spark):
    df = spark.createDataFrame([(1, 2)], ["SerialNo", "Serial"])
    with pytest.raises(ValueError, match="serial_number"):
        standardize_columns(df)


def test_rename_ignores_missing_columns(spark):
    df = spark.createDataFrame([(1,)], ["Status"])
    assert rename_existing(df, {"Status": "status", "Serial #": "serial_number"}).columns == ["status"]


def test_copy_aliases_keeps_standard_column(spark):
    df = spark.createDataFrame([("a", "b", 1)], ["Serial #", "created_by", "Delivery"])
    copied = copy_aliases(df)
    assert copied.columns == ["Serial #", "created_by", "delivery", "serial_number"]
    assert rows(copied) == [("a", "b", 1, "a")]
    assert copy_aliases(copied).columns == copied.columns


def test_bad_numbers_and_dates_become_null(spark):
    df = spark.createDataFrame(
        [("12", "2024-03-01"), ("x", "garbage"), (None, None), ("NaN", "10:30")], ["qty", "created_on"]
    )
    assert [r.qty for r in clean_numeric(df, ["qty", "missing"]).collect()] == [12.0, None, None, None]
    days = [r.created_on for r in clean_dates(df, ["created_on"]).collect()]
    assert days == [datetime(2024, 3, 1), None, None, None]


def test_scan_preset_reads_serials_as_numbers(spark):
    df = spark.createDataFrame([("A1", "1"), ("7", "1")], ["Serial #", "Pallet"])
    assert rows(sanitize_scans(df)) == [(7.0, 1.0), (None, 1.0)]


@pytest.mark.parametrize(
    ("value", "key", "zeroed"),
    [("12.9", "12", "12"), ("12", "12", "12"), (None, None, "0"), ("ab", None, None),
     ("9007199254740993", "9007199254740993", "9007199254740993")],
)
def test_delivery_key(spark, value, key, zeroed):
    df = spark.createDataFrame([(value,)], "delivery string")
    assert normalize_delivery(df, drop_missing=False).first()[0] == key
    assert normalize_delivery(df, null_key_as_zero=True, drop_missing=False).first()[0] == zeroed


def test_delivery_key_of_numbers(spark):
    df = spark.createDataFrame([(12.9,), (float("nan"),), (None,)], "delivery double")
    assert rows(normalize_delivery(df)) == [("12",)]
    whole = spark.createDataFrame([(80001234,)], "delivery long")
    assert rows(normalize_delivery(whole)) == [("80001234",)]


def test_blank_rows_go_wherever_they_are(spark):
    df = spark.createDataFrame([(None, None), (1, None), (None, None)], "a int, b string")
    assert rows(drop_blank_rows(df)) == [(1, None)]


def test_filters_need_their_column(spark):
    df = spark.createDataFrame([("R", 1), ("N", 1), ("R", 0), (None, None)], "warehouse_number string, pallet int")
    assert filter_warehouse(df, "R").count() == 2
    assert filter_pallet(df).count() == 2
    assert filter_pallet(filter_warehouse(df.select(df.pallet.alias("p")), "R")).count() == 4
    text = spark.createDataFrame([("1",), ("1.0",), ("x",)], "pallet string")
    assert filter_pallet(text).count() == 2


def test_scan_timestamp(spark):
    day = datetime(2024, 3, 1)
    df = spark.createDataFrame(
        [(day, "10:20:30"), (day, None), (day, "xx"), (None, "10:20:30")],
        "created_on timestamp, time string",
    )
    assert [r.scan_timestamp for r in with_scan_timestamp(df).collect()] == [
        datetime(2024, 3, 1, 10, 20, 30),
        None,
        None,
        None,
    ]
    assert with_scan_timestamp(df.drop("time")).first().scan_timestamp == day
    text = spark.createDataFrame([("2024-03-01", "10:20")], "created_on string, time_str string")
    assert with_scan_timestamp(text).first().scan_timestamp == datetime(2024, 3, 1, 10, 20)
    bare = spark.createDataFrame([(1,)], "x int")
    assert with_scan_timestamp(bare).first().scan_timestamp is None


def raw(spark):
    scans = spark.createDataFrame(
        [
            ("S1", "U1", "2024-03-01", "10:00:00", "7.0", "ASH", "E01", "1"),
            ("S2", "U1", "2024-03-01", "11:00:00", "8", "SHP", "E01", "1"),
            ("S3", "U2", "2024-03-01", "12:00:00", "7", "ASH", "E02", "1"),
            ("S4", "U2", "2024-03-01", "12:00:00", "7", "ASH", "E01", "0"),
            ("S5", "U2", "2024-03-01", "12:00:00", None, "ASH", "E01", "1"),
            (None, None, None, None, None, None, None, None),
        ],
        ["Serial #", "Created by", "Created on", "Time", "Delivery", "Status", "Warehouse Number", "Pallet"],
    )
    deliveries = spark.createDataFrame(
        [("7", "4", "SP1"), ("7", "5", "SP1"), ("9", "1", "SP2"), (None, "2", None)],
        ["Delivery", "Number of packages", "Shipping Point/Receiving Pt"],
    )
    return scans, deliveries


def test_read_scans(spark):
    scans = read_scans(raw(spark)[0])
    assert scans.schema == conform(scans, SCANS).schema
    assert rows(scans, "serial_number", "delivery", "pallet", "scan_timestamp") == [
        ("S1", "7", 1, datetime(2024, 3, 1, 10)),
        ("S2", "8", 1, datetime(2024, 3, 1, 11)),
    ]


def test_missing_delivery_as_zero(spark):
    params = Params(null_key_as_zero=True)
    scans, deliveries = (f(x, params) for f, x in zip((read_scans, read_deliveries), raw(spark)))
    assert "S5" in {r.serial_number for r in combine(scans, deliveries).collect()}


def test_required_columns(spark):
    with pytest.raises(ValueError, match="status"):
        read_scans(raw(spark)[0].drop("Status"))


def test_combine_is_many_to_many(spark):
    scans, deliveries = raw(spark)
    both = combine(read_scans(scans), read_deliveries(deliveries))
    assert rows(both, "serial_number", "number_of_packages") == [("S1", 4.0), ("S1", 5.0)]


def test_combine_names_both_sides_of_a_clash(spark):
    left = spark.createDataFrame([("D", "a", 1)], ["delivery", "created_by", "x"])
    right = spark.createDataFrame([("D", "b", 2)], ["delivery", "created_by", "y"])
    assert combine(left, right).columns == [
        "delivery",
        "created_by_serial",
        "x",
        "created_by_delivery",
        "y",
    ]


def test_empty_reports(spark):
    scans, deliveries = (df.limit(0) for df in raw(spark))
    assert combine(read_scans(scans), read_deliveries(deliveries)).count() == 0


def test_read_from_files(spark, tmp_path):
    scans, deliveries = raw(spark)
    scans.toPandas().to_csv(tmp_path / "scans.csv", index=False)
    deliveries.write.parquet(str(tmp_path / "deliveries"))
    both = read_combined(spark, str(tmp_path / "scans.csv"), str(tmp_path / "deliveries"))
    assert rows(both, "serial_number", "number_of_packages") == [("S1", 4.0), ("S1", 5.0)]


@pytest.mark.parametrize(
    "text, key",
    [("12D", None), ("12f", None), ("12L", None), ("", None), ("  ", None), ("NaN", None), ("0x1F", None),
     ("12.9", "12"), (" 12 ", "12"), ("12e0", "12"), ("-.5", "0"), ("9007199254740993", "9007199254740993")],
)
def test_delivery_keys_of_text(spark, text, key):
    df = spark.createDataFrame([(text,)], "delivery string")
    assert normalize_delivery(df, drop_missing=False).first().delivery == key


def test_nan_delivery_as_zero(spark):
    df = spark.createDataFrame([(float("nan"),), (None,), (3.0,)], "delivery double")
    kept = normalize_delivery(df, null_key_as_zero=True)
    assert sorted(r.delivery for r in kept.collect()) == ["0", "0", "3"]


@pytest.mark.parametrize(
    "text, expected",
    [("2024-01-31", "2024-01-31 00:00:00"), ("01/31/2024", "2024-01-31 00:00:00"),
     ("20240131", "2024-01-31 00:00:00"), ("Jan 31 2024", "2024-01-31 00:00:00"),
     ("31-Jan-2024", "2024-01-31 00:00:00"), ("1/31/2024 2:05 PM", "2024-01-31 14:05:00"),
     ("31.01.2024", None), ("12:30:00", None), ("garbage", None)],
)
def test_date_texts(spark, text, expected):
    found = clean_dates(spark.createDataFrame([(text,)], "d string"), ["d"]).first().d
    assert (found and str(found)) == expected


def test_times_of_twelve_hour_clocks(spark):
    df = spark.createDataFrame([("2024-03-01", "2:05:00 PM"), ("2024-03-01", "12:00 am")], "created_on string, time string")
    times = [str(r.scan_timestamp) for r in with_scan_timestamp(df).collect()]
    assert times == ["2024-03-01 14:05:00", "2024-03-01 00:00:00"]
