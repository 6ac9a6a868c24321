"""Reports derived from the generated star-schema tables.

Orders stand for deliveries, line items for scans, suppliers for users and events for user
activity. Two cumulative snapshots are taken, at the end of June and of December 1998.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from dockpulse.operators.combine import combine
from dockpulse.operators.headers import report_header
from dockpulse.operators.serials import CORE_COLUMNS
from dockpulse.params import Params
from dockpulse.plans.dashboard import build_section, current_serials
from dockpulse.session import pin_utc
from dockpulse.sources.reports import read_deliveries, read_scans

# Line items with this return flag make up the warehouse. Most line items of the generated data
# are older than an hour, so the window is 30 days.
PARAMS = Params(warehouse="R", window_minutes=43200)


@dataclass(frozen=True)
class Snapshot:
    id: str
    day: str

    @property
    def as_of(self) -> str:
        return f"{self.day} 23:59:59"


PREVIOUS = Snapshot("19980630", "1998-06-30")
CURRENT = Snapshot("19981231", "1998-12-31")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return pin_utc(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def _text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def second_of_day() -> Column:
    return (F.col("l_partkey") * 43 + F.col("l_linenumber") * 7) % 86400


def clock_text(seconds: Column) -> Column:
    return F.date_format(F.timestamp_seconds(seconds), "HH:mm:ss")


def report_rows(spark: SparkSession, sf_dir: str, snapshot: Snapshot) -> DataFrame:
    """Line items of the orders placed up to the day of the snapshot."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    placed = orders.filter(F.col("o_orderdate") <= F.lit(snapshot.day).cast("timestamp_ntz"))
    items = table(spark, sf_dir, "lineitem")
    return items.join(placed, F.col("l_orderkey") == F.col("o_orderkey"))


def raw_scan_columns(snapshot: Snapshot) -> list[Column]:
    shipped = F.col("l_shipdate") <= F.lit(snapshot.day).cast("timestamp_ntz")
    name = _text("Worker ", F.col("l_suppkey"), ".", F.col("l_partkey") % 3)
    return [
        _text(F.col("l_orderkey"), "-", F.col("l_linenumber")).alias("Serial #"),
        _text("U", F.col("l_suppkey")).alias("Created by"),
        F.col("o_orderdate").cast("timestamp").alias("Created on"),
        clock_text(second_of_day()).alias("Time"),
        F.col("l_orderkey").cast("double").alias("Delivery"),
        F.when(shipped, "SHP").otherwise("ASH").alias("Status"),
        F.col("l_returnflag").alias("Warehouse Number"),
        (F.col("l_linenumber") % 2).alias("Pallet"),
        F.col("l_quantity").alias("Qty"),
        F.when(F.col("l_suppkey") % 3 != 0, name).alias("Name"),
        # columns that no section knows of
        F.when(F.col("l_partkey") % 5 != 0, _text("B", F.col("l_partkey") % 97)).alias("Batch"),
        _text("N", F.col("l_linenumber")).alias("Note"),
    ]


def raw_scans(spark: SparkSession, sf_dir: str, snapshot: Snapshot = CURRENT) -> DataFrame:
    return report_rows(spark, sf_dir, snapshot).select(*raw_scan_columns(snapshot))


def raw_deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = F.col("o_custkey")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("double").alias("Delivery"),
        F.when(customer % 50 == 0, 0.0)
        .otherwise((customer % 10 + 1).cast("double"))
        .alias("Number of packages"),
        _text("SP", customer % 7).alias("Shipping Point/Receiving Pt"),
        _text("C", customer).alias("Ship-to party"),
        F.col("o_orderpriority").alias("Note"),
    )


def plain_scans(spark: SparkSession, sf_dir: str, snapshot: Snapshot = CURRENT) -> DataFrame:
    """Scan report with clean headers but neither filtered nor typed."""
    raw = raw_scans(spark, sf_dir, snapshot)
    return raw.toDF(*[report_header(c) for c in raw.columns])


def untidy_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scan report as text with header variants and unreadable cells."""
    order, line = F.col("l_orderkey"), F.col("l_linenumber")
    kind = F.col("l_suppkey") % 10
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    quantity = F.col("l_quantity").cast("int").cast("string")
    number = (order * 10 + line).cast("string")
    return report_rows(spark, sf_dir, CURRENT).select(
        F.when(line == 7, _text("S", number)).otherwise(number).alias("SerialNo"),
        _text("U", F.col("l_suppkey")).alias("User ID"),
        F.when(line == 6, "garbage")
        .when(line == 4, F.date_format("o_orderdate", "MM/dd/yyyy"))
        .when(line == 3, F.date_format("o_orderdate", "yyyyMMdd"))
        .when(line != 5, day)
        .alias("Created Date"),
        F.when(kind == 1, "ab")
        .when(kind == 2, _text(order, ".9"))
        .when(kind == 3, _text(order, "D"))
        .when(kind == 4, _text(order, "f"))
        .when(kind == 5, F.when(line % 2 == 0, "  ").otherwise("NaN"))
        .when(kind == 6, _text(" ", order, "e0 "))
        .when(kind != 0, order.cast("string"))
        .alias("Delivery Number"),
        F.when(F.col("l_quantity") >= 45, "n/a")
        .when(F.col("l_quantity") >= 40, _text(quantity, "d"))
        .otherwise(quantity)
        .alias("Qty"),
        (line % 2).cast("string").alias("Pallet"),
        F.col("l_returnflag").alias("Warehouse ID"),
    )


def untidy_deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = F.col("o_custkey")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("DeliveryNo"),
        F.when(customer % 20 == 0, "many")
        .otherwise((customer % 10 + 1).cast("string"))
        .alias("Packages"),
        _text("SP", customer % 7).alias("Shipping Point/Receiving Pt"),
    )


def timed_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Day and time of day apart, some times missing or unreadable."""
    quantity = F.col("l_quantity")
    return report_rows(spark, sf_dir, CURRENT).select(
        _text(F.col("l_orderkey"), "-", F.col("l_linenumber")).alias("serial_number"),
        F.col("o_orderdate").cast("timestamp").alias("created_on"),
        F.when(quantity < 5, "xx")
        .when(quantity >= 10, clock_text(second_of_day()))
        .alias("time"),
    )


def scattered_blanks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items in which some rows have every cell empty."""
    filled = F.col("l_linenumber") != 3
    return table(spark, sf_dir, "lineitem").select(
        F.when(filled, F.col("l_orderkey")).alias("delivery"),
        F.when(filled & (F.col("l_quantity") < 40), F.col("l_quantity")).alias("qty"),
        F.when(filled, F.col("l_returnflag")).alias("warehouse_number"),
    )


def file_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder listing with one file per order."""
    key = F.col("o_orderkey")
    path = (
        F.when(key % 4 == 0, _text("/inbox/ZMDESNR_", key, ".xlsx"))
        .when(key % 4 == 1, _text("/inbox/vl06o_", key, ".XLSX"))
        .when(key % 4 == 2, _text("/inbox/notes_", key, ".xlsx"))
        .otherwise(_text("/inbox/ZMDESNR_", key, ".csv"))
    )
    return table(spark, sf_dir, "orders").select(
        path.alias("path"), F.col("o_orderdate").cast("timestamp").alias("modified_at")
    )


def refresh_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A refresh log with one entry per order, for three of the sections."""
    key = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        F.when(key % 3 == 0, "users")
        .when(key % 3 == 1, "progress")
        .otherwise("serials")
        .alias("section"),
        F.concat(F.date_format("o_orderdate", "yyyyMMdd"), F.lpad(key.cast("string"), 12, "0")).alias(
            "snapshot_id"
        ),
        F.col("o_orderdate").cast("timestamp").alias("updated_at"),
        F.col("o_custkey").alias("row_count"),
    )


def activity_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return activity_columns(table(spark, sf_dir, "events"))


def activity_columns(events: DataFrame) -> DataFrame:
    return events.select(
        _text("U", F.col("user_id")).alias("user_id"),
        F.col("event_type").alias("activity_type"),
        F.col("ts").cast("timestamp").alias("timestamp"),
    )


def scans(spark: SparkSession, sf_dir: str, snapshot: Snapshot = CURRENT) -> DataFrame:
    return read_scans(raw_scans(spark, sf_dir, snapshot), PARAMS)


def deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_deliveries(raw_deliveries(spark, sf_dir), PARAMS)


def combined(spark: SparkSession, sf_dir: str, snapshot: Snapshot = CURRENT) -> DataFrame:
    return combine(scans(spark, sf_dir, snapshot), deliveries(spark, sf_dir))


def current(spark: SparkSession, sf_dir: str, snapshot: Snapshot = CURRENT) -> DataFrame:
    """One row per serial with the status description."""
    return current_serials(combined(spark, sf_dir, snapshot), PARAMS)


def core(spark: SparkSession, sf_dir: str, snapshot: Snapshot = CURRENT) -> DataFrame:
    """The same rows with the columns the metrics need."""
    return current_serials(combined(spark, sf_dir, snapshot), PARAMS, CORE_COLUMNS)


# Sections whose rows are whole serial records; the others need the core columns only.
_WHOLE_ROWS = {"serials", "status_changes", "new_serials"}
_COMPARED = {"status_changes", "new_serials", "completed_deliveries"}


def section(
    spark: SparkSession,
    sf_dir: str,
    name: str,
    snapshot: Snapshot = CURRENT,
    previous: Snapshot | None = None,
) -> DataFrame:
    """One section on its own, straight from the reports."""
    now = current if name in _WHOLE_ROWS else core
    compare = previous is not None and name in _COMPARED
    before = core(spark, sf_dir, previous) if compare else None
    return build_section(
        name, now(spark, sf_dir, snapshot), before, snapshot.as_of, PARAMS, unique_previous=True
    )
