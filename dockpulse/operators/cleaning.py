"""Value cleaning and the row filters applied while reading. All of it is narrow: no shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F, types as T

from dockpulse.functions.casting import delivery_key, to_number, to_time
from dockpulse.functions.timing import join_date_and_time, time_of_day
from dockpulse.operators.headers import standardize_columns
from dockpulse.schemas import present

# Columns cleaned by the two presets.
SCAN_NUMBERS = ("serial_number", "pallet", "delivery", "qty")
SCAN_DATES = ("created_on",)
DELIVERY_NUMBERS = ("delivery", "number_of_packages")


def _map_columns(df: DataFrame, columns: Sequence[str], convert) -> DataFrame:
    kinds = {f.name: f.dataType for f in df.schema.fields}
    return df.withColumns({c: convert(F.col(c), kinds[c]) for c in columns if c in kinds})


def clean_numeric(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return _map_columns(df, columns, to_number)


def clean_dates(df: DataFrame, columns: Sequence[str], day_first: bool = False) -> DataFrame:
    return _map_columns(df, columns, lambda value, kind: to_time(value, kind, day_first))


def sanitize_table(
    df: DataFrame,
    numeric: Sequence[str] = (),
    dates: Sequence[str] = (),
    day_first: bool = False,
) -> DataFrame:
    return clean_dates(clean_numeric(standardize_columns(df), numeric), dates, day_first)


def sanitize_scans(df: DataFrame, day_first: bool = False) -> DataFrame:
    """Preset for scan reports. It reads serial numbers as numbers, so serials with letters
    become null; use it only where serials are numeric."""
    return sanitize_table(df, SCAN_NUMBERS, SCAN_DATES, day_first)


def sanitize_deliveries(df: DataFrame) -> DataFrame:
    return sanitize_table(df, DELIVERY_NUMBERS)


def drop_blank_rows(df: DataFrame) -> DataFrame:
    """Drop rows in which every cell is missing (rows have no position in a DataFrame, so this
    drops such a row wherever it stands)."""
    return df.dropna(how="all")


def normalize_delivery(
    df: DataFrame, null_key_as_zero: bool = False, drop_missing: bool = True
) -> DataFrame:
    """Delivery numbers as text keys; rows without a readable number are dropped."""
    kind = df.schema["delivery"].dataType
    keyed = df.withColumn("delivery", delivery_key(F.col("delivery"), kind, null_key_as_zero))
    return present(keyed, "delivery") if drop_missing else keyed


def with_scan_timestamp(df: DataFrame, day_first: bool = False) -> DataFrame:
    """Scan time from day and time of day.

    With a time column, an unreadable time gives null. Without one, the day itself is the scan
    time. Which case applies is known from the columns, so no row decides it.
    """
    kinds = {f.name: f.dataType for f in df.schema.fields}
    if "created_on" not in kinds:
        return df if "scan_timestamp" in kinds else df.withColumn(
            "scan_timestamp", F.lit(None).cast("timestamp")
        )
    day = to_time(F.col("created_on"), kinds["created_on"], day_first)
    for name in ("time_str", "time"):
        if name in kinds:
            text = time_of_day(F.col(name), kinds[name])
            return df.withColumn("scan_timestamp", join_date_and_time(day, text))
    return df.withColumn("scan_timestamp", day)


def filter_warehouse(df: DataFrame, warehouse: str) -> DataFrame:
    if "warehouse_number" not in df.columns:
        return df
    return df.filter(F.col("warehouse_number") == F.lit(warehouse))


def filter_pallet(df: DataFrame, pallet: int = 1) -> DataFrame:
    if "pallet" not in df.columns:
        return df
    if isinstance(df.schema["pallet"].dataType, T.NumericType):
        return df.filter(F.col("pallet") == F.lit(pallet))
    return df.filter(F.col("pallet").try_cast("double") == F.lit(float(pallet)))
