"""The two reports as clean tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from dockpulse.functions.casting import to_number, to_time
from dockpulse.functions.open_columns import with_extra
from dockpulse.functions.timing import time_of_day
from dockpulse.operators.cleaning import (
    drop_blank_rows,
    filter_pallet,
    filter_warehouse,
    normalize_delivery,
    with_scan_timestamp,
)
from dockpulse.operators.combine import combine
from dockpulse.operators.headers import (
    DELIVERY_HEADERS,
    SCAN_HEADERS,
    rename_existing,
    sanitize_headers,
)
from dockpulse.params import Params
from dockpulse.schemas import (
    DELIVERIES,
    DELIVERIES_REQUIRED,
    SCANS,
    SCANS_REQUIRED,
    conform,
    require,
)
from dockpulse.sources.workbook import unreadable_workbooks, workbook_table


def load_report(spark: SparkSession, path: str) -> DataFrame:
    """Raw report: workbooks (a path or glob ending in ``.xlsx``), CSV with a header, or Parquet."""
    lowered = path.lower()
    if lowered.endswith(".xlsx"):
        return workbook_table(spark.read.format("binaryFile").load(path))
    if lowered.endswith(".csv"):
        return spark.read.option("header", True).csv(path)
    return spark.read.parquet(path)


def unreadable_report(spark: SparkSession, path: str) -> list[tuple[str, str]]:
    """(path, error) of the workbooks of a report that cannot be opened; other formats are not
    looked into."""
    if not path.lower().endswith(".xlsx"):
        return []
    return unreadable_workbooks(spark.read.format("binaryFile").load(path))


def _typed(df: DataFrame, schema: T.StructType, day_first: bool) -> DataFrame:
    """Bring text cells to the column types; cells that cannot be read become null."""
    kinds = {f.name: f.dataType for f in df.schema.fields}

    def cell(field: T.StructField) -> Column:
        value, kind = F.col(field.name), kinds[field.name]
        if isinstance(field.dataType, T.TimestampType):
            return to_time(value, kind, day_first)
        if isinstance(field.dataType, T.NumericType):
            return to_number(value, kind)
        if field.name == "time":
            return time_of_day(value, kind)
        return value

    return df.withColumns({f.name: cell(f) for f in schema.fields if f.name in kinds})


def _finish(df: DataFrame, schema: T.StructType, params: Params) -> DataFrame:
    # Rows without a delivery go anyway, blank ones among them. Only when a missing delivery
    # counts as '0' must blank rows be looked for, which reads every column.
    if params.null_key_as_zero:
        df = drop_blank_rows(df)
    # Further columns become one map that nothing has to read: whoever does not ask for it never
    # moves it, and the files are read without the columns it is made of.
    typed = with_extra(_typed(df, schema, params.day_first), schema.fieldNames())
    return conform(normalize_delivery(typed, params.null_key_as_zero), schema)


def read_scans(raw: DataFrame, params: Params = Params()) -> DataFrame:
    """Scan report: names, warehouse and pallet filter, scan time, fixed columns and, in ``extra``,
    all further ones.

    The filters come first and compare plain columns, so they reach the file scan.
    """
    df = sanitize_headers(rename_existing(raw, SCAN_HEADERS))
    require(df, SCANS_REQUIRED, "scan report")
    df = filter_pallet(filter_warehouse(df, params.warehouse), params.pallet)
    return _finish(with_scan_timestamp(df, params.day_first), SCANS, params)


def read_deliveries(raw: DataFrame, params: Params = Params()) -> DataFrame:
    """Delivery report: names, numbers, fixed columns and, in ``extra``, all further ones."""
    df = sanitize_headers(rename_existing(raw, DELIVERY_HEADERS))
    require(df, DELIVERIES_REQUIRED, "delivery report")
    return _finish(df, DELIVERIES, params)


def read_combined(
    spark: SparkSession, scans_path: str, deliveries_path: str, params: Params = Params()
) -> DataFrame:
    """Both reports, cleaned and joined."""
    return combine(
        read_scans(load_report(spark, scans_path), params),
        read_deliveries(load_report(spark, deliveries_path), params),
    )
