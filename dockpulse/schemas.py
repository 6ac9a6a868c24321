"""Column contracts of the inputs and of the saved sections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F, types as T

from dockpulse.functions.open_columns import EXTRA, OPEN

_string = T.StringType()
_long = T.LongType()
_double = T.DoubleType()
_time = T.TimestampType()


def _struct(*columns: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns])


SCANS = _struct(
    ("serial_number", _string),
    ("created_by", _string),
    ("created_on", _time),
    ("time", _string),
    ("scan_timestamp", _time),
    ("delivery", _string),
    ("status", _string),
    ("warehouse_number", _string),
    ("pallet", _long),
    ("qty", _double),
    ("name", _string),
    (EXTRA, OPEN),
)
SCANS_REQUIRED = ("serial_number", "delivery", "status", "created_by")

DELIVERIES = _struct(
    ("delivery", _string),
    ("number_of_packages", _double),
    ("shipping_point", _string),
    (EXTRA, OPEN),
)
DELIVERIES_REQUIRED = ("delivery", "number_of_packages")

COMBINED = T.StructType(
    [f for f in SCANS.fields if f.name != EXTRA] + [f for f in DELIVERIES.fields if f.name != "delivery"]
)

ACTIVITY = _struct(("user_id", _string), ("activity_type", _string), ("timestamp", _time))

REFRESH_LOG = _struct(
    ("section", _string), ("snapshot_id", _string), ("updated_at", _time), ("row_count", _long)
)

# A report that has landed and can be read.
ARRIVAL = _struct(("report_type", _string), ("path", _string), ("modified_at", _time))

_DESCRIBED = COMBINED.fields + [T.StructField("status_description", _string)]

SECTIONS: dict[str, T.StructType] = {
    "users": _struct(
        ("user_id", _string),
        ("scan_count", _long),
        ("first_scan", _time),
        ("last_scan", _time),
        ("unique_deliveries", _long),
        ("scans_per_hour", _double),
        ("minutes_since_last_scan", _double),
        ("name", _string),
    ),
    "deliveries": _struct(("delivery", _string), ("number_of_packages", _double)),
    "progress": _struct(
        ("delivery", _string),
        ("created_by", _string),
        ("scanned_count", _long),
        ("number_of_packages", _double),
        ("progress_percentage", _double),
    ),
    "scan_times": _struct(
        ("user_id", _string),
        ("current_scan_time", _time),
        ("previous_scan_time", _time),
        ("time_between_scans_minutes", _double),
        ("serial", _string),
        ("status", _string),
        ("minutes_since_last_scan", _double),
    ),
    "serials": _struct(
        ("serial_number", _string),
        ("delivery", _string),
        ("status", _string),
        ("created_by", _string),
        ("scan_timestamp", _time),
        ("time", _string),
        ("created_on", _time),
        ("status_description", _string),
    ),
    "status_changes": T.StructType(
        _DESCRIBED + [T.StructField("previous_status", _string), T.StructField("event", _string)]
    ),
    "new_serials": T.StructType(_DESCRIBED + [T.StructField("event", _string)]),
    "completed_deliveries": _struct(
        ("delivery", _string),
        ("total_serials", _long),
        ("shipped_serials", _long),
        ("event", _string),
    ),
}

# Key of each section in the change feed; a section not listed is keyed by all its columns.
SECTION_KEYS: dict[str, tuple[str, ...]] = {
    "users": ("user_id",),
    "deliveries": ("delivery",),
    "progress": ("delivery", "created_by"),
    "scan_times": ("user_id",),
}


def require(df: DataFrame, columns: Sequence[str], what: str) -> None:
    missing = [name for name in columns if name not in df.columns]
    if missing:
        raise ValueError(f"{what} lacks required columns {missing}; it has {df.columns}")


def present(df: DataFrame, *columns: str) -> DataFrame:
    """Rows with a value in every given column. Unlike ``dropna`` these are plain predicates the
    optimizer can push into a scan."""
    for name in columns:
        df = df.filter(F.col(name).isNotNull())
    return df


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Project to exactly ``schema``; a column the frame lacks becomes a typed null."""
    have = set(df.columns)
    return df.select(
        *[
            (F.col(f.name) if f.name in have else F.lit(None)).try_cast(f.dataType).alias(f.name)
            for f in schema.fields
        ]
    )
