"""One row per serial, and the views taken from it."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from dockpulse.functions.labels import describe_status
from dockpulse.functions.open_columns import entries_as_maps, map_columns, maps_as_entries
from dockpulse.operators.ranking import top_rows
from dockpulse.params import SHIPPED, STATUS_DESCRIPTIONS
from dockpulse.schemas import SCANS_REQUIRED, SECTIONS, present, require

# The metrics need no other columns. They also come first in the order of preference, so the
# deduplication of these columns alone picks the same values as that of the whole table.
CORE_COLUMNS = (
    "serial_number",
    "scan_timestamp",
    "created_by",
    "delivery",
    "number_of_packages",
    "status",
    "name",
)


def dedup_serials(combined: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Keep one row per serial number, across deliveries; a shipped row wins over any other.

    Among equals the latest scan wins, then the lowest user, delivery, package count and so on
    over all columns, so the choice does not depend on how the input is partitioned. Serials of
    one delivery thus agree on the package count even if the delivery report has several.
    ``columns`` narrows what is shuffled, for callers that need only ``CORE_COLUMNS``.
    """
    require(combined, ("serial_number", "status"), "combined table")
    if columns is not None:
        combined = combined.select(*[c for c in columns if c in combined.columns])
    have = combined.columns
    order = [F.coalesce(F.col("status") == SHIPPED, F.lit(False)).desc()]
    for name in [*CORE_COLUMNS[1:], *[c for c in have if c not in CORE_COLUMNS]]:
        if name in have:
            latest = name == "scan_timestamp"
            order.append(F.col(name).desc_nulls_last() if latest else F.col(name).asc_nulls_last())
    maps = map_columns(combined)
    # maps are moved as the entries they are ordered by, not as both
    return entries_as_maps(top_rows(maps_as_entries(combined, maps), ["serial_number"], order), maps)


def with_status_description(
    df: DataFrame, descriptions: Mapping[str, str] = STATUS_DESCRIPTIONS
) -> DataFrame:
    return df.withColumn("status_description", describe_status(F.col("status"), descriptions))


def serials_section(described: DataFrame) -> DataFrame:
    require(described, SCANS_REQUIRED, "serial table")
    return described.select(
        *[c for c in SECTIONS["serials"].fieldNames() if c in described.columns]
    )


def status_distribution(df: DataFrame) -> DataFrame:
    return present(df, "status").groupBy("status").agg(F.count(F.lit(1)).alias("row_count"))
