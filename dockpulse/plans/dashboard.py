"""The eight sections from one combined table."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame

from dockpulse.operators.events import completed_deliveries, newly_picked, shipped
from dockpulse.operators.progress import delivery_packages, progress
from dockpulse.operators.scan_times import scan_times
from dockpulse.operators.serials import (
    dedup_serials,
    serials_section,
    with_status_description,
)
from dockpulse.operators.users import user_activity
from dockpulse.params import Params
from dockpulse.schemas import SECTIONS


def current_serials(
    combined: DataFrame, params: Params = Params(), columns: Sequence[str] | None = None
) -> DataFrame:
    """Combined table with one row per serial and the status description: what every section
    is computed from."""
    return with_status_description(dedup_serials(combined, columns), params.status_descriptions)


def build_section(
    name: str,
    current: DataFrame,
    previous_serials: DataFrame | None,
    as_of: datetime | str,
    params: Params = Params(),
    unique_previous: bool = False,
) -> DataFrame:
    """One lazy section over ``current``."""
    match name:
        case "users":
            return user_activity(
                current, as_of, params.window_minutes, params.include_inactive, params.half_even
            )
        case "deliveries":
            return delivery_packages(current)
        case "progress":
            return progress(current, params.half_even)
        case "scan_times":
            return scan_times(current, as_of, params.half_even)
        case "serials":
            return serials_section(current)
        case "status_changes":
            return shipped(current, previous_serials, unique_previous)
        case "new_serials":
            return newly_picked(current, previous_serials, unique_previous)
        case "completed_deliveries":
            return completed_deliveries(current, previous_serials)
    raise ValueError(f"no section {name!r}; there are {list(SECTIONS)}")


def build_sections(
    current: DataFrame,
    previous_serials: DataFrame | None,
    as_of: datetime | str,
    params: Params = Params(),
    unique_previous: bool = False,
) -> dict[str, DataFrame]:
    """All sections. Hand in a saved table: each section that runs is a query of its own, and
    over anything else each of them would repeat the join and the deduplication."""
    return {
        name: build_section(name, current, previous_serials, as_of, params, unique_previous)
        for name in SECTIONS
    }
