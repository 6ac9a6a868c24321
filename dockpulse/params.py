"""Settings shared by the operators. Every metric also takes an explicit ``as_of`` time."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

# Status codes and their descriptions.
PICKED = "ASH"
SHIPPED = "SHP"
STATUS_DESCRIPTIONS = {
    "ASH": "picked",
    "SHP": "shipped / closed",
}

# A report file is recognised by this text in its name.
SCAN_REPORT_MARK = "ZMDESNR"
DELIVERY_REPORT_MARK = "VL06O"
WORKBOOK_SUFFIX = ".xlsx"


@dataclass(frozen=True)
class Params:
    warehouse: str = "E01"
    pallet: int = 1
    window_minutes: int = 60
    refresh_seconds: int = 60
    feed_seconds: int = 10
    activity_keep: int = 100
    history_limit: int = 20
    null_key_as_zero: bool = False
    include_inactive: bool = False
    #: Whether 1/2/2024 in a report is in February.
    day_first: bool = False
    #: Round halves to the even neighbour instead of up.
    half_even: bool = False
    #: Columns that the change feed does not compare, such as minutes that grow with every run.
    ignore_columns: tuple[str, ...] = ()
    #: Snapshots that a refresh leaves in the store, the new one among them; 0 keeps all.
    keep_snapshots: int = 0
    status_descriptions: Mapping[str, str] = field(default_factory=lambda: dict(STATUS_DESCRIPTIONS))
