"""Column naming. Names are plan-time values, so none of this costs a pass over the data."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Mapping

from pyspark.sql import DataFrame, functions as F

# Report headers and the names they get.
SCAN_HEADERS = {
    "Serial #": "serial_number",
    "Created by": "created_by",
    "Created on": "created_on",
    "Delivery": "delivery",
    "Status": "status",
    "Warehouse Number": "warehouse_number",
}
DELIVERY_HEADERS = {
    "Delivery": "delivery",
    "Number of packages": "number_of_packages",
    "Shipping Point/Receiving Pt": "shipping_point",
}
COMBINED_HEADERS = {
    "Serial #": "serial_number",
    "Created by": "created_by",
    "Created on": "created_on",
    "Delivery": "delivery",
    "Status": "status",
    "Number of packages": "number_of_packages",
}

# Variants of a cleaned header and the standard name they stand for.
HEADER_VARIANTS = {
    "serialnumber": "serial_number",
    "serial_": "serial_number",
    "serialno": "serial_number",
    "serial": "serial_number",
    "deliverynumber": "delivery",
    "delivery_number": "delivery",
    "deliveryno": "delivery",
    "warehouse": "warehouse_number",
    "warehouseno": "warehouse_number",
    "warehouseid": "warehouse_number",
    "warehouse_id": "warehouse_number",
    "createdon": "created_on",
    "created_date": "created_on",
    "createdby": "created_by",
    "user": "created_by",
    "userid": "created_by",
    "user_id": "created_by",
    "numberofpackages": "number_of_packages",
    "package_count": "number_of_packages",
    "packages": "number_of_packages",
    "shippingpoint": "shipping_point",
    "shipping_point_receiving_pt": "shipping_point",
}

_HEADER_SIGNS = str.maketrans({" ": "_", "#": "number", "/": "_"})


def header_rule(name: str) -> str:
    return name.lower().translate(_HEADER_SIGNS)


def report_header(name: str) -> str:
    """Name a report header gets on reading: the fixed names, else the header rule."""
    return SCAN_HEADERS.get(name) or DELIVERY_HEADERS.get(name) or header_rule(name)


def standard_name(name: str) -> str:
    bare = re.sub(r"[^a-zA-Z0-9_]", "", header_rule(name))
    return HEADER_VARIANTS.get(bare, bare)


def _renamed(df: DataFrame, names: list[str]) -> DataFrame:
    twice = sorted(name for name, n in Counter(names).items() if n > 1)
    if twice:
        raise ValueError(f"several columns would be called {twice}: {df.columns}")
    return df.toDF(*names)


def rename_existing(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Rename the columns that exist; the others in ``names`` are ignored."""
    return _renamed(df, [names.get(c, c) for c in df.columns])


def sanitize_headers(df: DataFrame) -> DataFrame:
    """Lower case; blank and slash become underscores, '#' becomes 'number'."""
    return _renamed(df, [header_rule(c) for c in df.columns])


def standardize_columns(df: DataFrame) -> DataFrame:
    """Header rule, other signs removed, known variants mapped to the standard name."""
    return _renamed(df, [standard_name(c) for c in df.columns])


def copy_aliases(df: DataFrame, names: Mapping[str, str] = COMBINED_HEADERS) -> DataFrame:
    """Add each standard column that is missing as a copy of its report column. Spark does not
    tell names apart by case, so a report column that differs only in case is renamed instead."""
    have = set(df.columns)
    return df.withColumns(
        {
            std: F.col(f"`{raw}`")
            for raw, std in names.items()
            if raw in have and std not in have
        }
    )
