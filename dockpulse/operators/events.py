"""What happened to serials and deliveries since the previous snapshot."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from dockpulse.operators.progress import delivery_status
from dockpulse.operators.ranking import top_rows
from dockpulse.params import PICKED, SHIPPED


_SERIAL = "__serial"


def _keyed(df: DataFrame) -> DataFrame:
    """Serial numbers are compared as text. Inside a struct a missing one equals itself, and the
    comparison stays an equi-join that can reuse the partitioning of a preceding aggregation."""
    return df.withColumn(_SERIAL, F.struct(F.col("serial_number").cast("string").alias("s")))


def _seen(previous: DataFrame, unique: bool) -> DataFrame:
    """Serials of a snapshot; repeated ones are collapsed on the map side."""
    serials = _keyed(previous).select(_SERIAL)
    return serials if unique else serials.distinct()


def status_per_serial(previous: DataFrame, unique: bool = False) -> DataFrame:
    """Serial and its status in the previous snapshot. A saved serials section is unique already;
    for any other table the latest scan decides."""
    keyed = _keyed(previous)
    if not unique:
        order = [F.col("status").asc_nulls_last()]
        if "scan_timestamp" in previous.columns:
            order.insert(0, F.col("scan_timestamp").desc_nulls_last())
        keyed = top_rows(keyed, [_SERIAL], order)
    return keyed.select(_SERIAL, F.col("status").alias("previous_status"))


def _by_serial(current: DataFrame, previous: DataFrame, how: str) -> DataFrame:
    """Rows of ``current`` whose serial ``previous`` has (semi) or lacks (anti), for tables with one
    row per serial. Compared as plain columns, serials find each other within the buckets both
    tables are saved in, and neither is moved. The one row without a serial equals the other such
    row and is decided by whether there is one."""
    seen = previous.select(F.col("serial_number").cast("string").alias(_SERIAL))
    missing = F.col("serial_number").isNull()
    other_missing = previous.filter(missing).exists()
    matched = current.join(seen, current.serial_number.cast("string") == seen[_SERIAL], how)
    if how == "left_anti":
        return matched.filter(~missing | ~other_missing)
    return matched.unionByName(current.filter(missing & other_missing))


def newly_picked(
    current: DataFrame, previous: DataFrame | None, unique_previous: bool = False
) -> DataFrame:
    """Picked serials the previous snapshot did not have; on a first run every picked serial."""
    picked = current.filter(F.col("status") == PICKED)
    if previous is not None and unique_previous:
        picked = _by_serial(picked, previous, "left_anti")
    elif previous is not None:
        seen = _seen(previous, unique_previous)
        picked = _keyed(picked).join(seen, _SERIAL, "left_anti").drop(_SERIAL)
    return picked.withColumn("event", F.lit("newly_picked"))


def common_serials(
    current: DataFrame, previous: DataFrame, unique_previous: bool = False
) -> DataFrame:
    """Current rows whose serial the previous snapshot had."""
    if unique_previous:
        return _by_serial(current, previous, "left_semi")
    seen = _seen(previous, unique_previous)
    return _keyed(current).join(seen, _SERIAL, "left_semi").drop(_SERIAL)


def shipped(
    current: DataFrame, previous: DataFrame | None, unique_previous: bool = False
) -> DataFrame:
    """Serials that were picked in the previous snapshot and are shipped now."""
    now_shipped = current.filter(F.col("status") == SHIPPED)
    if previous is not None and unique_previous:
        # the status before is known: it is the one that is asked for
        kept = _by_serial(now_shipped, previous.filter(F.col("status") == PICKED), "left_semi")
        return kept.withColumns({"previous_status": F.lit(PICKED), "event": F.lit("shipped")})
    if previous is None:
        before = status_per_serial(now_shipped.limit(0), unique=True)
    else:
        before = status_per_serial(previous, unique_previous)
    before = before.filter(F.col("previous_status") == PICKED)
    return (
        _keyed(now_shipped)
        .join(before, _SERIAL, "inner")
        .select(*current.columns, "previous_status")
        .withColumn("event", F.lit("shipped"))
    )


def completed_deliveries(current: DataFrame, previous: DataFrame | None) -> DataFrame:
    """Deliveries with every serial shipped. It is a state, not a change, so a delivery shows up
    in every run; the first run, one without previous serials, reports none."""
    done = (
        delivery_status(current)
        .filter(F.col("total_serials") == F.col("shipped_serials"))
        .withColumn("event", F.lit("completed"))
    )
    return done.limit(0) if previous is None else done.filter(previous.exists())
