"""One refresh: reports in, saved snapshot and change feed out."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame

from dockpulse.operators.combine import combine, one_row_per_delivery
from dockpulse.operators.diff import change_feed
from dockpulse.params import Params
from dockpulse.plans.dashboard import build_section, current_serials
from dockpulse.schemas import SECTIONS
from dockpulse.sources.reports import read_deliveries, read_scans
from dockpulse.sources.store import CHANGE_FEED, SnapshotStore


def refresh(
    store: SnapshotStore,
    raw_scans: DataFrame,
    raw_deliveries: DataFrame,
    snapshot_id: str,
    as_of: datetime | str,
    params: Params = Params(),
) -> dict[str, int] | None:
    """Compute and save the snapshot ``snapshot_id``; returns its row counts.

    Nothing happens when the snapshot is saved already or a report has no usable rows. The
    deduplicated table is written once and read back with the columns each section needs, which
    also ends the lineage: a lost executor never brings back the join. The previous state is the
    newest snapshot saved before this one; without one, the feed stays empty. Sections are compared
    by the digests of their slots, and only rows of slots that differ are read for the feed.
    """
    if store.is_saved(snapshot_id):
        return None
    scans, deliveries = read_scans(raw_scans, params), read_deliveries(raw_deliveries, params)
    joined = combine(scans, one_row_per_delivery(deliveries))
    serials = store.write("current", current_serials(joined, params), snapshot_id)
    # Any serial proves that both reports have rows, so they are looked into only without one: a
    # report may be the result of a join that would run again for it.
    if not serials and (scans.isEmpty() or deliveries.isEmpty()):
        store.discard_current(snapshot_id)
        return None
    current = store.load("current", snapshot_id)

    before = store.latest_snapshot(before=snapshot_id)
    previous_serials = store.load("serials", before) if before else None

    def save(name: str) -> int:
        if name == "serials":  # saved with the current table
            return serials
        section = build_section(name, current, previous_serials, as_of, params, True)
        return store.write(name, section, snapshot_id)

    counts = store.side_by_side(save, SECTIONS)
    store.save_digests(snapshot_id, ignore=params.ignore_columns)
    changed = store.differing_slots(snapshot_id, before) if before else {}

    def save_changes(name: str) -> int:
        slots = changed[name]
        now, then = store.load(name, snapshot_id, slots), store.load(name, before, slots)
        feed = change_feed({name: now}, {name: then}, as_of, params.ignore_columns, unique=True)
        return store.write("change_feed", feed, snapshot_id, section=name)

    differing = [name for name, slots in changed.items() if slots != []]
    store.side_by_side(save_changes, differing)
    if not differing:
        nothing = store.spark.createDataFrame([], CHANGE_FEED)
        store.write("change_feed", nothing, snapshot_id, section="serials")
    store.commit(snapshot_id, counts, as_of)
    if params.keep_snapshots:
        store.expire(params.keep_snapshots)
    return counts
