"""Null-safe change feed between two snapshots of a section.

Keys are compared as one struct: struct equality treats two missing fields as equal, so a key
with a missing part matches itself, and the comparison stays an equi-join.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from dockpulse.functions.open_columns import entries_as_maps, map_columns, maps_as_entries
from dockpulse.functions.records import record_json
from dockpulse.functions.timing import at
from dockpulse.schemas import SECTION_KEYS

_KEY, _NOW, _BEFORE = "__key", "__now", "__before"
ADDED, REMOVED, CHANGED = "added", "removed", "changed"
_NOTES = ("op", "changed_column", "previous_value")


def _nothing() -> Column:
    return F.lit(None).cast("string")


def _keyed(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.withColumn(_KEY, F.struct(*keys))


def added_rows(current: DataFrame, previous: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``current`` whose key ``previous`` lacks; duplicates are all kept. The keys of
    ``previous`` are collapsed before they are moved, so many copies of one key weigh nothing."""
    maps = map_columns(current)
    here = _keyed(maps_as_entries(current, maps), keys)
    there = _keyed(maps_as_entries(previous, maps), keys).select(_KEY).distinct()
    return entries_as_maps(here.join(there, _KEY, "left_anti").drop(_KEY), maps)


def removed_rows(current: DataFrame, previous: DataFrame, keys: Sequence[str]) -> DataFrame:
    return added_rows(previous, current, keys)


def _packed(df: DataFrame, keys: Sequence[str], name: str, unique: bool) -> DataFrame:
    """Key and remaining columns as structs, one row per key: the lowest if there are several."""
    values = [c for c in df.columns if c not in keys]
    packed = df.select(F.struct(*keys).alias(_KEY), F.struct(*values).alias(name))
    return packed if unique else packed.groupBy(_KEY).agg(F.min(name).alias(name))


def _compared(
    current: DataFrame, previous: DataFrame, keys: Sequence[str], ignore: Sequence[str]
) -> list[str]:
    return [
        c
        for c in current.columns
        if c not in keys and c not in ignore and c in previous.columns
    ]


def _first_difference(matched: DataFrame, compared: Sequence[str]) -> DataFrame:
    """Add the first differing column in column order and its previous value as text. The value
    follows the column's name: it may be null itself."""

    def differs(name: str) -> Column:
        return ~F.col(f"{_NOW}.{name}").eqNullSafe(F.col(f"{_BEFORE}.{name}"))

    column = F.coalesce(_nothing(), *[F.when(differs(c), F.lit(c)) for c in compared])
    value = _nothing()
    for c in compared:
        before = F.col(f"{_BEFORE}.{c}").cast("string")
        value = F.when(F.col("changed_column") == c, before).otherwise(value)
    return matched.withColumn("changed_column", column).withColumn("previous_value", value)


def changed_rows(
    current: DataFrame,
    previous: DataFrame,
    keys: Sequence[str],
    ignore: Sequence[str] = (),
    unique: bool = False,
) -> DataFrame:
    """Common keys with a differing value: current row, first differing column, previous value.

    ``unique`` promises one row per key on both sides.
    """
    maps = map_columns(current)
    current, previous = maps_as_entries(current, maps), maps_as_entries(previous, maps)
    matched = _packed(current, keys, _NOW, unique).join(
        _packed(previous, keys, _BEFORE, unique), _KEY, "inner"
    )
    noted = _first_difference(matched, _compared(current, previous, keys, ignore))
    changed = noted.filter(F.col("changed_column").isNotNull()).select(
        *[F.col(f"{_KEY if c in keys else _NOW}.{c}").alias(c) for c in current.columns],
        "changed_column",
        "previous_value",
    )
    return entries_as_maps(changed, maps)


def _noted(df: DataFrame, op: str) -> DataFrame:
    missing = [c for c in ("changed_column", "previous_value") if c not in df.columns]
    return df.withColumns({"op": F.lit(op), **{c: _nothing() for c in missing}})


def _any_rows(
    current: DataFrame, previous: DataFrame, keys: Sequence[str], ignore: Sequence[str]
) -> DataFrame:
    """Differences of tables that may repeat a key. Anti-joins keep every duplicate, and adaptive
    skew handling can split their large side."""
    parts = [
        _noted(added_rows(current, previous, keys), ADDED),
        _noted(removed_rows(current, previous, keys), REMOVED),
    ]
    if _compared(current, previous, keys, ignore):
        parts.append(_noted(changed_rows(current, previous, keys, ignore), CHANGED))
    return reduce(DataFrame.unionByName, parts)


def _unique_rows(current: DataFrame, previous: DataFrame) -> DataFrame:
    """Differences of tables without duplicates, keyed by all columns: one hash aggregation over
    both, no join and no sort."""
    names = current.columns
    both = current.withColumn("__side", F.lit(1)).unionByName(
        previous.select(*names).withColumn("__side", F.lit(-1))
    )
    side = both.groupBy(*names).agg(F.sum("__side").alias("__side"))
    op = F.when(F.col("__side") > 0, ADDED).otherwise(REMOVED)
    noted = side.filter(F.col("__side") != 0).withColumn("op", op).drop("__side")
    return noted.withColumns({c: _nothing() for c in _NOTES[1:]})


def _unique_keys(
    current: DataFrame, previous: DataFrame, keys: Sequence[str], ignore: Sequence[str]
) -> DataFrame:
    """Differences of tables with one row per key: one outer join."""
    matched = _packed(current, keys, _NOW, True).join(
        _packed(previous, keys, _BEFORE, True), _KEY, "full_outer"
    )
    now, before = F.col(_NOW), F.col(_BEFORE)
    noted = _first_difference(matched, _compared(current, previous, keys, ignore))
    common = now.isNotNull() & before.isNotNull()
    column = F.when(common, F.col("changed_column"))
    op = F.when(before.isNull(), ADDED).when(now.isNull(), REMOVED).otherwise(CHANGED)

    def value(name: str) -> Column:
        if name in keys:
            return F.col(f"{_KEY}.{name}")
        if name not in previous.columns:
            return F.col(f"{_NOW}.{name}")
        # not coalesce: a null in the current row must stay null
        return F.when(now.isNull(), F.col(f"{_BEFORE}.{name}")).otherwise(F.col(f"{_NOW}.{name}"))

    return noted.filter(~common | column.isNotNull()).select(
        *[value(c).alias(c) for c in current.columns],
        op.alias("op"),
        column.alias("changed_column"),
        F.when(common, F.col("previous_value")).alias("previous_value"),
    )


def diff_section(
    section: str,
    current: DataFrame,
    previous: DataFrame | None,
    keys: Sequence[str] | None = None,
    ignore: Sequence[str] = (),
    unique: bool = False,
) -> DataFrame:
    """Added, removed and changed rows of one section as feed rows.

    Without keys every column is the key, and no row can count as changed. Without a previous
    snapshot every row is added. ``unique`` promises one row per key on both sides and takes a
    shorter plan with the same result. Maps are compared by their sorted entries.
    """
    maps = map_columns(current)
    current = maps_as_entries(current, maps)
    previous = previous if previous is None else maps_as_entries(previous, maps)
    if previous is None:
        rows = _noted(current, ADDED)
    elif not unique:
        rows = _any_rows(current, previous, keys or current.columns, ignore)
    elif keys:
        rows = _unique_keys(current, previous, keys, ignore)
    else:
        rows = _unique_rows(current, previous)
    rows = entries_as_maps(rows, maps)
    return rows.select(
        F.lit(section).alias("section"),
        "op",
        (record_json(rows, keys) if keys else _nothing()).alias("key"),
        "changed_column",
        "previous_value",
        record_json(rows, current.columns).alias("record"),
    )


def change_feed(
    current: Mapping[str, DataFrame],
    previous: Mapping[str, DataFrame] | None,
    as_of: datetime | str,
    ignore: Sequence[str] = (),
    unique: bool = False,
) -> DataFrame:
    """All sections as one flat feed. A section the previous snapshot lacks counts as added.

    Idle minutes grow with every run and make nearly every user count as changed; ``ignore``
    leaves such columns out of the comparison. Sections built from deduplicated serials have one
    row per key, so ``unique`` may be set for them.
    """
    parts = [
        diff_section(
            name,
            df,
            previous.get(name) if previous else None,
            SECTION_KEYS.get(name),
            ignore,
            unique,
        )
        for name, df in current.items()
    ]
    return reduce(DataFrame.unionByName, parts).withColumn("generated_at", at(as_of))
