"""Report columns beyond the declared ones, held as one map of texts.

A report may have any further columns. They are read into the column ``extra``, keyed by their clean
headers, and carried through the join, the deduplication and the events without the tables having
to know them; a missing cell is a null value, so every row of a report has the same keys.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

EXTRA = "extra"
OPEN = T.MapType(T.StringType(), T.StringType())


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def with_extra(df: DataFrame, declared: Sequence[str]) -> DataFrame:
    """Add ``extra``: what the columns outside of ``declared`` hold, as text. A map that is there
    already, from a table read before, keeps its entries."""
    held = EXTRA in df.columns and isinstance(df.schema[EXTRA].dataType, T.MapType)
    known = {*declared, *([EXTRA] if held else [])} - ({EXTRA} if not held else set())
    parts = [
        part
        for name in sorted(set(df.columns) - known)
        for part in (F.lit(name), F.col(_quoted(name)).cast("string"))
    ]
    found = F.create_map(*parts) if parts else F.create_map().cast(OPEN)
    if held:
        before = F.coalesce(F.col(EXTRA).cast(OPEN), F.create_map().cast(OPEN))
        fresh = F.map_filter(found, lambda k, _: ~F.map_contains_key(before, k))
        found = F.map_concat(before, fresh)
    return df.withColumn(EXTRA, found)


def merged_extra(left: Column, right: Column, left_suffix: str, right_suffix: str) -> Column:
    """Entries of both sides in the order of their names; a name that both have gets the suffix of its side. Should a side have
    the suffixed name as well, its entry stays and the clashing one is left under the plain name."""

    def renamed(mine: Column, other: Column, suffix: str) -> Column:
        def name(k: Column, _: Column) -> Column:
            with_suffix = F.concat(k, F.lit(suffix))
            clash = F.map_contains_key(other, k) & ~F.map_contains_key(mine, with_suffix)
            return F.when(clash, with_suffix).otherwise(k)

        return F.transform_keys(mine, name)

    empty = F.create_map().cast(OPEN)
    a, b = F.coalesce(left, empty), F.coalesce(right, empty)
    one, two = renamed(a, b, left_suffix), renamed(b, a, right_suffix)
    both = F.map_concat(one, F.map_filter(two, lambda k, _: ~F.map_contains_key(one, k)))
    return F.map_from_entries(sorted_entries(both))


def sorted_entries(value: Column) -> Column:
    """Entries of a map by name. Names do not repeat, and ``array_sort`` would compare by a lambda
    that is interpreted for every pair."""
    return F.sort_array(F.map_entries(value))


def comparable(value: Column, kind: T.DataType) -> Column:
    """``value`` in a form that can be ordered, grouped and hashed: a map as its sorted entries."""
    return sorted_entries(value) if isinstance(kind, T.MapType) else value


def map_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.MapType)]


def maps_as_entries(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Maps as sorted entries; ``entries_as_maps`` turns them back."""
    return df.withColumns({n: sorted_entries(F.col(n)) for n in names if n in map_columns(df)})


def entries_as_maps(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.withColumns({n: F.map_from_entries(n) for n in names})
