"""Rows as JSON text: ISO times, missing values as null."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from dockpulse.functions.casting import nan_to_null
from dockpulse.functions.timing import iso_text

# Types JSON can carry as they are; anything else becomes text.
_PLAIN = (
    T.StringType,
    T.BooleanType,
    T.NumericType,
    T.ArrayType,
    T.MapType,
    T.StructType,
    T.NullType,
)


def _json_value(name: str, kind: T.DataType) -> Column:
    value = F.col(f"`{name}`")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return iso_text(value.cast("timestamp")).alias(name)
    if isinstance(kind, _PLAIN):
        return nan_to_null(value, kind).alias(name)
    return value.cast("string").alias(name)


def record_json(df: DataFrame, columns: Sequence[str] | None = None) -> Column:
    """One JSON object per row of ``df`` with the given columns in order."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    record = F.struct(*[_json_value(c, kinds[c]) for c in columns or df.columns])
    return F.to_json(record, {"ignoreNullFields": "false"})
