"""Sections as JSON records, and back."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from dockpulse.functions.records import record_json
from dockpulse.functions.timing import at
from dockpulse.schemas import SECTIONS

RECORDS = T.StructType(
    [
        T.StructField("section", T.StringType()),
        T.StructField("record", T.StringType()),
        T.StructField("generated_at", T.TimestampType()),
    ]
)
_BROKEN = "__broken"


def sections_to_json(sections: Mapping[str, DataFrame], as_of: datetime | str) -> DataFrame:
    """All sections as (section, record, generated_at); ``.write.json`` or a text sink stores it."""
    parts = [
        df.select(F.lit(name).alias("section"), record_json(df).alias("record"))
        for name, df in sections.items()
    ]
    return reduce(DataFrame.unionByName, parts).withColumn("generated_at", at(as_of))


def load_records(spark: SparkSession, path: str) -> DataFrame:
    """Records (section, record, generated_at) from JSON files that hold one of them per line."""
    return spark.read.schema(RECORDS).json(path)


def _parsed(records: DataFrame, section: str) -> DataFrame:
    """Typed columns of a section's records, ``rescued`` with the fields no column is declared for,
    and the whole text of a record that cannot be read to the declared types."""
    schema = SECTIONS[section]
    declared = T.StructType([*schema.fields, T.StructField(_BROKEN, T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BROKEN}
    row = F.from_json("record", declared, options)
    fields = F.from_json("record", T.MapType(T.StringType(), T.StringType()))
    known = F.array(*[F.lit(name) for name in schema.fieldNames()])
    further = F.map_filter(fields, lambda k, _: ~F.array_contains(known, k))
    parsed = records.filter(F.col("section") == section).select(
        row.alias("row"),
        F.when(F.size(further) > 0, F.to_json(further)).alias("rescued"),
        "record",
        "generated_at",
    )
    # text that is no object gives a row of nulls and no error of its own
    whole = F.coalesce(F.ltrim("record").startswith("{"), F.lit(False))
    broken = F.when(whole, F.col(f"row.{_BROKEN}")).otherwise(F.coalesce("record", F.lit("")))
    return parsed.withColumn(_BROKEN, broken)


def section_from_json(records: DataFrame, section: str) -> DataFrame:
    """A section read back from its records: its columns with their types, and ``rescued``, a JSON
    object of further fields or null. Records that do not fit are left to ``broken_records``."""
    names = SECTIONS[section].fieldNames()
    sound = _parsed(records, section).filter(F.col(_BROKEN).isNull())
    return sound.select(*[F.col(f"row.{n}").alias(n) for n in names], "rescued")


def broken_records(records: DataFrame) -> DataFrame:
    """(section, record, generated_at) of the records that no section takes: unreadable ones, and
    those of sections nobody knows."""
    parts = [
        _parsed(records, name)
        .filter(F.col(_BROKEN).isNotNull())
        .select(F.lit(name).alias("section"), "record", "generated_at")
        for name in SECTIONS
    ]
    unknown = records.filter(~F.coalesce(F.col("section").isin(*SECTIONS), F.lit(False)))
    return reduce(DataFrame.unionByName, parts, unknown.select(*RECORDS.fieldNames()))
