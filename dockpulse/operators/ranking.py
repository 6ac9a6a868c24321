"""Top rows per key.

A ``row_number() <= n`` filter lets Spark cut every key to n rows on the map side
(WindowGroupLimit), so a key that owns a third of the input still reaches its reducer with at
most n rows per map task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

_RANK, _SPLIT = "__rank", "__split"


def ranked(df: DataFrame, keys: Sequence[str], order: Sequence[Column], rank: str) -> DataFrame:
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window))


def top_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int = 1) -> DataFrame:
    """The first n rows of every key, for a small n that Spark cuts on the map side.

    ``order`` should leave ties only between equal rows.
    """
    return ranked(df, keys, order, _RANK).filter(F.col(_RANK) <= n).drop(_RANK)


def most_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The first n rows of every key for any n: the rows of a key that one map task holds are cut
    as a part of their own, then what is left of the key."""
    parts = ranked(df.withColumn(_SPLIT, F.spark_partition_id()), [*keys, _SPLIT], order, _RANK)
    return top_rows(parts.filter(F.col(_RANK) <= n).drop(_SPLIT, _RANK), keys, order, n)
