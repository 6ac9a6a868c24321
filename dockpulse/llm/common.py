"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from dockpulse.session import scratch_dir


#: Rows that a Python function is handed at once.
BATCH_ROWS = 2048


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the folder of ``spark.checkpoint.dir``, so that its lineage ends there.

    Only a local session without that setting falls back to a folder of its own.
    """
    spark, context = df.sparkSession, df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        context.setCheckpointDir(shared or os.path.join(tempfile.gettempdir(), "dockpulse-llm"))
    return df.checkpoint()


def written(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` as a table in the shared scratch folder; compact, and its lineage ends there."""
    path = scratch_dir(df.sparkSession, f"llm-{purpose}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def map_arrow(
    df: DataFrame, schema: StructType, function: Callable[[Iterator[pa.RecordBatch]], Iterator[list]]
) -> DataFrame:
    """``mapInArrow`` for functions that yield lists of columns in the order of ``schema``.

    The function gets batches of at most ``BATCH_ROWS`` rows, so that what it makes of one at a
    time stays small however many rows Spark sends at once.
    """
    arrow = to_arrow_schema(schema)

    def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, BATCH_ROWS):
                yield batch.slice(start, BATCH_ROWS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in function(sliced(batches)):
            arrays = [
                c if isinstance(c, pa.Array) else pa.array(c, type=field.type)
                for c, field in zip(columns, arrow)
            ]
            yield pa.RecordBatch.from_arrays(arrays, schema=arrow)

    return df.mapInArrow(run, schema)


def utf8(column: str) -> Column:
    """UTF-8 bytes of a text column; null is empty."""
    return F.coalesce(F.col(column), F.lit("")).cast("binary")


def text_key(column: str) -> Column:
    """Hash that tells apart rows of one doc_id with different texts; null counts as empty."""
    return F.xxhash64(F.coalesce(F.col(column), F.lit("")))


def octets_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a binary column one value after the other, and where each begins and the end."""
    large = pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if large else np.int32)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    return np.frombuffer(data, np.uint8) if data else np.empty(0, np.uint8), offsets
