"""Which report files have landed, and which one is the newest of its kind."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from dockpulse.params import DELIVERY_REPORT_MARK, SCAN_REPORT_MARK, WORKBOOK_SUFFIX
from dockpulse.schemas import present

SCAN_REPORT, DELIVERY_REPORT = "scans", "deliveries"


def list_files(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """Path, modification time and size of the files of a folder. The contents are not read:
    the binary source skips them unless the column is asked for."""
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", glob)
        .load(folder)
        .select("path", F.col("modificationTime").alias("modified_at"), "length")
    )


def classify_files(listing: DataFrame, suffix: str = WORKBOOK_SUFFIX) -> DataFrame:
    """Add the kind of report a file name stands for, ignoring case; null for any other file."""
    name = F.element_at(F.split(F.col("path"), "/"), -1)
    known_suffix = F.lower(name).endswith(suffix)
    kind = F.when(
        known_suffix & F.upper(name).contains(SCAN_REPORT_MARK), F.lit(SCAN_REPORT)
    ).when(known_suffix & F.upper(name).contains(DELIVERY_REPORT_MARK), F.lit(DELIVERY_REPORT))
    return listing.withColumn("report_type", kind)


def latest_file(classified: DataFrame) -> DataFrame:
    """Newest file of each kind; the higher path wins a tie."""
    return (
        present(classified, "report_type")
        .groupBy("report_type")
        .agg(F.max(F.struct("modified_at", "path")).alias("newest"))
        .select("report_type", "newest.path", "newest.modified_at")
    )
