"""The physical plans: what is pushed into scans, how rows are shuffled, what never appears."""

import re

import pytest
from conftest import SF
from helpers import plan
from pyspark.sql import functions as F

from dockpulse.operators.combine import combine
from dockpulse.operators.diff import change_feed
from dockpulse.operators.progress import progress_lookup
from dockpulse.operators.scan_times import scan_times
from dockpulse.operators.serials import dedup_serials
from dockpulse.operators.users import user_activity
from dockpulse.plans import canonical, catalog
from dockpulse.schemas import SECTIONS

# These run jobs or streams before they return a frame; their parts are covered by the others.
EAGER = {
    "save_sections",
    "load_section",
    "latest_section",
    "change_feed",
    "dashboard",
    "section_from_json",
    "users_from_slices",
    "stream_scans",
    "stream_refresh",
    "stream_change_feed",
    "stream_activity",
}
LAZY = [name for name in catalog.QUERIES if name not in EAGER]


@pytest.fixture()
def no_broadcast(spark):
    settings = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    for key in settings:
        spark.conf.set(key, "-1")
    yield
    for key in settings:
        spark.conf.unset(key)


@pytest.mark.parametrize("name", LAZY)
def test_no_nested_loops_and_no_row_python(spark, no_broadcast, name):
    """Without broadcasts every join must still find an equality to shuffle on."""
    text = plan(catalog.QUERIES[name](spark, SF))
    for bad in ("NestedLoopJoin", "CartesianProduct", "BatchEvalPython", "ArrowEvalPython"):
        assert bad not in text
    if name != "xlsx_ingest":
        assert "InPandas" not in text and "InArrow" not in text
    if "SinglePartition" in text:
        # a single partition may only take the partial results of a global aggregate
        for block in re.findall(r"Exchange SinglePartition[^\n]*\n([^\n]*)", text):
            assert "HashAggregate" in block, block


def test_scan_filters_reach_the_files(spark):
    text = plan(canonical.scans(spark, SF))
    assert "EqualTo(l_returnflag,R)" in text
    assert re.search(r"PushedFilters: \[[^\]]*LessThanOrEqual\(o_orderdate", text)
    read = re.findall(r"ReadSchema: struct<([^>]*)>", text)
    assert not any("l_tax" in schema or "o_totalprice" in schema for schema in read)


def test_metrics_read_the_columns_they_need(spark):
    text = plan(catalog.QUERIES["progress"](spark, SF))
    assert "l_quantity" not in text
    assert "o_totalprice" not in text


def test_rows_per_serial_are_cut_before_the_shuffle(spark):
    text = plan(dedup_serials(canonical.combined(spark, SF)))
    assert re.search(r"row_number\(\), 1, Partial", text)
    assert text.index("1, Final") < text.index("Exchange hashpartitioning(serial_number") < text.index("1, Partial")


def test_scan_times_are_cut_before_the_shuffle(spark):
    scans = canonical.core(spark, SF)
    text = plan(scan_times(scans, "1998-12-31"))
    assert re.search(r"row_number\(\), 1, Partial", text)
    assert re.search(r"row_number\(\), 2, Partial", text)


def test_activity_is_cut_before_the_shuffle(spark):
    assert re.search(r"row_number\(\), 50, Partial", plan(catalog.QUERIES["activity_last_n"](spark, SF)))


def test_both_sides_of_progress_share_one_deduplication(spark):
    df = catalog.QUERIES["progress"](spark, SF)
    df.collect()
    assert "ReusedExchange" in plan(df)


def test_user_metrics_aggregate_by_hash_first(spark):
    text = plan(catalog.QUERIES["users"](spark, SF))
    assert re.search(r"HashAggregate\(keys=\[created_by[^\n]*partial_max\(scan_timestamp", text)


def test_the_window_of_user_metrics_reaches_a_saved_table(spark, tmp_path):
    canonical.core(spark, SF).write.parquet(f"{tmp_path}/current")
    saved = spark.read.parquet(f"{tmp_path}/current")
    text = plan(user_activity(saved, canonical.CURRENT.as_of, 43200))
    assert re.search(r"PushedFilters: \[[^\]]*GreaterThanOrEqual\(scan_timestamp", text)


def test_unique_feed_needs_no_sort_for_whole_rows(spark, tmp_path):
    tables = {
        name: spark.createDataFrame([], schema) for name, schema in SECTIONS.items() if name == "serials"
    }
    for name, df in tables.items():
        df.write.parquet(f"{tmp_path}/{name}")
    read = {name: spark.read.parquet(f"{tmp_path}/{name}") for name in tables}
    text = plan(change_feed(read, read, "2024-03-01", unique=True))
    assert "HashAggregate" in text
    assert "Sort" not in text
    assert text.count("Exchange hashpartitioning") == 1


def test_lookup_reaches_a_saved_section(spark, tmp_path):
    spark.createDataFrame([], SECTIONS["progress"]).write.parquet(f"{tmp_path}/progress")
    saved = spark.read.schema(SECTIONS["progress"]).parquet(f"{tmp_path}/progress")
    assert "EqualTo(delivery,7)" in plan(progress_lookup(saved, delivery="7"))


@pytest.fixture()
def small_skew(spark, no_broadcast):
    settings = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.shuffle.partitions": "8",
    }
    old = {key: spark.conf.get(key) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    yield
    for key, value in old.items():
        spark.conf.set(key, value)


def test_hot_delivery_is_split_in_the_join(spark, small_skew, tmp_path):
    """One delivery holds a third of the scans."""
    key = F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id")).cast("string")
    scans = spark.range(0, 60000, numPartitions=8).select(
        F.concat(F.lit("S"), "id").alias("serial_number"), key.alias("delivery"),
        F.lit("ASH").alias("status"), F.sha2(F.col("id").cast("string"), 256).alias("name"),
    )
    deliveries = spark.range(0, 60000, numPartitions=8).select(
        F.col("id").cast("string").alias("delivery"), F.lit(4.0).alias("number_of_packages")
    )
    scans.write.parquet(f"{tmp_path}/scans")
    deliveries.write.parquet(f"{tmp_path}/deliveries")
    both = dedup_serials(
        combine(spark.read.parquet(f"{tmp_path}/scans"), spark.read.parquet(f"{tmp_path}/deliveries"))
    )
    assert len(both.collect()) == 60000
    assert "skew=true" in plan(both)
