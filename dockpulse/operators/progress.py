"""Packing progress."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from dockpulse.functions.labels import card_band, card_percent, percent_of
from dockpulse.params import SHIPPED
from dockpulse.schemas import present


def delivery_packages(df: DataFrame) -> DataFrame:
    """Distinct (delivery, number_of_packages) pairs."""
    return df.select("delivery", "number_of_packages").distinct()


def progress(df: DataFrame, half_even: bool = False) -> DataFrame:
    """Scanned count per delivery and user against the packages of the delivery.

    Both sides are reduced on the map side before they are shuffled. A delivery with two totals
    gives two rows per user.
    """
    counts = (
        present(df, "delivery", "created_by")
        .groupBy("delivery", "created_by")
        .agg(F.count(F.lit(1)).alias("scanned_count"))
    )
    return counts.join(delivery_packages(df), "delivery", "left").select(
        "delivery",
        "created_by",
        "scanned_count",
        "number_of_packages",
        percent_of(F.col("scanned_count"), F.col("number_of_packages"), half_even).alias(
            "progress_percentage"
        ),
    )


def progress_lookup(
    section: DataFrame, delivery: str | None = None, user: str | None = None
) -> DataFrame:
    """Progress rows of one delivery, one user, or both; no argument returns all rows."""
    if delivery:
        section = section.filter(F.col("delivery") == delivery)
    if user:
        section = section.filter(F.col("created_by") == user)
    return section


def progress_cards(section: DataFrame) -> DataFrame:
    """Per delivery: scanned, total, whole percent and colour band."""
    total = F.coalesce("number_of_packages", F.lit(0.0))
    cards = (
        section.groupBy("delivery", total.alias("total"))
        .agg(F.sum("scanned_count").alias("current"))
        .withColumn("percent", card_percent(F.col("current"), F.col("total")))
    )
    return cards.select(
        "delivery", "current", "total", "percent", card_band(F.col("percent")).alias("band")
    )


def delivery_status(df: DataFrame) -> DataFrame:
    """Serials and shipped serials per delivery."""
    return (
        present(df, "delivery")
        .groupBy("delivery")
        .agg(
            F.count("serial_number").alias("total_serials"),
            F.count_if(F.col("status") == SHIPPED).alias("shipped_serials"),
        )
    )
