from __future__ import annotations

import itertools
import random
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession

from dockpulse.schemas import COMBINED

DAY = datetime(2024, 3, 1)


def at(clock: str, day: datetime = DAY) -> datetime:
    hours, minutes, *rest = (int(x) for x in clock.split(":"))
    return day + timedelta(hours=hours, minutes=minutes, seconds=rest[0] if rest else 0)


def combined(spark: SparkSession, *rows: dict) -> DataFrame:
    """Combined table from partial rows; what a row leaves out has a plain default."""
    serial = itertools.count(1)
    full = []
    for row in rows:
        plain = {
            "serial_number": f"S{next(serial)}",
            "created_by": "U1",
            "created_on": DAY,
            "scan_timestamp": at("10:00"),
            "delivery": "D1",
            "status": "ASH",
            "number_of_packages": 4.0,
        }
        full.append(tuple({**dict.fromkeys(COMBINED.fieldNames()), **plain, **row}.values()))
    names = list({**dict.fromkeys(COMBINED.fieldNames())})
    assert names == COMBINED.fieldNames()
    return spark.createDataFrame(full, COMBINED)


def random_scans(seed: int, n: int) -> list[dict]:
    """Few keys, many ties, some nulls."""
    rng = random.Random(seed)
    times = [at(f"{h}:{m:02d}") for h in (8, 9) for m in (0, 1, 30)]
    return [
        {
            "serial_number": rng.choice([None, *[f"S{i}" for i in range(n // 3)]]),
            "created_by": rng.choice([None, "U1", "U1", "U1", "U2", "U3"]),
            "scan_timestamp": rng.choice([None, *times]),
            "delivery": rng.choice([None, "D1", "D1", "D1", "D2", "D3"]),
            "status": rng.choice(["ASH", "SHP", "ZZ", None]),
            "number_of_packages": rng.choice([None, 0.0, 4.0, 5.0]),
            "name": rng.choice([None, "Ann", "Bo"]),
        }
        for _ in range(n)
    ]


def rows(df: DataFrame, *columns: str) -> list[tuple]:
    picked = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in picked.collect()), key=repr)


def plan(df: DataFrame) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


__all__ = ["DAY", "at", "combined", "plan", "random_scans", "rows"]
