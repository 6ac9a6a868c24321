"""Session settings and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Runtime SQL settings the package relies on; everything else stays as the cluster sets it.
_RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}


def build_session(
    app_name: str = "dockpulse", master: str | None = None, **settings: str
) -> SparkSession:
    """Session for jobs, tests and the bench. On a cluster leave ``master`` to spark-submit."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**_RUNTIME_SETTINGS, **settings}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def pin_utc(spark: SparkSession) -> SparkSession:
    """Report times carry no zone, so date arithmetic must not shift them."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def scratch_dir(spark: SparkSession, purpose: str) -> str:
    """A new, unused folder below the shared folder named by ``spark.checkpoint.dir``.

    Only a local master may fall back to a machine-local folder: on a cluster such a folder
    would be lost with the machine that owns it.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        shared = os.path.join(tempfile.gettempdir(), "dockpulse-checkpoints")
    return f"{shared.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
