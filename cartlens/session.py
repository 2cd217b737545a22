"""Spark session settings and the shared scratch folder."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import SparkSession


#: Folder for written intermediates of a session that runs on one machine.
LOCAL_DIR = "/tmp/cartlens"


def build_session(cpus: str | int = "*", app: str = "cartlens") -> SparkSession:
    """Local session with the settings the library is tuned for.

    On a cluster the caller's own session is used instead; the same adaptive
    settings should be on there, with shuffle partitions sized to the cluster.
    """
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("CARTLENS_DRIVER_MEMORY", "8g"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.sources.partitionOverwriteMode", "dynamic")
        .getOrCreate()
    )


def scratch_dir(spark: SparkSession, purpose: str) -> str:
    """A new folder for written intermediates.

    It lies under ``spark.checkpoint.dir``, which driver and executors share. Where
    that is unset, only a session on one machine has a folder to fall back on; on a
    cluster a folder of one machine would give the others' readers nothing or part.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and spark.sparkContext.master.startswith("local["):
        shared = LOCAL_DIR
    if not shared:
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{shared.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
