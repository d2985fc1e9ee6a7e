"""Session settings and the shared scratch folder."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    # Strict cleaning relies on casts that fail.
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Estimates made before the run do not count what an explode adds. Only measured sizes lead to a broadcast.
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "10m",
    # Aggregates of plays are collapsed map-side first, so shuffle blocks are small;
    # AQE merges them up to this size and splits rebalanced writes above it.
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
}


def cluster_settings(total_cores: int, largest_shuffle_gb: int = 0) -> dict[str, str]:
    """Extra settings for a cluster: enough shuffle partitions for the cores and for the data.

    A partition starts at about 200 MB at most; adaptive execution merges those that turn out small.
    Range partitions, which order the plays, use the same number.
    """
    partitions = max(3 * total_cores, 5 * largest_shuffle_gb)
    return {"spark.sql.shuffle.partitions": str(partitions)}


def build_session(app="playtrail", master=None, extra=None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **(extra or {})}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach: ``spark.checkpoint.dir``, or the one given to ``setCheckpointDir``.

    Only a session on this machine alone may go without; there a temporary folder is used, which is removed at exit.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if folder is None:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder shared by the cluster")
        folder = tempfile.mkdtemp(prefix="playtrail-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        sc.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new, never used path below the shared folder."""
    return os.path.join(shared_folder(spark), f"{label}-{uuid.uuid4().hex}")
