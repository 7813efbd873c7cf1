"""Session defaults and the shared scratch location."""

from __future__ import annotations

import sys
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import SparkSession


def get_spark(app_name: str = "wardlens", master: str | None = None, **conf) -> SparkSession:
    """Build (or reuse) a session with the settings the operators assume.

    Only semantics-bearing settings are fixed here (UTC, adaptive execution);
    sizing such as shuffle partitions belongs to the cluster or the caller.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, str(value))
    return builder.getOrCreate()


def work_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder under the cluster's shared checkpoint location.

    ``spark.checkpoint.dir`` names storage every executor can reach. A local
    folder is used only by a local-mode session that has none set.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
        base = tempfile.mkdtemp(prefix="wardlens-")
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def stored(frame, label: str):
    """Write an intermediate that several later steps read, and return it as a table scan.

    The table lives in the shared folder, so it survives lost executors, and its
    recorded size lets the planner choose join strategies by fact.
    """
    path = work_dir(frame.sparkSession, label)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def ship_by_value(module_name: str) -> None:
    """Send a module's task code along with the task, so executors need no copy of this package."""
    cloudpickle.register_pickle_by_value(sys.modules[module_name])


def spread(scan):
    """Round-robin a scan that has fewer splits than there are cores, for costly per-row work.

    Large inputs have many splits and pass through untouched.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan
