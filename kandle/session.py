"""Spark session helpers.

Lineage is cut by tables in ``spark.checkpoint.dir`` as configured by the cluster. Only a local
master (tests) may leave it unset and gets a fresh temp folder; elsewhere that is an error.
"""
from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # window-heavy stages are CPU-bound: let AQE keep small shuffle partitions apart (one task
    # per series) instead of merging them up to 1 MB; at scale partitions are far larger anyway
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "16KB",
    "spark.driver.memory": "8g",
    # wide indicator plans are large: keep only recent executions' plans in the driver
    "spark.sql.ui.retainedExecutions": "50",
    "spark.ui.retainedJobs": "200",
    "spark.ui.retainedStages": "200",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None, app: str = "kandle") -> SparkSession:
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in DEFAULT_CONF.items():
        b = b.config(k, v)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = b.getOrCreate()
    tune(spark)
    return spark


def tune(spark: SparkSession) -> None:
    """What a query needs of any session, its settings left alone: a checkpoint folder, and the
    package on the executors."""
    checkpoint_dir(spark)
    ship_package(spark)


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``kandle`` importable on executors (grouped-map folds import it): zip the package on
    the driver once per SparkContext and hand it to ``addPyFile``."""
    sc = spark.sparkContext
    key = id(sc._jsc) if sc._jsc is not None else None
    if key in _SHIPPED:
        return
    import zipfile
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    out = os.path.join(tempfile.mkdtemp(prefix="kandle-pkg-"), "kandle.zip")
    with zipfile.ZipFile(out, "w") as z:
        for d, _, files in os.walk(os.path.join(root, "kandle")):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(d, f)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(out)
    _SHIPPED.add(key)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by the cluster; a temp one only when unset (tests)."""
    sc = spark.sparkContext
    cur = sc.getCheckpointDir() if hasattr(sc, "getCheckpointDir") else None
    if not cur:
        cur = spark.conf.get("spark.checkpoint.dir", None)
        if not cur:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            cur = tempfile.mkdtemp(prefix="kandle-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
            spark.conf.set("spark.checkpoint.dir", cur)
        sc.setCheckpointDir(cur)
    return cur
