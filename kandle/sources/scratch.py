"""Intermediate tables in the shared folder the cluster names in ``spark.checkpoint.dir``."""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from kandle.session import checkpoint_dir


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder, removed when the driver JVM ends."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/kandle-{uuid.uuid4().hex}/{name}"
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop.getParent())
    return path


def materialize(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Write ``df`` once as Parquet into the shared folder and read it back.

    Cuts lineage like ``checkpoint()`` but runs the plan once, compresses, and survives lost
    executors because every executor can read the folder."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Delete tables that ``materialize`` wrote and that nothing reads any more: their successors are written."""
    for df in tables:
        path = getattr(df, "_scratch", None)
        if path:
            sc = df.sparkSession.sparkContext
            hadoop = sc._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(sc._jsc.hadoopConfiguration()).delete(hadoop.getParent(), True)
