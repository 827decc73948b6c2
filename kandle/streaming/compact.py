"""Compaction of a live store: few folders however many micro-batches there were.

A store is ``run=<name>/batch_id=<n>`` folders. Compaction copies all of them but each run's last one (the only one that a stream may
run again) into one folder ``run=compact/batch_id=<k>``, with a list of what it holds (``_merged``) beside the rows. The folder
appears by one rename; from then on readers leave out what it lists, so the old folders can be deleted at any time. Whatever breaks off, rows
are there exactly once: an unfinished copy has a hidden name, and the next compaction deletes what is listed.
"""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

RUN = "compact"


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _children(spark: SparkSession, path: str, prefix: str) -> list[str]:
    fs, p = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p) if s.getPath().getName().startswith(prefix)) if fs.exists(p) else []


def folders(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """(run, batch_id) of all folders that are there."""
    return [(r[4:], int(b[9:])) for r in _children(spark, path, "run=") for b in _children(spark, f"{path}/{r}", "batch_id=")]


def _listed(spark: SparkSession, path: str, number: int) -> list[tuple[str, int]]:
    fs, p = _fs(spark, f"{path}/run={RUN}/batch_id={number}/_merged")
    if not fs.exists(p):
        return []
    stream = fs.open(p)
    text = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    stream.close()
    return [(r, int(b)) for b, r in (line.split("\t", 1) for line in text.splitlines() if line)]


def merged(spark: SparkSession, path: str) -> set[tuple[str, int]]:
    """Folders whose rows are in a compacted one; a compacted one may be among them."""
    return {x for run, n in folders(spark, path) if run == RUN for x in _listed(spark, path, n)}


def clean(spark: SparkSession, path: str) -> None:
    """Delete what is listed and unfinished copies."""
    gone = merged(spark, path)
    for run, n in sorted(gone, key=lambda x: x[0] == RUN):  # lists last
        fs, p = _fs(spark, f"{path}/run={run}/batch_id={n}")
        fs.delete(p, True)
    for name in _children(spark, path, ".compact-"):
        fs, p = _fs(spark, f"{path}/{name}")
        fs.delete(p, True)


def compact(spark: SparkSession, path: str, schema: T.StructType, most: int = 64, rows_per_file: int = 4_000_000) -> bool:
    """Merge the folders of a store if there are more than ``most``; whether it did. One writer at a time."""
    clean(spark, path)
    here = folders(spark, path)
    last = {run: max(n for r, n in here if r == run) for run, _ in here if run != RUN}
    old = [(run, n) for run, n in here if run == RUN or n < last[run]]
    if len(here) <= most or len(old) < 2:
        return False
    rows = spark.read.schema(schema).parquet(*[f"{path}/run={r}/batch_id={n}" for r, n in old])
    number = max([n for r, n in here if r == RUN], default=-1) + 1
    hidden = f"{path}/.compact-{uuid.uuid4().hex}"
    files = max(1, rows.count() // rows_per_file)
    # rows of a series stay together in time order, so that a scan of one series skips the other files
    rows.repartitionByRange(files, "symbol", "interval", "ts").sortWithinPartitions("symbol", "interval", "ts").write.parquet(hidden)
    fs, p = _fs(spark, f"{hidden}/_merged")
    out = fs.create(p, True)
    out.write(bytearray("".join(f"{n}\t{r}\n" for r, n in old).encode()))
    out.close()
    fs.mkdirs(_fs(spark, f"{path}/run={RUN}")[1])
    if not fs.rename(_fs(spark, hidden)[1], _fs(spark, f"{path}/run={RUN}/batch_id={number}")[1]):
        raise OSError(f"cannot rename {hidden}")
    clean(spark, path)
    return True


def without_merged(df: DataFrame, path: str) -> DataFrame:
    """Rows (with run and batch_id) of folders that no compacted folder holds."""
    gone = merged(df.sparkSession, path)
    for run in sorted({r for r, _ in gone}):
        df = df.where(~((F.col("run") == run) & F.col("batch_id").isin([n for r, n in gone if r == run])))
    return df
