"""Carried state of the live path (D04): what scoring the next bars of a series needs of its past.

A row per series: the last ``TAIL`` bars, the number of bars so far and the supertrend ratchet's state after the last one.
Frames and lags look back over fewer bars than that, smoothed values forget theirs (the slowest decays to 1e-20 of its weight
within the tail), and the ratchet, which need not forget anything, is carried exactly. So a micro-batch reads its new bars and the carries of
the series it touches, never their history.

Carries lie in a fixed number of buckets of series; a batch reads the buckets it touches and writes each as a new version,
``bucket=<b>/v=<number>-<batch>-<run>``. A batch that runs again finds the version before its own and writes its own anew. Versions before
the last two are deleted, so the folder holds at most two per bucket.
"""
from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from kandle.operators.fold import fold_chunks
from kandle.operators.indicators import _bars, _ratchet, with_atr10, with_indicators
from kandle.operators.layout import KEYS, layout
from kandle.operators.signals import with_flags, with_scores
from kandle.sources.scratch import materialize

TAIL = 8192
BUCKETS = 64
BAR = ["ts_ms", "open", "high", "low", "close", "volume"]
SCHEMA = T.StructType.fromDDL("symbol string, interval string, n long, top double, bottom double, rising boolean, "
                              "tail array<struct<ts_ms: bigint, open: double, high: double, low: double, close: double, volume: double>>")


def _bucket():
    return F.pmod(F.xxhash64(*KEYS), F.lit(BUCKETS))


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _versions(spark: SparkSession, path: str, bucket: int) -> list[tuple[int, str, str]]:
    """(number, batch-run, folder) of a bucket's finished versions, ascending."""
    fs, p = _fs(spark, f"{path}/bucket={bucket}")
    if not fs.exists(p):
        return []
    out = []
    for s in fs.listStatus(p):
        name = s.getPath().getName()
        if name.startswith("v=") and fs.exists(_fs(spark, f"{path}/bucket={bucket}/{name}/_SUCCESS")[1]):
            number, rest = name[2:].split("-", 1)
            out.append((int(number), rest, f"{path}/bucket={bucket}/{name}"))
    return sorted(out)


def read(spark: SparkSession, path: str, buckets: list[int], run: str, batch_id: int) -> tuple[DataFrame, dict[int, int]]:
    """Carries of the buckets as they were before (run, batch_id), and the number of the version that the batch writes in each."""
    mine, folders, numbers = f"{batch_id}-{run}", [], {}
    for b in buckets:
        versions = _versions(spark, path, b)
        own = [v for v in versions if v[1] == mine]
        before = [v for v in versions if v[1] != mine and (not own or v[0] < own[0][0])]
        numbers[b] = own[0][0] if own else (versions[-1][0] + 1 if versions else 0)
        if before:
            folders.append(before[-1][2])
    return (spark.read.schema(SCHEMA).parquet(*folders) if folders else spark.createDataFrame([], SCHEMA)), numbers


def write(carry: DataFrame, path: str, numbers: dict[int, int], run: str, batch_id: int) -> None:
    spark = carry.sparkSession
    carry = materialize(carry.withColumn("_b", _bucket()), "carry")
    for b, number in numbers.items():
        carry.where(F.col("_b") == b).drop("_b").write.mode("overwrite").parquet(f"{path}/bucket={b}/v={number}-{batch_id}-{run}")
        for old in _versions(spark, path, b)[:-2]:
            fs, p = _fs(spark, old[2])
            fs.delete(p, True)


def forget(series: DataFrame, path: str, run: str, batch_id: int) -> None:
    """Drop the carries of ``series``: their past has changed, and the next batch takes it from the store."""
    spark = series.sparkSession
    buckets = [r[0] for r in series.select(_bucket().alias("b")).distinct().collect()]  # at most BUCKETS
    held, numbers = read(spark, path, buckets, run, batch_id)
    write(held.join(series, KEYS, "left_anti").select(*SCHEMA.names), path, numbers, run, batch_id)


def _ratchet_rows(rows: DataFrame) -> DataFrame:
    """New bars (with ``_atr10`` and the state before the first of them, if any) -> SUPERTREND, SUPERTd and the state after each."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        first = pdf.iloc[0]
        state = None if pd.isna(first["rising"]) else (first["top"], first["bottom"], bool(first["rising"]))
        close, upper, lower = _bars(pdf)
        out = pdf[[*KEYS, "ts_ms"]].copy()
        line, way, states = [], [], []
        for t in range(len(pdf)):  # a bar at a time, as the state after each is wanted
            one, direction, state = _ratchet(close[t:t + 1], upper[t:t + 1], lower[t:t + 1], state)
            line.append(one[0])
            way.append(direction[0])
            states.append(state)
        out["SUPERTREND"], out["SUPERTd"] = line, np.array(way, np.int32)
        out["top"], out["bottom"], out["rising"] = zip(*states)
        return out

    return fold_chunks(rows, KEYS, "rn", run, T.StructType([*[rows.schema[k] for k in KEYS], *T.StructType.fromDDL(
        "ts_ms long, SUPERTREND double, SUPERTd int, top double, bottom double, rising boolean").fields]))


def score(new: DataFrame, carry: DataFrame, params: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """(scored new bars, carries after them). ``new``: bars later than their series' carried ones; a series without a carry
    begins with them."""
    own = new.select(*KEYS, "ts", *BAR).withColumn("is_new", F.lit(True))
    tail = carry.select(*KEYS, F.explode("tail").alias("b")).select(*KEYS, F.timestamp_millis("b.ts_ms").cast("timestamp_ntz").alias("ts"), "b.*").withColumn("is_new", F.lit(False))
    touched = new.select(*KEYS).distinct()
    rows = materialize(own.unionByName(tail.join(touched, KEYS, "left_semi")), "live-rows")
    lay = materialize(with_atr10(layout(rows, KEYS), KEYS), "live-layout")
    fresh = lay.where("is_new AND NOT is_halo").join(carry.select(*KEYS, "top", "bottom", "rising"), KEYS, "left")
    trend = materialize(_ratchet_rows(fresh), "live-ratchet")
    with_trend = lay.join(trend.select(*KEYS, "ts_ms", "SUPERTREND", "SUPERTd"), [*KEYS, "ts_ms"], "left")
    df = with_flags(with_indicators(with_trend, KEYS)).where("is_new AND NOT is_halo")
    last = trend.groupBy(*KEYS).agg(F.max_by(F.struct("top", "bottom", "rising"), "ts_ms").alias("s"))
    bars = rows.groupBy(*KEYS).agg(F.sort_array(F.collect_list(F.struct(*BAR))).alias("tail"), F.sum(F.col("is_new").cast("long")).alias("more"))
    after = bars.join(last, KEYS).join(carry.select(*KEYS, "n"), KEYS, "left").select(
        *KEYS, (F.coalesce("n", F.lit(0)) + F.col("more")).alias("n"), "s.top", "s.bottom", "s.rising", F.expr(f"slice(tail, greatest(size(tail) - {TAIL} + 1, 1), {TAIL})").alias("tail"))
    untouched = carry.join(touched, KEYS, "left_anti").select(*SCHEMA.names)
    return with_scores(df, params), after.select(*SCHEMA.names).unionByName(untouched)
