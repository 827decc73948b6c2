"""Bars (OHLCV candles) from ticks, and the candle-store operations S01-S05, S13, S14.

Candle schema: symbol string, interval string, ts timestamp_ntz (bar open), ts_ms bigint,
open/high/low/close/volume double. Natural key (symbol, interval, ts).
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from kandle.functions.intervals import epoch_ms, epoch_us, interval_seconds, ntz_from_ms, ntz_from_us

BAR_COLS = ["symbol", "interval", "ts", "ts_ms", "open", "high", "low", "close", "volume"]


def bars_from_ticks(ticks: DataFrame, symbol: Column, ts: Column, price: Column, qty: Column,
                    interval: str = "30") -> DataFrame:
    """Tumbling OHLCV bars. One map-side-combined aggregation keyed by (symbol, bucket):
    a hot symbol's ticks spread over its buckets, and partial aggregation runs before the shuffle."""
    sec = interval_seconds(F.lit(interval))
    t = ticks.select(symbol.alias("symbol"), ts.alias("_ts"), price.cast("double").alias("_p"),
                     qty.cast("double").alias("_q"))
    bucket_us = F.floor(epoch_us("_ts") / (sec * 1_000_000)) * (sec * 1_000_000)
    t = t.withColumn("_b", bucket_us.cast("bigint"))
    g = t.groupBy("symbol", "_b").agg(
        # of ticks with one timestamp the lowest price opens and the highest closes: the same bar on every run
        F.min(F.struct("_ts", "_p"))["_p"].alias("open"), F.max("_p").alias("high"), F.min("_p").alias("low"),
        F.max(F.struct("_ts", "_p"))["_p"].alias("close"), F.sum("_q").alias("volume"))
    return g.select("symbol", F.lit(interval).alias("interval"), ntz_from_us(F.col("_b")).alias("ts"),
                    (F.col("_b") / 1000).cast("bigint").alias("ts_ms"), "open", "high", "low", "close", "volume")


def bars_from_events(events: DataFrame, interval: str = "30") -> DataFrame:
    """Test-data adapter: symbol = event_type, price = value, volume = value (FIXTURES.md)."""
    return bars_from_ticks(events, F.col("event_type"), F.col("ts"), F.col("value"), F.col("value"), interval)


def user_daily_bars(events: DataFrame) -> DataFrame:
    """Many-series variant: symbol = user_id, daily bars."""
    return bars_from_ticks(events, F.col("user_id").cast("string"), F.col("ts"), F.col("value"), F.col("value"), "D")


def scan_candles(bars: DataFrame, symbol: str | None = None, interval: str | None = None,
                 start_ms: int | None = None, end_ms: int | None = None, limit: int | None = None,
                 must_exist: bool = False) -> DataFrame:
    """Equality on symbol + interval, inclusive ts range (pushed to the parquet scan); ordered by ts and
    cut to the first ``limit`` rows if given. ``must_exist``: no row is an error (one row is looked for)."""
    c = F.lit(True)
    if symbol is not None:
        c = c & (F.col("symbol") == symbol)
    if interval is not None:
        c = c & (F.col("interval") == interval)
    if start_ms is not None:
        c = c & (F.col("ts") >= ntz_from_ms(F.lit(start_ms)))
    if end_ms is not None:
        c = c & (F.col("ts") <= ntz_from_ms(F.lit(end_ms)))
    found = bars.where(c)
    if must_exist and found.isEmpty():
        raise ValueError(f"no candles of {symbol} {interval} between {start_ms} and {end_ms}")
    return found if limit is None else found.orderBy("ts", "symbol", "interval").limit(limit)


def scan_requests(bars: DataFrame, requests: DataFrame) -> DataFrame:
    """S01 batch form / J02: a table of (symbol, interval, start_ms, end_ms[, req_id]) range-joined
    to the bars, both ends inclusive: a binned interval join, so that a hot series is many tasks."""
    from kandle.operators.interval_join import interval_join
    return interval_join(bars, requests, ["symbol", "interval"], epoch_ms("ts"), F.col("start_ms"), F.col("end_ms")).select(
        *bars.columns, *[c for c in requests.columns if c not in ("symbol", "interval")])


# The base columns of a candle.
BASE_COLS = ["open", "high", "low", "close", "volume", "turnover"]


def base_columns(df: DataFrame, keys=("symbol", "interval")) -> DataFrame:
    """Series, time and the base columns that are there; indicators, flags and helpers go."""
    return df.select(*keys, *[c for c in ("ts", "ts_ms", *BASE_COLS) if c in df.columns])


def first_n(bars: DataFrame, n: int, keys=("symbol", "interval")) -> DataFrame:
    """T01 per series: the first n bars by ts (WindowGroupLimit keeps it a per-partition top-k)."""
    w = Window.partitionBy(*keys).orderBy("ts")
    return bars.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def last_n(bars: DataFrame, n: int, keys=("symbol", "interval")) -> DataFrame:
    """The last n bars per series."""
    w = Window.partitionBy(*keys).orderBy(F.col("ts").desc())
    return bars.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def append_new(existing: DataFrame, batch: DataFrame, keys=("symbol", "interval", "ts")) -> DataFrame:
    """Rows of ``batch`` whose key is not stored yet (the rows to append). The batch is
    de-duplicated on the key first (keeping the latest-arriving copy is not defined; we keep any
    one deterministic row: max by all columns) - a stated difference from the reference."""
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in batch.columns if c not in keys])
    b = batch.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
    return b.join(existing.select(*keys), list(keys), "left_anti")


def latest_ts(bars: DataFrame, series: DataFrame) -> DataFrame:
    """Latest epoch-ms per requested series, 0 if none."""
    m = bars.groupBy("symbol", "interval").agg(F.max("ts_ms").alias("latest_ms"))
    return series.join(m, ["symbol", "interval"], "left").select(
        "symbol", "interval", F.coalesce("latest_ms", F.lit(0)).cast("bigint").alias("latest_ms"))


def first_candle(bars: DataFrame) -> DataFrame:
    """The first candle per series."""
    cols = [c for c in BAR_COLS if c not in ("symbol", "interval")]
    g = bars.groupBy("symbol", "interval").agg(F.min_by(F.struct(*cols), "ts").alias("f"))
    return g.select("symbol", "interval", "f.*")


def backfill_plan(latest: DataFrame, now_ms: int, batch: int = 1000) -> DataFrame:
    """Which [start, end] batches of ``batch`` candles each series still lacks, from its
    latest stored ts up to ``now_ms``. A series with nothing stored (latest 0) starts at its ``first_ms``,
    a column of ``latest`` that then must be there; gaps inside the stored rows: ``gap_plan``."""
    step_ms = interval_seconds("interval") * 1000
    start = F.col("latest_ms") + step_ms
    if "first_ms" in latest.columns:
        start = F.when(F.col("latest_ms") > 0, start).otherwise(F.col("first_ms"))
    else:
        start = F.when(F.col("latest_ms") > 0, start).otherwise(
            F.raise_error(F.concat(F.lit("nothing stored and no first_ms for "), "symbol")).cast("bigint"))
    n_missing = F.when(F.lit(now_ms) >= start, F.floor((F.lit(now_ms) - start) / step_ms) + 1).otherwise(0)
    b = latest.withColumn("_step", step_ms).withColumn("expected", n_missing.cast("bigint"))
    b = b.where(F.col("expected") > 0)
    b = b.withColumn("batch_no", F.explode(F.sequence(F.lit(0).cast("bigint"),
                                                       F.floor((F.col("expected") - 1) / batch).cast("bigint"))))
    return b.select("symbol", "interval", "expected", "batch_no",
                    (start + F.col("batch_no") * batch * F.col("_step")).alias("start_ms"),
                    F.least(start + (F.col("batch_no") * batch + batch - 1) * F.col("_step"),
                            start + (F.col("expected") - 1) * F.col("_step")).alias("end_ms"))


def gap_plan(bars: DataFrame, batch: int = 1000, keys=("symbol", "interval")) -> DataFrame:
    """Batches of missing candles between stored neighbours: start_ms, end_ms (both inclusive)."""
    from kandle.operators.layout import on_layout
    step = interval_seconds("interval") * 1000
    prev = on_layout(bars.select(*keys, "ts", "ts_ms"), lambda d, w: d.withColumn("_prev", F.lag("ts_ms").over(w)), list(keys), look_back=1)
    gaps = prev.withColumn("_step", step).where(F.col("ts_ms") - F.col("_prev") > F.col("_step"))
    n = F.floor((F.col("ts_ms") - F.col("_prev")) / F.col("_step") - 1)
    at = F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((n - 1) / batch).cast("bigint")))
    g = gaps.select(*keys, "_prev", "ts_ms", "_step", at.alias("k"))
    start = F.col("_prev") + F.col("_step") * (1 + F.col("k") * batch)
    return g.select(*keys, start.cast("bigint").alias("start_ms"),
                    F.least(start + F.col("_step") * (batch - 1), F.col("ts_ms") - F.col("_step")).cast("bigint").alias("end_ms"))
