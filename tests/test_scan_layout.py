import math
import random
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from kandle.operators.indicators import INDICATOR_COLS, indicator_table


def walk_bars(spark, n, seed=5, symbols=("A",)):
    rows = []
    for s in symbols:
        rnd = random.Random(seed + zlib.crc32(s.encode()) % 100)
        px = 100.0
        for i in range(n):
            o = px
            c = o * (1 + rnd.gauss(0, 0.01))
            h, l = max(o, c) * (1 + abs(rnd.gauss(0, 0.004))), min(o, c) * (1 - abs(rnd.gauss(0, 0.004)))
            ts = 1704067200000 + i * 1800000
            rows.append((s, "30", ts, o, h, l, c, 1000.0 + rnd.random() * 500))
            px = c
    df = spark.createDataFrame(rows, "symbol string, interval string, ts_ms long, open double, high double, low double, "
                                     "close double, volume double")
    return df.withColumn("ts", F.timestamp_millis("ts_ms").cast("timestamp_ntz"))


def test_scans_match_pandas(spark):
    pdf = indicator_table(walk_bars(spark, 600), supertrend=False).orderBy("ts").toPandas()
    c = pdf.close
    # EMA: SMA-seeded, then ewm(adjust=False)
    for n in (9, 200):
        x = c.copy()
        sma = x[:n].mean()
        x[: n - 1] = np.nan
        x.iloc[n - 1] = sma
        want = x.ewm(span=n, adjust=False).mean()
        np.testing.assert_allclose(pdf[f"EMA_{n}"].to_numpy(dtype=float), want.to_numpy(), rtol=1e-11, equal_nan=True)
    # EWM(200) of close, seeded with the first value
    np.testing.assert_allclose(pdf.EMA_TREND, c.ewm(span=200, adjust=False).mean(), rtol=1e-11)
    # ATR: RMA(14) of the true range = ewm(alpha=1/14, adjust=True, min_periods=14)
    pc = c.shift(1)
    tr = pd.concat([pdf.high - pdf.low, (pdf.high - pc).abs(), (pc - pdf.low).abs()], axis=1).max(axis=1)
    tr.iloc[0] = np.nan
    atr = tr.ewm(alpha=1 / 14, min_periods=14).mean()
    np.testing.assert_allclose(pdf.ATR.to_numpy(dtype=float), atr.to_numpy(), rtol=1e-11, equal_nan=True)
    # RSI in [0, 100], no null in the last 30 rows
    tail = pdf.tail(30)
    assert tail[INDICATOR_COLS].notna().all().all()
    assert pdf.RSI.dropna().between(0, 100).all()


def test_multi_part_layout_equals_single_part(spark):
    """A long series cut into time parts with halo rows gives the single-part results."""
    bars = walk_bars(spark, 80000, seed=11)
    cols = ["EMA_9", "EMA_200", "ATR", "RSI", "MACD", "Signal", "ADX", "TEMA_21", "BBM", "CCI", "MFI", "StochRSI_D",
            "SUPERTREND", "SMART_SIGNAL", "smart_trend"]
    one = indicator_table(bars).select("ts_ms", *cols).toPandas().sort_values("ts_ms").reset_index(drop=True)
    many = indicator_table(bars, part_rows=32768, halo=32768).select("ts_ms", *cols).toPandas() \
        .sort_values("ts_ms").reset_index(drop=True)
    assert len(one) == len(many) == 80000
    for col in cols:
        np.testing.assert_allclose(many[col].to_numpy(dtype=float), one[col].to_numpy(dtype=float),
                                   rtol=1e-9, atol=1e-9, equal_nan=True, err_msg=col)


def test_sparse_and_empty_parts_equal_one_part(spark):
    """A bar in 100 slots: parts of few rows, look-back over many of them."""
    bars = walk_bars(spark, 1600, seed=3)
    bars = bars.withColumn("ts_ms", 1704067200000 + (F.col("ts_ms") - 1704067200000) * 100)
    bars = bars.where("ts_ms % 7200000000 < 3600000000 OR ts_ms > 1718000000000").withColumn("ts", F.timestamp_millis("ts_ms").cast("timestamp_ntz"))
    cols = ["EMA_9", "EMA_200", "EMA_TREND", "ATR", "RSI", "MACD", "Signal", "ADX", "BBM", "SUPERTREND", "smart_trend"]
    one = indicator_table(bars).select("ts_ms", *cols).toPandas().sort_values("ts_ms").reset_index(drop=True)
    many = indicator_table(bars, part_rows=2048, halo=32768).select("ts_ms", *cols).toPandas().sort_values("ts_ms").reset_index(drop=True)
    assert len(one) == len(many) > 1000
    for col in cols:
        np.testing.assert_allclose(many[col].to_numpy(dtype=float), one[col].to_numpy(dtype=float),
                                   rtol=1e-9, atol=1e-9, equal_nan=True, err_msg=col)


def _states(rng):
    level = rng.choice([rng.uniform(80, 120), 100.0, float("nan")])
    return level, level - rng.uniform(0, 30), bool(rng.random() < 0.5)


def test_ratchet_state_maps_are_exact():
    """A run of bars as a map of its start state equals stepping through it, for any start; maps compose."""
    from kandle.operators.indicators import _apply, _ratchet, _state_map
    rng = random.Random(12)
    for case in range(400):
        n = rng.randint(1, 40)
        quiet = rng.choice([0.01, 1.0, 8.0])
        close = np.array([100 + rng.gauss(0, quiet) for _ in range(n + 1)]).round(rng.choice([0, 1, 9]))
        width = np.abs(np.array([rng.choice([0.5, 2.0, 20.0]) for _ in range(n + 1)]))
        if rng.random() < 0.2:
            width[rng.randrange(n + 1)] = np.nan
        upper, lower = close + width, close - width
        cut = rng.randint(1, n)
        whole = _state_map(close[1:], upper[1:], lower[1:], upper[0], lower[0])
        a = _state_map(close[1:cut], upper[1:cut], lower[1:cut], upper[0], lower[0]) if cut > 1 else None
        b = _state_map(close[cut:], upper[cut:], lower[cut:], upper[cut - 1], lower[cut - 1])
        for _ in range(25):
            x, rising = rng.choice([rng.uniform(70, 130), *close[:3], *lower[:3], *upper[:3]]), rng.random() < 0.5
            start = (upper[0], x, True) if rising else (x, lower[0], False)
            want = _ratchet(close[1:], upper[1:], lower[1:], start)[2]
            np.testing.assert_array_equal(_apply(whole, start), want)
            mid = _apply(a, start) if a else start
            np.testing.assert_array_equal(_apply(b, mid), want)
        assert len(whole) < 60


def test_supertrend_over_a_quiet_series_equals_one_part(spark):
    """After an early fall nothing crosses a band for 70,000 rows: the direction of the first rows holds in every later part."""
    n = 70000
    base = spark.range(n).select(F.lit("A").alias("symbol"), F.lit("30").alias("interval"), (1704067200000 + F.col("id") * 1800000).alias("ts_ms"), "id")
    px = F.when(F.col("id") < 40, 100.0).when(F.col("id") < 60, 100.0 - (F.col("id") - 40) * 4).otherwise(20.0 + (F.col("id") % 2) * 0.01)
    bars = base.select("symbol", "interval", "ts_ms", F.timestamp_millis("ts_ms").cast("timestamp_ntz").alias("ts"), px.alias("open"),
                       (px + 0.5).alias("high"), (px - 0.5).alias("low"), px.alias("close"), F.lit(5.0).alias("volume"))
    from kandle.operators.indicators import with_supertrend_narrow
    from kandle.operators.layout import drop_halo, layout
    one = drop_halo(with_supertrend_narrow(layout(bars))).select("ts_ms", "SUPERTREND", "SUPERTd").toPandas().sort_values("ts_ms")
    many = drop_halo(with_supertrend_narrow(layout(bars, part_rows=4096, halo=1024))).select("ts_ms", "SUPERTREND", "SUPERTd").toPandas().sort_values("ts_ms")
    assert (one["SUPERTd"].to_numpy()[100:] == -1).all() and len(many) == n
    assert (many["SUPERTd"].to_numpy() == one["SUPERTd"].to_numpy()).all()
    np.testing.assert_allclose(many["SUPERTREND"].to_numpy(float), one["SUPERTREND"].to_numpy(float), rtol=1e-9, equal_nan=True)
