import pandas as pd
import pytest
from pyspark.sql import functions as F

from kandle.operators import retune as RT, walkforward as WF
from kandle.operators.replay import DEFAULTS
from kandle.operators.signals import LONG_SIGNALS, SHORT_SIGNALS, signal_table
from kandle.operators.tuning import best_params, loss_table, param_table, score_params
from test_scan_layout import walk_bars
from test_walkforward import window_by_rows

TRADE = {"tp_pct": 0.02, "sl_pct": 0.015}
ON = ("volatility_breakout", "volume_above_avg")
THRESHOLDS = [(1, 1), (2, 9), (9, 1)]


def settings(spark):
    weights = {f"w_{s}": F.lit(1.0 if s in ON else 0.0) for s in dict.fromkeys([*LONG_SIGNALS, *SHORT_SIGNALS])}
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(THRESHOLDS)]
    return spark.createDataFrame(rows, "param_id long, long_score_threshold double, short_score_threshold double").withColumns(
        {**weights, "use_smart_trend_filter": F.lit(False)})


def answer(n):
    """A made-up tuner: what it finds on n training rows; none on many."""
    return None if n % 7 in (0, 1, 2, 3) else n % 3


def fake_tuner(rows):
    n = F.max("rn") + 1
    return rows.groupBy("symbol", "interval", "request").agg(
        F.when(n % 7 > 3, n % 3).cast("long").alias("param_id"))


@pytest.fixture(scope="module")
def data(spark):
    bars = walk_bars(spark, 560, seed=9, symbols=("A", "B")).where("ts_ms % 97 <> 0 AND NOT (symbol = 'B' AND ts_ms > 1704067200000 + 400 * 1800000L)").cache()
    return bars, signal_table(bars).cache()


def step_through(flags, win, first, last, step, initial=1000.0):
    p = {**DEFAULTS, **TRADE}
    rows = flags.join(win, ["symbol", "interval", "ts_ms"]).toPandas().sort_values("rn")
    out = []
    for symbol, s in rows.groupby("symbol"):
        balance, param, span = initial, None, first
        for wid, w in s[s["window_id"] >= 0].groupby("window_id"):
            n = int(w["rn"].min())
            if param is None:
                param = answer(n)
                while param is None and span < last:
                    span = min(span + step, last)
                    param = answer(min(span, len(s)))
                if param is None:
                    span = first
                    continue
            lt, st = THRESHOLDS[param]
            w = w.assign(long_entry=w["long_volatility_breakout"] + w["long_volume_above_avg"] >= lt, short_entry=w["short_volatility_breakout"] >= st)
            r = window_by_rows(w, balance, p)
            if r["balance"] < 500:
                break
            balance = r["balance"]
            restart = r["final_state_balance"] < 900 or r["total_trades"] == 0 or r["winrate"] < 0.4
            out.append((symbol, int(wid), param, round(r["balance"], 6), r["total_trades"], restart))
            if restart:
                param = answer(n)
    return out


@pytest.mark.parametrize("ahead, tune_ahead, spans", [(16, 4, (150, 300, 50)), (3, 1, (150, 250, 100))])
def test_waves_equal_one_series_after_the_other(spark, data, ahead, tune_ahead, spans):
    bars, flags = data
    runs, tunings = RT.retune_waves(bars, flags, settings(spark), fake_tuner, 150, spans, TRADE, ahead=ahead, tune_ahead=tune_ahead)
    win = WF.assign_windows(bars.select("symbol", "interval", "ts", "ts_ms"), 150).drop("ts")
    first, last, step = spans
    want = step_through(flags, win, first, last, step)
    got = sorted((r["symbol"], r["window_id"], r["param_id"], round(r["balance"], 6), r["total_trades"], r["triggered_restart"]) for r in runs.collect())
    assert got == sorted(want) and len(got) > 3
    assert ahead < 16 or len({g[2] for g in got}) > 1  # settings change on the way
    assert runs.agg(F.max("wave")).first()[0] >= 1 and tunings.count() >= 2


def test_no_window_at_all(spark, data):
    bars, flags = data
    runs, tunings = RT.retune_waves(bars, flags, settings(spark), fake_tuner, 10 ** 5)
    assert runs.collect() == [] and tunings.collect() == [] and "triggered_restart" in runs.columns


def test_loss_tuner_is_the_tuning_job(spark, data):
    """Requests of one series are tuned apart, with the result of G01-G05 on the same rows."""
    bars, flags = data
    params = param_table(spark, 2).cache()
    asked = flags.where("symbol = 'A' AND rn < 260").withColumn("request", F.lit(0).cast("long")).unionByName(
        flags.where("symbol = 'A' AND rn < 340").withColumn("request", F.lit(3).cast("long")))
    got = {(r["symbol"], r["request"]): r["param_id"] for r in RT.loss_tuner(params, reject=False)(asked).collect()}
    for request, n in ((0, 260), (3, 340)):
        part = flags.where(f"symbol = 'A' AND rn < {n}").select(*bars.columns)
        assert got["A", request] == best_params(loss_table(score_params(part, params)), params).first()["param_id"]
