import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from kandle.operators import walkforward as WF
from kandle.operators.fold import fold_carried, fold_chunks
from kandle.operators.replay import DEFAULTS
from kandle.operators.signals import signal_table, with_scores
from test_scan_layout import walk_bars

TRADE = {"tp_pct": 0.02, "sl_pct": 0.01}
VB = {"enabled_long_signals": ["volatility_breakout", "volume_above_avg"], "enabled_short_signals": ["volatility_breakout"],
      "long_score_threshold": 1, "short_score_threshold": 1}


def window_by_rows(bars: pd.DataFrame, balance: float, p: dict, initial=1000.0) -> dict:
    """One window bar by bar, as a trader would step through it."""
    risk = 0.2 if balance <= 0 else min(max(0.05 * initial / balance, 0.01), 0.2)
    state, side, entry, qty, pnl, n, wins = balance, 0, 0.0, 0.0, 0.0, 0, 0

    def leave(price):
        nonlocal state, side, pnl, n, wins
        got = side * (price - entry) * qty - price * qty * p["fee"]
        state, pnl, n, wins, side = state + got, pnl + got, n + 1, wins + (got > 0), 0

    for b in bars.itertuples():
        if side:
            up, down = entry * (1 + side * p["tp_pct"]), entry * (1 - side * p["sl_pct"])
            if side * (b.high if side > 0 else b.low) >= side * up:
                leave(up)
                continue
            if side * (b.low if side > 0 else b.high) <= side * down:
                leave(min(b.open, down) if side > 0 else max(b.open, down))
                continue
        elif b.long_entry or b.short_entry:
            side, entry = (1 if b.long_entry else -1), b.close
            qty = state * risk * p["leverage"] / p["sl_pct"] / entry
            state -= qty * entry * p["fee"]
    if side and qty > 0:
        leave(bars["close"].iloc[-1])
    return {"risk_pct": risk, "pnl": pnl, "total_trades": n, "winrate": wins / n if n else 0.0, "final_state_balance": state, "balance": balance + pnl}


@pytest.fixture(scope="module")
def scored(spark):
    bars = walk_bars(spark, 700, seed=4, symbols=("A", "B")).where("ts_ms % 91 <> 0").cache()
    return bars, with_scores(signal_table(bars), VB).cache()


@pytest.mark.parametrize("chunk_trades", [WF.CHUNK_TRADES, 120])
def test_walk_forward_equals_stepping_through_rows(scored, chunk_trades):
    """The runs, with all windows in one chunk and with a wave for every two windows."""
    bars, sc = scored
    p = {**DEFAULTS, **TRADE}
    got = WF.walk_forward(bars, sc, 150, params=TRADE, chunk_trades=chunk_trades).toPandas().sort_values(["symbol", "window_id"])
    win = WF.assign_windows(bars.select("symbol", "interval", "ts", "ts_ms"), 150).drop("ts")
    rows = sc.join(win, ["symbol", "interval", "ts_ms"]).where("window_id >= 0").toPandas().sort_values("rn")
    want = []
    for symbol, s in rows.groupby("symbol"):
        balance = 1000.0
        for wid, w in s.groupby("window_id"):
            r = window_by_rows(w, balance, p)
            if r["balance"] < 500:
                break
            balance = r["balance"]
            restart = r["final_state_balance"] < 900 or r["total_trades"] == 0 or r["winrate"] < 0.4
            want.append({"symbol": symbol, "window_id": wid, **r, "triggered_restart": restart})
    want = pd.DataFrame(want).sort_values(["symbol", "window_id"])
    assert len(got) == len(want) > 10 and got["triggered_restart"].nunique() == 2
    for c in want.columns:
        a, b = got[c].to_numpy(), want[c].to_numpy()
        assert np.allclose(a.astype(float), b.astype(float), rtol=1e-9) if c != "symbol" else (a == b).all(), c
    assert (got["retrained"] == (got["pnl"] <= 0)).all() and (got["loss"] == -got["winrate"]).all()


def test_cut_off(scored):
    """A window that ends after ``now`` is not evaluated."""
    bars, sc = scored
    whole = WF.walk_forward(bars, sc, 150, params=TRADE).agg(F.max("window_id")).first()[0]
    now = bars.agg(F.max("ts_ms")).first()[0] - 100 * 1800000
    assert 0 < WF.walk_forward(bars, sc, 150, now_ms=now, params=TRADE).agg(F.max("window_id")).first()[0] < whole


def test_a_fold_of_ones_own(spark):
    """a running sum that is reset above 50, in chunks of 7 rows, in waves; a start state; a series without rows."""
    rows = spark.range(100).select(F.when(F.col("id") % 3 == 0, "a").when(F.col("id") % 3 == 1, "b").alias("k"), (F.col("id") * 7 % 13).alias("v"), "id",
                                   F.floor(F.col("id") / 21).alias("chunk")).where("NOT (k = 'b' AND chunk = 2)")

    def step(pdf, state):
        total, out = 0 if state is None else int(state["total"]), []
        for i, v in zip(pdf["id"], pdf["v"]):
            total = 0 if total > 50 else total + int(v)
            out.append({"id": i, "sum": total})
        return pd.DataFrame(out), {"total": total}

    start = spark.createDataFrame([("a", 40), ("z", 9)], "k string, total long")
    got, states = fold_carried(rows, ["k"], "chunk", "id", step, "id long, sum long", "total long", start)
    want, last = {}, {"a": 40, "z": 9}
    for r in sorted(rows.collect(), key=lambda r: r["id"]):
        t = last.get(r["k"], 0)
        last[r["k"]] = want[r["id"]] = 0 if t > 50 else t + r["v"]
    assert {r["id"]: r["sum"] for r in got.collect()} == want
    assert {r["k"]: r["total"] for r in states.collect()} == last
    empty, none = fold_carried(rows.limit(0), ["k"], "chunk", "id", step, "id long, sum long", "total long")
    assert empty.collect() == [] and none.collect() == []
    sums = fold_chunks(rows, ["k", "chunk"], "id", lambda pdf: pdf.assign(s=pdf["v"].cumsum())[["id", "s"]], "id long, s long")
    assert sums.count() == rows.count()
