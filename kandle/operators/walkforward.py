"""Walk-forward evaluation (G06-G10, G12, G13, A04, A05) as table jobs.

Re-aimed from the reference's per-symbol loop:
* G06 windows: the first ``train_bars`` rows train; each test window is
  [anchor + interval, anchor + step*interval] (both ends inclusive), and the next anchor is the
  last *present* bar of that window (re-anchoring over gaps): a pointer chain over bars.
* G08: indicators are causal and start at the first candle, so one pass over each series gives
  the same values as the reference's recompute of train + test per window.
* G09: one replay over all (series, window) segments at unit balance yields every trade's
  price return; the balance <-> risk feedback (risk from the balance, window pnl without entry
  fees, stop below 500) is a fold over the windows' trade returns, never over bars.
* G10 restart flag: final balance < 0.9 * initial, or no trade, or winrate < 0.4 (a no-trade
  window has winrate 0, so the reference's two-window counter never gets to matter).
Re-tuning on restart (G11) is in ``kandle.operators.retune``; here the flag is reported.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from kandle.functions.intervals import interval_seconds
from kandle.operators.chain import CHUNK, first_entry_after, follow_chain, last_marker_before
from kandle.operators.fold import fold_carried
from kandle.operators.layout import on_layout
from kandle.operators.replay import DEFAULTS, replay
from kandle.sources.scratch import materialize

# Fixed values that must equal the reference's walk-forward settings.
TRAIN_BARS = 1000
DAY_MINUTES = 24 * 60
RUIN_BALANCE = 500.0
RESTART_BALANCE_FRAC = 0.9
RESTART_WINRATE = 0.4
INV_BASE, INV_MAX, INV_MIN = 0.05, 0.20, 0.01


def assign_windows(bars: DataFrame, train_bars: int = TRAIN_BARS, now_ms: int | None = None,
                   keys=("symbol", "interval"), chunk: int = CHUNK) -> DataFrame:
    """window_id per bar (-1 = initial train rows, NULL = after the last window), without any
    per-series task: rn from the part layout; next anchor of every bar = (first bar with ts > ts + step +
    interval) - 1 per bounded time chunk; anchors = the chain from bar train_bars-1 with hop counts
    (= window ids); each bar's window = the hop count of the last anchor before it."""
    k = list(keys)
    d_ms = interval_seconds("interval") * 1000
    span = (F.floor(F.lit(DAY_MINUTES * 60) / interval_seconds("interval")) + 1) * d_ms
    b = on_layout(bars.select(*k, "ts", "ts_ms"), lambda df, w: df, k).select(*k, "ts_ms", "rn") \
        .withColumns({"_span": span, "_d": d_ms})
    b = materialize(b, "window-bars")
    last = b.groupBy(*k).agg(F.max("rn").alias("last_rn"))
    cand = b.where(F.col("rn") >= train_bars - 1)
    chunk_ms = CHUNK * 1000 * interval_seconds("interval")  # the time of about CHUNK bars
    nx = first_entry_after(b.select(*k, F.col("ts_ms").alias("pos"), F.col("rn").alias("eid")),
                           cand.select(*k, F.col("rn").alias("pid"), (F.col("ts_ms") + F.col("_span")).alias("x")),
                           k, lambda pos: F.floor(pos / chunk_ms))
    nodes = nx.join(last, k).select(*k, F.col("pid").alias("id"),
                                    F.coalesce(F.col("nxt_id") - 1, F.col("last_rn")).alias("end"))
    if now_ms is not None:  # G07: a window whose end time is after now is not evaluated
        ends = cand.select(*k, F.col("rn").alias("id"), (F.col("ts_ms") + F.col("_span")).alias("_end_ms"))
        nodes = nodes.join(ends, [*k, "id"]).where(F.col("_end_ms") <= now_ms).drop("_end_ms")
    nodes = materialize(nodes.withColumn("nxt", F.when(F.col("end") > F.col("id"), F.col("end"))), "window-nodes")
    heads = last.where(F.col("last_rn") >= train_bars).select(*k, F.lit(train_bars - 1).cast("long").alias("id"))
    longest = last.agg(F.max("last_rn")).first()[0] or 0
    # with a cut-off (G07) the last window's end may be no node itself: an end of the chain
    ids = nodes.select(*k, F.col("id").alias("nxt"))
    known = nodes.select(*k, "id", "nxt").join(ids.withColumn("_is", F.lit(True)), [*k, "nxt"], "left")
    path = known.select(*k, "id", F.when(F.col("_is"), F.col("nxt")).alias("nxt"))
    anchors = materialize(follow_chain(path, heads.join(ids.withColumnRenamed("nxt", "id"), [*k, "id"]), k, int(longest) + 1, chunk), "anchors")
    # an anchor opens window `dist` only if it has a successor (a non-empty window)
    opened = anchors.join(nodes.where(F.col("nxt").isNotNull()).select(*k, "id"), [*k, "id"])
    lab = last_marker_before(opened.select(*k, "id", F.col("dist").alias("tag")),
                             b.where(F.col("rn") >= train_bars).select(*k, F.col("rn").alias("pid")), k, chunk)
    # a bar belongs to the window of the last anchor before it, if it is inside that window
    ends = nodes.select(*k, F.col("id").alias("marker_id"), "end")
    lab = lab.join(ends, [*k, "marker_id"], "left") \
             .select(*k, F.col("pid").alias("rn"), F.when(F.col("pid") <= F.col("end"), F.col("tag")).alias("window_id"))
    win = b.join(lab, [*k, "rn"], "left").select(
        *k, "ts_ms", F.when(F.col("rn") < train_bars, F.lit(-1)).otherwise(F.col("window_id")).cast("long").alias("window_id"))
    return bars.join(win, [*k, "ts_ms"])


def window_trades(scored: DataFrame, keys=("symbol", "interval"), params: dict | None = None, pk=()) -> DataFrame:
    """Per (series, window[, ``pk``]): the trades of a flat-start replay at unit balance, as returns."""
    p = {**DEFAULTS, **(params or {})}
    t = scored.where(F.col("window_id") >= 0)
    seg = [*keys, "window_id"]
    # the bars of a window stand side by side in ``rn``
    first = t.groupBy(*seg).agg(F.min("rn").alias("_first"))
    t = t.join(first, seg).withColumn("srn", F.col("rn") - F.col("_first"))
    t = t.withColumns({k: F.lit(v) for k, v in p.items()}).withColumn("initial_balance", F.lit(1.0))
    bars = t.dropDuplicates([*seg, "srn"]) if pk else t
    tr = replay(bars, t, seg, list(pk))
    ret = F.when(F.col("side_name") == "long", 1.0).otherwise(-1.0) * (F.col("exit_price") / F.col("entry_price") - 1) \
        - F.lit(p["fee"]) * F.col("exit_price") / F.col("entry_price")
    return tr.select(*seg, *pk, "trade_no", "kind", ret.alias("ret"), "side_name", "entry_srn", "exit_srn", "entry_price", "exit_price", "exit_action")


def window_rows(trades: DataFrame, windows: DataFrame, keys=("symbol", "interval"), pk=()) -> DataFrame:
    """One row per (series, window): its trades' returns in order (no more than the window has bars), and whether the last is closed
    by the end of the window only. ``windows``: keys + pk + window_id, with those that have no trade."""
    seg = [*keys, *pk, "window_id"]
    t = trades.groupBy(*seg).agg(F.sort_array(F.collect_list(F.struct("trade_no", "ret"))).alias("_t"), F.max((F.col("kind") == "AUTO").cast("int")).alias("_auto"))
    return windows.join(t, seg, "left").withColumns({"rets": F.coalesce(F.col("_t.ret"), F.array().cast("array<double>")),
                                                     "auto": F.coalesce(F.col("_auto") == 1, F.lit(False))}).drop("_t", "_auto")


def inverse_risk(balance: float, initial: float) -> float:
    return INV_MAX if balance <= 0 else min(max(INV_BASE * initial / balance, INV_MIN), INV_MAX)


def evaluate_window(rets: np.ndarray, auto: bool, balance: float, p: dict, initial: float) -> dict:
    """One window's outcome as a function of the balance that comes in: risk by P07, sizes compound inside the window,
    the window's pnl leaves the entry fees out, an automatic close needs a size above 0."""
    risk = inverse_risk(balance, initial)
    k = risk * p["leverage"] / p["sl_pct"] if p["sl_pct"] > 0 and risk > 0 and p["leverage"] > 0 else 0.0
    factors = 1 + k * (rets - p["fee"])
    before = balance * np.concatenate(([1.0], np.cumprod(factors)))  # balance in front of each trade, and after the last
    gains = before[:-1] * k * rets
    state = before[-1]
    if auto and not before[-2] * k > 0:
        state, gains = before[-2] * (1 - k * p["fee"]), gains[:-1]
    n, wins, pnl = len(gains), int((gains > 0).sum()), float(gains.sum())
    winrate = wins / n if n else 0.0
    return {"sizes": (before[:-1] * k).tolist(), "risk_pct": risk, "pnl": pnl, "total_trades": n, "winrate": winrate, "final_state_balance": float(state), "balance": balance + pnl,
            "triggered_restart": bool(state < RESTART_BALANCE_FRAC * initial or n == 0 or winrate < RESTART_WINRATE)}


OUTCOME = ("window_id long, risk_pct double, pnl double, total_trades long, winrate double, final_state_balance double, balance double, "
           "triggered_restart boolean, sizes array<double>")
STATE = "balance double, ended boolean"


def _run_windows(p: dict, initial: float, until_restart: bool = False):
    """Step of the fold: windows in order from the balance carried in, up to a ruin (that window is neither logged nor
    followed) and, if asked for, up to and with the first restart."""
    def step(pdf: pd.DataFrame, state: dict | None):
        balance, ended = (initial, False) if state is None else (float(state["balance"]), bool(state["ended"]))
        out = []
        for wid, rets, auto in zip(pdf["window_id"], pdf["rets"], pdf["auto"]):
            if ended:
                break
            got = evaluate_window(np.asarray(rets, float), bool(auto), balance, p, initial)
            if got["balance"] < RUIN_BALANCE:
                ended = True
                break
            out.append({"window_id": int(wid), **got})
            balance = got["balance"]
            ended = until_restart and got["triggered_restart"]
        return pd.DataFrame(out), {"balance": balance, "ended": ended}

    return step


#: trades (at most one a bar) that a chunk of windows may hold
CHUNK_TRADES = 1 << 16


def window_chunk(per: int = CHUNK_TRADES):
    """Chunk of a window: so many windows of an interval's bars that ``per`` trades are not exceeded."""
    bars = F.floor(F.lit(DAY_MINUTES * 60) / interval_seconds("interval")) + 1
    return F.floor(F.col("window_id") / F.greatest(F.floor(F.lit(per) / bars), F.lit(1)))


def run_log(rows: DataFrame) -> DataFrame:
    """G12 columns of evaluated windows (with ``test_start``): loss, retrained, date."""
    return rows.withColumns({"loss": -F.col("winrate"), "retrained": F.col("pnl") <= 0, "date": F.date_format("test_start", "yyyy-MM-dd")})


def walk_forward(bars: DataFrame, scored: DataFrame, train_bars: int = TRAIN_BARS, now_ms: int | None = None,
                 keys=("symbol", "interval"), params: dict | None = None, initial: float = 1000.0, chunk_trades: int = CHUNK_TRADES) -> DataFrame:
    """One run-log row per evaluated window (windows without trades included).

    Each window is reduced to one row; the balance, which sets the next window's risk, is carried along chunks of windows
    (``fold_carried``): a task holds a chunk's returns, never a series."""
    return walk_forward_log(bars, scored, train_bars, now_ms, keys, params, initial, chunk_trades)[0].drop("sizes", "window_end")


def walk_forward_log(bars: DataFrame, scored: DataFrame, train_bars: int = TRAIN_BARS, now_ms: int | None = None,
                     keys=("symbol", "interval"), params: dict | None = None, initial: float = 1000.0,
                     chunk_trades: int = CHUNK_TRADES) -> tuple[DataFrame, DataFrame]:
    """(runs, legs): the runs with the money size of each trade, and the trade list of the evaluated windows (G12): an open and a closing
    leg per trade with timestamp, action, side, price and qty."""
    p = {**DEFAULTS, **(params or {})}
    keys = list(keys)
    seg = [*keys, "window_id"]
    win = assign_windows(bars.select(*keys, "ts", "ts_ms"), train_bars, now_ms, keys).drop("ts")
    sc = materialize(scored.join(win, [*keys, "ts_ms"]).where("window_id >= 0"), "test-bars")
    wins = materialize(sc.groupBy(*seg).agg(F.min("ts").alias("test_start"), F.max("ts").alias("window_end"), F.min("rn").alias("_first")), "windows")
    trades = window_trades(sc, keys, p)
    rows = window_rows(trades, wins.select(*seg), keys).withColumn("_chunk", window_chunk(chunk_trades))
    done, _ = fold_carried(rows, keys, "_chunk", "window_id", _run_windows(p, initial), OUTCOME, STATE, name="walk-forward")
    runs = run_log(done.join(wins.drop("_first"), seg))
    sized = trades.join(done.select(*seg, "total_trades", "sizes"), seg).join(wins.select(*seg, "_first"), seg).withColumn(
        "qty", F.get("sizes", F.col("trade_no").cast("int")) / F.col("entry_price"))
    at = sc.select(*keys, F.col("rn").alias("_rn"), F.col("ts").alias("timestamp"))
    legs = sized.withColumn("leg", F.explode(F.array(F.lit(0), F.lit(1))))
    # the last trade of a window may stay without a close (no size)
    legs = legs.where("leg = 0 OR trade_no < total_trades").select(
        *seg, "trade_no", "leg", (F.col("_first") + F.when(F.col("leg") == 0, F.col("entry_srn")).otherwise(F.col("exit_srn"))).alias("_rn"),
        F.when(F.col("leg") == 0, F.concat(F.lit("OPEN "), F.upper("side_name"))).otherwise(_close_action()).alias("action"),
        F.col("side_name").alias("side"), F.when(F.col("leg") == 0, F.col("entry_price")).otherwise(F.col("exit_price")).alias("price"), "qty")
    return runs, legs.join(at, [*keys, "_rn"]).drop("_rn")


def _close_action():
    """The closing action by kind and side, whatever the replay at unit balance made of it."""
    side = F.upper("side_name")
    return F.when(F.col("kind") == "AUTO", F.when(side == "LONG", "AUTO SELL").otherwise("AUTO COVER")).when(
        F.col("kind") == "SIGNAL", F.concat(F.lit("CLOSE "), side)).otherwise(F.concat(F.col("kind"), F.lit(" CLOSE "), side))


def final_report(runs: DataFrame, keys=("symbol", "interval"), initial: float = 1000.0) -> DataFrame:
    """G13 + A04 + A05: final balance, total pnl, APR over the number of windows, risk stats."""
    g = runs.groupBy(*keys).agg(F.max_by("balance", "window_id").alias("final_balance"),
                                F.count(F.lit(1)).alias("days"),
                                F.avg("risk_pct").alias("risk_mean"), F.max("risk_pct").alias("risk_max"),
                                F.min("risk_pct").alias("risk_min"))
    apr = F.when(F.col("days") > 0, (F.pow(F.col("final_balance") / initial, 365.0 / F.col("days")) - 1) * 100).otherwise(0.0)
    return g.withColumns({"total_pnl": F.col("final_balance") - initial, "apr": apr})


def equity_curve(runs: DataFrame, keys=("symbol", "interval"), initial: float = 1000.0) -> DataFrame:
    """Start + cumulative pnl by window date."""
    w = Window.partitionBy(*keys).orderBy("window_id").rowsBetween(Window.unboundedPreceding, 0)
    return runs.select(*keys, "window_id", "date", (F.lit(initial) + F.sum("pnl").over(w)).alias("equity"))


def update_training(train: DataFrame, test: DataFrame, keys=("symbol", "interval")) -> DataFrame:
    """The training rows of the next step: those before a series' test window, and the window's base columns."""
    from kandle.sources.bars import base_columns
    keys = list(keys)
    start = test.groupBy(*keys).agg(F.min("ts").alias("_start"))
    kept = train.join(start, keys, "left").where(F.col("_start").isNull() | (F.col("ts") < F.col("_start")))
    return base_columns(kept, keys).unionByName(base_columns(test, keys))
