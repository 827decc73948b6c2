import random

import pytest
from pyspark.sql import functions as F

from kandle.operators.replay import replay, summarize
from rowloop import run_loop

SEG = ["symbol", "interval"]


def frame(spark, rows, symbol="S", params=None):
    recs = []
    for i, r in enumerate(rows):
        d = {"symbol": symbol, "interval": "30", "srn": i, "open": float(r["open"]), "high": float(r["high"]),
             "low": float(r["low"]), "close": float(r["close"]), "long_entry": bool(r.get("long_entry")),
             "short_entry": bool(r.get("short_entry")), "long_exit": int(r.get("long_exit", 0)),
             "short_exit": int(r.get("short_exit", 0))}
        d.update(params or {})
        recs.append(d)
    return spark.createDataFrame(recs)


def run(spark, rows, finalize=True, **params):
    df = frame(spark, rows, params=params)
    tr = replay(df, df, SEG, finalize=finalize)
    s = summarize(tr, df.select(*SEG).distinct(), SEG)
    return tr.orderBy("trade_no").collect(), s.first()


def test_long_trade_tp_zero_fee_zero(spark):
    # reference: entry on row 0, tp 0, fee 0 -> one trade, balance stays 1000
    rows = [dict(open=100, high=101, low=99, close=100, long_entry=1),
            dict(open=100, high=101, low=99, close=100, long_exit=1),
            dict(open=100, high=101, low=99, close=100, long_exit=1)]
    tr, s = run(spark, rows, tp_pct=0.0, sl_pct=0.01, fee=0.0)
    assert s.total_trades == 1
    assert s.final_balance == pytest.approx(1000.0)


def test_short_trade(spark):
    rows = [dict(open=100, high=101, low=99, close=100, short_entry=1),
            dict(open=99, high=100, low=95, close=96, short_exit=1),
            dict(open=96, high=97, low=95, close=96)]
    tr, s = run(spark, rows)
    assert s.total_trades == 1 and s.final_balance != 1000.0


def test_stop_loss_only(spark):
    rows = [dict(open=100, high=100, low=100, close=100, long_entry=1),
            dict(open=100, high=100, low=98, close=98)]
    tr, s = run(spark, rows, sl_pct=0.01)
    assert s.total_trades == 1 and s.final_balance < 1000 and tr[0].kind == "SL"


def test_no_finalize_keeps_position(spark):
    rows = [dict(open=100, high=100, low=100, close=100, long_entry=1),
            dict(open=100, high=100.5, low=99.9, close=100), dict(open=100, high=100.5, low=99.9, close=100)]
    tr, s = run(spark, rows, finalize=False)
    assert s.total_trades == 0 and tr[0].closed is False


def test_tp_only(spark):
    rows = [dict(open=100, high=100, low=100, close=100, long_entry=1),
            dict(open=100, high=103, low=99, close=102), dict(open=102, high=103, low=101, close=102)]
    tr, s = run(spark, rows, tp_pct=0.02, sl_pct=0.10)
    assert s.total_trades == 1 and tr[0].kind == "TP" and tr[0].exit_price == pytest.approx(102.0)


def _walk(seed, n, p_entry=0.15, gappy=True):
    rnd = random.Random(seed)
    px, rows = 100.0, []
    for i in range(n):
        o = px * (1 + (rnd.uniform(-0.04, 0.04) if gappy and rnd.random() < 0.1 else 0))
        c = o * (1 + rnd.gauss(0, 0.01))
        h, l = max(o, c) * (1 + abs(rnd.gauss(0, 0.006))), min(o, c) * (1 - abs(rnd.gauss(0, 0.006)))
        if rnd.random() < 0.05:  # both barriers on one bar
            h, l = h * 1.03, l * 0.97
        rows.append(dict(open=o, high=h, low=l, close=c, long_entry=rnd.random() < p_entry,
                         short_entry=rnd.random() < p_entry, long_exit=int(rnd.random() < 0.03),
                         short_exit=int(rnd.random() < 0.03)))
        px = c
    rows[-1]["long_entry"] = True  # last-bar entry
    return rows


@pytest.mark.parametrize("seed,tp,sl", [(1, 0.025, 0.0175), (2, 0.01, 0.02), (3, 0.0, 0.01), (4, 0.05, 0.03)])
def test_matches_row_loop(spark, seed, tp, sl):
    rows = _walk(seed, 5000)
    want, bal = run_loop(rows, tp=tp, sl=sl)
    tr, s = run(spark, rows, tp_pct=tp, sl_pct=sl)
    got = [(t.kind, t.exit_srn, t.exit_price, t.pnl) for t in tr if t.closed]
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g[0] == w[0] and g[1] == w[1]
        assert g[2] == pytest.approx(w[2], rel=1e-12)
        assert g[3] == pytest.approx(w[3], rel=1e-9, abs=1e-9)
    assert s.final_balance == pytest.approx(bal, rel=1e-9)


def test_small_chunks_equal_one_chunk(spark):
    """Selection over chunks of 7 bars (pointer doubling over some 430 chunks) gives one chunk's trades."""
    rows = _walk(9, 3000, p_entry=0.3)
    df = frame(spark, rows, params={"tp_pct": 0.01, "sl_pct": 0.02})
    a = replay(df, df, SEG).orderBy("trade_no").collect()
    b = replay(df, df, SEG, chunk=7).orderBy("trade_no").collect()
    assert len(a) == len(b) > 50
    for x, y in zip(a, b):
        assert (x.trade_no, x.entry_srn, x.exit_srn, x.kind) == (y.trade_no, y.entry_srn, y.exit_srn, y.kind)
        assert x.balance_after == pytest.approx(y.balance_after, rel=1e-12)


def _walk_windows(ts, train, d, step, now=None):
    """Windows by a plain walk: id per bar."""
    out = [-1] * min(train, len(ts)) + [None] * max(0, len(ts) - train)
    if len(ts) <= train:
        return out
    anchor, i, w = ts[train - 1], train, 0
    while i < len(ts):
        end = anchor + d + step
        if now is not None and end > now:
            break
        j = i
        while j < len(ts) and ts[j] <= end:
            out[j] = w
            j += 1
        if j == i:
            break
        anchor, i, w = ts[j - 1], j, w + 1
    return out


@pytest.mark.parametrize("chunk,cut", [(1 << 16, None), (7, None), (7, 0.6)])
def test_window_anchoring_equals_a_plain_walk(spark, chunk, cut):
    """Window ids, gaps included, also with a cut-off and over many chunks."""
    from conftest import SF
    from kandle.operators import walkforward as WF
    from kandle.plans.common import events_bars
    b = events_bars(spark, SF.replace("0.001", "0.01")).select("symbol", "interval", "ts", "ts_ms")
    rows = {}
    for r in b.collect():
        rows.setdefault(r.symbol, []).append(r.ts_ms)
    lo, hi = min(map(min, rows.values())), max(map(max, rows.values()))
    now = None if cut is None else int(lo + (hi - lo) * cut)
    got = {(r.symbol, r.ts_ms): r.window_id for r in WF.assign_windows(b, 100, now, chunk=chunk).collect()}
    d, top = 30 * 60_000, 0
    for s, ts in rows.items():
        ts.sort()
        want = _walk_windows(ts, 100, d, 48 * d, now)
        assert [got[(s, t)] for t in ts] == want
        top = max(top, *(w for w in want if w is not None))
    assert len(got) == sum(map(len, rows.values())) and top > 5


def test_position_carried_in_and_out(spark):
    """A segment cut in two, the second part started from the first part's state, trades on as the whole."""
    from kandle.operators.replay import final_state
    rows = _walk(5, 1200, p_entry=0.2)
    p = dict(tp_pct=0.05, sl_pct=0.04)
    want, bal = run_loop(rows, tp=0.05, sl=0.04, finalize=False)
    carried = 0
    for cut in (301, 500, 777):
        first = frame(spark, rows[:cut], params=p)
        tr1 = replay(first, first, SEG, finalize=False)
        st = final_state(tr1, first.select(*SEG).distinct(), SEG)
        s = st.first()
        carried += s.position_type is not None
        second = frame(spark, rows[cut:], params={**p, "initial_balance": s.balance})
        tr2 = replay(second, second, SEG, finalize=False, open_positions=st)
        a = [t for t in tr1.orderBy("trade_no").collect() if t.closed]
        b = [t for t in tr2.orderBy("trade_no").collect() if t.closed]
        got = [(t.kind, t.exit_srn, t.pnl) for t in a] + [(t.kind, t.exit_srn + cut, t.pnl) for t in b]
        assert [g[:2] for g in got] == [w[:2] for w in want]
        assert [g[2] for g in got] == pytest.approx([w[3] for w in want], rel=1e-9)
        assert final_state(tr2, second.select(*SEG, "initial_balance").distinct(), SEG).first().balance == pytest.approx(bal, rel=1e-9)
    assert carried


def test_open_long_closes_at_take_profit(spark):
    df = frame(spark, [dict(open=104, high=110, low=102, close=109)], params={"tp_pct": 0.05})
    held = spark.createDataFrame([("S", "30", "long", 1.0, 100.0)], "symbol string, interval string, position_type string, position double, entry_price double")
    tr = replay(df, df, SEG, open_positions=held).collect()
    assert len(tr) == 1 and tr[0].kind == "TP" and tr[0].closed and tr[0].balance_after > 1000
    flat = held.withColumn("position_type", F.lit(None).cast("string"))
    assert replay(df, df, SEG, open_positions=flat).collect() == []


def test_summary_plan_is_small(spark):
    """The summary reads the written trades; it does not plan the replay again."""
    df = frame(spark, _walk(2, 300))
    s = summarize(replay(df, df, SEG), df.select(*SEG).distinct(), SEG)
    plan = s._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Join") < 30 and "ArrowEval" not in plan and "InPandas" not in plan


def test_trade_chunking_is_exact(spark, monkeypatch):
    """Running balances (B04) and streaks (A02) give the same result across chunk edges."""
    import kandle.operators.replay as RP
    rows = _walk(21, 4000, p_entry=0.2)
    df = frame(spark, rows, params={"tp_pct": 0.01, "sl_pct": 0.01})
    series = df.select(*SEG).distinct()
    tr1 = replay(df, df, SEG)
    a = tr1.orderBy("trade_no").collect()
    s1 = summarize(tr1, series, SEG).first()
    monkeypatch.setattr(RP, "TRADE_CHUNK", 7)
    tr2 = replay(df, df, SEG)
    b = tr2.orderBy("trade_no").collect()
    s2 = summarize(tr2, series, SEG).first()
    assert len(a) == len(b) > 100
    for x, y in zip(a, b):
        assert x.bal_before == pytest.approx(y.bal_before, rel=1e-12)
    assert (s1.max_win_streak, s1.max_loss_streak, s1.total_trades) == (s2.max_win_streak, s2.max_loss_streak, s2.total_trades)
    assert s1.final_balance == pytest.approx(s2.final_balance, rel=1e-12)
