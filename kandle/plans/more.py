"""Registered queries: replay, summaries, recursive indicators (recursive-CTE oracles)."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from kandle.operators.layout import KEYS
from kandle.operators.replay import replay, summarize, trade_legs
from kandle.operators.signals import signal_table, with_scores
from kandle.plans.common import SERIES_SQL, events_bars, rounded_sig as rounded
from kandle.sources.scratch import materialize
from kandle.plans.queries import query

SEG = list(KEYS)


def _scored(spark, sf_dir, params=None):
    sig = signal_table(events_bars(spark, sf_dir))
    return with_scores(sig, params).withColumnRenamed("rn", "srn")


def _series(sig: DataFrame) -> DataFrame:
    return sig.select(*SEG).distinct()


def backtest(spark, sf_dir, params=None, extra=None):
    sc = _scored(spark, sf_dir, params)
    if extra:
        sc = sc.withColumns({k: F.lit(v) for k, v in extra.items()})
    # the scored table feeds several joins of the replay: cut its lineage once (reliable
    # checkpoint into spark.checkpoint.dir) instead of re-planning the indicator job per join
    sc = sc.checkpoint(eager=True)
    tr = replay(sc, sc, SEG)
    return sc, tr


def a01_backtest_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    sc, tr = backtest(spark, sf_dir)
    return rounded(summarize(tr, _series(sc), SEG))





# A replay whose entry flags SQL can express too (volatility breakout + volume filter), wide
# barriers; the oracle replays the reference's row loop as a recursive CTE.
VB_PARAMS = {"enabled_long_signals": ["volatility_breakout", "volume_above_avg"],
             "enabled_short_signals": ["volatility_breakout"],
             "long_score_threshold": 2, "short_score_threshold": 1}
VB_TRADE = {"tp_pct": 0.5, "sl_pct": 0.3, "risk_pct": 0.05, "leverage": 1.0, "fee": 0.00055,
            "initial_balance": 1000.0}

_LOOP_SQL = """{prefix},
sig AS ({sig}),
start AS (
  SELECT symbol, "interval"{pkc}, -1 AS rn, 0 AS pos, 0.0::DOUBLE AS ep, 0.0::DOUBLE AS qty, {bal}::DOUBLE AS bal,
    0 AS n, 0 AS nw, 0 AS nl, 0.0::DOUBLE AS psum, 0 AS cw, 0 AS cl, 0 AS mw, 0 AS ml,
    0 AS ln, 0.0::DOUBLE AS lsum, 0.0::DOUBLE AS lmin,
    0 AS nopen, CAST(NULL AS VARCHAR) AS ev, 0.0::DOUBLE AS evp, 0.0::DOUBLE AS evpnl, 0.0::DOUBLE AS evq, -1 AS tno
  FROM sig WHERE rn = 0),
sim AS (
  SELECT * FROM start
  UNION ALL
  SELECT symbol, "interval"{pkc}, rn,
    CASE WHEN closed THEN 0 WHEN p0 = 0 AND le THEN 1 WHEN p0 = 0 AND se THEN -1 ELSE p0 END,
    CASE WHEN closed THEN 0.0 WHEN opened THEN c ELSE ep0 END,
    CASE WHEN closed THEN 0.0 WHEN opened THEN nq ELSE q0 END,
    CASE WHEN closed THEN bal0 + pnl WHEN opened THEN bal0 - nq*c*{fee} ELSE bal0 END,
    n0 + CAST(closed AS INT), nw0 + CAST(closed AND pnl > 0 AS INT), nl0 + CAST(closed AND pnl < 0 AS INT),
    psum0 + CASE WHEN closed THEN pnl ELSE 0 END,
    CASE WHEN closed THEN (CASE WHEN pnl > 0 THEN cw0 + 1 ELSE 0 END) ELSE cw0 END,
    CASE WHEN closed THEN (CASE WHEN pnl <= 0 THEN cl0 + 1 ELSE 0 END) ELSE cl0 END,
    greatest(mw0, CASE WHEN closed AND pnl > 0 THEN cw0 + 1 ELSE 0 END),
    greatest(ml0, CASE WHEN closed AND pnl <= 0 THEN cl0 + 1 ELSE 0 END),
    ln0 + CAST(closed AND pnl <= 0 AS INT),
    lsum0 + CASE WHEN closed AND pnl <= 0 THEN pnl ELSE 0 END,
    CASE WHEN closed AND pnl <= 0 THEN least(lmin0, pnl) ELSE lmin0 END,
    nopen0 + CAST(opened AS INT),
    CASE WHEN closed THEN xk || ' CLOSE ' || CASE WHEN p0 = 1 THEN 'LONG' ELSE 'SHORT' END
         WHEN opened THEN CASE WHEN le THEN 'OPEN LONG' ELSE 'OPEN SHORT' END END,
    CASE WHEN closed THEN x WHEN opened THEN c END,
    CASE WHEN closed THEN pnl WHEN opened THEN 0.0 END,
    CASE WHEN closed THEN q0 WHEN opened THEN nq END,
    CASE WHEN closed THEN nopen0 - 1 WHEN opened THEN nopen0 END
  FROM (
    SELECT *, x IS NOT NULL AS closed, p0*(x - ep0)*q0 - x*q0*{fee} AS pnl,
      p0 = 0 AND (le OR se) AS opened,
      CASE WHEN c > 0 THEN bal0*{k}/c ELSE 0 END AS nq
    FROM (
      SELECT b.symbol, b."interval"{bpkc}, b.rn, b.open, b.high, b.low, b.close AS c, b.le, b.se,
        s.pos AS p0, s.ep AS ep0, s.qty AS q0, s.bal AS bal0, s.n AS n0, s.nw AS nw0, s.nl AS nl0,
        s.psum AS psum0, s.cw AS cw0, s.cl AS cl0, s.mw AS mw0, s.ml AS ml0, s.ln AS ln0, s.lsum AS lsum0,
        s.lmin AS lmin0, s.nopen AS nopen0,
        CASE WHEN s.pos = 1 AND b.high >= s.ep*(1+{tp}) THEN 'TP' WHEN s.pos = -1 AND b.low <= s.ep*(1-{tp}) THEN 'TP'
             WHEN s.pos = 1 AND b.low <= s.ep*(1-{sl}) THEN 'SL' WHEN s.pos = -1 AND b.high >= s.ep*(1+{sl}) THEN 'SL'
        END AS xk,
        CASE WHEN s.pos = 1 AND b.high >= s.ep*(1+{tp}) THEN s.ep*(1+{tp})
             WHEN s.pos = -1 AND b.low <= s.ep*(1-{tp}) THEN s.ep*(1-{tp})
             WHEN s.pos = 1 AND b.low <= s.ep*(1-{sl}) THEN least(b.open, s.ep*(1-{sl}))
             WHEN s.pos = -1 AND b.high >= s.ep*(1+{sl}) THEN greatest(b.open, s.ep*(1+{sl})) END AS x
      FROM sim s JOIN sig b ON b.symbol = s.symbol AND b."interval" = s."interval" AND b.rn = s.rn + 1{pkj}) t0) t1),
fin AS (
  SELECT s.*, g.close AS lc, s.pos <> 0 AND s.qty > 0 AS auto,
    s.pos*(g.close - s.ep)*s.qty - g.close*s.qty*{fee} AS apnl
  FROM sim s JOIN sig g ON g.symbol = s.symbol AND g."interval" = s."interval" AND g.rn = s.rn{gpkj}
  WHERE s.rn = g.last_rn),
tot AS (
  SELECT symbol, "interval"{pkc}, n + CAST(auto AS INT) AS total_trades,
    nw + CAST(auto AND apnl > 0 AS INT) AS w, nl + CAST(auto AND apnl < 0 AS INT) AS l,
    psum + CASE WHEN auto THEN apnl ELSE 0 END AS ps,
    bal + CASE WHEN auto THEN apnl ELSE 0 END AS final_balance,
    greatest(mw, CASE WHEN auto AND apnl > 0 THEN cw + 1 ELSE 0 END) AS max_win_streak,
    greatest(ml, CASE WHEN auto AND apnl <= 0 THEN cl + 1 ELSE 0 END) AS max_loss_streak,
    ln + CAST(auto AND apnl <= 0 AS INT) AS lnn, lsum + CASE WHEN auto AND apnl <= 0 THEN apnl ELSE 0 END AS ls,
    CASE WHEN auto AND apnl <= 0 THEN least(lmin, apnl) ELSE lmin END AS lm
  FROM fin)
SELECT {head}, CAST(total_trades AS BIGINT) AS total_trades,
  {r_winrate} AS winrate, {r_lossrate} AS lossrate, {r_pnl} AS pnl, {r_avg} AS avg_trade,
  {r_final} AS final_balance,
  CAST(max_win_streak AS BIGINT) AS max_win_streak, CAST(max_loss_streak AS BIGINT) AS max_loss_streak,
  {r_avgloss} AS avg_loss, {r_maxloss} AS max_loss
FROM tot"""

_OUT = {"r_winrate": "CASE WHEN total_trades > 0 THEN w / total_trades ELSE 0 END",
        "r_lossrate": "CASE WHEN total_trades > 0 THEN l / total_trades ELSE 1 END",
        "r_pnl": "CASE WHEN total_trades > 0 THEN ps ELSE final_balance - {bal} END",
        "r_avg": "CASE WHEN total_trades > 0 THEN ps / total_trades ELSE 0 END",
        "r_final": "final_balance",
        "r_avgloss": "CASE WHEN lnn > 0 THEN ls / lnn ELSE 0 END",
        "r_maxloss": "CASE WHEN lnn > 0 THEN lm ELSE 0 END"}

_VB_SIG = """SELECT symbol, "interval", rn, open, high, low, close,
    (CAST(coalesce(open > lag(open) OVER w + 0.5*(lag(high) OVER w - lag(low) OVER w), false) AS INT)
     + CAST(coalesce(volume > avg(volume) OVER (w ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), false) AS INT)) >= 2 AS le,
    coalesce(open < lag(open) OVER w - 0.5*(lag(high) OVER w - lag(low) OVER w), false) AS se,
    max(rn) OVER (PARTITION BY symbol, "interval") AS last_rn
  FROM series WINDOW w AS (PARTITION BY symbol, "interval" ORDER BY ts)"""

_SCORED_SIG = """SELECT symbol, "interval", rn, open, high, low, close, long_entry AS le, short_entry AS se,
    max(rn) OVER (PARTITION BY symbol, "interval") AS last_rn FROM scored"""


def loop_sql(prefix: str, sig: str, trade: dict, by_param: bool = False, head: str = 'symbol, "interval"') -> str:
    pk = dict(pkc=", param_id", bpkc=", b.param_id", pkj=" AND b.param_id = s.param_id",
              gpkj=" AND g.param_id = s.param_id") if by_param else dict(pkc="", bpkc="", pkj="", gpkj="")
    from kandle.plans.common import sig_round_sql
    outs = {k: sig_round_sql(f"({v.format(bal=trade['initial_balance'])})") for k, v in _OUT.items()}
    return _LOOP_SQL.format(prefix=prefix, sig=sig, head=head, **pk, **outs, bal=trade["initial_balance"], fee=trade["fee"],
                            tp=trade["tp_pct"], sl=trade["sl_pct"],
                            k=trade["risk_pct"] * trade["leverage"] / trade["sl_pct"])


VB_SQL = loop_sql("WITH RECURSIVE " + SERIES_SQL, _VB_SIG, VB_TRADE)


def _legs_sql() -> str:
    from kandle.plans.common import sig_round_sql as r
    body = VB_SQL[:VB_SQL.index("tot AS (")]
    return body + f"""legs AS (
  SELECT symbol, "interval", tno AS trade_no, ev AS action, rn, evp AS price, evpnl AS pnl, evq AS qty FROM sim
  WHERE ev IS NOT NULL
  UNION ALL
  SELECT symbol, "interval", nopen - 1, CASE WHEN pos = 1 THEN 'AUTO SELL' ELSE 'AUTO COVER' END, rn, lc, apnl, qty
  FROM fin WHERE auto)
SELECT l.symbol, l."interval", CAST(l.trade_no AS BIGINT) AS trade_no, l.action, s.ts, {r('l.price')} AS price,
  {r('l.pnl')} AS pnl, CASE WHEN l.action LIKE '%LONG' OR l.action = 'AUTO SELL' THEN 'long' ELSE 'short' END AS side_name,
  {r('l.qty')} AS qty
FROM legs l JOIN series s ON s.symbol = l.symbol AND s."interval" = l."interval" AND s.rn = l.rn"""


LEGS_SQL = _legs_sql()

from kandle.operators.replay import DEFAULTS as _D  # noqa: E402
from kandle.plans.oracle_ind import scored_sql  # noqa: E402

query("a01_backtest_summary", loop_sql(scored_sql(), _SCORED_SIG, _D))(a01_backtest_summary)


@query("b04_replay_summary", VB_SQL)
def b04_replay_summary(spark, sf_dir):
    sc, tr = backtest(spark, sf_dir, VB_PARAMS, VB_TRADE)
    return rounded(summarize(tr, _series(sc), SEG))


@query("b05_trade_legs", LEGS_SQL)
def b05_trade_legs(spark, sf_dir):
    sc, tr = backtest(spark, sf_dir, VB_PARAMS, VB_TRADE)
    legs = trade_legs(tr, SEG)
    ts = sc.select(*SEG, "srn", "ts")
    return rounded(legs.join(ts, [*SEG, "srn"]).select(*SEG, "trade_no", "action", "ts", "price", "pnl",
                                                         "side_name", "qty"))


# ---------------------------------------------------------------- walk-forward
from kandle.operators import walkforward as WF  # noqa: E402


def _wf(spark, sf_dir, train_bars=WF.TRAIN_BARS):
    bars = events_bars(spark, sf_dir)
    sc = materialize(_scored(spark, sf_dir).withColumnRenamed("srn", "rn"), "scored")
    return WF.walk_forward(bars, sc, train_bars=train_bars)


def _anchors_sql(train: int) -> str:
    return f"""a AS (SELECT symbol, "interval", 0 AS w, ts_ms AS anchor FROM series WHERE rn = {train - 1}
  UNION ALL
  SELECT symbol, "interval", w + 1, nxt FROM (
    SELECT a.symbol, a."interval", a.w, (SELECT max(s.ts_ms) FROM series s WHERE s.symbol = a.symbol
      AND s."interval" = a."interval" AND s.ts_ms > a.anchor AND s.ts_ms <= a.anchor + 49*1800000) AS nxt FROM a) t
  WHERE nxt IS NOT NULL)"""


WF_TRAIN = 200


#: entries by volatility breakout and volume (VB_PARAMS) instead of the whole signal set
VB_SCORED_SQL = "WITH RECURSIVE " + SERIES_SQL + """,
scored AS (SELECT *, le AS long_entry, se AS short_entry FROM (""" + _VB_SIG.replace("rn, open", "rn, ts, ts_ms, open") + "))"


def _wf_sql(select: str, trade: dict | None = None, scored: str | None = None) -> str:
    from kandle.plans.oracle_ind import scored_sql
    d = {**_D, **(trade or {})}
    k = f"riskn*{d['leverage']}/{d['sl_pct']}"
    fee, tp, sl = d["fee"], d["tp_pct"], d["sl_pct"]
    return (scored or scored_sql()) + ",\n" + _anchors_sql(WF_TRAIN) + f""",
tw AS (SELECT s.symbol, s."interval", s.rn, s.ts, s.open, s.high, s.low, s.close, s.long_entry AS le,
         s.short_entry AS se, a.w
       FROM scored s JOIN a ON s.rn >= {WF_TRAIN} AND s.symbol = a.symbol AND s."interval" = a."interval"
         AND s.ts_ms > a.anchor AND s.ts_ms <= a.anchor + 49*1800000),
tw2 AS (SELECT *, row_number() OVER (PARTITION BY symbol, "interval", w ORDER BY rn) - 1 AS srn,
          count(*) OVER (PARTITION BY symbol, "interval", w) - 1 AS last_srn,
          min(ts) OVER (PARTITION BY symbol, "interval", w) AS wstart FROM tw),
wf AS (
  SELECT symbol, "interval", {WF_TRAIN - 1} AS rn, -1 AS w, -1 AS srn, -1 AS last_srn, 1000.0::DOUBLE AS B,
    0.0::DOUBLE AS risk, 0 AS pos, 0.0::DOUBLE AS ep, 0.0::DOUBLE AS qty, 1000.0::DOUBLE AS bal,
    0.0::DOUBLE AS pw, 0 AS n, 0 AS nwin, false AS stop, CAST(NULL AS TIMESTAMP) AS wstart
  FROM (SELECT DISTINCT symbol, "interval" FROM tw2)
  UNION ALL
  SELECT symbol, "interval", rn, w, srn, last_srn, Bn, riskn,
    CASE WHEN auto THEN 0 ELSE p1 END, CASE WHEN auto THEN 0.0 ELSE ep1 END, CASE WHEN auto THEN 0.0 ELSE q1 END,
    bal1 + CASE WHEN auto THEN apnl ELSE 0 END, pw1 + CASE WHEN auto THEN apnl ELSE 0 END,
    n1 + CAST(auto AS INT), w1 + CAST(auto AND apnl > 0 AS INT), stopn, wstart
  FROM (SELECT *, srn = last_srn AND p1 <> 0 AND q1 > 0 AS auto, p1*(close - ep1)*q1 - close*q1*{fee} AS apnl FROM (
  SELECT *, CASE WHEN closed THEN 0 WHEN opened AND le THEN 1 WHEN opened THEN -1 ELSE p0 END AS p1,
    CASE WHEN closed THEN 0.0 WHEN opened THEN close ELSE ep0 END AS ep1,
    CASE WHEN closed THEN 0.0 WHEN opened THEN nq ELSE q0 END AS q1,
    CASE WHEN closed THEN bal0 + pnl WHEN opened THEN bal0 - nq*close*{fee} ELSE bal0 END AS bal1,
    pw0 + CASE WHEN closed THEN pnl ELSE 0 END AS pw1, n0 + CAST(closed AS INT) AS n1,
    w0 + CAST(closed AND pnl > 0 AS INT) AS w1 FROM (
  SELECT *, x IS NOT NULL AS closed, p0*(x - ep0)*q0 - x*q0*{fee} AS pnl, p0 = 0 AND (le OR se) AS opened,
    CASE WHEN close > 0 THEN bal0*{k}/close ELSE 0 END AS nq FROM (
  SELECT *, CASE WHEN p0 = 1 AND high >= ep0*(1+{tp}) THEN ep0*(1+{tp})
                 WHEN p0 = -1 AND low <= ep0*(1-{tp}) THEN ep0*(1-{tp})
                 WHEN p0 = 1 AND low <= ep0*(1-{sl}) THEN least(open, ep0*(1-{sl}))
                 WHEN p0 = -1 AND high >= ep0*(1+{sl}) THEN greatest(open, ep0*(1+{sl})) END AS x FROM (
  SELECT *, Bn < 500 AND srn = 0 AS stopn,
    CASE WHEN srn = 0 THEN (CASE WHEN Bn <= 0 THEN 0.2 ELSE least(greatest(0.05*1000/Bn, 0.01), 0.2) END)
         ELSE risk_p END AS riskn,
    CASE WHEN srn = 0 THEN 0 ELSE pos_p END AS p0, CASE WHEN srn = 0 THEN 0.0 ELSE ep_p END AS ep0,
    CASE WHEN srn = 0 THEN 0.0 ELSE q_p END AS q0, CASE WHEN srn = 0 THEN Bn ELSE bal_p END AS bal0,
    CASE WHEN srn = 0 THEN 0.0 ELSE pw_p END AS pw0, CASE WHEN srn = 0 THEN 0 ELSE n_p END AS n0,
    CASE WHEN srn = 0 THEN 0 ELSE w_p END AS w0 FROM (
  SELECT *, CASE WHEN srn = 0 THEN (CASE WHEN w = 0 THEN 1000.0 ELSE B_p + pw_p END) ELSE B_p END AS Bn FROM (
  SELECT b.*, s.B AS B_p, s.pw AS pw_p, s.risk AS risk_p, s.pos AS pos_p, s.ep AS ep_p, s.qty AS q_p,
    s.bal AS bal_p, s.n AS n_p, s.nwin AS w_p
  FROM wf s JOIN tw2 b ON b.symbol = s.symbol AND b."interval" = s."interval" AND b.rn = s.rn + 1
  WHERE NOT s.stop) t0) t1) t2) t3) t4) t5) t6),
runs AS (SELECT symbol, "interval", w AS window_id, strftime(wstart, '%Y-%m-%d') AS date, risk AS risk_pct, pw AS pnl,
    n AS total_trades, CASE WHEN n > 0 THEN nwin / n ELSE 0 END AS winrate, B + pw AS balance, bal AS final_state_balance
  FROM wf WHERE w >= 0 AND srn = last_srn AND NOT stop AND B + pw >= 500)
{select}"""


G06_SQL = f"""WITH RECURSIVE {SERIES_SQL},
a AS (SELECT symbol, "interval", 0 AS w, ts_ms AS anchor FROM series WHERE rn = {WF.TRAIN_BARS - 1}
  UNION ALL
  SELECT symbol, "interval", w + 1, nxt FROM (
    SELECT a.symbol, a."interval", a.w, (SELECT max(s.ts_ms) FROM series s WHERE s.symbol = a.symbol
      AND s."interval" = a."interval" AND s.ts_ms > a.anchor AND s.ts_ms <= a.anchor + 49*1800000) AS nxt FROM a) t
  WHERE nxt IS NOT NULL)
SELECT s.symbol, s."interval", s.ts, CAST(CASE WHEN s.rn < {WF.TRAIN_BARS} THEN -1 ELSE a.w END AS BIGINT) AS window_id
FROM series s LEFT JOIN a ON s.rn >= {WF.TRAIN_BARS} AND s.symbol = a.symbol AND s."interval" = a."interval"
  AND s.ts_ms > a.anchor AND s.ts_ms <= a.anchor + 49*1800000"""


@query("g06_windows", G06_SQL)
def g06_windows(spark, sf_dir):
    """Test-window id per bar (train rows -1)."""
    b = events_bars(spark, sf_dir)
    return WF.assign_windows(b.select(*SEG, "ts_ms", "ts"), WF.TRAIN_BARS).select(*SEG, "ts", "window_id")


def _rs(x):
    from kandle.plans.common import sig_round_sql
    return sig_round_sql(x)


G09_SQL = _wf_sql(f"""SELECT symbol, "interval", CAST(window_id AS BIGINT) AS window_id, date, {_rs('risk_pct')} AS risk_pct,
  {_rs('pnl')} AS pnl, CAST(total_trades AS BIGINT) AS total_trades, {_rs('winrate')} AS winrate,
  {_rs('-winrate')} AS loss, {_rs('balance')} AS balance, {_rs('final_state_balance')} AS final_state_balance,
  pnl <= 0 AS retrained, (final_state_balance < 900 OR total_trades = 0 OR winrate < 0.4) AS triggered_restart FROM runs""")

G13_SQL = _wf_sql(f"""SELECT symbol, "interval", {_rs('arg_max(balance, window_id)')} AS final_balance,
  count(*) AS days, {_rs('avg(risk_pct)')} AS risk_mean, {_rs('max(risk_pct)')} AS risk_max, {_rs('min(risk_pct)')} AS risk_min,
  {_rs('arg_max(balance, window_id) - 1000')} AS total_pnl,
  {_rs('(pow(arg_max(balance, window_id) / 1000, 365.0 / count(*)) - 1) * 100')} AS apr FROM runs GROUP BY ALL""")

W30_SQL = _wf_sql(f"""SELECT symbol, "interval", CAST(window_id AS BIGINT) AS window_id, date,
  {_rs('1000 + sum(pnl) OVER (PARTITION BY symbol, "interval" ORDER BY window_id ROWS UNBOUNDED PRECEDING)')} AS equity
  FROM runs""")


@query("g09_walkforward_runs", G09_SQL)
def g09_walkforward_runs(spark, sf_dir):
    """Run-log rows per evaluated window with the default parameters."""
    r = _wf(spark, sf_dir, WF_TRAIN)
    return rounded(r.select(*SEG, "window_id", "date", "risk_pct", "pnl", "total_trades", "winrate", "loss",
                            "balance", "final_state_balance", "retrained", "triggered_restart"))


@query("g13_final_report", G13_SQL)
def g13_final_report(spark, sf_dir):
    """G13 + A04/A05: final balance, APR, risk statistics per series."""
    return rounded(WF.final_report(_wf(spark, sf_dir, WF_TRAIN)))


@query("w30_equity_curve", W30_SQL)
def w30_equity_curve(spark, sf_dir):
    return rounded(WF.equity_curve(_wf(spark, sf_dir, WF_TRAIN)))
