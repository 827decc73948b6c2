"""Registered queries: walk-forward with re-tuning (G11), run rows with their trades."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from kandle.operators import retune as RT
from kandle.operators.signals import LONG_SIGNALS, SHORT_SIGNALS, signal_table
from kandle.plans.common import SERIES_SQL, events_bars, rounded_sig as rounded, sig_round_sql as _rs
from kandle.plans.more import SEG, _anchors_sql, loop_sql
from kandle.plans.queries import query
from kandle.operators.replay import DEFAULTS
from kandle.sources.scratch import materialize

TRAIN, SPANS = 200, (200, 300, 100)
MIN_TRADES, MIN_WINRATE = 4, 0.55
#: (long threshold, short threshold) by param_id; 9: never
SETTINGS = [(2, 1), (1, 1), (2, 9), (9, 1)]
TRADE = {**DEFAULTS, "tp_pct": 1.5, "sl_pct": 0.99}


def settings(spark: SparkSession) -> DataFrame:
    """Volatility breakout and volume alone count; the settings differ in their thresholds."""
    on = ("volatility_breakout", "volume_above_avg")
    weights = {f"w_{s}": F.lit(1.0 if s in on else 0.0) for s in dict.fromkeys([*LONG_SIGNALS, *SHORT_SIGNALS])}
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(SETTINGS)]
    return spark.createDataFrame(rows, "param_id long, long_score_threshold double, short_score_threshold double").withColumns(
        {**weights, "use_smart_trend_filter": F.lit(False)})


def waves(spark: SparkSession, sf_dir: str):
    bars = materialize(events_bars(spark, sf_dir), "bars")
    flags = materialize(signal_table(bars), "flags")
    params = settings(spark)
    tuner = RT.validation_tuner(params, TRADE, MIN_TRADES, MIN_WINRATE)
    return RT.retune_waves(bars, flags, params, tuner, TRAIN, SPANS, TRADE, ahead=32, tune_ahead=32)


def _le(alias: str, column: int) -> str:
    """Entry flag of the current setting ``alias``."""
    score = "lvb + lva" if column == 0 else "svb"
    return "(CASE " + " ".join(f"WHEN {alias} = {i} THEN {score} >= {s[column]}" for i, s in enumerate(SETTINGS)) + " ELSE false END)"


def _waves_sql(select: str) -> str:
    fee, tp, sl, lev = TRADE["fee"], TRADE["tp_pct"], TRADE["sl_pct"], TRADE["leverage"]
    k = f"riskn*{lev}/{sl}"
    by = 'symbol, "interval"'
    prefix = f"""WITH RECURSIVE {SERIES_SQL}, {_anchors_sql(TRAIN)},
fl AS (SELECT *, CAST(coalesce(open > lag(open) OVER w + 0.5*(lag(high) OVER w - lag(low) OVER w), false) AS INT) AS lvb,
    CAST(coalesce(volume > avg(volume) OVER (w ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), false) AS INT) AS lva,
    CAST(coalesce(open < lag(open) OVER w - 0.5*(lag(high) OVER w - lag(low) OVER w), false) AS INT) AS svb
  FROM series WINDOW w AS (PARTITION BY {by} ORDER BY ts)),
tw AS (SELECT f.*, a.w FROM fl f JOIN a ON f.rn >= {TRAIN} AND f.symbol = a.symbol AND f."interval" = a."interval"
    AND f.ts_ms > a.anchor AND f.ts_ms <= a.anchor + 49*1800000),
ww AS (SELECT {by}, w, min(rn) AS known, max(rn) AS last_rn, min(ts) AS wstart FROM tw GROUP BY ALL),
-- every number of training rows that a tuning can see: all before a window, or the widest span
tn AS (SELECT DISTINCT {by}, known AS n FROM ww UNION SELECT {by}, least({SPANS[1]}, count(*)) FROM series GROUP BY ALL),
tl AS (SELECT *, n - 2*CAST(floor(n*0.1) AS BIGINT) AS lo, n - CAST(floor(n*0.1) AS BIGINT) AS hi FROM tn)"""
    lanes = f"""SELECT f.symbol, f."interval", l.n*10 + p.i AS param_id, f.rn - l.lo AS rn, open, high, low, close,
    {_le('p.i', 0)} AS le, {_le('p.i', 1)} AS se, l.hi - l.lo - 1 AS last_rn
  FROM tl l JOIN fl f ON f.symbol = l.symbol AND f."interval" = l."interval" AND f.rn >= l.lo AND f.rn < l.hi,
    (SELECT unnest(range({len(SETTINGS)})) AS i) p"""
    tune = loop_sql(prefix, lanes, TRADE, True, f"{by}, param_id")
    tune = tune[:tune.rindex(f"SELECT {by}, param_id, CAST(total_trades")]
    return tune + f""",
best AS (SELECT {by}, param_id // 10 AS n, arg_min(param_id % 10, (-(CASE WHEN total_trades > 0 THEN ps ELSE final_balance - 1000.0 END), param_id)) AS p
  FROM tot WHERE total_trades >= {MIN_TRADES} AND w / total_trades >= {MIN_WINRATE} GROUP BY ALL),
bars2 AS (SELECT t.*, t.rn - x.known AS srn, x.last_rn - x.known AS last_srn, x.wstart, b1.p AS best_n, b2.p AS best_w
  FROM tw t JOIN ww x ON x.symbol = t.symbol AND x."interval" = t."interval" AND x.w = t.w
  LEFT JOIN best b1 ON b1.symbol = t.symbol AND b1."interval" = t."interval" AND b1.n = x.known
  LEFT JOIN (SELECT s.symbol, s."interval", b.p FROM (SELECT {by}, least({SPANS[1]}, count(*)) AS n FROM series GROUP BY ALL) s
    JOIN best b ON b.symbol = s.symbol AND b."interval" = s."interval" AND b.n = s.n) b2 ON b2.symbol = t.symbol AND b2."interval" = t."interval"),
wf AS (
  SELECT {by}, {TRAIN - 1}::BIGINT AS rn, -1 AS w, -1::BIGINT AS srn, -1::BIGINT AS last_srn, 1000.0::DOUBLE AS B,
    0.0::DOUBLE AS risk, 0 AS pos, 0.0::DOUBLE AS ep, 0.0::DOUBLE AS qty, 1000.0::DOUBLE AS bal,
    0.0::DOUBLE AS pw, 0 AS n, 0 AS nwin, false AS stop, CAST(NULL AS TIMESTAMP) AS wstart,
    CAST(NULL AS BIGINT) AS p, CAST(NULL AS BIGINT) AS pn, {SPANS[0]} AS span
  FROM (SELECT DISTINCT {by} FROM bars2)
  UNION ALL
  SELECT {by}, rn, w, srn, last_srn, Bn, riskn, posn, epn, qn, baln, pwn, nn, winn, stopn, wstart, pc,
    CASE WHEN pc IS NULL THEN NULL WHEN srn < last_srn THEN pc
         WHEN baln < 900 OR nn = 0 OR winn / nn < 0.4 THEN best_n ELSE pc END, spanc
  FROM (SELECT *, CASE WHEN auto THEN 0 ELSE p1 END AS posn, CASE WHEN auto THEN 0.0 ELSE ep1 END AS epn, CASE WHEN auto THEN 0.0 ELSE q1 END AS qn,
    bal1 + CASE WHEN auto THEN apnl ELSE 0 END AS baln, pw1 + CASE WHEN auto THEN apnl ELSE 0 END AS pwn,
    n1 + CAST(auto AS INT) AS nn, w1 + CAST(auto AND apnl > 0 AS INT) AS winn
  FROM (SELECT *, srn = last_srn AND p1 <> 0 AND q1 > 0 AS auto, p1*(close - ep1)*q1 - close*q1*{fee} AS apnl FROM (
  SELECT *, CASE WHEN closed THEN 0 WHEN opened AND le THEN 1 WHEN opened THEN -1 ELSE p0 END AS p1,
    CASE WHEN closed THEN 0.0 WHEN opened THEN close ELSE ep0 END AS ep1,
    CASE WHEN closed THEN 0.0 WHEN opened THEN nq ELSE q0 END AS q1,
    CASE WHEN closed THEN bal0 + pnl WHEN opened THEN bal0 - nq*close*{fee} ELSE bal0 END AS bal1,
    pw0 + CASE WHEN closed THEN pnl ELSE 0 END AS pw1, n0 + CAST(closed AS INT) AS n1,
    w0 + CAST(closed AND pnl > 0 AS INT) AS w1 FROM (
  SELECT *, x IS NOT NULL AS closed, p0*(x - ep0)*q0 - x*q0*{fee} AS pnl, p0 = 0 AND (le OR se) AS opened,
    CASE WHEN close > 0 THEN bal0*{k}/close ELSE 0 END AS nq FROM (
  SELECT *, {_le('pc', 0)} AS le, {_le('pc', 1)} AS se,
    CASE WHEN p0 = 1 AND high >= ep0*(1+{tp}) THEN ep0*(1+{tp})
         WHEN p0 = -1 AND low <= ep0*(1-{tp}) THEN ep0*(1-{tp})
         WHEN p0 = 1 AND low <= ep0*(1-{sl}) THEN least(open, ep0*(1-{sl}))
         WHEN p0 = -1 AND high >= ep0*(1+{sl}) THEN greatest(open, ep0*(1+{sl})) END AS x FROM (
  SELECT *, Bn < 500 AND srn = 0 AS stopn,
    CASE WHEN srn = 0 THEN (CASE WHEN Bn <= 0 THEN 0.2 ELSE least(greatest(0.05*1000/Bn, 0.01), 0.2) END)
         ELSE risk_p END AS riskn,
    CASE WHEN srn <> 0 THEN pc_p WHEN pn_p IS NOT NULL THEN pn_p WHEN best_n IS NOT NULL THEN best_n
         WHEN span_p < {SPANS[1]} THEN best_w END AS pc,
    CASE WHEN srn <> 0 OR pn_p IS NOT NULL OR best_n IS NOT NULL THEN span_p WHEN span_p < {SPANS[1]} AND best_w IS NOT NULL THEN {SPANS[1]}
         ELSE {SPANS[0]} END AS spanc,
    CASE WHEN srn = 0 THEN 0 ELSE pos_p END AS p0, CASE WHEN srn = 0 THEN 0.0 ELSE ep_p END AS ep0,
    CASE WHEN srn = 0 THEN 0.0 ELSE q_p END AS q0, CASE WHEN srn = 0 THEN Bn ELSE bal_p END AS bal0,
    CASE WHEN srn = 0 THEN 0.0 ELSE pw_p END AS pw0, CASE WHEN srn = 0 THEN 0 ELSE n_p END AS n0,
    CASE WHEN srn = 0 THEN 0 ELSE w_p END AS w0 FROM (
  SELECT *, CASE WHEN srn = 0 THEN (CASE WHEN w = 0 THEN 1000.0 ELSE B_p + pw_p END) ELSE B_p END AS Bn FROM (
  SELECT b.*, s.B AS B_p, s.pw AS pw_p, s.risk AS risk_p, s.pos AS pos_p, s.ep AS ep_p, s.qty AS q_p,
    s.bal AS bal_p, s.n AS n_p, s.nwin AS w_p, s.p AS pc_p, s.pn AS pn_p, s.span AS span_p
  FROM wf s JOIN bars2 b ON b.symbol = s.symbol AND b."interval" = s."interval" AND b.rn = s.rn + 1
  WHERE NOT s.stop) t0) t1) t2) t3) t4) t5) t6) t7),
runs AS (SELECT {by}, w AS window_id, strftime(wstart, '%Y-%m-%d') AS date, p AS param_id, risk AS risk_pct, pw AS pnl,
    n AS total_trades, CASE WHEN n > 0 THEN nwin / n ELSE 0 END AS winrate, B + pw AS balance, bal AS final_state_balance
  FROM wf WHERE w >= 0 AND srn = last_srn AND NOT stop AND B + pw >= 500 AND p IS NOT NULL)
{select}"""


G11_SQL = _waves_sql(f"""SELECT symbol, "interval", CAST(window_id AS BIGINT) AS window_id, date, CAST(param_id AS BIGINT) AS param_id, {_rs('risk_pct')} AS risk_pct,
  {_rs('pnl')} AS pnl, CAST(total_trades AS BIGINT) AS total_trades, {_rs('winrate')} AS winrate, {_rs('balance')} AS balance,
  {_rs('final_state_balance')} AS final_state_balance, (final_state_balance < 900 OR total_trades = 0 OR winrate < 0.4) AS triggered_restart FROM runs""")


@query("g11_retune_waves", G11_SQL)
def g11_retune_waves(spark, sf_dir):
    """Run rows of a walk-forward that is tuned again after every restart, with the setting of each window."""
    runs, _ = waves(spark, sf_dir)
    return rounded(runs.select(*SEG, "window_id", "date", "param_id", "risk_pct", "pnl", "total_trades", "winrate", "balance",
                               "final_state_balance", "triggered_restart"))
