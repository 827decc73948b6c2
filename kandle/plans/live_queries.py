"""Registered queries: live merge and tick bars (batch forms), carried positions, closed legs, gap plan, daily
bars of many series, window estimates."""
from __future__ import annotations

from pyspark.sql import functions as F

from kandle.operators import tuning as TU
from kandle.operators.indicators import indicator_table
from kandle.operators.layout import KEYS
from kandle.operators.replay import closed_legs, final_state, replay, trade_legs
from kandle.plans.common import BARS_SQL, events_bars, rounded, rounded_sig
from kandle.plans.more import LEGS_SQL, SEG, VB_PARAMS, VB_TRADE, _scored, backtest
from kandle.plans.queries import query
from kandle.plans.tune_queries import SEED, _USER_PARAMS_SQL, user_ids
from kandle.session import tune
from kandle.sources.bars import gap_plan, user_daily_bars
from kandle.sources.scratch import materialize
from kandle.sources.tables import table
from kandle.streaming import live

# 60, 80 and 90 % of a series' time
_SPAN_SQL = """, x AS (SELECT symbol, "interval", min(ts_ms) AS t0, max(ts_ms) - min(ts_ms) AS d FROM bars GROUP BY ALL),
c AS (SELECT bars.*, (ts_ms - t0) * 10 AS t, d FROM bars JOIN x USING (symbol, "interval"))"""


def _cut(bars):
    span = bars.groupBy(*KEYS).agg(F.min("ts_ms").alias("_t0"), (F.max("ts_ms") - F.min("ts_ms")).alias("d"))
    return bars.join(span, KEYS).withColumn("t", (F.col("ts_ms") - F.col("_t0")) * 10).drop("_t0")


@query("d03_merge_live", f"""WITH {BARS_SQL}{_SPAN_SQL},
stored AS (SELECT * FROM c WHERE t < 8 * d),
l AS (SELECT symbol, "interval", max(ts_ms) AS last_ms FROM stored GROUP BY ALL)
SELECT symbol, "interval", ts, round(close, 6) AS close FROM stored
UNION ALL SELECT c.symbol, c."interval", c.ts, round(c.close, 6) FROM c JOIN l USING (symbol, "interval")
WHERE c.t >= 6 * c.d AND c.ts_ms > last_ms""")
def d03_merge_live(spark, sf_dir):
    """Stored: the first 80 % of each series' time. Live: messages of the last 40 %, some of them twice."""
    bars = _cut(events_bars(spark, sf_dir))
    stored = live.parse_messages(live.messages_from_bars(bars.where("t < 8 * d")))
    batch = live.parse_messages(live.messages_from_bars(bars.where("t >= 6 * d")))
    batch = batch.unionByName(live.parse_messages(live.messages_from_bars(bars.where("t >= 9 * d"))))
    merged = stored.unionByName(live.live_rows(stored, batch))
    return rounded(merged.select(*KEYS, "ts", "close"))


@query("d06_tick_bars", f"WITH {BARS_SQL} SELECT symbol, \"interval\", ts, round(open, 6) AS open, round(high, 6) AS high, "
                        "round(low, 6) AS low, round(close, 6) AS close, round(volume, 6) AS volume FROM bars")
def d06_tick_bars(spark, sf_dir):
    tune(spark)
    ticks = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("price"), F.col("value").alias("qty"))
    return rounded(live.stream_bars(spark, ticks).drop("ts_ms"))


# exit legs of the whole run: a run cut in two, its state carried over, must make the same ones
@query("b06_carry_position", f"""SELECT symbol, "interval", action, ts, price, side_name FROM ({LEGS_SQL}) WHERE action NOT LIKE 'OPEN%'""")
def b06_carry_position(spark, sf_dir):
    sc = _scored(spark, sf_dir, VB_PARAMS).withColumns({k: F.lit(v) for k, v in VB_TRADE.items()})
    sc = materialize(sc, "carry-scored")
    sc = materialize(sc.join(sc.groupBy(*SEG).agg(F.floor(F.max("srn") / 2).alias("half")), SEG), "carry-bars")
    first = sc.where("srn < half")
    tr1 = replay(first, first, SEG, finalize=False)
    state = materialize(final_state(tr1, first.select(*SEG, "initial_balance").distinct(), SEG), "carry-state")
    second = (sc.where("srn >= half").withColumn("srn", F.col("srn") - F.col("half")).drop("initial_balance")
              .join(state.select(*SEG, F.col("balance").alias("initial_balance")), SEG))
    tr2 = replay(second, second, SEG, open_positions=state)
    ts = sc.select(*SEG, "srn", "ts", "half")
    a = trade_legs(tr1, SEG).where("leg = 1").join(ts, [*SEG, "srn"])
    b = trade_legs(tr2, SEG).where("leg = 1").join(ts.where("srn >= half").withColumn("srn", F.col("srn") - F.col("half")), [*SEG, "srn"])
    return rounded_sig(a.unionByName(b).select(*SEG, "action", "ts", "price", "side_name"))


@query("p04_closed_legs", f"""SELECT symbol, "interval", trade_no, action, pnl FROM ({LEGS_SQL}) WHERE action IN
  ('CLOSE LONG', 'CLOSE SHORT', 'TP CLOSE LONG', 'TP CLOSE SHORT', 'SL CLOSE LONG', 'SL CLOSE SHORT', 'AUTO SELL', 'AUTO COVER')""")
def p04_closed_legs(spark, sf_dir):
    _, tr = backtest(spark, sf_dir, VB_PARAMS, VB_TRADE)
    return rounded_sig(closed_legs(trade_legs(tr, SEG)).select(*SEG, "trade_no", "action", "pnl"))


@query("s13_gap_plan", f"""WITH {BARS_SQL}, g AS (SELECT symbol, "interval", ts_ms,
    lag(ts_ms) OVER (PARTITION BY symbol, "interval" ORDER BY ts) AS p FROM bars),
m AS (SELECT *, unnest(range(p + 1800000, ts_ms, 1800000)) AS missing FROM g WHERE ts_ms - p > 1800000),
b AS (SELECT *, (missing - p) // 1800000 - 1 AS k FROM m)
SELECT symbol, "interval", CAST(min(missing) AS BIGINT) AS start_ms, CAST(max(missing) AS BIGINT) AS end_ms
FROM b GROUP BY symbol, "interval", p, k // 2""")
def s13_gap_plan(spark, sf_dir):
    """Batches of at most two candles, so that longer gaps need several."""
    return gap_plan(events_bars(spark, sf_dir), batch=2)


@query("w03_volume_sma_daily", """WITH bars AS (
  SELECT CAST(user_id AS VARCHAR) AS symbol, 'D' AS "interval", date_trunc('day', ts) AS ts, sum(value) AS volume FROM events GROUP BY ALL)
SELECT symbol, "interval", CAST(ts AS TIMESTAMP) AS ts, round(avg(volume) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), 6) AS Volume_SMA_20
FROM bars""")
def w03_volume_sma_daily(spark, sf_dir):
    """W03 over many short series of interval D."""
    tune(spark)
    df = indicator_table(user_daily_bars(table(spark, sf_dir, "events")), supertrend=False)
    return rounded(df.select(*KEYS, "ts", "Volume_SMA_20"))


@query("p12_window_estimate", f"""WITH p AS ({_USER_PARAMS_SQL}),
k AS (SELECT * FROM (VALUES ('rsi', 14), ('macd', 26), ('mfi', 14), ('cci', 20), ('stochrsi', 14), ('tema_cross', 21),
  ('ema_cross', 200), ('trend', 50), ('donchian', 20), ('roc', 12), ('volspike', 20), ('volume', 20)) t(name, period)),
l AS (SELECT param_id, replace(name, 'w_', '') AS name, w FROM (SELECT param_id, COLUMNS('w_.*') FROM p)
      UNPIVOT (w FOR name IN (COLUMNS('w_.*')))),
b AS (SELECT param_id, sum(period * w) / sum(w) AS base FROM l JOIN k USING (name) WHERE w > 0 GROUP BY param_id)
SELECT p.param_id, CAST(CASE WHEN base IS NULL THEN 300 ELSE least(greatest(floor(base * 8
  + CASE WHEN w_ema_cross >= 2 THEN 150 ELSE 0 END + CASE WHEN w_trend >= 2 THEN 100 ELSE 0 END), 300), 2000) END AS BIGINT) AS window_size
FROM p LEFT JOIN b USING (param_id)""")
def p12_window_estimate(spark, sf_dir):
    """P12 for a trial of each user."""
    return TU.window_estimate(TU.param_rows(user_ids(spark, sf_dir), SEED))
