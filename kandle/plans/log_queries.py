"""Registered queries: run rows with their trades (G12, S06, J03), file round trips (S08-S11), binned relevance (A07), logged
parameters (P11), training update (U02, P01), further feeds (W29, W20)."""
from __future__ import annotations

from pyspark.sql import functions as F

from kandle.operators import reports as R, walkforward as WF
from kandle.operators.indicators import indicator_table, smart_rsi_mean
from kandle.operators.interval_join import run_trades
from kandle.operators.layout import KEYS
from kandle.operators.replay import DEFAULTS, trade_legs
from kandle.operators.signals import signal_table
from kandle.plans.common import BARS_SQL, SERIES_SQL, events_bars, rounded, rounded_sig, sig_round_sql as _rs
from kandle.plans.misc_queries import _RUNS_SQL, _runs
from kandle.plans.more import LEGS_SQL, SEG, VB_PARAMS, VB_SCORED_SQL, VB_TRADE, WF_TRAIN, _anchors_sql, _scored, _wf_sql, backtest
from kandle.plans.oracle_ind import indicator_sql
from kandle.plans.queries import query
from kandle.sources import bars as SB, runs as SR
from kandle.sources.scratch import materialize, scratch_path
from kandle.sources.tables import table


def _session(c="symbol"):
    return F.md5(F.col(c))


# ---------------------------------------------------------------- J03
_J03_SQL = LEGS_SQL[:LEGS_SQL.rindex("SELECT l.symbol")].rstrip() + f""",
{_anchors_sql(WF_TRAIN)},
r AS (SELECT s.symbol, s."interval", a.w, min(s.ts) AS window_start, max(s.ts) AS window_end FROM series s JOIN a ON s.rn >= {WF_TRAIN}
  AND s.symbol = a.symbol AND s."interval" = a."interval" AND s.ts_ms > a.anchor AND s.ts_ms <= a.anchor + 49*1800000 GROUP BY ALL)
SELECT md5(r.symbol) AS session_uuid, r.symbol, CAST(r.w AS BIGINT) AS window_id, t.ts AS timestamp, t.action, {_rs('t.price')} AS price
FROM r LEFT JOIN (SELECT l.symbol, l."interval", l.action, l.price, s.ts FROM legs l JOIN series s ON s.symbol = l.symbol AND s."interval" = l."interval"
  AND s.rn = l.rn) t ON t.symbol = r.symbol AND t."interval" = r."interval" AND t.ts >= r.window_start AND t.ts <= r.window_end"""


@query("j03_run_trades", _J03_SQL)
def j03_run_trades(spark, sf_dir):
    """Each series' test windows as runs, the trade legs of a replay as trades; windows without a trade are kept."""
    sc, tr = backtest(spark, sf_dir, VB_PARAMS, VB_TRADE)
    legs = trade_legs(tr, SEG).join(sc.select(*SEG, "srn", "ts"), [*SEG, "srn"])
    trades = legs.select(_session().alias("session_uuid"), "symbol", F.col("ts").alias("timestamp"), "action", "price")
    win = WF.assign_windows(sc.select(*SEG, "ts", "ts_ms"), WF_TRAIN).where("window_id >= 0")
    runs = win.groupBy(_session().alias("session_uuid"), "symbol", "window_id").agg(F.min("ts").alias("window_start"), F.max("ts").alias("window_end"))
    return rounded_sig(run_trades(runs, trades, "left").select("session_uuid", "symbol", "window_id", "timestamp", "action", "price"))


# ---------------------------------------------------------------- G12, S06
#: wide barriers and small sizes, so that accounts last for many windows of these bars
TRADE = {"tp_pct": 1.5, "sl_pct": 0.99, "leverage": 0.1}
G12_SQL = _wf_sql(f"""SELECT md5(symbol) AS session_uuid, symbol, "interval", date, {_rs('pnl')} AS pnl, {_rs('-winrate')} AS loss, {_rs('balance')} AS balance,
  CAST(total_trades AS BIGINT) AS total_trades, pnl <= 0 AS retrained, CAST(2 * total_trades AS BIGINT) AS n_legs, CAST(total_trades AS BIGINT) AS n_opens,
  {_rs('pnl')} AS pnl_of_legs FROM runs""", TRADE, VB_SCORED_SQL)


@query("g12_run_rows", G12_SQL)
def g12_run_rows(spark, sf_dir):
    """G12 + S06: run rows and trades written, written again, and read back with each run's trades as a list."""
    bars = events_bars(spark, sf_dir)
    sc = materialize(_scored(spark, sf_dir, VB_PARAMS).withColumnRenamed("srn", "rn"), "scored")
    runs, legs = WF.walk_forward_log(bars, sc, train_bars=WF_TRAIN, params=TRADE)
    none = F.lit("{}")
    runs = runs.withColumns({"session_uuid": _session(), "params": none, "best_params": none, "window_start": F.col("test_start")})
    legs = legs.withColumn("session_uuid", _session())
    path = scratch_path(spark, "run-log")
    for _ in range(2):  # a session that is written again is replaced, not doubled
        SR.save_model_runs(runs.drop("sizes"), legs, path)
    back = SR.load_runs_with_trades(spark, path)
    side = "(CASE WHEN t.side = 'long' THEN 1 ELSE -1 END)"
    # money of the closing legs: side * (exit - entry) * qty - fee, entry and exit alternate in the list
    gains = F.expr(f"""aggregate(trades, named_struct('p', 0D, 's', 0D), (a, t) -> CASE WHEN t.action LIKE 'OPEN%' THEN named_struct('p', t.price, 's', a.s)
        ELSE named_struct('p', 0D, 's', a.s + {side} * (t.price - a.p) * t.qty - t.price * t.qty * {DEFAULTS['fee']}D) END, a -> a.s)""")
    return rounded_sig(back.select(
        "session_uuid", "symbol", "interval", "date", "pnl", "loss", "balance", "total_trades", "retrained", F.size("trades").cast("bigint").alias("n_legs"),
        F.size(F.filter("trades", lambda t: t["action"].startswith("OPEN"))).cast("bigint").alias("n_opens"), gains.alias("pnl_of_legs")))


# ---------------------------------------------------------------- S08-S11
_LEGS_BODY = LEGS_SQL[:LEGS_SQL.rindex("SELECT l.symbol")]


def _legs(spark, sf_dir):
    sc, tr = backtest(spark, sf_dir, VB_PARAMS, VB_TRADE)
    return trade_legs(tr, SEG).join(sc.select(*SEG, "srn", "ts"), [*SEG, "srn"])


@query("s08_trades_csv", _LEGS_BODY + f"""SELECT l.symbol, s.ts AS timestamp, l.action, {_rs('l.price')} AS price, {_rs('l.pnl')} AS pnl
FROM legs l JOIN series s ON s.symbol = l.symbol AND s."interval" = l."interval" AND s.rn = l.rn""")
def s08_trades_csv(spark, sf_dir):
    """The trade log as a CSV folder per symbol, written twice, and read back."""
    legs = materialize(_legs(spark, sf_dir).select("symbol", F.col("ts").alias("timestamp"), "action", "price", "pnl"), "legs")
    path = scratch_path(spark, "trades-csv")
    for _ in range(2):
        SR.write_trades_csv(legs, path)
    return rounded_sig(SR.read_trades_csv(spark, path))


@query("s09_equity_csv", _wf_sql(f"""SELECT date AS timestamp, symbol, {_rs('1000 + sum(pnl) OVER (PARTITION BY symbol, "interval" ORDER BY window_id ROWS UNBOUNDED PRECEDING)')} AS balance
  FROM runs"""))
def s09_equity_csv(spark, sf_dir):
    """The equity log (timestamp, balance) as CSV, and read back."""
    sc = materialize(_scored(spark, sf_dir).withColumnRenamed("srn", "rn"), "scored")
    runs = WF.walk_forward(events_bars(spark, sf_dir), sc, train_bars=WF_TRAIN)
    path = scratch_path(spark, "equity-csv")
    SR.write_equity_csv(WF.equity_curve(runs).select(F.col("date").alias("timestamp"), "symbol", F.col("equity").alias("balance")), path)
    return rounded_sig(spark.read.option("header", True).schema("timestamp string, symbol string, balance double").csv(path))


@query("s10_config_symbols", """SELECT DISTINCT event_type AS symbol FROM events""")
def s10_config_symbols(spark, sf_dir):
    """A JSON config that lists the symbols of the events, written and read."""
    path = scratch_path(spark, "config")
    names = table(spark, sf_dir, "events").select("event_type").distinct()
    names.agg(F.sort_array(F.collect_list("event_type")).alias("symbols")).write.json(path)  # a config's few symbols
    return SR.symbols_from_config(spark, path)


@query("s11_ticker_symbols", """SELECT CAST(user_id AS VARCHAR) || 'USDT' AS symbol FROM events WHERE event_id % 5 <> 0 AND event_id % 7 <> 0""")
def s11_ticker_symbols(spark, sf_dir):
    """Landed ticker responses made of the events: a fifth failed (retCode 1), a seventh are no JSON at all."""
    e = table(spark, sf_dir, "events")
    name = F.concat(F.col("user_id").cast("string"), F.lit("USDT"))
    body = F.to_json(F.struct(F.when(F.col("event_id") % 5 == 0, 1).otherwise(0).alias("retCode"),
                              F.struct(F.array(F.struct(name.alias("symbol"))).alias("list")).alias("result")))
    return SR.symbols_from_tickers(e.select(F.when(F.col("event_id") % 7 == 0, F.lit("<html>")).otherwise(body).alias("body")))


# ---------------------------------------------------------------- A07 with continuous features
_BINS = 16
_CONT = ["range", "volume", "body", "close"]


@query("a07_binned_relevance", f"""WITH {BARS_SQL},
f AS (SELECT high - low AS range, volume, (close - open) / nullif(open, 0) AS body, close, dayofweek(ts) AS weekday,
  CAST(coalesce(lead(close) OVER (PARTITION BY symbol, "interval" ORDER BY ts) > close, false) AS INT) AS y FROM bars),
d AS (SELECT * FROM f WHERE body IS NOT NULL),
b AS ({" UNION ALL ".join(f"SELECT '{c}' AS feature, CAST((rank() OVER (ORDER BY {c}) - 1) * {_BINS} // count(*) OVER () AS VARCHAR) AS x, y FROM d" for c in _CONT)}
  UNION ALL SELECT 'weekday', CAST(weekday + 1 AS VARCHAR), y FROM d),
c AS (SELECT feature, x, y, count(*) AS c FROM b GROUP BY ALL),
m AS (SELECT *, sum(c) OVER (PARTITION BY feature) AS n, sum(c) OVER (PARTITION BY feature, x) AS cx, sum(c) OVER (PARTITION BY feature, y) AS cy FROM c),
mi AS (SELECT feature, sum(c/n * ln(c*n/(cx*cy))) AS importance FROM m GROUP BY feature)
SELECT feature, round(importance, 6) AS importance, row_number() OVER (ORDER BY importance DESC, feature) AS rank FROM mi""")
def a07_binned_relevance(spark, sf_dir):
    """A07 with continuous features (quantile bins, ties together) and a discrete one against the direction of the next bar."""
    from kandle.operators.layout import on_layout
    bars = events_bars(spark, sf_dir)
    # the next bar's close by looking back from it
    nxt = on_layout(bars.select(*KEYS, "ts", "close"), lambda d, w: d.withColumn("_pt", F.lag("ts").over(w)), KEYS, look_back=1)
    nxt = nxt.where("_pt IS NOT NULL").select(*KEYS, F.col("_pt").alias("ts"), F.col("close").alias("_next"))
    f = bars.join(nxt, [*KEYS, "ts"], "left").select(
        (F.col("high") - F.col("low")).alias("range"), "volume", F.try_divide(F.col("close") - F.col("open"), F.col("open")).alias("body"), "close",
        F.dayofweek("ts").alias("weekday"), F.coalesce(F.col("_next") > F.col("close"), F.lit(False)).cast("int").alias("y"))
    mi = R.mutual_information(f, [*_CONT, "weekday"], "y", bins=_BINS)
    return rounded(mi.withColumn("rank", F.col("rank").cast("bigint")))


# ---------------------------------------------------------------- P11, P01, U02
@query("p11_logged_params", f"""WITH {_RUNS_SQL} SELECT session_uuid, symbol, date,
  CASE WHEN symbol = 'error' THEN '{{}}' ELSE '{{"enabled_long_signals": ["' || symbol || '"], "enabled_short_signals": [], "k": '
    || CAST(json_extract_string(best_params, '$.k') AS BIGINT) || '}}' END AS params FROM runs""")
def p11_logged_params(spark, sf_dir):
    """Parameters as logged: numbers normalised, signal lists attached; no parameters (here: of errors) give {}."""
    r = _runs(spark, sf_dir).withColumn("_p", F.from_json("best_params", "map<string,string>"))
    p = F.when(F.col("symbol") != "error", F.transform_values("_p", lambda k, v: F.concat(v, F.lit(".0"))))
    return r.select("session_uuid", "symbol", "date", R.logged_params(p, F.array("symbol"), F.lit(None).cast("array<string>")).alias("params"))


@query("p01_base_columns", f"""WITH {BARS_SQL} SELECT symbol, "interval", ts, ts_ms, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low,
  round(close, 6) AS close, round(volume, 6) AS volume FROM bars""")
def p01_base_columns(spark, sf_dir):
    """A signal table without its indicators and flags is the bars again."""
    return rounded(SB.base_columns(signal_table(events_bars(spark, sf_dir))))


@query("u02_train_update", f"""WITH RECURSIVE {SERIES_SQL}, {_anchors_sql(WF_TRAIN)}
SELECT s.symbol, s."interval", s.ts, s.ts_ms, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close,
  round(volume, 6) AS volume FROM series s JOIN a ON a.symbol = s.symbol AND a."interval" = s."interval" AND a.w = 1
WHERE s.ts_ms <= a.anchor + 49*1800000""")
def u02_train_update(spark, sf_dir):
    """Training rows after the second test window; the training rows before it overlap it by half a window."""
    sig = materialize(signal_table(events_bars(spark, sf_dir)), "signals")
    win = materialize(WF.assign_windows(sig.select(*KEYS, "ts", "ts_ms"), WF_TRAIN), "windows").drop("ts_ms")
    test = sig.join(win.where("window_id = 1"), [*KEYS, "ts"]).drop("window_id")
    most = test.groupBy(*KEYS).agg(F.floor(F.avg("rn")).alias("_most"))
    train = sig.join(most, KEYS).where("rn <= _most").drop("_most")
    return rounded(WF.update_training(train, test))


# ---------------------------------------------------------------- W29, W20
@query("w29_bollinger_feed", indicator_sql() + f""",
e0 AS (SELECT *, count(close) OVER w20 AS bb_n, avg(close) OVER w20 AS bb_mid, stddev_pop(close) OVER w20 AS bb_sd FROM ind
  WINDOW w20 AS (PARTITION BY symbol, "interval" ORDER BY ts ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))
SELECT symbol, "interval", ts, round(close, 6) AS close, round(EMA_9, 6) AS EMA_9, round(EMA_21, 6) AS EMA_21, round(EMA_100, 6) AS EMA_100,
  round(EMA_200, 6) AS EMA_200, round(CASE WHEN bb_n >= 20 THEN bb_mid - 2.0*bb_sd END, 6) AS BBL, round(CASE WHEN bb_n >= 20 THEN bb_mid + 2.0*bb_sd END, 6) AS BBU FROM e0""")
def w29_bollinger_feed(spark, sf_dir):
    """The price panel with its four averages and the Bollinger band."""
    df = indicator_table(events_bars(spark, sf_dir), supertrend=False)
    return rounded(df.select(*KEYS, "ts", "close", "EMA_9", "EMA_21", "EMA_100", "EMA_200", "BBL", "BBU"))


@query("w20_smart_rsi_mean", indicator_sql() + """,
p0 AS (SELECT *, lag(close) OVER s AS pc2, tr50 - lag(tr50) OVER s AS sl FROM (SELECT *, ewm50 AS tr50 FROM ind) q WINDOW s AS (PARTITION BY symbol, "interval" ORDER BY ts)),
p1 AS (SELECT *, coalesce(greatest(close - pc2, 0), 0) * volume AS g, coalesce(greatest(pc2 - close, 0), 0) * volume AS l FROM p0),
p2 AS (SELECT *, count(g) OVER s AS n, avg(g) OVER s AS ag, avg(l) OVER s AS al FROM p1
  WINDOW s AS (PARTITION BY symbol, "interval" ORDER BY ts ROWS BETWEEN 13 PRECEDING AND CURRENT ROW))
SELECT symbol, "interval", ts, round(CASE WHEN n >= 14 THEN least(greatest(100 - 100/(1 + ag/(al + 1e-9))
  + CASE WHEN sl > 0 THEN 2 WHEN sl < 0 THEN -2 ELSE 0 END, 0), 100) END, 6) AS SMART_RSI_MEAN FROM p2""")
def w20_smart_rsi_mean(spark, sf_dir):
    """W20 with plain 14-row means."""
    df = indicator_table(events_bars(spark, sf_dir), supertrend=False, extra=smart_rsi_mean)
    return rounded(df.select(*KEYS, "ts", "SMART_RSI_MEAN"))
